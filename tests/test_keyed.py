from datetime import datetime, timedelta

import pytest

from sluice.model import Rate
from sluice.operators import actions
from sluice.streaming import keyed

T0 = datetime(2025, 1, 15, 10)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, keyed.PROVIDER)
    yield spark
    spark.conf.unset(key)


def run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_token_buckets_across_batches(rocks, tmp_path):
    rows = rocks.createDataFrame([(f"r{i:03}", "ab"[i % 2], T0 + timedelta(milliseconds=40 * i)) for i in range(60)], "request_id string, service string, created_at timestamp")
    for i in range(3):
        rows.filter(f"substring(request_id, 2) >= '{20 * i:03}' AND substring(request_id, 2) < '{20 * i + 20:03}'").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    rates = {"a": Rate(3, 2.0), "b": Rate(5, 20.0)}
    got = {r["request_id"]: r["allowed"] for r in run(rocks, keyed.rate_limited(stream, rates), "buckets")}
    want = {r["request_id"]: r["allowed"] for r in actions.rate_limited(rows, rates).collect()}
    assert got == want and 0 < sum(got.values()) < 60


def test_delays_fire_when_the_watermark_passes(rocks, tmp_path):
    rows = rocks.createDataFrame([("k", f"t{i}", T0 + timedelta(seconds=i), 2500 if i % 2 else 0) for i in range(12)], "key string, id string, ts timestamp, delay_ms long")
    for i in range(3):
        rows.filter(f"cast(substring(id, 2) as int) div 4 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = rocks.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = run(rocks, keyed.delayed(stream), "delays")
    base = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)
    fired = {r["id"]: r["fired_ms"] - base for r in got}
    assert all(fired[f"t{i}"] == 1000 * i for i in range(0, 12, 2)) and len(got) == len(fired)
    assert fired["t1"] == 3500 and all(fired[k] == 1000 * int(k[1:]) + 2500 for k in fired if int(k[1:]) % 2)
