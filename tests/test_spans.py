"""Hot keys as chains of spans: the same results as in one task, and no task with more than its span."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.model import Rate
from sluice.operators import actions, campaigns, dedup, fold, gates, routing

T0 = datetime(2024, 1, 1)


@pytest.fixture
def spans(monkeypatch):
    """Spans of 40 rows."""
    monkeypatch.setattr(fold, "SPAN_ROWS", 40)


def rows(spark, n=600):
    dice = random.Random(5)
    own = [(i, dice.choice(["hot", "hot", "hot", None, "cold"]) if i % 50 else f"k{i}", dice.randrange(25), T0 + timedelta(milliseconds=dice.randrange(4000)), dice.randrange(100)) for i in range(n)]
    return spark.createDataFrame(own, "n long, key string, user long, ts timestamp, k long").withColumn("note", F.concat(F.lit("x"), "n"))


def both(monkeypatch, make):
    """What make() gives in spans, and in one task a key."""
    chained = sorted(map(str, make().collect()))
    monkeypatch.setattr(fold, "SPAN_ROWS", 10**9)
    return chained, sorted(map(str, make().collect()))


CASES = {
    "acquire": lambda ev: actions.acquire(ev.select(F.col("key").alias("service"), F.col("n").alias("request_id"), F.col("ts").alias("created_at")), {"hot": Rate(20, 9.5)}),
    "rate_limited": lambda ev: actions.rate_limited(ev.select(F.col("key").alias("service"), F.col("n").alias("request_id"), F.col("ts").alias("created_at")), {"hot": Rate(3, 7.5)}),
    "admit": lambda ev: routing.admit(ev.withColumn("start_ms", F.unix_millis("ts")).withColumn("end_ms", F.col("start_ms") + F.col("k")), 2, ["key"], ["start_ms", "n"]),
    "lru": lambda ev: dedup.lru_cached(ev, 10, 500, ("ts", "n"), ("user",)),
    "lru_shards": lambda ev: dedup.lru_cached(ev, 12, 500, ("ts", "n"), ("user",), shards=3),
    "replay": lambda ev: campaigns.replay(ev.select(F.col("key").alias("campaign_id"), F.col("n").alias("seq"), F.element_at(F.array(F.lit("ACTIVE"), F.lit("PAUSED")), (F.col("k") % 2 + 1).cast("int")).alias("to_status"))),
    "consume": lambda ev: gates.consume(ev.select(F.col("key").alias("campaign_id"), F.col("k").alias("amount"), F.col("n").alias("seq")), ev.sparkSession.createDataFrame([("hot", 900, 0), ("hot", 333, 300)], "campaign_id string, budget long, seq long")),
}


@pytest.mark.parametrize("name", CASES)
def test_spans_change_nothing(spark, spans, monkeypatch, name):
    ev = rows(spark)
    chained, alone = both(monkeypatch, lambda: CASES[name](ev))
    assert chained == alone and len(chained) == 600


def test_no_task_takes_more_than_a_span(spark, spans):
    ev = rows(spark)

    def step(taken, _row):
        import pyspark

        at = pyspark.TaskContext.get().taskAttemptId()
        return taken, str(at)

    out = fold.ordered_fold(ev, ["key"], ["ts", "n"], lambda: None, step, ["n"], "task string", spans=True)
    hot = out.filter("key = 'hot'").groupBy("task").count().collect()
    assert sum(r["count"] for r in hot) > 200 and max(r["count"] for r in hot) <= 3 * fold.SPAN_ROWS
