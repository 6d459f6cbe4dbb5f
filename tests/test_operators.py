import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice import queries
from sluice.functions import hashing
from sluice.functions.fields import Fields
from sluice.model import Action, And, Campaign, Leaf, Op, Rate, Retry
from sluice.operators import abtest, actions, bloom, campaigns, dedup, enrichment, gates, metrics, pipeline, routing, schedule
from sluice.sources.events import RecordingClient, SeenKeys, normalized
from sluice.streaming import log
from sluice.streaming.engine import Builder, Coordinator, deduplicated, windowed_counts

T0 = datetime(2025, 1, 15, 10)
RIDE = Leaf("country", Op.EQ, "vn")


def events(spark, rows):
    """(event_id, type, user, payload json, seconds)"""
    raw = spark.createDataFrame([(i, t, u, p, T0 + timedelta(seconds=s), "svc") for i, t, u, p, s in rows], "event_id string, event_type string, user_id string, payload string, ts timestamp, source_service string")
    return normalized(raw)[0]


def ride(i, user="u", payload='{"country":"VN"}', s=0):
    return (i, "RIDE", user, payload, s)


def run(spark, rows, *own):
    r = pipeline.run(events(spark, rows), own)
    return r.metrics().first().asDict(), r


SEND = (Action("SEND_MESSAGE", "notify", {"msg": "hello"}),)


def test_null_ids_are_set_aside(spark):
    raw = spark.createDataFrame([("a", "t", "u", None, None, None), (None, "t", "u", "{}", None, None), ("b", "t", None, "{", None, None)], "event_id string, event_type string, user_id string, payload string, ts timestamp, source_service string")
    good, bad = normalized(raw)
    assert [r["event_id"] for r in good.collect()] == ["a"] and bad.count() == 2
    assert good.select(F.to_json("payload").alias("p"), F.col("ts").isNotNull().alias("t")).first() == ("{}", True)


def test_ten_duplicates_act_once(spark):
    m, _ = run(spark, [ride("e", s=i) for i in range(10)], Campaign("c", "RIDE", RIDE, actions=SEND))
    assert (m["events_received"], m["duplicates_filtered"], m["events_processed"], m["actions_triggered"]) == (10, 9, 1, 1)


@pytest.mark.parametrize(("changes", "evaluated", "sent"), [({}, 5, 5), ({"budget": 3}, 3, 3), ({"budget": 0}, 0, 0), ({"status": "DRAFT"}, 0, 0), ({"start": "2025-01-15T11:00:00"}, 0, 0), ({"end": "2025-01-15T09:00:00"}, 0, 0), ({"max_per_user": 2}, 2, 2), ({"rule": Leaf("country", Op.EQ, "US")}, 5, 0), ({"actions": SEND * 2}, 5, 10)])
def test_gates_of_one_campaign(spark, changes, evaluated, sent):
    m, _ = run(spark, [ride(f"e{i}", s=i) for i in range(5)], Campaign("c", "RIDE", **({"rule": RIDE, "actions": SEND} | changes)))
    assert (m["rules_evaluated"], m["actions_triggered"]) == (evaluated, sent)


def test_only_triggered_campaigns_are_evaluated(spark):
    own = [Campaign(f"r{i}", "RIDE", RIDE, actions=SEND) for i in range(2)] + [Campaign(f"o{i}", "ORDER", RIDE, actions=SEND) for i in range(98)]
    m, r = run(spark, [ride("e"), ("x", "OTHER", "u", "{}", 1)], *own)
    assert (m["rules_evaluated"], m["rules_matched"], m["actions_triggered"], m["events_processed"]) == (2, 2, 2, 2)
    assert campaigns.unmatched(r.new, campaigns.campaign_table(spark, own)).count() == 1
    assert len({x["request_id"] for x in r.requests.collect()}) == 2


def test_written_stages_change_nothing(spark, tmp_path):
    rows = [ride(f"e{i}", user=f"u{i % 2}", s=i) for i in range(9)] + [ride("e1", s=20)]
    own = [Campaign("c", "RIDE", RIDE, budget=4, actions=SEND), Campaign("d", "RIDE", RIDE, max_per_user=2)]
    ev = events(spark, rows)
    plain, staged = pipeline.run(ev, own), pipeline.run(ev, own, stage=str(tmp_path))
    assert plain.metrics().first() == staged.metrics().first()
    assert sorted(r["request_id"] for r in plain.requests.collect()) == sorted(r["request_id"] for r in staged.requests.collect())


def simulate(rows, own):
    """The pipeline one event at a time."""
    left, uses, out = {c["id"]: c["budget"] for c in own}, {}, {}
    for e in rows:
        for c in own:
            if c["trigger"] != e["type"] or left[c["id"]] <= 0:
                continue
            key = (c["id"], e["user"])
            if uses.get(key, 0) >= c["max"]:
                continue
            uses[key] = uses.get(key, 0) + 1
            n = out.setdefault(c["id"], [0, 0])
            n[0] += 1
            if e["m"]:
                n[1] += 1
                if c["budget"] <= 100_000:
                    left[c["id"]] -= 1
    return {k: tuple(v) for k, v in out.items()}


def test_gates_equal_a_simulation(spark):
    rows = [{"id": i, "type": "ab"[i % 2], "user": f"u{i * 7 % 13}", "m": i * 31 % 10 < 6} for i in range(600)]
    own = [{"id": "x", "trigger": "a", "budget": 20, "max": 9}, {"id": "y", "trigger": "a", "budget": 100_001, "max": 5}, {"id": "z", "trigger": "b", "budget": 500, "max": 2**31 - 1}]
    ev = events(spark, [(f"{r['id']:05}", r["type"], r["user"], f'{{"m": {str(r["m"]).lower()}}}', r["id"]) for r in rows])
    table = [Campaign(c["id"], c["trigger"], Leaf("m", Op.EQ, True), budget=c["budget"], max_per_user=c["max"]) for c in own]
    got = pipeline.evaluate(ev, table).groupBy("campaign_id").agg(F.count(F.lit(1)), F.count_if("triggered")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == simulate(rows, own)


def test_budget_amounts(spark):
    asked = spark.createDataFrame([("low", 1, 600), ("low", 2, 600), ("low", 3, 400), ("high", 1, 50), ("high", 2, 10**6), ("gone", 1, 1)], "campaign_id string, seq int, amount long")
    budgets = spark.createDataFrame([("low", 1000), ("high", 200_000)], "campaign_id string, budget long")
    got = {(r["campaign_id"], r["seq"]): r["granted"] for r in gates.consume(asked, budgets).collect()}
    assert got == {("low", 1): True, ("low", 2): False, ("low", 3): True, ("high", 1): True, ("high", 2): True, ("gone", 1): False}


def test_ttl_window_is_set_at_acceptance(spark):
    ev = events(spark, [ride("e", s=s) for s in (0, 10, 25, 29, 31, 60)] + [("e", "OTHER", "u", "{}", 5)])
    got = dedup.within_ttl(ev, 30_000).filter("accepted").select("event_type", F.unix_seconds("ts").alias("s")).collect()
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert sorted((r["event_type"], r["s"] - base) for r in got) == [("OTHER", 5), ("RIDE", 0), ("RIDE", 31)]


def table_of_events(spark, path, kinds):
    """A folder with an events table, one event of each kind in turn, a second apart."""
    rows = [(i, T0 + timedelta(seconds=i), i, t, 1.0, '{"k": 1}') for i, t in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return str(path)


BIG = 2**53 + 1  # not a double


def test_folds_keep_numbers_and_nulls(spark):
    """Each user of the fold over rows with null and large ids and other columns that hold nulls."""
    rows = [(BIG, "t", T0, 1, BIG, None), (BIG - 1, "t", T0, None, None, "x"), (None, "t", T0, 2, BIG, None)]
    base = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp, amount long, other long, note string")
    keep = lambda df: sorted((tuple(r)[:6] for r in df.collect()), key=str)
    plain = sorted(map(tuple, rows), key=str)
    ttl = dedup.within_ttl(base, 1000)
    assert [(*r[:2], r[3:]) for r in keep(ttl)] == [(*r[:2], r[3:]) for r in plain] and ttl.filter("accepted").count() == 3
    asked = base.withColumnRenamed("event_id", "campaign_id").withColumn("seq", F.col("other"))
    budgets = spark.createDataFrame([(BIG, 10), (BIG - 1, 10)], "campaign_id long, budget long")
    granted = gates.consume(asked, budgets).select("campaign_id", "other", "note", "granted").collect()
    assert {tuple(r) for r in granted} == {(BIG, BIG, None, True), (BIG - 1, None, "x", False), (None, BIG, None, False)}
    requests = base.select(F.col("event_type").alias("service"), F.col("event_id").alias("request_id"), F.col("ts").alias("created_at"), "other", "note")
    limited = actions.rate_limited(requests, {"t": Rate(2, 0.001)}).collect()
    assert {(r["request_id"], r["other"], r["note"]) for r in limited} == {(r[0], r[4], r[5]) for r in rows} and sum(r["allowed"] for r in limited) == 2
    tried = actions.acquire(requests.filter("request_id IS NOT NULL"), {"t": Rate(1, 0.001)}).collect()
    assert {(r["request_id"], r["allowed"]) for r in tried} == {(BIG - 1, True), (BIG, False)}
    commands = base.select(F.col("event_id").alias("campaign_id"), F.col("other").alias("seq"), F.lit("ACTIVE").alias("to_status"), "note")
    assert {(r["campaign_id"], r["seq"], r["applied"]) for r in campaigns.replay(commands).collect()} == {(BIG, BIG, True), (BIG - 1, None, True), (None, BIG, True)}
    work = base.select("event_id", "event_type", F.lit(0).cast("long").alias("start_ms"), F.lit(5).cast("long").alias("end_ms"), "other")
    assert sorted((str(r["event_id"]), r["other"], r["admitted"]) for r in routing.admit(work, 2, ["event_type"], ["start_ms", "event_id"]).collect()) == [(str(BIG - 1), None, True), (str(BIG), BIG, False), ("None", BIG, True)]


def by_hand(rows, ttl_ms, fires, until=None, fired=False):
    """The status of each time in turn."""
    out = []
    for now in rows:
        if until is not None and now <= until:
            out.append(dedup.CACHED)
        elif fired:
            out.append(dedup.PERSISTENT)
        else:
            out.append(dedup.NEW)
            until, fired = now + ttl_ms, fires(now)
    return out


def test_windows_and_fired_actions_together(spark, tmp_path):
    times = {"a": [0, 5, 31, 40, 90], "b": [0, 29, 30, 31, 62], "c": [7]}
    ev = events(spark, [(k, "RIDE", "u", f'{{"n": {s}}}', s) for k, own in times.items() for s in own])
    own = [Campaign("c", "RIDE", Leaf("n", Op.GTE, 31), actions=SEND)]  # what comes from 31 s on fires
    got = pipeline.run(ev, own, stage=str(tmp_path), ttl_ms=30_000).events
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    statuses = {k: [r["dedup_status"] for r in got.filter(F.col("event_id") == k).orderBy("ts").collect()] for k in times}
    assert statuses == {k: by_hand([1000 * (base + s) for s in v], 30_000, lambda now: now // 1000 - base >= 31) for k, v in times.items()}
    assert statuses["a"][2:] == [dedup.NEW, dedup.CACHED, dedup.PERSISTENT]
    with pytest.raises(ValueError):
        pipeline.run(ev, own, ttl_ms=1)


def test_composed_history(spark):
    ev = events(spark, [("a", "t", "u", "{}", 0), ("a", "t", "u", "{}", 50), ("b", "t", "u", "{}", 0), ("c", "t", "u", "{}", 0), ("c", "t", "u", "{}", 0)])
    base = 1000 * int((T0 - datetime(1970, 1, 1)).total_seconds())
    history = spark.createDataFrame([("a", "t", base + 10_000, False), ("b", "t", base - 1, True), ("c", "t", base - 1, False)], "event_id string, event_type string, until_ms long, fired boolean")
    got = sorted((r["event_id"], r["occurrence"], r["dedup_status"]) for r in dedup.composed(ev, 1000, history).collect())
    assert got == [("a", 1, dedup.CACHED), ("a", 2, dedup.NEW), ("b", 1, dedup.PERSISTENT), ("c", 1, dedup.NEW), ("c", 2, dedup.CACHED)]


def test_lru_cache(spark):
    hits = lambda rows, size, ttl, shards=1: [r["cached"] for r in dedup.lru_cached(events(spark, [ride(k, s=s) for k, s in rows]), size, ttl, shards=shards).orderBy("ts").collect()]
    assert hits([("1", 0), ("2", 1), ("3", 2), ("4", 3), ("1", 4)], 3, 10**9) == [False] * 5
    assert hits([("1", 0), ("2", 1), ("3", 2), ("1", 3), ("4", 4), ("1", 5), ("2", 6)], 3, 10**9) == [False, False, False, True, False, True, False]
    assert hits([("1", 0), ("1", 5), ("1", 9), ("1", 16), ("1", 20)], 3, 9_000) == [False, True, True, False, True]
    assert hits([(str(i % 20), i) for i in range(60)], 20 * 8, 10**9, shards=8) == [False] * 20 + [True] * 40
    with pytest.raises(ValueError):
        hits([], 2, 1, shards=3)


def test_actions_without_type_or_service_fail(spark, tmp_path):
    own = [Campaign("c", "RIDE", RIDE, actions=(Action(None, "s"), Action("SEND_MESSAGE", "  "), *SEND))]
    ev = events(spark, [ride("a"), ride("b", s=1)])
    for stage in (None, str(tmp_path)):
        m = pipeline.run(ev, own, stage=stage).metrics().first()
        assert (m["rules_matched"], m["actions_triggered"], m["actions_failed"]) == (2, 2, 4)


def test_limits_in_windows_of_many_lengths(spark):
    rows = [(f"c{i % 1500}", "u", T0 + timedelta(milliseconds=i * 37 % 9000), (i % 1500) * 7) for i in range(4000)]
    got = gates.user_limit_in_window(spark.createDataFrame(rows, "campaign_id string, user_id string, ts timestamp, user_window_ms long")).collect()
    ms = lambda t: round(t.timestamp() * 1000)
    times = {}
    for c, _, t, w in rows:
        times.setdefault(c, []).append(ms(t))
    assert all(r["recent"] == sum(ms(r["ts"]) - r["user_window_ms"] <= x <= ms(r["ts"]) for x in times[r["campaign_id"]]) for r in got) and len(got) == 4000


def test_registry(spark):
    r = campaigns.Registry([Campaign("a", "t"), Campaign("b", "t", status="PAUSED")])
    before = r.snapshot()
    r.register(Campaign("a", "t", budget=5))
    r.replace_budget("a", 9)
    assert (r.get("a").budget, r.get("a").budget_epoch, len(r), [c.id for c in r.active()]) == (9, 1, 2, ["a"]) and before[0].budget_epoch == 0
    r.reload([Campaign("z", "t")])
    assert len(r) == 1
    with pytest.raises(KeyError):
        r.get("a")


def test_variants_in_utf16_order(spark):
    shares = {"\uffee": 0.5, "\U0001f600": 0.5}  # a surrogate comes before other high characters
    assert [n for n, _ in abtest.thresholds(shares)] == ["\U0001f600", "\uffee"]
    users = spark.range(200).select(F.concat(F.lit("user-"), "id").alias("u"), F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]).alias("v"))
    assert users.filter(abtest.variant_of(F.col("u"), shares) != abtest.variant_by_map(F.col("u"), F.col("v"))).count() == 0


def test_json_columns_read_as_the_driver_does(spark):
    from sluice.functions import jsoncodec, jsoncols

    texts = ['{"a":1} x', '{"a":1,"a":2}', '{"a":01}', '{"a":"x\ty"}', "1],[2", "1, 2", "", "  ", "null", '{"a":{"b":1,"b":007}}', "{'a':1}", '{"a":1}}, {"b":1', '{"a":NaN}', '{"a":"\\q"}', "{a:1}", '{"a":1,}', '{"a":"}]"}', "[1, 2,3]", "42 extra", '"s"', "-017", "[01e2]", '{"a":1}]', "{", "\n [ ] \r\n"]
    got = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", F.to_json(jsoncols.parse(F.col("t"))).alias("j"), jsoncols.corrupt(F.col("t")).alias("bad")).collect()
    for r in got[:-1]:
        try:
            want = jsoncodec.serialize(jsoncodec.parse(r["t"]))
        except jsoncodec.JsonError:
            want = None
        assert (r["j"], r["bad"]) == (want, want is None), r["t"]
    assert (got[-1]["j"], got[-1]["bad"]) == (None, False)


def test_ttl_query_reads_every_event(spark, tmp_path):
    at = table_of_events(spark, tmp_path / "sf", ["click"] * 23)
    want, until = set(), None
    for m in (0, 10, 25, 29, 31, 60):
        ok = until is None or m > until
        until = m + 30 if ok else until
        want |= {(i, m, ok) for i in range(23)}
    got = queries.QUERIES["q_dedup_ttl"](spark, at).collect()
    assert len(got) == 23 * 6 and {tuple(r) for r in got} == want


def test_status_store_and_lru(spark, tmp_path):
    ev = events(spark, [ride("a"), ride("a", s=1), ride("b", s=2), ride("c", s=3)])
    store = SeenKeys(spark, str(tmp_path))
    assert store.size() == 0
    store.record(ev.filter("event_id = 'b'"), 0)
    store.record(ev.filter("event_id = 'c'"), 1)
    store.record(ev.filter("event_id = 'c'"), 1)
    assert store.size() == 2 and store.exists(ev.select("event_id", "event_type")).count() == 2
    got = sorted((r["event_id"], r["dedup_status"]) for r in dedup.with_status(ev, store.table()).collect())
    assert got == [("a", dedup.CACHED), ("a", dedup.NEW), ("b", dedup.PERSISTENT), ("c", dedup.PERSISTENT)]
    assert [r["event_id"] for r in dedup.most_recent(ev, 2).collect()] == ["c", "b"]


def test_bloom(spark, monkeypatch):
    assert [(bloom.bit_count(n, p), bloom.hash_count(bloom.bit_count(n, p), n)) for n, p in ((10**6, 0.001), (10**5, 0.01), (10**4, 0.01))] == [(14377588, 10), (958506, 7), (95851, 7)]
    for bad in ((0, 0.1), (5, 0.0), (5, 1.0)):
        with pytest.raises(ValueError):
            bloom.bit_count(*bad)
    keys = spark.range(2000).select(F.concat(F.lit("evt-"), "id").alias("event_id"), F.lit("TYPE").alias("event_type"), "id")
    own = bloom.build(keys.filter("id < 1000"), 1000, 0.01)
    found = own.might_contain(keys)
    assert found.filter("id < 1000 AND NOT might_contain").count() == 0 and found.filter("id >= 1000 AND might_contain").count() < 30
    assert own.inserted == 1000 and found.columns == [*keys.columns, "might_contain"]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(bloom, "BROADCAST_WORDS", 10)  # as of a bitmap that is too large for tasks
    wide = bloom.build(keys.filter("id < 1000"), 1000, 0.01)
    assert wide.bitmap is None and wide.inserted == 1000
    assert {tuple(r) for r in wide.might_contain(keys).select("id", "might_contain").collect()} == {tuple(r) for r in found.select("id", "might_contain").collect()}
    assert bloom.build(keys.limit(0), 10, 0.5).might_contain(keys.limit(3)).filter("might_contain").count() == 0


def test_murmur3_and_buckets(spark):
    known = {(b"", 0): 0, (b"", 1): 0x514E28B7, (b"test", 0): 0xBA6BD213, (b"Hello, world!", 0): 0xC0363E43, (b"The quick brown fox jumps over the lazy dog", 0x9747B28C): 0x2FA826CD}
    for (raw, seed), want in known.items():
        assert int(hashing.murmur3_32([raw, b"xx"], seed)[0]) == want

    def java_hash(s):
        h = 0
        raw = s.encode("utf-16-be", "surrogatepass")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return h

    words = ["", "a", "user-42", "ñandú", "日本", "😀x", "user-ab-test"]
    got = spark.createDataFrame([(w,) for w in words], "s string").select(hashing.string_hash(F.col("s")), hashing.ab_bucket(F.col("s"))).collect()
    assert [r[0] for r in got] == [java_hash(w) for w in words]
    assert got[6][1] == 3907 and got[2][1] == 5428


def test_variants(spark):
    users = spark.range(1000).select(F.concat(F.lit("user-"), "id").alias("u"))
    got = {r["variant"]: r["n"] for r in abtest.distribution(users.select(abtest.variant_of(F.col("u"), {"A": 0.5, "B": 0.5}).alias("variant"))).collect()}
    assert got["A"] == 511
    same = users.select(abtest.variant_of(F.col("u"), {"A": 0.6, "B": 0.2, "C": 0.2}).alias("x"), abtest.variant_by_map(F.col("u"), F.expr("map('C', 0.2D, 'A', 0.6D, 'B', 0.2D)")).alias("y"))
    assert same.filter("x <> y").count() == 0
    assert users.limit(1).select(abtest.variant_of(F.col("u"), {"default": 1.0})).first()[0] == "default"
    with pytest.raises(ValueError):
        abtest.thresholds({})


def test_token_buckets(spark):
    rows = spark.createDataFrame([(f"{i:03}", "a", T0) for i in range(5)] + [("x1", "b", T0), ("x2", "b", T0), ("x3", "b", T0 + timedelta(milliseconds=50)), ("x4", "b", T0 - timedelta(seconds=9))], "request_id string, service string, created_at timestamp")
    got = {r["request_id"]: r["allowed"] for r in actions.rate_limited(rows, {"a": Rate(3, 1.0), "b": Rate(1, 100.0)}).collect()}
    assert [got[f"{i:03}"] for i in range(5)] == [True, True, True, False, False]
    assert (got["x4"], got["x1"], got["x2"], got["x3"]) == (True, True, False, True)
    for bad in ((0, 1.0), (1, 0.0)):
        with pytest.raises(ValueError):
            Rate(*bad)


def test_tries_for_tokens_interleave(spark):
    rows = spark.createDataFrame([("a", "s", T0), ("b", "s", T0), ("c", "s", T0 + timedelta(milliseconds=40)), ("d", "slow", T0), ("e", "slow", T0)], "request_id string, service string, created_at timestamp")
    got = {r["request_id"]: (r["allowed"], r["tries"]) for r in actions.acquire(rows, {"s": Rate(1, 20.0), "slow": Rate(1, 1.0)}).collect()}
    # one token each 50 ms: b waits for the first, c (at 40, 90, 140) for the second
    assert got == {"a": (True, 1), "b": (True, 2), "c": (True, 3), "d": (True, 1), "e": (False, 3)}


def test_token_queries_read_every_event(spark, tmp_path):
    kinds = ("click", "view", "purchase", "signup", "error")
    at = table_of_events(spark, tmp_path / "sf", kinds * 9)
    got = {r["service"]: r["allowed"] for r in queries.QUERIES["q_token_bucket"](spark, at).collect()}
    assert got == {"click": 5} | dict.fromkeys(kinds[1:], 9)
    # all 45 at one time: 20 tokens, and less than one more by the last try
    assert [tuple(r) for r in queries.QUERIES["q_token_tries"](spark, at).collect()] == [("a", 20, 25)]


def test_outcomes_and_retries(spark):
    rows = spark.createDataFrame([("a", "SEND_MESSAGE", "s", True, 0, True), ("b", None, "s", True, 0, True), ("c", "GRANT_REWARD", " ", True, 0, True), ("d", "GRANT_REWARD", "s", True, 5, True), ("e", "GRANT_REWARD", "s", False, 0, True), ("f", "GRANT_REWARD", "s", True, 0, False)], "request_id string, action_type string, service string, allowed boolean, delay_ms long, success boolean")
    out = actions.outcomes(rows)
    got = {r["request_id"]: r["response"] for r in out.collect()}
    assert got == {"a": "OK", "b": actions.INVALID_TYPE, "c": actions.INVALID_SERVICE, "d": "SCHEDULED", "e": "RATE_LIMITED", "f": "DISPATCH_ERROR"}
    assert actions.dispatch_counts(out).first() == (6, 2, 4, 1)
    tried = {r["request_id"]: (r["success"], r["retry_count"], r["waited_ms"]) for r in actions.attempts(rows.select("request_id"), (F.col("attempt") >= 1) & (F.col("request_id") != "f"), Retry(2, 100, 2.0, 0.0)).collect()}
    assert tried["a"] == (True, 1, 100) and tried["f"] == (False, 2, 300)


def test_timers(spark):
    tasks = spark.createDataFrame([(f"t{i}", i * 100, False) for i in range(1, 6)] + [("late", 350, False), ("gone", 100, True)], "id string, deadline_ms long, cancelled boolean")
    assert [r["id"] for r in schedule.due(tasks, 200, 100).collect()] == ["t1", "t2"] and schedule.pending(tasks, 200, 100).count() == 4
    tasks = schedule.cancel(tasks, spark.createDataFrame([("t3", 250)], "id string, at_ms long"))
    assert [(r["id"], r["fired_ms"]) for r in schedule.due(tasks, 400, 100, since_ms=200).collect()] == [("late", 400), ("t4", 400)]
    got = schedule.schedule(spark.createDataFrame([(T0, None), (T0, -5), (T0, 7)], "created_at timestamp, delay_ms long")).collect()
    base = got[0]["deadline_ms"]
    assert [r["deadline_ms"] - base for r in got] == [0, 0, 7]


def test_lifecycle_and_registry(spark):
    steps = [("c1", 1, "ACTIVE"), ("c1", 2, "DRAFT"), ("c1", 3, "PAUSED"), ("c1", 4, "COMPLETED"), ("c1", 5, "ACTIVE"), ("c1", 6, "COMPLETED"), ("c1", 7, "ACTIVE"), ("c2", 1, "PAUSED")]
    got = {(r["campaign_id"], r["seq"]): (r["applied"], r["status"]) for r in campaigns.replay(spark.createDataFrame(steps, "campaign_id string, seq int, to_status string")).collect()}
    assert [got["c1", i][0] for i in range(1, 8)] == [True, False, True, False, True, True, False] and got["c1", 7][1] == "COMPLETED" and got["c2", 1] == (False, "DRAFT")
    made, taken = campaigns.create(spark.createDataFrame([("a",)], "campaign_id string"), spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "campaign_id string, seq int"))
    assert [(r["campaign_id"], r["status"]) for r in made.collect()] == [("b", "DRAFT")] and taken.count() == 2
    table = campaigns.campaign_table(spark, [Campaign("a", "t"), Campaign("b", "t").with_status("PAUSED")])
    assert metrics.campaign_counts(table).first()["active"] == 1
    with pytest.raises(ValueError):
        campaigns.campaign_table(spark, [Campaign("a", "t", actions=(Action("EMAIL", "s"),))])
    with pytest.raises(ValueError):
        Campaign(None, "t")


def test_routing_and_admission(spark):
    ev = events(spark, [("a", "x", "u", "{}", 0), ("b", "y", "u", "{}", 1), ("c", "z", "u", "{}", 2)])
    handlers = spark.createDataFrame([("x", "h1"), ("x", "h2"), ("y", "h1")], "event_type string, handler string")
    assert routing.route(ev, handlers).count() == 3 and routing.route_counts(ev, handlers).first() == (2, 1)
    assert {r["partition"]: r["events"] for r in routing.consumed(routing.merged([ev, ev.limit(1)])).collect()} == {0: 3, 1: 1}
    work = spark.createDataFrame([(1, "k", 0, 10), (2, "k", 1, 5), (3, "k", 2, 9), (4, "k", 6, 7)], "id int, k string, start_ms long, end_ms long")
    assert {r["id"]: r["admitted"] for r in routing.admit(work, 2, ["k"], ["start_ms"]).collect()} == {1: True, 2: True, 3: False, 4: True}
    with pytest.raises(ValueError):
        routing.admit(work, 0, ["k"], ["start_ms"])


def test_staged_enrichment_and_as_of(spark):
    from sluice.model import Source

    ev = events(spark, [(str(i), "t", f"u{i % 3}", f'{{"k": {i}}}', i) for i in range(9)])
    rule = And((Leaf("k", Op.GT, 3), Leaf("enriched.tier", Op.EQ, "gold", Source.DATABASE)))
    base = Fields(F.col("payload"))
    after = Fields(F.col("payload"), typed={"enriched.tier": (F.col("tier"), "string")})
    tiers = spark.createDataFrame([("u0", "gold"), ("u1", "tin")], "user_id string, tier string")
    got = {r["event_id"]: (r["matched"], r["stage"]) for r in enrichment.staged_match(ev, rule, base, lambda e: enrichment.enrich(e, tiers, "user_id"), after=after).collect()}
    assert got["0"] == (False, 1) and got["6"] == (True, 2) and got["4"] == (False, 2) and got["5"] == (False, 2)
    changes = spark.createDataFrame([("u0", T0 + timedelta(seconds=1), "x"), ("u0", T0 + timedelta(seconds=6), "y")], "user_id string, ts timestamp, v string")
    assert {r["event_id"]: r["v"] for r in enrichment.as_of(ev, changes, "user_id").filter("user_id = 'u0'").collect()} == {"0": None, "3": "x", "6": "y"}


def test_as_of_equals_brute_force_over_spans(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", at(i * 977 % 40_000)) for i in range(300)] + [(900, "hot", None)]
    changes = [("hot" if j % 2 else f"k{j % 5}", at(j * 2311 % 40_000), j) for j in range(40)] + [("hot", None, -1)]
    ev = spark.createDataFrame(rows, "event_id long, user_id string, ts timestamp")
    got = {r["event_id"]: r["v"] for r in enrichment.as_of(ev, spark.createDataFrame(changes, "user_id string, ts timestamp, v long"), "user_id", span_s=3600).collect()}
    want = {i: max(((t, v) for k, t, v in changes if k == u and t is not None and when is not None and t <= when), default=(None, None))[1] for i, u, when in rows}
    assert got == want and None in set(want.values())


def test_observed_counts(spark):
    df, seen = metrics.observed(spark.range(10), even=F.col("id") % 2 == 0)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5}


def test_recording_client(spark, tmp_path):
    client = RecordingClient(str(tmp_path), succeed=False, response="NO")
    requests = spark.createDataFrame([("a",), ("b",)], "request_id string")
    assert {r["succeeded"] for r in client.execute(requests).collect()} == {False}
    client.execute(requests)
    assert client.received(spark).count() == 2


def stream_of(spark, path, *parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def test_stream_equals_batch_across_batches(spark, tmp_path):
    rows = [ride(f"e{i:02}", user=f"u{i % 3}", s=i) for i in range(30)] + [ride("e03", user="u0", s=31)]
    own = [Campaign("b", "RIDE", RIDE, budget=7, actions=SEND), Campaign("l", "RIDE", RIDE, max_per_user=4, actions=SEND * 2)]
    raw = events(spark, rows)
    stream = stream_of(spark, tmp_path, raw.filter("event_id < 'e11' AND unix_seconds(ts) % 100 < 100"), raw.filter("event_id >= 'e11'"))
    engine = Builder.defaults(spark).campaigns(own).state(str(tmp_path / "state")).build().start(stream, once=True)
    engine.wait()
    assert not engine.is_running()
    assert engine.metrics().first() == pipeline.run(raw, own).metrics().first()
    assert engine.metrics().first()["rules_matched"] == 7 + 12 and engine.results("requests").count() == 7 + 24
    engine.stop()


def test_stream_expires_keys_that_fired_nothing(spark, tmp_path):
    us = '{"country":"US"}'
    first = events(spark, [ride("fired"), ride("quiet", payload=us), ride("short", payload=us, s=1)])
    later = events(spark, [ride("fired", s=400), ride("quiet", payload=us, s=400), ride("short", payload=us, s=200)])
    engine = Builder.defaults(spark).campaigns([Campaign("c", "RIDE", RIDE, actions=SEND)]).cache(1000, 300_000).state(str(tmp_path / "state")).build()
    engine.start(stream_of(spark, tmp_path, first, later), once=True).wait()
    got = {(r["event_id"], r["dedup_status"]) for r in engine.results("events").collect()}
    assert got == {("fired", dedup.NEW), ("quiet", dedup.NEW), ("short", dedup.NEW), ("fired", dedup.PERSISTENT), ("short", dedup.CACHED)}
    assert engine.metrics().first()["duplicates_filtered"] == 2


class FlakyClient:
    """Refuses each request twice, and raises for a service."""

    def __init__(self):
        self.calls = []

    def execute(self, requests, batch=0):
        rows = [(r["request_id"], r["service"]) for r in requests.collect()]
        if any(s == "broken" for _, s in rows):
            raise RuntimeError("no route")
        self.calls.append(len(rows))
        ok = len(self.calls) > 2
        return requests.select("request_id", F.lit(ok).alias("succeeded"), F.lit("OK" if ok else "BUSY").alias("response"))


def test_stream_dispatches_with_rates_retries_and_delays(spark, tmp_path):
    own = [
        Campaign("now", "RIDE", RIDE, actions=(Action("SEND_MESSAGE", "notify"), Action(None, "notify"))), Campaign("later", "WAIT", RIDE, actions=(Action("SEND_MESSAGE", "slow"),), delay_ms=60_000),
    ]
    vn = '{"country":"VN"}'
    parts = [events(spark, [ride(f"e{i}", s=i) for i in range(4)] + [("w", "WAIT", "u", vn, 3)]), events(spark, [ride("f", s=5)]), events(spark, [("x", "OTHER", "u", vn, 70)])]
    client = FlakyClient()
    build = Builder.defaults(spark).campaigns(own).rates({"notify": Rate(2, 0.001)}).retry(Retry(2, 1, 2.0, 0.0)).client(client).state(str(tmp_path / "state")).build()
    build.start(stream_of(spark, tmp_path, *parts), once=True).wait()
    got = sorted((r["service"], r["response"], r["retry_count"]) for r in build.results("results").collect())
    assert got == sorted([("notify", "OK", 2)] * 2 + [("notify", actions.RATE_LIMITED, 0)] * 3 + [("notify", actions.INVALID_TYPE, 0)] * 5 + [("slow", actions.SCHEDULED, 0), ("slow", "OK", 0)])
    assert client.calls[:3] == [2, 2, 2] and client.calls[-1] == 1  # the delayed one in the batch that reaches its time
    m = build.metrics().first()
    assert (m["actions_triggered"], m["actions_failed"]) == (6, 5)
    assert build.dispatched().first() == (12, 4, 8, 3)
    broken = Builder.defaults(spark).campaigns([Campaign("c", "RIDE", RIDE, actions=(Action("SEND_MESSAGE", "broken"),))]).client(client).state(str(tmp_path / "broken")).build()
    broken.process(parts[1], 0)
    assert [r["response"] for r in broken.results("results").collect()] == ["DISPATCH_ERROR: no route"]


def test_registry_changes_take_effect_when_rebuilt(spark, tmp_path):
    registry = campaigns.Registry([Campaign("c", "RIDE", RIDE, budget=1, actions=SEND)])
    engine = Builder.defaults(spark).campaigns(registry).state(str(tmp_path)).build()
    batch = lambda n: engine.process(events(spark, [ride(f"e{n}{i}", s=10 * n + i) for i in range(3)]), n)
    matched = lambda: engine.metrics().first()["rules_matched"]
    assert engine.metrics().first()["events_received"] == 0
    batch(0)
    registry.replace_budget("c", 2)
    batch(1)
    assert matched() == 1
    engine.rebuild()
    batch(2)
    batch(2)  # a replay
    assert matched() == 3
    registry.reload([])
    engine.rebuild()
    batch(3)
    assert matched() == 3 and engine.metrics().first()["events_processed"] == 12


def test_logs_merge_and_stay_small(spark, tmp_path):
    assert [log.segments(n) for n in (0, 1, 8, 10, 64, 73)] == [[], [(0, 0)], [(1, 0)], [(1, 0), (0, 8), (0, 9)], [(2, 0)], [(2, 0), (1, 8), (0, 72)]]
    own = log.Log(spark, str(tmp_path / "log"), lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")).coalesce(1))
    sizes = []
    for n in range(200):
        own.begin(n)
        own.add(spark.range(3).select((F.col("id") + n % 5).alias("k"), F.lit(1).cast("long").alias("n")).coalesce(1), n)
        if n in (99, 199):
            assert own.read(n + 1).agg(F.sum("n")).first()[0] == 3 * (n + 1)
            sizes.append(sum(len(f) for _, _, f in os.walk(tmp_path)))
    assert sizes[1] < 2.5 * sizes[0] and sizes[1] < 200  # files of 200 batches, not of 200 versions
    own.add(spark.range(3).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n")), 199)  # a replay
    assert own.read(200).agg(F.sum("n")).first()[0] == 600


def test_streams_start_and_stop_together(spark, tmp_path):
    ev = events(spark, [ride(f"e{i}", s=i) for i in range(7)]).select("event_id", "ts")
    seen = []
    work = lambda batch, n: seen.append(batch.count())
    own = Coordinator([(stream_of(spark, tmp_path / "a", ev), work), (stream_of(spark, tmp_path / "b", ev.limit(3)), work)], str(tmp_path / "c")).start(once=True)
    own.wait()
    assert own.events_consumed() == 10 == sum(seen) and not own.is_running()
    own.stop()


def test_stream_dedup_and_windows(spark, tmp_path):
    raw = events(spark, [ride("a"), ride("a", s=5), ride("b", s=7)]).select("event_id", "event_type", "ts")
    raw.write.parquet(str(tmp_path / "in"))
    for name, make, mode in (("d", deduplicated, "append"), ("w", windowed_counts, "complete")):
        q = make(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("d").count() == 2 and spark.table("w").first()["n"] == 3
