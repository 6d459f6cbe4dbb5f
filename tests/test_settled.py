"""Marks that wait for what fires: events are dealt by key and folded once, however many turns the gates take."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.model import UNLIMITED_ACTIONS, Action, Campaign, Leaf, Op
from sluice.operators import dedup, fold, pipeline
from sluice.streaming.engine import Builder

from .test_operators import SEND, T0, by_hand, events, ride

TTL_S = 30


def one_by_one(rows, own):
    """Statuses by time, and (evaluated, triggered), one event at a time."""
    until, fired, out, uses, left, counts = {}, set(), {}, {}, {c.id: c.budget for c in own}, [0, 0]
    for key, _, user, payload, s in sorted(rows, key=lambda r: r[4]):
        if key in until and s <= until[key]:
            out[s] = dedup.CACHED
        elif key in fired:
            out[s] = dedup.PERSISTENT
        else:
            out[s], until[key] = dedup.NEW, s + TTL_S
            for c in own:
                if left[c.id] <= 0 or uses.get((c.id, user), 0) >= c.max_per_user:
                    continue
                uses[c.id, user] = uses.get((c.id, user), 0) + 1
                counts[0] += 1
                if '"VN"' in payload:
                    counts[1], left[c.id] = counts[1] + 1, left[c.id] - 1
                    fired |= {key} if c.actions and c.actions[0].type else set()
    return out, tuple(counts)


@pytest.mark.parametrize("task_rows", [20, 10**9])
def test_turns_move_events_once(spark, tmp_path, monkeypatch, task_rows):
    dice = random.Random(3)
    rows = [ride(f"k{dice.randrange(25)}", f"u{dice.randrange(4)}", f'{{"country":"{dice.choice(["VN", "US"])}"}}', s) for s in range(0, 900, 3)]
    rule = Leaf("country", Op.EQ, "VN")
    own = [Campaign("b", "RIDE", rule, budget=12, actions=SEND), Campaign("l", "RIDE", rule, max_per_user=6, actions=SEND), Campaign("n", "RIDE", rule, actions=(Action(None, "svc"),), max_per_user=UNLIMITED_ACTIONS)]
    monkeypatch.setattr(fold, "TASK_ROWS", task_rows, raising=False)
    folds, evaluations = [], []
    composed, evaluate = dedup.composed, pipeline.evaluate
    monkeypatch.setattr(dedup, "composed", lambda *a: folds.append(1) or composed(*a))
    monkeypatch.setattr(pipeline, "evaluate", lambda *a: evaluations.append(1) or evaluate(*a))
    got = pipeline.run(events(spark, rows), own, stage=str(tmp_path), ttl_ms=TTL_S * 1000)
    want, counts = one_by_one(rows, own)
    base = int((T0 - datetime(1970, 1, 1)).total_seconds())
    assert {r["s"] - base: r["dedup_status"] for r in got.events.select(F.unix_seconds("ts").alias("s"), "dedup_status").collect()} == want
    m = got.metrics().first()
    assert (m["rules_evaluated"], m["rules_matched"]) == counts and m["events_processed"] == sum(v == dedup.NEW for v in want.values()) == got.new.count()
    assert set(want.values()) == {dedup.NEW, dedup.CACHED, dedup.PERSISTENT} and len(evaluations) > 2
    assert len(folds) == 1


def test_nothing_fires(spark, tmp_path):
    ev = events(spark, [ride(k, s=s) for k in "ab" for s in (0, 31, 40, 62)])
    got = pipeline.run(ev, [Campaign("c", "RIDE", Leaf("country", Op.EQ, "US"), actions=SEND)], stage=str(tmp_path), ttl_ms=30_000)
    assert sorted(r["dedup_status"] for r in got.events.collect()) == [dedup.CACHED] * 2 + [dedup.NEW] * 6
    m = got.metrics().first()
    assert (m["events_received"], m["events_processed"], m["rules_evaluated"], m["rules_matched"]) == (8, 6, 6, 0)


def test_batches_with_keys_that_return(spark, tmp_path):
    """A stream's batches in which keys return after their windows, fired or not, here and before."""
    vn, us = '{"country":"VN"}', '{"country":"US"}'
    times = {"a": (vn, [0, 10, 31, 90, 400]), "b": (us, [1, 20, 32, 90, 401]), "c": (vn, [205, 240]), "d": (us, [206, 240])}
    engine = Builder.defaults(spark).campaigns([Campaign("c", "RIDE", Leaf("country", Op.EQ, "VN"), actions=SEND)]).cache(1000, 30_000).state(str(tmp_path)).build()
    rows = [(k, p, s) for k, (p, own) in times.items() for s in own]
    for n, (low, high) in enumerate([(0, 200), (200, 500)]):
        batch = events(spark, [ride(k, payload=p, s=s) for k, p, s in rows if low <= s < high])
        for _ in range(2):  # again, as after a failure
            engine.process(batch, n)
    marked = engine.results("events").collect()
    for k, (p, own) in times.items():
        got = [r["dedup_status"] for r in sorted((r for r in marked if r["event_id"] == k), key=lambda r: r["ts"])]
        assert got == by_hand([1000 * s for s in own], 30_000, lambda now, p=p: p == vn), k
    assert engine.metrics().first()["events_received"] == len(rows) == len(marked) and engine.metrics().first()["actions_triggered"] == 2


def test_ties_nulls_and_history(spark):
    """Equal times, a missing time and a missing id, with what earlier rows leave."""
    at = lambda s: None if s is None else T0 + timedelta(seconds=s)
    rows = [("x", "t", at(s)) for s in (None, 0, 0, 40)] + [("y", "t", at(s)) for s in (5, 50, 90)] + [(None, "t", at(s)) for s in (0, 0, 31)]
    ev = spark.createDataFrame(rows, "event_id string, event_type string, ts timestamp")
    base = 1000 * int((T0 - datetime(1970, 1, 1)).total_seconds())
    history = spark.createDataFrame([("y", "t", base + 10_000, False)], "event_id string, event_type string, until_ms long, fired boolean")
    marked = dedup.composed(ev, 30_000, history)
    fired = spark.createDataFrame([("x", "t", 2), ("y", "t", 1)], "event_id string, event_type string, fired_at long")
    got = sorted((str(r["event_id"]), r["occurrence"], r["acceptance"], r["dedup_status"]) for r in dedup.cut(marked, fired).collect())
    new, cached, gone = dedup.NEW, dedup.CACHED, dedup.PERSISTENT
    assert got == [("None", 1, 1, new), ("None", 2, 1, cached), ("None", 3, 2, new), ("x", 1, 1, new), ("x", 2, 2, new), ("x", 3, 2, cached), ("x", 4, 3, gone), ("y", 1, 0, cached), ("y", 2, 1, new), ("y", 3, 2, gone)]
