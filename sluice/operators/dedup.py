"""Event deduplication: first occurrences, time-limited windows, status against a store of seen keys."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .fold import dealt, ordered_fold

KEY = ["event_id", "event_type"]
NEW, CACHED, PERSISTENT = "NEW_EVENT", "DUPLICATE_CACHED", "DUPLICATE_PERSISTENT"
#: An occurrence without a time counts as the earliest.
_EARLIEST = -(2**62)


def first_occurrences(events: DataFrame, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The earliest row of each (event_id, event_type). A limit of one row a key is taken before the shuffle too."""
    w = W.Window.partitionBy(*KEY).orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def within_ttl(events: DataFrame, ttl_ms: int, time: str = "ts", order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """events with accepted: whether no accepted occurrence of the key lies within the time to live before.

    The window is set when an occurrence is accepted and repeats don't extend it. An occurrence without a time counts
    as the earliest.
    """
    ms = events.withColumn("_ms", F.unix_millis(F.col(time).cast("timestamp")))

    def step(until, row):
        now = _EARLIEST if row[0] is None else row[0]
        return (until, False) if until is not None and now <= until else (now + ttl_ms, True)

    return ordered_fold(ms, KEY, list(order), lambda: None, step, ["_ms"], "accepted boolean").drop("_ms")


def composed(events: DataFrame, ttl_ms: int, history: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """events with occurrence (its number among the key's, by time), acceptance and dedup_status, as if none of them fired an action.

    An occurrence is a duplicate if an accepted one of its key lies within the time to live before it (cached), or if any
    accepted one before it has fired an action (persistent). history (KEY, until_ms, fired) is what earlier rows leave.
    acceptance says how many occurrences of the key were accepted up to this one; 0 is what history alone settles. What
    fires among these rows only cuts a key's acceptances short: see cut(). tasks: as in ordered_fold().
    """
    rows = dealt(events, KEY, tasks).withColumn("_ms", F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(_EARLIEST)))
    inputs = ["_ms"]
    if history is not None:
        held = history.groupBy(*KEY).agg(F.max("until_ms").alias("_until"), F.bool_or("fired").alias("_fired"))
        rows = rows.join(held, KEY, "left")
        inputs += ["_until", "_fired"]

    def step(state, row):
        now, *before = row
        n, accepted, until, has_fired = state or (0, 0, *(before or (None, False)))
        n += 1
        if until is not None and now <= until:
            return (n, accepted, until, has_fired), [n, accepted, 0]
        if has_fired:
            return (n, accepted, until, has_fired), [n, 0, 1]
        return (n, accepted + 1, now + ttl_ms, has_fired), [n, accepted + 1, 2]

    folded = ordered_fold(rows, KEY, ["ts"], lambda: None, step, inputs, "_place array<long>", tasks=tasks)
    status = F.element_at(F.array(*map(F.lit, (CACHED, PERSISTENT, NEW))), F.col("_place")[2].cast("int") + 1)
    return folded.select(*events.columns, F.col("_place")[0].alias("occurrence"), F.col("_place")[1].alias("acceptance"), status.alias("dedup_status"))


def cut(marked: DataFrame, fired: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows of composed() with dedup_status as it is once fired (KEY, fired_at: the first acceptance that fired an action) is known.

    What comes after that acceptance's window is persistent. First acceptances and their windows can't depend on it, so
    only later rows meet fired, by a hash of the key and without being sorted.
    """
    late = dealt(marked.filter("acceptance > 1"), KEY, tasks).join(dealt(fired, KEY, tasks).hint("shuffle_hash"), KEY, "left")
    status = F.when(F.col("acceptance") > F.col("fired_at"), PERSISTENT).otherwise(F.col("dedup_status"))
    return marked.filter("acceptance <= 1").unionByName(late.withColumn("dedup_status", status).select(*marked.columns))


def with_status(events: DataFrame, store: DataFrame | None = None, ttl_ms: int | None = None) -> DataFrame:
    """events with dedup_status: a repeat within the batch is cached, a key of the durable store is persistent, else new.

    The durable store is the ground truth; nothing in front of it can hide a key that it holds.
    """
    if ttl_ms is None:
        w = W.Window.partitionBy(*KEY).orderBy("ts")
        marked = events.withColumn("accepted", F.row_number().over(w) == 1)
    else:
        marked = within_ttl(events, ttl_ms)
    if store is None:
        held = marked.withColumn("_held", F.lit(False))
    else:
        seen = store.select(*KEY).distinct().withColumn("_held", F.lit(True))
        held = marked.join(seen, KEY, "left")
    status = F.when(~F.col("accepted"), CACHED).when(F.coalesce("_held", F.lit(False)), PERSISTENT).otherwise(NEW)
    return held.withColumn("dedup_status", status).drop("accepted", "_held")


def status_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("dedup_status").agg(F.count(F.lit(1)).alias("n"))


def record(store: DataFrame | None, events: DataFrame) -> DataFrame:
    """The store of seen keys with the latest time of each."""
    rows = events.select(*KEY, F.col("ts"))
    rows = rows if store is None else store.select(*KEY, "ts").unionByName(rows)
    return rows.groupBy(*KEY).agg(F.max("ts").alias("ts"))


def lru_cached(events: DataFrame, size: int, ttl_ms: int, order: tuple[str, ...] = ("ts",), keys: tuple[str, ...] = tuple(KEY), shards: int = 1) -> DataFrame:
    """events with cached: whether a least-recently-used cache holds the key when its turn comes.

    A hit makes the key the most recent one and doesn't extend its time; a miss, also of a key whose time is over, puts
    it with a new time and drops the least recent key beyond size. Such a cache depends on the order of all its rows, which
    are folded in spans one after another; shards are caches of size / shards keys each, by a hash of the key, as a cluster would hold them.
    """
    if size < shards or shards < 1:
        raise ValueError("each shard must hold a key")
    rows = events.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards))).withColumn("_ms", F.coalesce(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(_EARLIEST)))

    def step(held, row):
        *key, now = row
        key = tuple(key)
        hit = key in held and now <= held[key]
        if not hit:
            held[key] = now + ttl_ms
        held.move_to_end(key)
        if len(held) > size // shards:
            held.popitem(last=False)
        return held, hit

    out = ordered_fold(rows, ["_shard"], list(order), OrderedDict, step, [*keys, "_ms"], "cached boolean", spans=True)
    return out.select(*events.columns, "cached")


def most_recent(keys: DataFrame, size: int, time: str = "ts") -> DataFrame:
    """What a least-recently-used cache of this size holds: the keys of the latest access."""
    last = keys.groupBy(*KEY).agg(F.max(time).alias("last_access"))
    return last.orderBy(F.col("last_access").desc(), *KEY).limit(size)
