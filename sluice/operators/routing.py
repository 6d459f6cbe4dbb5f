"""Routing of events to handlers, union of partitions, admission of work in flight."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import ordered_fold


def route(events: DataFrame, handlers: DataFrame) -> DataFrame:
    """A row for each event and handler of its type."""
    return events.join(handlers, "event_type", "inner")


def route_counts(events: DataFrame, handlers: DataFrame) -> DataFrame:
    """How many events have a handler, each counted once, and how many have none."""
    types = handlers.select("event_type").distinct().withColumn("_has", F.lit(True))
    has = F.coalesce("_has", F.lit(False))
    return events.join(types, "event_type", "left").agg(F.count_if(has).alias("routed"), F.count_if(~has).alias("skipped"))


def merged(partitions: list[DataFrame]) -> DataFrame:
    """All partitions' events, with partition."""
    return reduce(DataFrame.unionByName, [p.withColumn("partition", F.lit(i)) for i, p in enumerate(partitions)])


def consumed(events: DataFrame) -> DataFrame:
    return events.groupBy("partition").agg(F.count(F.lit(1)).alias("events"))


def admit(work: DataFrame, permits: int, keys: list[str], order: list[str]) -> DataFrame:
    """work (start_ms, end_ms, ...) with admitted: whether fewer than `permits` admitted items are in flight at its start.

    What finds no permit is turned away, not queued. The state of a key is the ends of at most `permits` items.
    """
    if permits <= 0:
        raise ValueError("permits must be positive")

    def step(ends, row):
        start, end = row
        ends = [e for e in ends if e > start]
        return ([*ends, end], True) if len(ends) < permits else (ends, False)

    return ordered_fold(work, keys, order, list, step, ["start_ms", "end_ms"], "admitted boolean", spans=True)
