"""Staged enrichment: costly fields are joined only for the rows that cheaper ones leave undecided."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import Fields
from ..model import Rule, Source
from ..plans.rulecompile import compile_partial, compile_rule


def enrich(events: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """events with the table's columns; rows without a partner keep nulls. The engine broadcasts the table by its measured size."""
    return events.join(table, on, "left")


def staged_match(events: DataFrame, rule: Rule, fields: Fields, database: Callable[[DataFrame], DataFrame], external: Callable[[DataFrame], DataFrame] | None = None, after: Fields | None = None) -> DataFrame:
    """events with matched and stage: 1 decided from memory, 2 after the database join, 3 after the external one.

    database and external add the columns that `after` resolves. Leaves of costlier sources count as unknown, and
    boolean logic over the unknown decides a row only if no value of them could change it.
    """
    columns = events.columns
    first = events.withColumn("matched", compile_partial(rule, fields, {Source.MEMORY}))
    done = [first.filter("matched IS NOT NULL").withColumn("stage", F.lit(1))]
    rest = database(first.filter("matched IS NULL").drop("matched"))
    if external is None:
        done.append(rest.withColumn("matched", compile_rule(rule, after or fields).matched).withColumn("stage", F.lit(2)))
    else:
        second = rest.withColumn("matched", compile_partial(rule, after or fields, {Source.MEMORY, Source.DATABASE}))
        done.append(second.filter("matched IS NOT NULL").withColumn("stage", F.lit(2)))
        last = external(second.filter("matched IS NULL").drop("matched"))
        done.append(last.withColumn("matched", compile_rule(rule, after or fields).matched).withColumn("stage", F.lit(3)))
    out = done[0].select(*columns, "matched", "stage")
    for x in done[1:]:
        out = out.unionByName(x.select(*columns, "matched", "stage"))
    return out


def as_of(events: DataFrame, changes: DataFrame, on: str, time: str = "ts", span_s: int = 86_400) -> DataFrame:
    """events with the latest change of their key at or before their time.

    Both are dealt by key and span of time and sorted once; a span begins with the last change before it, which a window
    over one row a key and span carries forward. So a key with most of the events is one task a span. Changes without a
    time never apply, and events without one have none.
    """
    from pyspark.sql import Window

    extra = [c for c in changes.columns if c not in (on, time)]
    span = F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / span_s).alias("_span")
    right = changes.filter(F.col(time).isNotNull()).select(on, time, span, F.lit(0).alias("_side"), F.struct(*extra).alias("_s"))
    left = events.select(*events.columns, span, F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_s"].dataType).alias("_s"))
    last = right.groupBy(on, "_span").agg(F.max_by("_s", time).alias("_s"))
    spots = left.filter("_span IS NOT NULL").select(on, "_span").distinct().select(on, "_span", F.lit(None).cast(right.schema["_s"].dataType).alias("_s")).unionByName(last).groupBy(on, "_span").agg(F.first("_s", ignorenulls=True).alias("_s"))
    before = Window.partitionBy(on).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spots.withColumn("_s", F.last("_s", ignorenulls=True).over(before)).filter("_s IS NOT NULL").select(on, F.lit(None).cast(right.schema[time].dataType).alias(time), "_span", F.lit(-1).alias("_side"), "_s")
    w = Window.partitionBy(on, "_span").orderBy(F.col(time).asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right.unionByName(carried), allowMissingColumns=True).withColumn("_s", F.last("_s", ignorenulls=True).over(w))
    return both.filter("_side = 1").select(*events.columns, *[F.col(f"_s.{c}").alias(c) for c in extra])
