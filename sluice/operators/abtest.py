"""A/B variants by a user's bucket."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import BUCKETS, ab_bucket


def thresholds(variants: Mapping[str, float]) -> list[tuple[str, int]]:
    """Variants by name with the bucket that each ends before: the shares' running sum in doubles, cut to whole buckets."""
    if not variants:
        raise ValueError("no variants")
    out, total = [], 0.0
    for name in sorted(variants, key=lambda n: n.encode("utf-16-be", "surrogatepass")):  # as the JVM orders text
        total += variants[name]
        out.append((name, int(total * BUCKETS)))
    return out


def variant_of(user: Column, variants: Mapping[str, float]) -> Column:
    """The first variant whose threshold lies above the user's bucket; the last one beyond all."""
    steps = thresholds(variants)
    if len(steps) == 1:
        return F.lit(steps[0][0])
    bucket, out = ab_bucket(user), F.lit(steps[-1][0])
    for name, end in reversed(steps):
        out = F.when(bucket < end, name).otherwise(out)
    return out


def variant_by_map(user: Column, variants: Column) -> Column:
    """The same for variants that differ by row, as a map column; null for an empty map."""
    entries = F.array_sort(F.transform(F.map_entries(variants), lambda e: F.struct(F.hex(F.encode(e["key"], "UTF-16BE")).alias("rank"), e["key"].alias("key"), e["value"].alias("value"))))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(None).cast("string").alias("found"))
    bucket = ab_bucket(user)
    pick = F.aggregate(
        entries, start,
        lambda s, e: F.struct((s["total"] + e["value"]).alias("total"), F.coalesce(s["found"], F.when(bucket < ((s["total"] + e["value"]) * BUCKETS).cast("int"), e["key"])).alias("found")),
        lambda s: s["found"],
    )
    return F.coalesce(pick, F.try_element_at(entries, F.lit(-1))["key"])


def distribution(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
