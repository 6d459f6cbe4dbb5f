"""Counters as aggregates: batch rows, and observations that ride along with a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..model import STATUSES


def observed(df: DataFrame, name: str = "pipeline", **counts) -> tuple[DataFrame, Observation]:
    """df, and an observation that has the counts once df has run: no second pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), seen


def campaign_counts(campaigns: DataFrame) -> DataFrame:
    return campaigns.agg(F.count(F.lit(1)).alias("campaigns"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
