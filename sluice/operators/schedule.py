"""Delayed work: rows with a deadline that fire at the tick which reaches it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fire_tick(deadline_ms: Column, tick_ms: int) -> Column:
    """The first tick at or after the deadline; never before it."""
    return F.ceil(deadline_ms / F.lit(tick_ms)).cast("long") * tick_ms


def slot(time_ms: Column, tick_ms: int, size: int) -> Column:
    return F.pmod(F.floor(time_ms / F.lit(tick_ms)), F.lit(size)).cast("int")


def schedule(requests: DataFrame, time: str = "created_at", delay: str = "delay_ms") -> DataFrame:
    """requests with deadline_ms; no or negative delay is due at once."""
    return requests.withColumn("deadline_ms", F.unix_millis(F.col(time).cast("timestamp")) + F.greatest(F.coalesce(F.col(delay), F.lit(0)), F.lit(0)))


def due(tasks: DataFrame, now_ms: int, tick_ms: int, since_ms: int | None = None) -> DataFrame:
    """Tasks that have fired by now, in the order of firing: not cancelled before, and, if given, not by an earlier call."""
    at = fire_tick(F.col("deadline_ms"), tick_ms)
    rows = tasks.filter(~F.col("cancelled")).withColumn("fired_ms", at).filter(F.col("fired_ms") <= now_ms)
    rows = rows if since_ms is None else rows.filter(F.col("fired_ms") > since_ms)
    return rows.orderBy("fired_ms", "id")


def pending(tasks: DataFrame, now_ms: int, tick_ms: int) -> DataFrame:
    """Tasks that wait: not cancelled and not due."""
    return tasks.filter(~F.col("cancelled") & (fire_tick(F.col("deadline_ms"), tick_ms) > now_ms))


def cancel(tasks: DataFrame, commands: DataFrame) -> DataFrame:
    """tasks with those cancelled that a command names before they fire."""
    at = commands.groupBy("id").agg(F.min("at_ms").alias("_at"))
    return tasks.join(at, "id", "left").withColumn("cancelled", F.col("cancelled") | F.coalesce(F.col("_at") < F.col("deadline_ms"), F.lit(False))).drop("_at")
