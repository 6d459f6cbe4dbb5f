"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Row numbers follow (doc_id, size, crc32); the permuted number p of n rows gives shard p mod s and slot p div s,
so any row's place is computable from its number, the row count and the seed, and back again.
The law is `rows`: counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

ROUNDS = 6
#: The odd multipliers and shifts of the murmur3 64-bit finaliser (fixed values).
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(33))


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1)))


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _walk(x: np.ndarray, n: int, seed: int, keys: np.ndarray) -> np.ndarray:
    half = np.uint64(_half_bits(n))
    mask = np.uint64((1 << int(half)) - 1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return (right << half) | left  # halves swapped, so that the reversed keys undo it

    with np.errstate(over="ignore"):
        out = once(np.asarray(x, dtype=np.uint64))
        while (outside := out >= np.uint64(n)).any():
            out[outside] = once(out[outside])
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Where a bijection of 0..n-1 takes each row number; steps that leave the range are walked on until they return."""
    return _walk(rows, n, seed, _keys(seed))


def invert(places: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """The row numbers that permute() takes to these places."""
    return _walk(places, n, seed, _keys(seed)[::-1])


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The row number that stands in a slot of a shard."""
    return int(invert(np.array([slot * shards + shard]), n, seed)[0])


def number_rows(df: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """df with gapless global row numbers from 0 in the given order, and the row count.

    Range partitions are sorted and written once; only their row counts (one number a partition) reach the driver.
    A third of all rows under one sort key still spreads as long as later sort columns differ.
    """
    at = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = common.staged(at, "numbered")
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted((r[0], r[1]) for r in at.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p, n in counts:
        starts[p] = total
        total += n
    if not starts:
        return at.select(*df.columns, F.lit(0).cast("long").alias(name)), 0
    start = F.element_at(F.create_map(*[F.lit(v) for p, s in starts.items() for v in (p, s)]), part) if len(starts) <= 64 else None
    if start is None:
        spark = df.sparkSession
        table = spark.createDataFrame(list(starts.items()), "_p int, _start long")
        at = at.withColumn("_p", part).join(F.broadcast(table), "_p")  # a row a partition
        start = F.col("_start")
    return at.select(*df.columns, (start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias(name)), total


def shard(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, row_no.

    Null texts count as none: size 1 and the crc32 of nothing, as empty ones have. Null ids come first. Very long texts
    count whole. Ties of doc_id are ordered by size and crc32, so repeated rows are interchangeable. An empty table
    gives no rows. Other columns of docs are ignored.
    """
    common.ready(docs.sparkSession)
    raw = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"], (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    sizes = common.staged(rows, "sizes")
    numbered, n = number_rows(sizes, ["doc_id", "size", "text_crc32"])
    common.drop_staged(sizes)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    return numbered.withColumn("_p", place("row_no")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.documents(spark, sf_dir))
