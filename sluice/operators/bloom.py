"""Bloom filters: bitmaps that tasks make of their own keys, merged by words of 64 bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.hashing import SEEDS, murmur3_32
from .dedup import KEY

#: Words of a bitmap that tasks hold as one array (8 MB) at most; a larger one stays a table and is joined by word.
BROADCAST_WORDS = 1_000_000


def bit_count(n: int, p: float) -> int:
    if n <= 0 or not 0 < p < 1:
        raise ValueError("insertions must be positive and the rate between 0 and 1")
    return max(1, math.ceil(-n * math.log(p) / math.log(2) ** 2))


def hash_count(bits: int, n: int) -> int:
    return max(1, math.floor(bits / n * math.log(2) + 0.5))


def bit_count_of(n: Column, p: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(-n * F.log(p) / F.pow(F.log(F.lit(2.0)), F.lit(2)))).cast("long")


def hash_count_of(bits: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(bits / n * F.log(F.lit(2.0)) + 0.5)).cast("int")


def expected_rate(inserted: Column, bits: Column, hashes: Column) -> Column:
    """The false positive rate after so many insertions; 0 when empty."""
    return F.when(inserted == 0, 0.0).otherwise(F.pow(1 - F.exp(-hashes * inserted / bits), hashes))


def places(keys: list[str | None], bits: int, hashes: int) -> np.ndarray:
    """Where each key sets its bits (keys x hashes): the first hash and multiples of the second, in signed 32 bits."""
    raw = [(k or "").encode() for k in keys]
    first, second = (murmur3_32(raw, s).astype(np.int64) for s in SEEDS)
    at = (first[:, None] + np.arange(hashes) * second[:, None]) & 0xFFFFFFFF
    return np.where(at >= 2**31, at - 2**32, at) % bits


def _words(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that hold these places, and their bits."""
    at = np.unique(at)
    word = at >> 6
    start = np.flatnonzero(np.diff(word, prepend=-1))
    return word[start], np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)), start) if len(at) else np.zeros(0, np.uint64)


def _key(keys: DataFrame) -> Column:
    return F.concat_ws(":", *[keys[k].cast("string") for k in KEY])


@dataclass(frozen=True)
class Bloom:
    """bitmap: words of 64 bits, or words: a table (word, bits) of them where they are many; inserted counts additions, repeats included."""

    bits: int
    hashes: int
    inserted: int
    bitmap: np.ndarray | None = None
    words: DataFrame | None = None

    def might_contain(self, keys: DataFrame) -> DataFrame:
        """keys with might_contain; false means certainly absent. A bitmap is probed in one pass without a shuffle."""
        if self.bitmap is None:
            return self._joined(keys)
        bits, hashes, held = self.bits, self.hashes, keys.sparkSession.sparkContext.broadcast(self.bitmap)
        schema = StructType([*keys.schema.fields, StructField("might_contain", BooleanType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = places(batch.column(batch.num_columns - 1).to_pylist(), bits, hashes)
                hit = ((held.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(hit)], names=[*batch.schema.names[:-1], "might_contain"])

        return keys.withColumn("_key", _key(keys)).mapInArrow(run, schema)

    def _joined(self, keys: DataFrame) -> DataFrame:
        """Distinct keys meet their words by shuffle, and the answer is joined back by key."""
        own = keys.select(*KEY).distinct()
        at = own.select(*KEY, _places_udf(self.bits, self.hashes)(_key(own)).alias("at")).select(*KEY, F.explode("at").alias("at"))
        probe = at.select(*KEY, F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).join(self.words, "word", "left")
        hit = F.coalesce(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.lit(False))
        return keys.join(probe.groupBy(*KEY).agg(F.bool_and(hit).alias("might_contain")), KEY)


def _places_udf(bits: int, hashes: int):
    @F.pandas_udf("array<long>")
    def found(keys: pd.Series) -> pd.Series:
        return pd.Series(list(places(keys.tolist(), bits, hashes)))

    return found


def build(keys: DataFrame, expected: int, rate: float) -> Bloom:
    """A filter of the keys. Each Arrow batch becomes the words that it sets, which are merged in the tasks first; one pass where the bitmap is small."""
    bits = bit_count(expected, rate)
    hashes = hash_count(bits, expected)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                word, held = _words(places(batch.column(0).to_pylist(), bits, hashes).ravel())
                n = np.zeros(len(word), np.int64)
                n[0] = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64)), pa.array(n)], names=["word", "bits", "n"])

    set_ = keys.select(_key(keys).alias("k")).mapInArrow(run, "word long, bits long, n long")
    words = set_.groupBy("word").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    if bits // 64 + 1 > BROADCAST_WORDS:
        return Bloom(bits, hashes, keys.count(), words=words.select("word", "bits"))
    table = words.toArrow()
    bitmap = np.zeros(bits // 64 + 1, dtype=np.uint64)
    bitmap[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return Bloom(bits, hashes, int(table.column("n").to_numpy().sum()), bitmap=bitmap)
