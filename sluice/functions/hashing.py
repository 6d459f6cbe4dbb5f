"""Hashes that must equal the JVM's: string hash codes, the spread behind A/B buckets, and 32-bit murmur3."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = 0xFFFFFFFF
#: The 32-bit murmur3 finaliser's multipliers, its block multipliers, and the seeds of the Bloom hash (fixed values).
FINAL = (0x85EBCA6B, 0xC2B2AE35)
BLOCK = (0xCC9E2D51, 0x1B873593)
SEEDS = (0, 0x9747B28C)
BUCKETS = 10_000


def string_hash(c: Column) -> Column:
    """The 31-polynomial over UTF-16 units, as an unsigned 32-bit number in a long."""
    units = F.hex(F.encode(c, "UTF-16BE"))
    unit = lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long")
    n = F.length(units) / 4
    numbers = F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda h, i: (h * 31 + unit(i)).bitwiseAND(_MASK))


def _times(h: Column, k: int) -> Column:
    """Product modulo 2^32, by halves so that nothing overflows."""
    high = (F.shiftright(h, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return (high + h.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)).bitwiseAND(F.lit(_MASK))


def spread(h: Column) -> Column:
    """murmur3's finaliser over an unsigned 32-bit number."""
    fold = lambda x, n: x.bitwiseXOR(F.shiftright(x, n))
    steps = F.transform(F.array(fold(h, 16)), lambda x: _times(x, FINAL[0]))
    steps = F.transform(steps, lambda x: fold(x, 13))
    steps = F.transform(steps, lambda x: _times(x, FINAL[1]))
    return F.element_at(F.transform(steps, lambda x: fold(x, 16)), 1)


def ab_bucket(user: Column) -> Column:
    """A user's bucket from 0 to 9999; the sign bit is dropped first."""
    return (spread(string_hash(user)).bitwiseAND(F.lit(0x7FFFFFFF)) % BUCKETS).cast("int")


def murmur3_32(raw: list[bytes], seed: int) -> np.ndarray:
    """murmur3 of many byte strings at once, as unsigned 32-bit numbers."""
    n = np.array([len(r) for r in raw], dtype=np.int64)
    width = max(4, int(-(-max(n.max(initial=0), 1) // 4) * 4))
    held = np.zeros((len(raw), width), dtype=np.uint8)
    for i, r in enumerate(raw):
        held[i, : len(r)] = np.frombuffer(r, dtype=np.uint8)
    words = held.view("<u4").astype(np.uint32)
    rotate = lambda x, k: (x << np.uint32(k)) | (x >> np.uint32(32 - k))
    with np.errstate(over="ignore"):
        h = np.full(len(raw), seed, dtype=np.uint32)
        for j in range(words.shape[1]):
            k = rotate(words[:, j] * np.uint32(BLOCK[0]), 15) * np.uint32(BLOCK[1])
            whole, part = n >= 4 * (j + 1), (n > 4 * j) & (n < 4 * (j + 1))
            h = np.where(whole, rotate(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64), np.where(part, h ^ k, h))
        h ^= n.astype(np.uint32)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(FINAL[0])
        h = (h ^ (h >> np.uint32(13))) * np.uint32(FINAL[1])
        return h ^ (h >> np.uint32(16))


def murmur3_pair(key: Column) -> Column:
    """The two signed 32-bit hashes of a key's UTF-8 bytes, as a struct h1, h2."""

    @F.pandas_udf("struct<h1:int,h2:int>")
    def pair(keys: pd.Series) -> pd.DataFrame:
        raw = [(k or "").encode() for k in keys]
        return pd.DataFrame({f"h{i + 1}": murmur3_32(raw, s).view(np.int32) for i, s in enumerate(SEEDS)})

    return pair(key)
