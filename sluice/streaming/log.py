"""What a stream has added to a table so far, as a log of segments that are merged as they age."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import delete

#: Segments of one size that are merged into one of the next size.
WIDTH = 8


def segments(n: int) -> list[tuple[int, int]]:
    """(level, index) of the segments that hold batches 0 to n - 1: the digits of n, so that no list of them is kept anywhere."""
    level = 0
    while WIDTH ** (level + 1) <= n:
        level += 1
    out, at = [], 0
    for k in range(level, -1, -1):
        while at + WIDTH**k <= n:
            out.append((k, at // WIDTH**k))
            at += WIDTH**k
    return out


class Log:
    """Batch n adds a segment; WIDTH segments of a level become one of the next, so a row is written once a level.

    merge(rows) makes one table of several segments and may drop what no later batch needs. A batch that is run again
    overwrites its own segments; those that a merge has made needless are deleted when the next batch begins.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], options: dict[str, str] | None = None):
        self.spark, self.path, self.merge, self.options = spark, path, merge, options or {}

    def _at(self, level: int, index: int) -> str:
        return f"{self.path}/{level}/{index}"

    def read(self, n: int) -> DataFrame | None:
        """All that batches before n have added; None before the first."""
        return self.spark.read.parquet(*[self._at(*s) for s in segments(n)]) if n else None

    def add(self, rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").options(**self.options).parquet(self._at(0, n))
        level = 1
        while (n + 1) % WIDTH**level == 0:
            index = (n + 1) // WIDTH**level - 1
            own = self.spark.read.parquet(*[self._at(level - 1, index * WIDTH + k) for k in range(WIDTH)])
            self.merge(own).write.mode("overwrite").options(**self.options).parquet(self._at(level, index))
            level += 1

    def begin(self, n: int) -> None:
        """Deletes the segments that batches before n, which are done, have merged."""
        level = 1
        while n and n % WIDTH**level == 0:
            index = n // WIDTH**level - 1
            delete(self.spark, *[self._at(level - 1, index * WIDTH + k) for k in range(WIDTH)])
            level += 1
