"""Connected components of a graph held as a table of edges: large-star and small-star rounds, or one task where the edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Edges of numbers (16 bytes each, 5 MB) that one task joins at most; more go through rounds over all tasks.
ONE_TASK_EDGES = 300_000


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, component of all edges u, v."""
    above: dict = {}

    def top(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for frame in batches:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            p, q = top(u), top(v)
            if p != q:
                above[max(p, q)] = min(p, q)
    nodes = list(above)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pd.DataFrame({"node": part, "component": [top(x) for x in part]})


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: bool = True) -> DataFrame:
    """node, component: each node of an edge with the smallest node that it reaches.

    Each round hooks neighbours to the smallest of a node (pre-aggregated; a hub's edges are dealt over all tasks) and
    writes the edges to the shared folder. Loops and repeated edges don't matter; nulls are not nodes; without edges
    there are no rows. one_task lets few edges of numbers be joined by Python in one task, with the same result; without
    it there are DataFrame functions alone.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    loops = e.filter("u = v").select("u", "v")
    e = common.staged(e.filter("u <> v").distinct(), "edges")
    n, kind = e.count(), e.schema["u"].dataType.simpleString()
    if one_task and n <= ONE_TASK_EDGES and kind in ("int", "bigint"):
        found = common.staged(e.coalesce(1).mapInPandas(_joined, f"node {kind}, component {kind}"), "components")
        common.drop_staged(e)
        return _with_loops(found, loops)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("c"))
        large = common.join_spread(both, least, "u", "c", 2 * n, ("u", "v")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.staged(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
        small = common.join_spread(large, low, "u", "c", large.count(), ("u", "v")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        new = common.staged(small, "edges")
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        common.drop_staged(e, large)
        e, n = new, mark[0]
        if mark == seen:
            break
        seen = mark
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return _with_loops(found.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), loops)


def _with_loops(found: DataFrame, loops: DataFrame) -> DataFrame:
    """Adds nodes that only have edges to themselves."""
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    return found.unionByName(alone.join(found.select("node"), "node", "left_anti"))
