"""Connected components of an edge table, by rounds of joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import BROADCAST_ROWS, durable


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b): component is the least node that it reaches.

    Up to BROADCAST_ROWS edges are joined up in a single task, which holds them in a few MB;
    more take rounds of joins over all executors. Both give the same rows.
    """
    links = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if links.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return links.coalesce(1).mapInPandas(_joined, "node long, component long")
    return in_rounds(links)


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union by least node of all links of the one partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"node": list(root), "component": [find(x) for x in root]}, dtype="int64")


def in_rounds(links: DataFrame) -> DataFrame:
    """The same for any number of links (u > v).

    Each round links every node's greater neighbours, then the node and its lesser ones, to
    the least of them (large star, small star), until a round changes nothing. The number of rounds
    grows with the logarithm of the longest path, and no group is collected.
    """
    before = _signature(links)
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        links = durable(small.where("u <> v").distinct())
        now = _signature(links)
        if now == before:
            break
        before = now
    roots = links.groupBy("u").agg(F.min("v").alias("component"))
    return roots.select(F.col("u").alias("node"), "component").union(roots.select("component", "component").distinct())


def _signature(links: DataFrame) -> tuple:
    """A count and a sum that stay the same when a round has changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
