"""Connected components of a table of links.

Every partition first contracts its own links to a forest. Up to `one_task` links that are
left (about 200 bytes each as Python objects) are contracted in one task; more go through alternating large and
small stars, with equal results. There, each round is two joins of the links with each node's least neighbour; the links are
written to the shared folder between rounds, and only a count and a checksum come to
the driver. A node with very many links is no group of its own in any task: least
neighbours are pre-aggregated, and the join's hot side can be split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _mark(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("x")).first()
    return r["n"], r["x"]


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour v of a node u is linked with the least of u and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """u > v. u and its smaller neighbours are linked with the least of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()


class Forest:
    """Union-find by least node."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, root = self.up, x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.up.setdefault(min(a, b), min(a, b))

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        nodes = [x for x in self.up if self.find(x) != x]
        return np.array(nodes, np.int64), np.array([self.up[x] for x in nodes], np.int64)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.link(u, v)
        if len(forest.up) > 500_000:  # about 100 MB
            u, v = forest.edges()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            forest = Forest()
    u, v = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", one_task: int = 500_000) -> DataFrame:
    """(node, comp) of every node that has a link with another; comp is the least node reachable."""
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    now = scratch.keep(pairs.mapInArrow(_contract, "u long, v long"))
    if now.count() <= one_task:
        before, now = now, scratch.keep(now.coalesce(1).mapInArrow(_contract, "u long, v long"))
        scratch.forget(before)
        return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
    mark = _mark(now)
    while mark[0]:
        older, now = now, scratch.keep(_small(_large(now)))
        scratch.forget(older)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
