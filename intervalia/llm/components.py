"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, stash

#: Nodes that a task links before it passes their forest on.
HELD = 500_000
MAX_ROUNDS = 60


class Forest:
    """Union-find whose roots are the least members."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.root(x) for x in nodes]


def joined_labels(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """up (for each of a set the least that it is known to be linked with), with links a[i] - b[i] added.

    A root hangs from a lesser one, so that all that hangs from it comes along; no link is undone."""
    while len(a):
        x, y = up[a], up[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]
    return up


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges (a > b) that link the same: each task's own forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda f: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in f.edges()], names=["a", "b"])
        f = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f.link(a, b)
            if len(f.up) >= HELD:
                yield made(f)
                f = Forest()
        if f.up:
            yield made(f)

    return edges.select("a", "b").mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node linked with it) of every node of edges (a, b: long, not null) that isn't a root.

    Each round joins nodes with their least neighbour; partial aggregation and Spark's splitting of
    skewed joins keep nodes of many edges from landing in one task. Rounds grow with the logarithm
    of the longest path, and each is written to the shared folder.
    """
    e = stash(forest(edges.filter("a <> b")), "links")
    for _ in range(MAX_ROUNDS):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # nodes with a lesser neighbour; written, as Spark splits a hub's rows only where both sides come from exchanges
        least = stash(both.groupBy("a").agg(F.min("b").alias("m")).filter("m < a").select(F.col("a").alias("n"), "m"), "least")
        large = e.join(least, F.col("b") == F.col("n"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        large = stash(large, "large-star")
        low = stash(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "low")
        small = large.join(low, F.col("a") == F.col("n")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stash(small.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        # done if every node has one edge, to a node without one
        if not e.groupBy("a").count().filter("count > 1").union(e.join(e.select(F.col("a").alias("n")), F.col("b") == F.col("n"), "left_semi").select("a", F.lit(0).cast("long"))).limit(1).collect():
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
