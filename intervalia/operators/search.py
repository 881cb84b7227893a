"""The targets that can be an item's best, found in a tree over its partition's targets instead of among all pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

Cols = list[str]
#: Targets, and items, that a group holds at most (small partitions share one); children of a node; pairs judged at a time.
BLOCK, FAN, PAIRS = 32_768, 16, 1 << 18
NEVER = np.iinfo(np.int64).max


def _codes(a: pa.Table, b: pa.Table, on: Cols) -> tuple[np.ndarray, np.ndarray]:
    """The rows' partitions as numbers, the same in both tables."""
    code = np.zeros(len(a) + len(b), np.int64)
    for c in on:
        one = pa.concat_arrays([*a[c].chunks, *b[c].chunks]).dictionary_encode()
        code = np.unique(code * len(one.dictionary) + one.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return code[: len(a)], code[len(a) :]


class Tree:
    """Targets in the order of partition and place, `FAN` to a node, and nodes likewise, each with the least and largest of every column."""

    def __init__(self, rows: np.ndarray, columns: dict[str, np.ndarray], x: str, y: str) -> None:
        part = columns["part"][rows]
        by_x = np.lexsort((columns[x][rows], part))
        _, first, n = np.unique(part[by_x], return_index=True, return_counts=True)
        slab = np.empty(len(rows), np.int64)
        slab[by_x] = (np.arange(len(rows)) - np.repeat(first, n)) // np.repeat(np.ceil(np.sqrt(n * FAN)).astype(np.int64), n)
        self.rows = rows[np.lexsort((columns[y][rows], slab, part))]
        self.levels = [({k: v[self.rows] for k, v in columns.items()},) * 2]
        while len(self.levels[-1][0]["part"]) > FAN:
            lo, hi = self.levels[-1]
            at = np.arange(0, len(lo["part"]), FAN)
            self.levels.append(({k: np.minimum.reduceat(v, at) for k, v in lo.items()}, {k: np.maximum.reduceat(v, at) for k, v in hi.items()}))

    def key(self, score: Callable, items: dict[str, np.ndarray], level: int, i: np.ndarray, node: np.ndarray, skip: np.ndarray | None) -> list[np.ndarray]:
        """The least (a, b, p) that a target in the node can have for the item; that of the target itself on level 0."""
        lo, hi = self.levels[level]
        a, b = score(lambda k: items[k][i], lambda k: lo[k][node], lambda k: hi[k][node])
        p, part = lo["p"][node], items["part"][i]
        out = (part < lo["part"][node]) | (part > hi["part"][node])
        if skip is not None and level == 0:
            out |= node == skip[i]
        return [np.where(out, np.inf, a), np.where(out, np.inf, b), np.where(out, NEVER, p)]

    def best(self, score: Callable, items: dict[str, np.ndarray], skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place (in `rows`; -1: none) and a of each item's target of least (a, b, p), other than the one to skip."""
        n = len(items["part"])
        found, a, b, p = np.full(n, -1), np.full(n, np.inf), np.full(n, np.inf), np.full(n, NEVER)
        if not len(self.rows):
            return found, a

        def spread(level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The children of nodes of the level above: which node's, and where."""
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            ok = child < len(self.levels[level][0]["part"])
            return np.repeat(np.arange(len(node)), FAN)[ok], child[ok]

        def least(i: np.ndarray, key: list[np.ndarray]) -> np.ndarray:
            """Where the pair of least key stands, for each item that has one."""
            order = np.lexsort((key[2], key[1], key[0], i))
            return order[np.flatnonzero(np.diff(i[order], prepend=-1))]

        def settle(i: np.ndarray, node: np.ndarray, key: list[np.ndarray]) -> None:
            at = least(i, key)
            at = at[less(i[at], [k[at] for k in key])]
            found[i[at]] = node[at]
            a[i[at]], b[i[at]], p[i[at]] = (k[at] for k in key)

        def less(i: np.ndarray, key: list[np.ndarray]) -> np.ndarray:
            return (key[0] < a[i]) | ((key[0] == a[i]) & ((key[1] < b[i]) | ((key[1] == b[i]) & (key[2] < p[i]))))

        def walk(level: int, i: np.ndarray, node: np.ndarray) -> None:
            for s in range(0, len(i), PAIRS):
                i_, node_ = i[s : s + PAIRS], node[s : s + PAIRS]
                key = self.key(score, items, level, i_, node_, skip)
                keep = less(i_, key)
                if level == 0:
                    settle(i_[keep], node_[keep], [k[keep] for k in key])
                elif keep.any():
                    i_, node_ = i_[keep], node_[keep]
                    for t in range(0, len(i_), PAIRS // FAN):
                        of, child = spread(level - 1, node_[t : t + PAIRS // FAN])
                        walk(level - 1, i_[t : t + PAIRS // FAN][of], child)

        top = len(self.levels) - 1
        roots = len(self.levels[top][0]["part"])
        for s in range(0, n, PAIRS // FAN):
            own = np.arange(s, min(n, s + PAIRS // FAN))
            i, node = np.repeat(own, roots), np.tile(np.arange(roots), len(own))
            for level in range(top, -1, -1):  # straight down, for a good target to measure the others by
                key = self.key(score, items, level, i, node, skip)
                if level == 0:
                    settle(i, node, key)
                else:
                    at = least(i, key)
                    of, child = spread(level - 1, node[at])
                    i, node = i[at][of], child
            if top:
                walk(top, np.repeat(own, roots), np.tile(np.arange(roots), len(own)))
        return found, a


def candidates(items: DataFrame, targets: DataFrame, on: Cols, order: list[Column], asked: dict[str, Column], held: dict[str, Column], axes: tuple[str, str], score: Callable, second: Column | None = None) -> DataFrame:
    """items joined with targets, without the pairs that can't matter: of an item's targets there stay the first one by (a, b, order)
    and, where its a is not below 0, the first two of those for which `second` holds (they aren't in the first choice).

    score(q, lo, hi) gives a and b from functions that take a name: q of `asked`, lo and hi of `held` (doubles, the target's own where
    both agree); for wider bounds, neither may be above what a target inside has, as a pair. axes: the two of `held` to sort targets by.
    Targets of a partition beyond BLOCK are dealt into blocks, items into chunks; each block gives its own candidates. Small partitions
    share a group, so what a worker holds is bounded.
    """
    ship(items.sparkSession)
    q, t = [*on, *(c for c in items.columns if c not in on)], [c for c in targets.columns if c not in on]
    items = items.select("*", *(c.cast("double").alias(f"_q_{k}") for k, c in asked.items()))
    targets = targets.select("*", *(c.cast("double").alias(f"_t_{k}") for k, c in held.items()), (F.lit(False) if second is None else second).alias("_second"))
    targets = targets.withColumn("_p", F.row_number().over(Window.partitionBy(*on).orderBy(*order)).cast("long"))
    many = lambda n: F.ceil(F.col(n) / BLOCK)
    parts = items.groupBy(*on).agg(F.count(F.lit(1)).alias("_ni")).join(targets.groupBy(*on).agg(F.count(F.lit(1)).alias("_nt")), on)
    parts = parts.crossJoin(parts.agg(F.ceil(F.sum(F.col("_ni") + F.col("_nt")) / BLOCK).alias("_groups")))
    code = F.xxhash64(*on)
    parts = parts.select(*on, many("_nt").alias("_blocks"), many("_ni").alias("_chunks"), "_groups")
    parts = parts.withColumn("_group", F.when((F.col("_blocks") == 1) & (F.col("_chunks") == 1), F.pmod(code, F.col("_groups"))).otherwise(code)).drop("_groups")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    hashed = F.xxhash64(*(f.name for f in items.schema.fields if "map<" not in f.dataType.simpleString()))
    i = items.join(parts, on).withColumns({"_chunk": F.pmod(hashed, F.col("_chunks")), "_block": upto("_blocks")}).drop("_blocks", "_chunks")
    s = targets.join(parts, on).withColumns({"_chunk": upto("_chunks"), "_block": F.floor((F.col("_p") - 1) / BLOCK)}).drop("_blocks", "_chunks").withColumnRenamed("_group", "_at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*(items.schema[c] for c in q), *(targets.schema[c] for c in t)])
    names = list(asked), list(held)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        mine, theirs = _codes(left, right, on)
        point = {k: left[f"_q_{k}"].to_numpy() for k in names[0]} | {"part": mine}
        box = {k: right[f"_t_{k}"].to_numpy() for k in names[1]} | {"part": theirs, "p": right["_p"].to_numpy()}
        other = right["_second"].to_numpy()
        first, rest = (Tree(np.flatnonzero(w), box, *axes) for w in (~other, other))
        with np.errstate(invalid="ignore"):
            found, a = first.best(score, point)
            pairs = [(np.arange(len(left)), found, first)]
            if len(rest.rows):
                open_ = np.flatnonzero(~(a < 0))
                point = {k: v[open_] for k, v in point.items()}
                one, _ = rest.best(score, point)
                two, _ = rest.best(score, point, one)
                pairs += [(open_, one, rest), (open_, two, rest)]
        at = np.concatenate([i[j >= 0] for i, j, _ in pairs])
        to = np.concatenate([tree.rows[j[j >= 0]] for _, j, tree in pairs])
        return pa.Table.from_arrays([*left.select(q).take(at).columns, *right.select(t).take(to).columns], names=[*q, *t])

    return i.groupBy("_group", "_block", "_chunk").cogroup(s.groupBy("_at", "_block", "_chunk")).applyInArrow(run, schema)


def away(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The distance of a place from a range, infinite where there is none."""
    d = np.maximum(np.maximum(lo - q, q - hi), 0.0)
    d[np.isnan(d)] = np.inf
    return d
