"""Near-duplicate embeddings by an epsilon grid order join.

Unit vectors of cosine c or more are at most eps = sqrt(2 - 2c) apart. They are projected onto their
leading principal directions (from a bounded sample, FIT_ROWS rows and FIT_BYTES bytes; any directions
are right, good ones are fast) and sorted by their cells there, FINER to a side of eps. The sorted
sequence is cut into blocks of BLOCK_BYTES, with the box that each fills; sequence intervals are halved
top down, level by level, and pairs whose boxes are more than eps apart are skipped with all they hold.
A pair of blocks that remains is a task's work: there the two intervals are halved on in the same way,
down to INTERVAL vectors, whose cosines are then taken in double precision. Blocks are large, as
directions that tell little apart leave most pairs of blocks, and each is sent once for every other.

Equal vectors are represented by one of them, counted with its copies. A task returns the number of
links of each vector and a forest of what is linked, never the pairs.

Defined cases: vectors that are null, empty or zero, or hold a null or a component that isn't finite,
link with nothing; shorter vectors count as padded by zeros; -0.0 equals 0.0; rows that repeat an id
are vectors of their own; a vector whose id is null links as any other, and has the least id of its
component that isn't null; very long vectors make blocks of fewer vectors (one at least); an empty
table gives an empty result; only id and vector are read, so that other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, lean, stash, table
from .components import components, joined_labels

COSINE = 0.95
FIT_ROWS, FIT_BYTES = 4096, 16 << 20
#: Leading principal directions with cells, cells to eps, bytes of a block, vectors in an interval that is halved no more.
DIMENSIONS, FINER, BLOCK_BYTES, INTERVAL = 10, 3, 4 << 20, 128
FANOUT = 8


def directions(sample: np.ndarray, n: int = DIMENSIONS) -> np.ndarray:
    """Orthonormal columns, from the direction of most variance: n at most."""
    return np.linalg.svd(sample - sample.mean(0), full_matrices=False)[2][:n].T


def _unit(vectors: np.ndarray) -> np.ndarray:
    # by a power of two, which is exact: the squares of very small or large numbers don't fit a double
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None])
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _unpack(values: list[bytes], dim: int, kind: str) -> np.ndarray:
    """Rows of doubles from packed components; kind is that in which they are packed."""
    out = np.zeros((len(values), dim))
    for i, v in enumerate(values):
        x = np.frombuffer(v, kind)
        out[i, : len(x)] = x
    return out


def _gap(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """Square of the least distance between boxes."""
    return (np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a)) ** 2).sum(-1)


def _blocks(vectors: DataFrame, turn: np.ndarray, eps: float, dim: int, size: int, kind: str) -> DataFrame:
    """part, block, box and content of each block of the sorted sequence."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.clip(np.floor(_unit(_unpack(b.column("v").to_pylist(), dim, kind)) @ turn * FINER / eps) + 32, 0, 63).astype(np.int64)
            key = np.zeros(len(cell), np.int64)
            for j in range(turn.shape[1]):
                key = key << 6 | cell[:, j]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], names=[*b.schema.names, "key"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def put(rows: list[tuple]) -> pa.RecordBatch:
            x = _unpack([v for _, v, _ in rows], dim, kind)
            r = _unit(x) @ turn
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            row = [part, (part << 24) + number, r.min(0).tolist(), r.max(0).tolist(), np.array([k for k, _, _ in rows], np.int64).tobytes(), x.astype(kind).tobytes(), np.array([c for _, _, c in rows], np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "lo", "hi", "ks", "xs", "copies"])

        for b in batches:
            held += zip(b.column("k").to_pylist(), b.column("v").to_pylist(), b.column("copies").to_pylist(), strict=True)
            while len(held) >= size:
                yield put(held[:size])
                held, number = held[size:], number + 1
        if held:
            yield put(held)

    schema = "part long, block long, lo array<double>, hi array<double>, ks binary, xs binary, copies binary"
    in_order = vectors.mapInArrow(lean(keyed), "k long, v binary, copies long, key long").repartitionByRange("key", "k").sortWithinPartitions("key", "k")
    return in_order.select("k", "v", "copies").mapInArrow(lean(cut), schema)


def _near_pairs(blocks: DataFrame, eps: float) -> DataFrame:
    """(a, b), a <= b: blocks whose boxes are at most eps apart, found by splitting sequence intervals from the top."""
    boxes = blocks.select(F.col("part").alias("up"), F.col("block").alias("node"), "lo", "hi")
    g = len(boxes.select("lo").first()["lo"])
    levels = [boxes]
    while True:
        low = levels[-1]
        whole = low.groupBy("up").agg(*(F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(g)), *(F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(g)))
        whole = whole.select(
            F.expr(f"up DIV {FANOUT}").alias("up"), F.col("up").alias("node"), F.array(*(f"l{i}" for i in range(g))).alias("lo"), F.array(*(f"h{i}" for i in range(g))).alias("hi")
        )
        whole = stash(whole, "grid-level")
        levels.append(whole)
        if not whole.filter("up <> 0 OR node <> 0").limit(1).collect():
            break
    pairs = levels.pop().select(F.col("node").alias("a"), F.col("node").alias("b"))
    while levels:
        low = levels.pop()
        one = low.select(F.col("up").alias("up_a"), F.col("node").alias("x"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
        two = low.select(F.col("up").alias("up_b"), F.col("node").alias("y"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        both = pairs.join(one, F.col("a") == F.col("up_a")).join(two, F.col("b") == F.col("up_b")).filter("x <= y")
        gap = sum(F.pow(F.greatest(F.lit(0.0), F.col("lo_a")[i] - F.col("hi_b")[i], F.col("lo_b")[i] - F.col("hi_a")[i]), F.lit(2.0)) for i in range(g))
        pairs = stash(both.filter(gap <= eps * eps).select(F.col("x").alias("a"), F.col("y").alias("b")), "grid-pairs")
    return pairs


def near_intervals(a: np.ndarray, b: np.ndarray, eps: float, same: bool, size: int) -> np.ndarray:
    """Rows (i, j): intervals of `size` rows of a and b whose boxes are at most eps apart, from the whole by halves."""

    def levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        cuts = np.arange(0, len(x), size)
        out = [(np.minimum.reduceat(x, cuts), np.maximum.reduceat(x, cuts))]
        while len(out[-1][0]) > 1:
            halves = np.arange(0, len(out[-1][0]), 2)
            out.append((np.minimum.reduceat(out[-1][0], halves), np.maximum.reduceat(out[-1][1], halves)))
        return out

    of_a, of_b = levels(a), levels(b)
    pairs = np.zeros((1, 2), np.int64)
    for level in range(max(len(of_a), len(of_b)) - 1, -1, -1):
        (lo_a, hi_a), (lo_b, hi_b) = of_a[min(level, len(of_a) - 1)], of_b[min(level, len(of_b) - 1)]
        pairs = pairs[(pairs[:, 0] < len(lo_a)) & (pairs[:, 1] < len(lo_b))]
        if same:
            pairs = pairs[pairs[:, 0] <= pairs[:, 1]]
        i, j = pairs.T
        pairs = pairs[_gap(lo_a[i], hi_a[i], lo_b[j], hi_b[j]) <= eps * eps]
        if level:
            halve = [np.array([[0, 0], [0, 1], [1, 0], [1, 1]])[:, k] if level < len(x) else np.zeros(4, np.int64) for k, x in enumerate((of_a, of_b))]
            double = np.array([2 if level < len(x) else 1 for x in (of_a, of_b)])
            pairs = np.unique((pairs[:, None] * double + np.stack(halve, 1)).reshape(-1, 2), axis=0)
    return pairs


def linked(a: np.ndarray, b: np.ndarray, turned_a: np.ndarray, turned_b: np.ndarray, eps: float, cosine: float, same: bool, size: int = INTERVAL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b of vectors (of length 1) that link, by intervals; for a block with itself, i < j."""
    for x, y in near_intervals(turned_a, turned_b, eps, same, size).tolist():
        i, j = x * size, y * size
        p, q = np.nonzero(a[i : i + size] @ b[j : j + size].T >= cosine)
        p, q = p + i, q + j
        if same and x == y:
            p, q = p[p < q], q[p < q]
        if len(p):
            yield p, q


def _links(pairs: DataFrame, turn: np.ndarray, eps: float, cosine: float, dim: int, interval: int, kind: str) -> DataFrame:
    """(a, links) of each vector with links, and (a, b) of a forest of what links, for every pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {c: batch.column(c)[n].as_py() for c in batch.schema.names}
                same = row["a"] == row["b"]
                sides = "a" if same else "ab"
                k = np.concatenate([np.frombuffer(row[f"ks_{s}"], np.int64) for s in sides])
                copies = np.concatenate([np.frombuffer(row[f"copies_{s}"], np.int64) for s in sides])
                xs = [_unit(np.frombuffer(row[f"xs_{s}"], kind).reshape(-1, dim).astype(float)) for s in sides]
                turned = [x @ turn for x in xs]
                off = 0 if same else len(xs[0])
                links, up = np.zeros(len(k), np.int64), np.arange(len(k))
                for p, q in linked(xs[0], xs[-1], turned[0], turned[-1], eps, cosine, same, interval):
                    q = q + off
                    np.add.at(links, p, copies[q])
                    np.add.at(links, q, copies[p])
                    up = joined_labels(up, p, q)
                has, hangs = np.flatnonzero(links), np.flatnonzero(up != np.arange(len(k)))
                for at, b, count in ((has, None, links), (hangs, k[up], None)):
                    if len(at):
                        values = [pa.nulls(len(at), pa.int64()) if v is None else pa.array(v[at]) for v in (b, count)]
                        yield pa.RecordBatch.from_arrays([pa.array(k[at]), *values], names=["a", "b", "links"])

    return pairs.mapInArrow(lean(run), "a long, b long, links long")


def joined(table_: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, block: int | None = None, interval: int = INTERVAL) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (least id reachable by links).

    block: vectors in a block (as many as BLOCK_BYTES hold, if None)."""
    sound = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0)
    kind = "f4" if table_.schema[vector].dataType.simpleString() == "array<float>" else "f8"  # what is sent; exact
    # -0.0 + 0.0 is 0.0; trailing zeros don't matter
    rows = table_.select(F.col(vec_id).alias("id"), F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"))
    rows = stash(rows.withColumn("v", F.when(F.coalesce(sound, F.lit(False)), F.col("v"))), "grid-rows")
    distinct = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    distinct = stash(distinct.withColumn("k", F.monotonically_increasing_id()), "grid-distinct")
    dim = distinct.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return rows.select(F.col("id").alias(vec_id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    sample = [r["v"] for r in bounded_sample(distinct, F.col("v"), max(1, min(FIT_ROWS, FIT_BYTES // (8 * dim)))).select("v").collect()]
    turn = directions(_unit(_unpack([np.array(v).tobytes() for v in sample], dim, "f8")))
    eps = float(np.sqrt(2 - 2 * cosine) + 1e-6)  # rounding may only add pairs of blocks

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(v, kind).tobytes() for v in b.column(1).to_pylist()], pa.binary()), b.column(2)], names=["k", "v", "copies"])

    packed = distinct.select("k", "v", "copies").mapInArrow(lean(pack), "k long, v binary, copies long")
    blocks = stash(_blocks(packed, turn, eps, dim, block or max(1, BLOCK_BYTES // (8 * dim)), kind), "grid-blocks")
    one = blocks.select(F.col("block").alias("x"), F.col("ks").alias("ks_a"), F.col("xs").alias("xs_a"), F.col("copies").alias("copies_a"))
    two = blocks.select(F.col("block").alias("y"), F.col("ks").alias("ks_b"), F.col("xs").alias("xs_b"), F.col("copies").alias("copies_b"))
    # a block's content goes by the pair, not by the block, so that blocks near many others are spread
    tasks = _near_pairs(blocks, eps).join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y")).drop("x", "y")
    spread = tasks.repartition(int(table_.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("a"), F.col("b"))
    links = stash(_links(spread, turn, eps, cosine, dim, interval, kind), "grid-links")

    root = components(links.filter("b IS NOT NULL").select("a", "b"))
    degree = links.filter("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
    named = distinct.join(degree, F.col("k") == F.col("a"), "left").join(root, F.col("k") == F.col("node"), "left").withColumn("top", F.coalesce("root", "k"))
    named = stash(named.select("v", "least", "copies", "links", "top"), "grid-named")
    first = named.groupBy("top").agg(F.min("least").alias("first")).select(F.col("top").alias("f_top"), "first")
    named = named.join(stash(first, "grid-first"), F.col("top") == F.col("f_top"))  # written, so that a large component's rows can be split
    named = named.select(F.col("v").alias("same"), "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.join(named, F.col("v") == F.col("same"), "left")
    return out.select(F.col("id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("first", "id").alias("component_id"))


def op10_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = joined(table(spark, sf_dir, "embeddings"))
    return got.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = """WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM e JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
