"""A factorisation machine that scores the quality of a text.

A document becomes a sparse vector: hashed words (their frequencies, of length 1), the shares of byte
values, and one entry a structure statistic or metadata column for the range that its value falls in.
The machine adds a weight for every entry and the product of low-rank factors for every two entries;
by the sum-of-squares identity, 0.5 * sum_f ((sum v x)^2 - sum (v x)^2), a score takes time linear in
the entries. It is trained here, by Adagrad on a bounded sample of labelled rows: the FIT_ROWS of
least hash of their id (a parameter). Scores of all documents come from one pass over the texts.

Defined cases: a null text counts as empty, a null metadata value is a range of its own; null labels
are passed over; several labels of an id count as their largest; without labelled rows of both kinds
the machine has the prior of those there are (0.5 without any); repeated rows are scored one by one; a
very long text is read whole, in memory in proportion to it; an empty table gives an empty result; other
columns are only carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, lean, table

FIT_ROWS = 6_000
WORD_BITS = 15
RANK = 8
EPOCHS = 6
#: Least score of documents predicted as good.
GOOD_FROM = 0.3

_WORDS = 1 << WORD_BITS
_RANGES = 24
_BYTES_AT = _WORDS
_STATS_AT = _WORDS + 256
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)


def _repeat_share(h: np.ndarray, n: int) -> float:
    """Share of the n-word windows that another one before them equals."""
    if len(h) <= n:
        return 0.0
    g = sum(h[i : len(h) - n + 1 + i] * _MIX[i] for i in range(n))
    return 1 - len(np.unique(g)) / len(g)


def _share_range(x: float) -> int:
    """Ranges for shares from 0 to 1, finer near 0."""
    return 0 if x <= 0 else min(_RANGES - 1, 1 + int(22 * x**0.5))


def _size_range(x: float) -> int:
    return min(_RANGES - 1, int(1.5 * np.log2(1 + max(x, 0))))


def vector(text: str | None, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray]:
    """Indices (sorted, each once) and values."""
    raw = (text or "").encode()
    low = raw.lower()
    split = low.split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
    idx, tf = np.unique(h >> np.uint64(64 - WORD_BITS), return_counts=True)
    tf = np.sqrt(tf)
    tf /= max(np.sqrt((tf * tf).sum()), 1e-9)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    share = hist / max(len(raw), 1)
    seen = np.flatnonzero(hist)
    lines = low.split(b"\n")
    n, letters = max(len(split), 1), max(int(hist[65:91].sum() + hist[97:123].sum()), 1)
    stats = [
        _size_range(len(split)),
        _size_range(len(lines)),
        _share_range(min(1.0, (len(low) / n) / 20)),
        _share_range(len(idx) / n),
        _share_range(_repeat_share(h, 2)),
        _share_range(_repeat_share(h, 4)),
        _share_range(1 - len(set(lines)) / len(lines)),
        _share_range(hist[65:91].sum() / letters),
        _share_range(hist[48:58].sum() / max(len(raw), 1)),
        _share_range(hist[128:].sum() / max(len(raw), 1)),
        _share_range(min(1.0, (hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / n / 4)),
        _share_range(hist[32] / max(len(raw), 1)),
    ] + [_RANGES - 1 if m is None else min(_RANGES - 2, _size_range(float(m))) for m in metadata]
    stats = np.array(stats) + _STATS_AT + _RANGES * np.arange(len(stats))
    at = np.concatenate([idx.astype(np.int64), seen + _BYTES_AT, stats])
    return at, np.concatenate([tf, np.sqrt(share[seen]), np.full(len(stats), 0.5)])


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        total = vx.sum(0)
        return float(self.bias + self.w[at] @ x + 0.5 * (total @ total - np.einsum("ij,ij->", vx, vx)))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(at, x), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_metadata: int, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-5, batch: int = 64) -> Machine:
    size = _STATS_AT + _RANGES * (12 + n_metadata)
    good = float(labels.mean()) if len(labels) else 0.5
    prior = float(np.log((good * len(labels) + 0.5) / ((1 - good) * len(labels) + 0.5)))
    rng = np.random.default_rng(7)
    m = Machine(prior, np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    if not rows or not 0 < good < 1:
        return Machine(prior, m.w, np.zeros((size, rank)))
    gb, gw, gv = 1e-3, np.full(size, 1e-3), np.full((size, rank), 1e-3)
    for _ in range(epochs):
        for part in np.array_split(order := rng.permutation(len(rows)), max(1, len(order) // batch)):
            at, x = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            ends = np.cumsum([0] + [len(rows[i][0]) for i in part])
            vx = m.v[at] * x[:, None]
            total = np.add.reduceat(vx, ends[:-1])
            margin = m.bias + np.add.reduceat(m.w[at] * x, ends[:-1]) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), ends[:-1]))
            off = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[part]
            each = np.repeat(off, np.diff(ends)) / len(part)
            some, where = np.unique(at, return_inverse=True)
            dw = np.bincount(where, each * x, len(some)) + decay * m.w[some]
            step = (each * x)[:, None] * (np.repeat(total, np.diff(ends), axis=0) - vx)
            dv = np.stack([np.bincount(where, step[:, f], len(some)) for f in range(rank)], 1) + decay * m.v[some]
            db = off.mean()
            gb += db * db
            gw[some] += dw * dw
            gv[some] += dv * dv
            m.bias -= rate * db / gb**0.5
            m.w[some] -= rate * dw / np.sqrt(gw[some])
            m.v[some] -= rate * dv / np.sqrt(gv[some])
    return m


def vectors(docs: DataFrame, text: str, metadata: tuple[str, ...], carry: list[str]) -> DataFrame:
    source = docs.select(*carry, F.col(text).alias("_text"), *(F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(metadata)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(carry)]] + ["_at binary, _x binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, extra = b.column(len(carry)), b.columns[len(carry) + 1 :]
            got = [vector(t.as_py(), tuple(c[i].as_py() for c in extra)) for i, t in enumerate(texts)]
            packed = [pa.array([at.astype(np.int32).tobytes() for at, _ in got], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in got], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *packed], names=[*b.schema.names[: len(carry)], "_at", "_x"])

    return source.mapInArrow(lean(run), schema)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), doc_id: str = "doc_id", label: str = "quality", rows: int = FIT_ROWS) -> Machine:
    """Labels (doc_id, label) must be those that may be learnt from; at most `rows` of them are."""
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    some = bounded_sample(known, F.col("_id"), rows)
    joined = docs.join(F.broadcast(some), F.col(doc_id) == F.col("_id"))  # `rows` bounds it
    got = vectors(joined, text, metadata, ["_id", "_y"]).orderBy(F.xxhash64("_id"), "_id").limit(rows).collect()
    pairs = [(np.frombuffer(r["_at"], np.int32).astype(np.int64), np.frombuffer(r["_x"], np.float32).astype(np.float64)) for r in got]
    return fit(pairs, np.array([float(r["_y"]) for r in got]), len(metadata))


def scored(docs: DataFrame, machine: Machine, text: str = "text", metadata: tuple[str, ...] = ("n_chars",), carry: list[str] | None = None, out: str = "score") -> DataFrame:
    """The columns `carry` (all, if None) and the score, from 0 to 1."""
    carry = list(docs.columns) if carry is None else carry
    source = docs.select(*carry, F.col(text).alias("_text"), *(F.col(m).cast("double").alias(f"_m{i}") for i, m in enumerate(metadata)))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(carry)]] + [f"`{out}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts, extra = b.column(len(carry)), b.columns[len(carry) + 1 :]
            got = [m.score(*vector(t.as_py(), tuple(c[i].as_py() for c in extra))) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(got, pa.float64())], names=[*b.schema.names[: len(carry)], out])

    return source.mapInArrow(lean(run), schema)


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").filter(fold != 0)
    got = scored(docs, train(docs, labels), carry=["doc_id"])
    return got.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


SQL = None
