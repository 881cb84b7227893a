"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents become sets of hashed 5-word shingles. Tasks write runs of (token, document) sorted by token
and cut into ranges of tokens; a token that many documents of a run have goes as one entry with their
number, and the run keeps which they are. Per range the runs are merged and tokens of one document only
are dropped. What is left goes back to the documents, with its exact frequency: a document that shares
less than the threshold's part of its set can't be similar to any, and ends here.

The others are ordered from rare to frequent tokens. Similar sets share l tokens or more of the first
n - ceil(0.8 n) + l of each. Each document takes the l of least estimated cost: a longer prefix means
more to read, but sets must then match l times before they are verified. The first of these matches lies
among the first n - ceil(0.8 n) + 1 tokens, so only these bring documents together, however long the
prefix: documents that meet in one of them form families, the units of work. In a family, sets whose
prefixes share the lesser l of the two are compared exactly. Families of over FAMILY documents are
dealt into blocks, and all pairs of blocks into tasks of their own, so that no task holds more than
two blocks. Exact copies of a set are represented by one of them throughout.

Shingles are hashed to 48 bits: a token of one set passes for one of another, different set in a case of
2^48, which changes a result only where the pair lies on the threshold; copies of a set go by 128 bits.

Defined cases: a null or empty text has an empty set, which is linked with nothing; a text of fewer
words than a shingle is one shingle; rows that repeat a doc_id are documents of their own; a document
whose doc_id is null links as any other and has the least id of its class that isn't null; a very long
text is one set, held by one task at a time (8 bytes a shingle, of up to 2^24); an empty table gives an
empty result; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, packed, stash, table
from .components import components, forest, joined_labels

WORDS = 5
PERCENT = 80
#: Tokens that a task holds before it passes on a run, and documents (their numbers take 16 bits).
RUN_TOKENS, RUN_DOCS = 1_000_000, 60_000
#: Cost of verifying a candidate, in postings read; longest match asked for.
VERIFY, MOST_MATCHES = 8.0, 64
FAMILY = 256
#: Documents of a run that must have a token for it to go as one entry; its document number.
HOT, MANY = 32, 0xFFFF
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_BITS = 48


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted (48 bits, in 64-bit numbers)."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    if len(split) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(split), seed=n) >> (64 - _BITS)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, split), np.uint64, len(split))
    g = sum(h[i : len(h) - n + 1 + i] * _MIX[i % 5] for i in range(n))
    g ^= g >> np.uint64(32)
    g *= _MIX[0]
    return np.unique((g ^ (g >> np.uint64(29))) >> np.uint64(64 - _BITS))


def least_overlap(n: int, percent: int = PERCENT) -> int:
    return -(-percent * n // 100)


def matches_asked(df: np.ndarray, n: int, percent: int = PERCENT) -> int:
    """The l of least cost. df: frequencies of the tokens that are shared, in order; those before them are unique."""
    spare = n - least_overlap(n, percent) - (n - len(df))  # tokens of the prefix that may fail to match, and are shared
    most = min(least_overlap(n, percent), MOST_MATCHES, len(df) - spare)
    if most <= 1:
        return 1
    read = np.cumsum(df - 1.0)[np.arange(spare, spare + most)]
    asked = np.arange(1, most + 1)
    return int(asked[np.argmin(read * (1 + VERIFY / asked))])


def _cells(tokens: np.ndarray, docs: np.ndarray, n_cells: int, most: int) -> Iterator[tuple[int | None, int, bytes]]:
    """A run (sorted by token) cut into ranges of tokens: cell, entries and packed content; first, with no cell, its
    tokens of over `most` documents, and who has them."""
    pack = zstandard.ZstdCompressor(level=1)
    _, starts, count = np.unique(tokens, return_index=True, return_counts=True)
    hot = np.repeat(count > most, count)
    if hot.any():
        yield None, int(hot.sum()), pack.compress(tokens[hot].tobytes() + docs[hot].astype(np.uint16).tobytes())
        first = np.zeros(len(tokens), bool)
        first[starts] = True
        keep, docs, times = ~hot | first, np.where(hot, MANY, docs), np.repeat(count, count)
        tokens, docs, times = tokens[keep], docs[keep], times[keep]
    else:
        times = np.zeros(0, np.int64)
    cell = (tokens * np.uint64(n_cells)) >> np.uint64(_BITS)
    cuts = np.flatnonzero(np.diff(cell, prepend=np.uint64(n_cells + 1)))
    for lo, hi in zip(cuts, [*cuts[1:], len(cell)], strict=True):
        t = tokens[lo:hi]
        step = np.diff(t, prepend=t[:1])
        wide = int(step.max()) >= 1 << 32
        many = times[lo:hi][docs[lo:hi] == MANY] if len(times) else times
        body = t[:1].tobytes() + step.astype(np.uint64 if wide else np.uint32).tobytes() + docs[lo:hi].astype(np.uint16).tobytes() + many.astype(np.uint32).tobytes()
        yield int(cell[lo]), int(hi - lo), np.uint32(hi - lo).tobytes() + bytes([wide]) + pack.compress(body)


def _opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, documents and how many documents each entry stands for."""
    n, wide = int(np.frombuffer(blob[:4], np.uint32)[0]), blob[4]
    body = zstandard.ZstdDecompressor().decompress(blob[5:])
    at = 8 + n * (8 if wide else 4)
    t = np.frombuffer(body[8:at], np.uint64 if wide else np.uint32).astype(np.uint64)
    docs = np.frombuffer(body[at : at + 2 * n], np.uint16)
    times = np.ones(n, np.uint32)
    times[docs == MANY] = np.frombuffer(body[at + 2 * n :], np.uint32)
    return np.frombuffer(body[:8], np.uint64)[0] + np.cumsum(t, dtype=np.uint64), docs, times


_SIGN = "run long, idx int, n long, s1 long, s2 long, cell int, body binary"


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    kinds = [("id", id_type), ("run", pa.int64()), ("idx", pa.int32()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("cell", pa.int32()), ("body", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[k for k, _ in kinds])


def _runs(docs: DataFrame, id_name: str, text: str, n_cells: int) -> DataFrame:
    """Rows of documents (body is null), of the cells of runs (id is null), and of their hot tokens (cell is null, too)."""
    source = docs.select(F.col(id_name).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held, seen, size, id_type = [], {}, 0, pa.int64()

        def flush() -> Iterator[pa.RecordBatch]:
            t, d = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
            order = np.argsort(t, kind="stable")
            cells = [(None, number, None, n, None, None, c, body) for c, n, body in _cells(t[order], d[order], n_cells, HOT)]
            for i in range(0, len(cells), 512):
                yield _batch(cells[i : i + 512], id_type)

        for b in batches:
            id_type, rows = b.column(0).type, []
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(x.as_py())
                whole = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and whole not in seen:
                    if size + len(s) > RUN_TOKENS and held or len(held) >= RUN_DOCS:
                        if rows:
                            yield _batch(rows, id_type)
                            rows = []
                        yield from flush()
                        held, seen, size, number = [], {}, 0, number + 1
                    seen[whole] = len(held)
                    held.append(s)
                    size += len(s)
                s1, s2 = np.frombuffer(whole, np.int64).tolist()
                rows.append((i, number, seen.get(whole), len(s), s1, s2, None, None))
            if rows:
                yield _batch(rows, id_type)
        if held:
            yield from flush()

    return source.mapInArrow(lean(run), f"id {source.schema['id'].dataType.simpleString()}, {_SIGN}")


def _shared_tokens(rows: DataFrame) -> DataFrame:
    """Rows without a cell as they are; cells (a cell's runs must follow each other) merged, less the tokens of one
    document: per run, tokens with their frequency."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        now, out, id_type = None, [], pa.int64()
        pack = zstandard.ZstdCompressor(level=1)

        def done() -> None:
            opened = [_opened(body) for _, body in held]
            t = np.concatenate([x for x, _, _ in opened])
            order = np.argsort(t, kind="stable")
            s = t[order]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            df = np.empty(len(t), np.uint32)
            df[order] = np.repeat(np.add.reduceat(np.concatenate([x for _, _, x in opened])[order], starts), np.diff(np.r_[starts, len(s)]))
            at = 0
            for (run, _), (tokens, docs, _) in zip(held, opened, strict=True):
                f = df[at : at + len(tokens)]
                at += len(tokens)
                if (keep := f > 1).any():
                    body = pack.compress(tokens[keep].tobytes() + docs[keep].tobytes() + f[keep].tobytes())
                    out.append((None, run, None, int(keep.sum()), None, None, now, body))
            held.clear()

        for b in batches:
            id_type, plain = b.schema.field("id").type, b.column("cell").is_null()
            if (docs := b.filter(plain)).num_rows:
                yield docs
            rest = b.filter(pc.invert(plain))
            for run, cell, body in zip(rest.column("run").to_pylist(), rest.column("cell").to_pylist(), rest.column("body"), strict=True):
                if cell != now and held:
                    done()
                now = cell
                held.append((run, body.as_py()))
                if len(out) >= 512:
                    yield _batch(out, id_type)
                    out.clear()
        if held:
            done()
        if out:
            yield _batch(out, id_type)

    return rows.mapInArrow(lean(merge), rows.schema)


def _survivors(rows: DataFrame, percent: int) -> DataFrame:
    """n, s1, s2, tokens, df: documents (one of equal sets a run; a run's rows must follow each other) of whose set
    enough is shared, from rare to frequent."""

    def of_run(parts: list[tuple[int, bytes]], hot: list[tuple[int, bytes]], docs: dict) -> Iterator[tuple]:
        ts, ds, fs = [], [], []
        for n, body in parts:
            raw = zstandard.ZstdDecompressor().decompress(body)
            ts.append(np.frombuffer(raw, np.uint64, n))
            ds.append(np.frombuffer(raw, np.uint16, n, 8 * n))
            fs.append(np.frombuffer(raw, np.uint32, n, 10 * n))
        t, d, f = np.concatenate(ts), np.concatenate(ds), np.concatenate(fs)
        many = d == MANY
        if many.any():
            of_hot, order = f[many], np.argsort(t[many])
            whole = [zstandard.ZstdDecompressor().decompress(body) for _, body in hot]
            hot_t = np.concatenate([np.frombuffer(raw, np.uint64, n) for (n, _), raw in zip(hot, whole, strict=True)])
            hot_d = np.concatenate([np.frombuffer(raw, np.uint16, n, 8 * n) for (n, _), raw in zip(hot, whole, strict=True)])
            hot_f = of_hot[order][np.searchsorted(t[many][order], hot_t)]
            t, d, f = (np.concatenate([x[~many], y]) for x, y in ((t, hot_t), (d, hot_d), (f, hot_f)))
        order = np.lexsort((t, f, d))
        t, d, f = t[order], d[order], f[order]
        at = np.searchsorted(d, np.arange(int(d.max()) + 2))
        for idx in range(len(at) - 1):
            n, s1, s2 = docs[idx]
            if at[idx + 1] - at[idx] >= least_overlap(n, percent):
                yield n, s1, s2, t[at[idx] : at[idx + 1]].tobytes(), f[at[idx] : at[idx + 1]].tobytes()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, hot, docs, out = None, [], [], {}, []
        for b in batches:
            for run, idx, n, s1, s2, cell, body in zip(*(b.column(c).to_pylist() for c in ("run", "idx", "n", "s1", "s2", "cell", "body")), strict=True):
                if run != now:
                    if parts:
                        out += of_run(parts, hot, docs)
                    now, parts, hot, docs = run, [], [], {}
                if body is not None:
                    (hot if cell is None else parts).append((n, body))
                elif idx is not None:
                    docs[idx] = (n, s1, s2)
                if len(out) >= 256:
                    yield made(out)
                    out = []
        if parts:
            out += of_run(parts, hot, docs)
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["n", "s1", "s2", "tokens", "df"])

    return rows.mapInArrow(lean(gather), "n long, s1 long, s2 long, tokens binary, df binary")


def _prefix(tokens: bytes, df: bytes, n: int, percent: int) -> tuple[np.ndarray, int]:
    """Of a set's shared tokens those in its prefix, and how many of them must match."""
    t, f = np.frombuffer(tokens, np.uint64), np.frombuffer(df, np.uint32)
    asked = matches_asked(f, n, percent)
    return t[: max(0, len(t) - least_overlap(n, percent) + asked)], asked


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(token, k) of the tokens among which a first match must lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [np.frombuffer(t.as_py(), np.int64)[: len(t.as_py()) // 8 - least_overlap(n, percent) + 1] for n, t in zip(b.column(1).to_pylist(), b.column(2), strict=True)]
            t = np.concatenate(got)
            k = np.repeat(np.array(b.column(0), np.int64), [len(p) for p in got])
            for i in range(0, len(t), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(t[i : i + (1 << 16)]), pa.array(k[i : i + (1 << 16)])], names=["token", "k"])

    return sets.select("k", "n", "tokens").mapInArrow(lean(run), "token long, k long")


def _matched(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Of token arrays: their columns among the tokens that two of them have, the rows, and how many columns."""
    t = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    _, where, count = np.unique(t, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    keep = count[where] > 1
    return column[where[keep]], row[keep], int((count > 1).sum())


def common_counts(parts: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """How many tokens every two of the arrays have in common."""
    column, row, n = _matched(parts)
    out = np.zeros((len(parts), len(parts)), np.float32)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for lo in range(0, n, width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(parts), min(width, n - lo)), np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        out += m @ m.T
    return out


def linked_in_family(n: np.ndarray, tokens: list[np.ndarray], prefixes: list[np.ndarray], asked: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Pairs (i < j) that link: those with enough common prefix tokens, verified on their whole sets."""
    enough = np.minimum(asked[:, None], asked[None, :])
    near = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    i, j = np.nonzero(np.triu((common_counts(prefixes) >= enough) & near, 1))
    if len(i) > 4 * len(n):
        common = common_counts(tokens)[i, j].astype(np.int64)
    else:
        common = np.array([len(np.intersect1d(tokens[a], tokens[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    linked = 100 * common >= percent * (n[i] + n[j] - common)
    return np.stack([i[linked], j[linked]], 1)


def least_labels(n: int, pairs: np.ndarray) -> np.ndarray:
    """For each of n sets the least that it is linked with, itself or through others."""
    return joined_labels(np.arange(n), pairs[:, 0], pairs[:, 1])


def _links(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b) of linked sets, as a forest of each family or pair of blocks, and (a, links) with each set's links."""

    def solve(group: list[tuple], made: list[tuple]) -> None:
        k, n, side, copies = (np.array([g[i] for g in group], np.int64) for i in (3, 4, 5, 6))
        prefixes, asked = zip(*(_prefix(g[7], g[8], g[4], percent) for g in group), strict=True)
        pairs = linked_in_family(n, [np.frombuffer(g[7], np.uint64) for g in group], list(prefixes), np.array(asked), percent)
        if group[0][1] != group[0][2]:  # of two blocks, the pairs across; those inside are another task's
            pairs = pairs[side[pairs[:, 0]] != side[pairs[:, 1]]]
        links = np.bincount(pairs[:, 0], copies[pairs[:, 1]], len(k)) + np.bincount(pairs[:, 1], copies[pairs[:, 0]], len(k))
        made += [(int(k[i]), None, int(links[i])) for i in np.flatnonzero(links)]
        up = least_labels(len(k), pairs)
        made += [(int(k[i]), int(k[up[i]]), None) for i in np.flatnonzero(up != np.arange(len(k)))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, made = [], []
        put = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made, strict=True)], names=["a", "b", "links"])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][:3] != row[:3]:
                    solve(group, made)
                    group = []
                group.append(row)
            if made:
                yield put()
                made = []
        if group:
            solve(group, made)
        if made:
            yield put()

    return dealt.mapInArrow(lean(run), "a long, b long, links long")


def joined(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (least id of the class), n_links (documents linked with it)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(64, 4 * parts)
    rows = _runs(docs, doc_id, text, cells).repartition(parts, F.coalesce(F.col("cell").cast("long"), F.xxhash64("run", "s1"))).sortWithinPartitions("cell")
    found = stash(_shared_tokens(rows), "ngram-shared")

    by_run = found.select("run", "idx", "n", "s1", "s2", "cell", "body").repartition(parts, F.col("run")).sortWithinPartitions("run")
    sets = _survivors(by_run, percent).dropDuplicates(["s1", "s2"])
    sets = stash(sets.withColumn("k", F.monotonically_increasing_id()), "ngram-sets")
    members = found.filter("body IS NULL").select("id", "n", "s1", "s2")
    classes = members.filter("n > 0").groupBy("s1", "s2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = stash(classes.select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "least", "copies"), "ngram-copies")

    # what is joined with a sum over itself is written before: Spark splits the rows of a hot key where both sides come from exchanges
    met = stash(_postings(sets, percent), "ngram-postings")
    lead = met.groupBy("token").agg(F.min("k").alias("b"), F.max("k").alias("last")).filter("b <> last").select(F.col("token").alias("t"), "b")
    meet = met.join(stash(lead, "ngram-leads"), F.col("token") == F.col("t")).select(F.col("k").alias("a"), "b").filter("a <> b")
    family = stash(components(forest(meet)), "ngram-families")
    # every member, the root included, and into how many blocks its family goes
    each = family.select(F.col("node").alias("f_k"), F.col("root").alias("family")).unionByName(family.select(F.col("root").alias("f_k"), F.col("root").alias("family")).distinct())
    size = stash(family.groupBy("root").agg(F.ceil((F.count(F.lit(1)) + 1) / FAMILY).cast("int").alias("blocks")), "ngram-sizes")
    each = each.join(size, F.col("family") == F.col("root")).drop("root")
    both = sets.join(each, F.col("k") == F.col("f_k")).join(classes, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    both = both.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = both.select("family", "block", other, "k", "n", "copies", "tokens", "df")
    dealt = dealt.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "k", "n", F.col("block").alias("side"), "copies", "tokens", "df")
    dealt = dealt.repartition(parts, "family", "i", "j").sortWithinPartitions("family", "i", "j")
    links = stash(_links(dealt, percent), "ngram-links")

    root = components(links.filter("b IS NOT NULL").select("a", "b"))
    degree = links.filter("links IS NOT NULL").groupBy("a").agg(F.sum("links").alias("links"))
    named = sets.select("k", "s1", "s2").join(classes, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
    named = named.join(degree, F.col("k") == F.col("a"), "inner").join(root, F.col("k") == F.col("node"), "left").withColumn("top", F.coalesce("root", "k"))
    named = stash(named.select("k", "s1", "s2", "least", "links", "top"), "ngram-linked")
    first = stash(named.groupBy("top").agg(F.min("least").alias("first")).select(F.col("top").alias("f_top"), "first"), "ngram-firsts")
    named = named.join(first, F.col("top") == F.col("f_top")).select(F.col("s1").alias("l1"), F.col("s2").alias("l2"), "first", "links")
    classes = classes.join(named, (F.col("c1") == F.col("l1")) & (F.col("c2") == F.col("l2")), "left")
    classes = classes.select("c1", "c2", F.coalesce("first", "least").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    classes = stash(classes, "ngram-ends")
    out = members.join(classes, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n") > 0), "left")
    return out.select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links")
    )


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies, the row of least id.

    Defined cases: rows are told apart by 128 bits of all their columns. Of rows that share the least id, that of least
    bits stays; of rows alike in every column, one; a row whose doc_id is null comes after all others of its class;
    documents without a shingle are in no class, and all stay.
    """
    cells = [x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]  # a hash passes over nulls
    rows = packed(docs, "doc_id", "text", F.xxhash64(*cells).alias("row1"), F.xxhash64(F.lit("second"), *cells).alias("row2"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row1").alias("h1"), F.col("row2").alias("h2"))
    got = stash(joined(rows.select(row.alias("row"), "text"), doc_id="row").filter("n_shingles > 0").select("row", "component_id"), "ngram-classes")
    # of each row that has to go or is repeated, once: whether one of it stays
    apart = got.groupBy(F.col("row.h1").alias("h1"), F.col("row.h2").alias("h2")).agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("row") == F.col("component_id")).alias("stays"))
    apart = stash(apart.filter("n > 1 OR NOT stays").select("h1", "h2", "stays"), "ngram-apart")
    on = (F.col("row1") == F.col("h1")) & (F.col("row2") == F.col("h2"))
    one = rows.join(apart.filter("stays"), on, "left_semi").dropDuplicates(["row1", "row2"])
    return rows.join(apart, on, "left_anti").unionByName(one).select("doc.*")


SQL = None
