"""A hidden Markov language model.

Every training token is counted (a shuffled table of all words). The OWN most frequent words are
symbols of the model; the others share a symbol for each ending and are told apart by their own
counts: P(word | symbol) = (c + 0.5) / (T + 0.5 * (V + 1)), T and V being the symbol's tokens and
distinct words, so that one unseen word has a share. Latent states emit symbols. Baum-Welch starts
from a few rounds on a bounded sample (START_DOCS, which only breaks the symmetry of the states);
then ROUNDS rounds run over all training documents: each partition adds up expected counts, which are
summed by blocks of symbols into a model of fixed size. A text's score is the exact log10 likelihood
of its tokens and the end, from the scaled forward recursion, run over many documents at a time.

Counts of the KNOWN most frequent words (of KNOWN_BYTES at most) go to the workers, a fixed bound; tokens
beyond them are joined with the table of counts, as that grows with the corpus. Texts are tokenised twice, to count
their words and to write their symbols, which the rounds and the score read. The sample has documents
of START_BYTES at most, so that the driver's share is bounded; all later rounds read every text whole.

Defined cases: a very long text is one sequence, held by one task (36 bytes a token); a null text counts as empty, which is the end alone; a null id is hashed as the empty
text; repeated rows are scored one by one; without training documents all counts are 0; no columns of
the input other than the id are carried, and no text is cut.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, lean, stash, table

STATES = 8
OWN = 16_384
KNOWN, KNOWN_BYTES = 131_072, 256
ENDINGS = 512
START_DOCS, START_BYTES = 300, 32 << 10
START_ROUNDS = 8
ROUNDS = 2
#: Tokens whose state probabilities are held at a time.
HELD = 1_500_000
#: Words counted by a task before it passes them on.
COUNTED = 400_000
BLOCK = 2048
SMOOTH = 20.0

def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def _ending_column(word: Column, own: int, endings: int) -> Column:
    """Vocabulary.ending of a column."""
    tail = F.substring(F.encode(word, "UTF-8"), -2, 2)
    return (F.crc32(F.when(F.octet_length(word) < 2, F.encode(word, "UTF-8")).otherwise(tail)) % endings + 1 + own).cast("int")


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n over the only column of texts; the empty word is the end, once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        got: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                got.update(tokens(t.as_py()))
                got[b""] += 1
                if len(got) >= COUNTED:
                    yield made(got)
                    got = Counter()
        if got:
            yield made(got)

    return texts.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    start: np.ndarray  # (states,)
    move: np.ndarray  # (states, states)
    emit: np.ndarray  # (symbols, states)


class _Ranks(dict):
    """Ranks of words; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """Symbol 0 is the end, 1 to own are words, and `endings` more are shared."""

    own: int
    endings: int
    known: dict[bytes, tuple[int, int]]  # symbol, count
    total: int
    distinct: int
    ends: int
    own_total: np.ndarray  # of each symbol, T
    own_distinct: np.ndarray  # of each symbol, V

    @property
    def width(self) -> type:
        """Of a symbol where sequences are written."""
        return np.uint16 if len(self.own_total) <= 1 << 16 else np.int32

    def ending(self, word: bytes) -> int:
        return 1 + self.own + zlib.crc32(word[-2:]) % self.endings

    def symbols(self, text: str | None) -> np.ndarray:
        known = self.known
        return np.array([known[w][0] if w in known else self.ending(w) for w in tokens(text)] + [0], np.int32)


def vocabulary(counts: DataFrame, own: int = OWN, known: int = KNOWN, endings: int = ENDINGS) -> Vocabulary:
    sums = counts.agg(F.sum("n"), F.count(F.lit(1)), F.sum(F.when(F.col("word") == "", F.col("n")))).first()
    # by eighths of a power of 2, how frequent the words to rank must be: tasks pass on no more than they
    size = F.floor(F.log2("n") * 8).cast("int")
    most, least = 0, 0
    for r in sorted(counts.filter("word <> ''").groupBy(size.alias("size")).count().collect(), reverse=True):  # at most 512 rows
        most, least = most + r["count"], r["size"]
        if most >= known:
            break
    ranked = counts.filter(f"word <> '' AND octet_length(word) <= {KNOWN_BYTES}").filter(size >= least).orderBy(F.col("n").desc(), "word").limit(known).collect()
    ranked = [(r["word"].encode(), r["n"]) for r in ranked]
    total, distinct = np.zeros(1 + own + endings), np.zeros(1 + own + endings)
    v = Vocabulary(own, endings, {w: (1 + i, n) for i, (w, n) in enumerate(ranked[:own])}, int(sums[0] or 0), int(sums[1]), int(sums[2] or 0), total, distinct)
    total[0], distinct[0] = v.ends, 1
    ending = _ending_column(F.col("word"), own, endings)
    for r in counts.filter("word <> ''").groupBy(ending.alias("s")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # at most `endings` rows
        total[r["s"]], distinct[r["s"]] = r["n"], r["v"]
    for w, (s, n) in v.known.items():  # words that are symbols of their own share none
        total[s], distinct[s] = n, 1
        total[v.ending(w)] -= n
        distinct[v.ending(w)] -= 1
    v.known.update((w, (v.ending(w), n)) for w, n in ranked[own:])
    return v


def _layout(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by length from the longest, how many go on at each step, and the symbols step by step."""
    n = np.array([len(s) for s in seqs])
    order = np.argsort(-n, kind="stable")
    going = np.searchsorted(-n[order], -np.arange(1, n.max() + 1), side="right")
    flat = np.concatenate([seqs[i] for i in order])
    step = np.concatenate([np.arange(len(seqs[i])) for i in order])
    return order, going, flat[np.argsort(step, kind="stable")]


def groups(seqs: list[np.ndarray], held: int = HELD) -> Iterator[list[int]]:
    """Sequences of like length together, `held` tokens at most (or one sequence)."""
    some, size = [], 0
    for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
        if some and size + len(seqs[i]) > held:
            yield some
            some, size = [], 0
        some.append(i)
        size += len(seqs[i])
    if some:
        yield some


def log10_likelihood(m: Model, seqs: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(seqs))
    for some in groups(seqs):
        order, going, flat = _layout([seqs[i] for i in some])
        total, at = np.zeros(len(some)), 0
        for t, d in enumerate(going):
            b = m.emit[flat[at : at + d]]
            a = (m.start if t == 0 else a[:d] @ m.move) * b
            scale = a.sum(1)
            a /= scale[:, None]
            total[:d] += np.log10(scale)
            at += d
        out[np.array(some)[order]] = total
    return out


class Expected:
    """Sums of expected counts over sequences."""

    def __init__(self, states: int, symbols: int) -> None:
        self.start, self.move, self.emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))

    def add(self, m: Model, seqs: list[np.ndarray]) -> None:
        for some in groups(seqs):
            _, going, flat = _layout([seqs[i] for i in some])
            at = np.concatenate([[0], np.cumsum(going)])
            a = np.empty((len(flat), len(m.start)), np.float32)
            scale = np.empty(len(flat), np.float32)
            now = None
            for t, d in enumerate(going):
                now = (m.start if t == 0 else now[:d] @ m.move) * m.emit[flat[at[t] : at[t + 1]]]
                s = now.sum(1)
                now /= s[:, None]
                a[at[t] : at[t + 1]], scale[at[t] : at[t + 1]] = now, s
            back = np.ones((0, len(m.start)))
            for t in range(len(going) - 1, -1, -1):
                d = going[t]
                beta = np.ones((d, len(m.start)))
                if len(back):
                    beta[: len(back)] = back @ m.move.T
                    self.move += a[at[t] : at[t] + len(back)].T @ back
                here = a[at[t] : at[t + 1]]
                b = m.emit[flat[at[t] : at[t + 1]]] / scale[at[t] : at[t + 1], None]
                back = b * beta
                here *= beta
                if t == 0:
                    self.start += here.sum(0)
            for k in range(len(m.start)):
                self.emit[:, k] += np.bincount(flat, a[:, k], len(self.emit))

    def model(self, old: Model, unigram: np.ndarray) -> Model:
        start = self.start + 1
        move = self.move * old.move + 1
        emit = self.emit + SMOOTH * unigram[:, None]
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def first_model(unigram: np.ndarray, states: int = STATES) -> Model:
    rng = np.random.default_rng(11)
    emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states)))
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def trained(texts: DataFrame, v: Vocabulary, sample: list[str], rounds: int = ROUNDS) -> Model:
    """Baum-Welch: rounds over the sample, then over all texts (a DataFrame of one column, of texts or of their symbols)."""
    unigram = (v.own_total + 0.5) / (v.own_total + 0.5).sum()
    m, symbols = first_model(unigram), len(unigram)
    some = [v.symbols(t) for t in sample]
    for _ in range(START_ROUNDS if some else 0):
        e = Expected(STATES, symbols)
        e.add(m, some)
        m = e.model(m, unigram)
    sc = texts.sparkSession.sparkContext
    width = v.width
    if texts.schema[0].dataType.typeName() == "binary":
        read = lambda x: np.frombuffer(x, width)
    else:
        words = sc.broadcast(v)
        read = lambda x: words.value.symbols(x)
    for _ in range(rounds):
        now = sc.broadcast(m)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            e = Expected(STATES, symbols)
            for b in batches:
                e.add(now.value, [read(t.as_py()) for t in b.column(0)])
            parts = [(-1, np.vstack([e.start, e.move]))] + [(i // BLOCK, e.emit[i : i + BLOCK]) for i in range(0, symbols, BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], names=["part", "counts"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    x = np.frombuffer(x.as_py())
                    sums[i] = sums[i] + x if i in sums else x
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["part", "counts"])

        partial = texts.mapInArrow(lean(expect), "part int, counts binary").repartition(F.col("part"))
        got = {r["part"]: np.frombuffer(r["counts"]) for r in partial.mapInArrow(lean(total), "part int, counts binary").collect()}
        if not got:
            break
        e = Expected(STATES, symbols)
        head = got.pop(-1).reshape(-1, STATES)
        e.start, e.move = head[0], head[1:]
        e.emit = np.concatenate([got[i] for i in sorted(got)]).reshape(-1, STATES)
        m = e.model(m, unigram)
    return m


def encoded(docs: DataFrame, v: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row read once, written: _row, _id, _symbols (of each token and the end), _n, _known, _base, _own, _rest.

    _base and _own are what known words add to the base score and, beside the states, to the score; the counts of
    the words in _rest are added after a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(v)
    source = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    id_type = source.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, _symbols binary, _n long, _known long, _base double, _own double, _rest array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        base_of = -np.log10(v.total + 0.5 * (v.distinct + 1))
        per_symbol = np.where(np.arange(len(v.own_total)) > v.own, -np.log10(v.own_total + 0.5 * (v.own_distinct + 1)), 0.0)
        # by rank, a word's symbol, log count, share of its symbol and whether it counts; the last stands for words not known
        ranks = _Ranks((w, i) for i, w in enumerate(v.known))
        symbol = np.array([s for s, _ in v.known.values()] + [0], np.int32)
        count = np.array([c for _, c in v.known.values()] + [0], float)
        base_add = np.append(np.log10(count[:-1] + 0.5), 0.0)
        own_add = np.where(symbol > v.own, base_add, 0.0)
        counts = count > 0
        end = np.log10(v.ends + 0.5)
        for b in batches:
            seqs, rest, n, known, base, own = [], [], [], [], [], []
            for t in b.column(1):
                ws = tokens(t.as_py())
                r = np.fromiter(map(ranks.__getitem__, ws), np.int64, len(ws))
                s = np.zeros(len(ws) + 1, v.width)
                s[:-1] = symbol[r]
                unseen = np.flatnonzero(r < 0)
                more = [ws[i] for i in unseen]
                s[unseen] = [v.ending(w) for w in more]
                seqs.append(s.tobytes())
                rest.append(more)
                n.append(len(ws) + 1)
                known.append(int(counts[r].sum()) + (v.ends > 0))
                base.append(base_add[r].sum() + end + base_of * (len(ws) + 1))
                own.append(own_add[r].sum() + per_symbol[s].sum())
            columns = [pa.array(seqs, pa.binary()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(rest, pa.list_(pa.binary())).cast(pa.list_(pa.string()))], names=["_id", "_symbols", "_n", "_known", "_base", "_own", "_rest"])

    return stash(source.mapInArrow(lean(run), schema).withColumn("_row", F.monotonically_increasing_id()), "lm-symbols")


def finished(rows: DataFrame, counts: DataFrame, v: Vocabulary, m: Model, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of encoded()."""
    model, width = rows.sparkSession.sparkContext.broadcast(m), v.width
    carried = rows.select("_row", "_id", "_n", "_known", "_base", "_own", "_symbols")
    id_type = carried.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [np.frombuffer(x.as_py(), width) for x in b.column(6)]
            like = log10_likelihood(model.value, seqs) if seqs else np.zeros(0)
            own = b.column(5).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(like + own, pa.float64())], names=["_row", "_id", "_n", "_known", "_base", "_score"])

    scores = carried.mapInArrow(lean(run), f"_row long, _id {id_type}, _n long, _known long, _base double, _score double")
    asked = rows.select("_row", F.explode("_rest").alias("_word"))
    answered = asked.join(counts.select(F.col("word").alias("_w"), "n"), F.col("_word") == F.col("_w"), "left")
    log = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 0.5)
    added = answered.groupBy("_row").agg(F.sum(log).alias("_add"), F.count("n").alias("_more")).withColumnRenamed("_row", "_r")
    both = scores.join(added, F.col("_row") == F.col("_r"), "left")
    add = F.coalesce(F.col("_add"), F.lit(0.0))
    return both.select(
        F.col("_id").alias(doc_id), F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce(F.col("_more"), F.lit(0))).alias("n_known"),
        (F.col("_base") + add).alias("base_score"), (F.col("_score") + add).alias("score"),
    )


def scored(docs: DataFrame, counts: DataFrame, v: Vocabulary, m: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row."""
    return finished(encoded(docs, v, text, doc_id), counts, v, m, doc_id)


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    learn = docs.filter(fold != 1)
    counts = stash(word_counts(learn.select("text")), "lm-counts")
    v = vocabulary(counts)
    short = learn.filter(F.octet_length("text") <= START_BYTES)
    sample = [r["text"] for r in bounded_sample(short, F.col("doc_id"), START_DOCS).select("text").collect()]
    rows = encoded(docs, v)
    of_id = F.crc32(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")) % 5
    m = trained(rows.filter(of_id != 1).select("_symbols"), v, sample)
    got = finished(rows, counts, v, m)
    return got.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", F.lit(v.total).cast("long").alias("train_tokens"), "base_score", "score")


SQL = None
