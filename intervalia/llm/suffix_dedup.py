"""Repeated passages by a distributed merge sort of suffixes that knows common prefixes.

Every string of LENGTH bytes contains an anchor: the k-gram of least hash in it, which depends on the
string alone. So strings that repeat have anchors that repeat, and only suffixes at anchors need
sorting. First, tasks write the hashes of anchors (and of all the bytes around them that matter) as
sorted runs; merged, these show anchors that occur once, which end here, and anchors whose whole
surroundings repeat, which are settled. A k-gram that a run has more than HOT times goes as one entry
with its number; the run keeps the places. The suffixes at the others, and at one anchor of each of
the different surroundings that they may share a string with, are sorted by each task, front-coded
(how many bytes are as in the suffix before, and the rest), exchanged, and combined by a loser tree:
it compares suffixes by the lengths they share with the last one put out, and bytes only from there on.

What the merge knows decides what repeats: suffixes that follow each other and share d bytes or more
are a run for d, and so are the bytes before the anchors, read backwards and sorted. Two anchors lie in
the same string that begins c bytes before them if they are in one run for LENGTH - c of the
suffixes, and in one for c of the bytes before. All bytes of strings found twice make the removed spans.

K-grams with over GROUP suffixes are dealt into parts, whose distinct strings meet in a second round, so
that no task needs a whole group. Hashes only choose candidates, but for settled surroundings (96 bits)
and strings in different parts of a large group (128 bits).

Defined cases: a null text is empty; texts of under LENGTH bytes keep all; equal texts of at least
LENGTH bytes lose all, each of them; overlapping repeats in one text count; repeated rows count as
texts of their own; very long texts are hashed in parts, and held whole, one at a time, where they are
cut; an empty table gives an empty result; columns that are carried must not be named like OWN
(cut_documents takes any).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import lean, stash, table

LENGTH = 200
GRAM = 72
#: k-grams in a string: anchors are at most so far apart, and strings begin at most REACH bytes before one.
STRING_GRAMS = LENGTH - GRAM + 1
REACH = STRING_GRAMS - 1
RUN_ANCHORS, RUN_DOCS = 250_000, 60_000
GROUP = 16_384
#: Places of a k-gram in a run from which it goes as one entry; the number of such an entry's text.
HOT, MANY = 32, 0xFFFF
#: Suffixes that are compared together.
TOGETHER = 4096
#: Bytes hashed at a time; positions in them take 20 bits.
CHUNK = 1 << 18
#: Bytes of suffixes that a task holds before it passes on their runs.
HELD = 24 << 20
#: Columns that deduplicated() needs on the way.
OWN = ("_text", "_k1", "_k2", "_r", "_p1", "_p2", "_p_r", "_packed", "_more")
_BITS = 48
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Polynomial hashes of any range of a byte array, from prefix sums modulo 2^64."""

    _rng = np.random.default_rng(2024)
    TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    COLUMNS = _rng.integers(1, 1 << 63, REACH + LENGTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    UP: np.ndarray | None = None
    DOWN: np.ndarray | None = None

    @classmethod
    def sums(cls, data: np.ndarray) -> np.ndarray:
        if cls.UP is None or len(cls.UP) < len(data) + 2:
            cls.UP, cls.DOWN = (_powers(b, max(CHUNK, len(data)) + 2) for b in (_ODD, pow(_ODD, -1, 1 << 64)))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(cls.TABLE[data] * cls.UP[: len(data)], out=out[1:])
        return out

    @classmethod
    def ranges(cls, sums: np.ndarray, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        h = (sums[hi] - sums[lo]) * cls.DOWN[: len(sums)][lo]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(29))


def _least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    """Least of v[i : i + w], for each i (by blocks of w: least from the left and from the right)."""
    n = len(v) - w + 1
    pad = -len(v) % w
    m = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(m, 1).ravel()
    right = np.minimum.accumulate(m[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined texts (ends: where each ends): places of anchors, their k-gram's hash, their surroundings' hash."""
    if len(data) < LENGTH:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none, none
    sums = _Hasher.sums(data)
    gram = _Hasher.ranges(sums, slice(0, len(data) - GRAM + 1), slice(GRAM, len(data) + 1))
    packed = (gram >> np.uint64(20) << np.uint64(20)) | np.arange(len(gram), dtype=np.uint64)
    least = _least_in_windows(packed, STRING_GRAMS)
    # strings that lie in one text: those that begin at LENGTH bytes or more before its end
    whole = np.ones(len(least), bool)
    starts = np.concatenate([[0], ends[:-1]])
    for e, s in zip(ends, starts, strict=True):
        whole[max(s, e - LENGTH + 1) : e] = False
    at = least[whole] & np.uint64((1 << 20) - 1)
    at = np.unique(at).astype(np.int64)
    text = np.searchsorted(ends, at, side="right")
    lo, hi = np.maximum(starts[text], at - REACH), np.minimum(ends[text], at + LENGTH)
    around = _Hasher.ranges(sums, lo, hi) + (at - lo).astype(np.uint64) * np.uint64(_ODD) + (hi - at).astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    return at, gram[at] >> np.uint64(64 - _BITS), around >> np.uint64(64 - _BITS)


def text_anchors(texts: Iterable[bytes], chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers of texts, places in them, and both hashes; texts are hashed together up to `chunk` bytes, longer ones in overlapping parts."""
    some, size = {}, 0

    def together() -> tuple:
        ends = np.cumsum([len(t) for t in some.values()])
        at, gram, around = anchors(np.frombuffer(b"".join(some.values()), np.uint8), ends)
        which = np.searchsorted(ends, at, side="right")
        return np.array(list(some))[which], at - np.concatenate([[0], ends])[which], gram, around

    for i, t in enumerate(texts):
        if len(t) < LENGTH:
            continue
        if len(t) > chunk:
            # a part's surroundings must not end where it does, but where the text does: parts overlap on both sides
            kept = chunk - 2 * (LENGTH + REACH)
            for lo in range(0, len(t), kept):
                a, b = max(0, lo - LENGTH - REACH), min(len(t), lo + kept + LENGTH + REACH)
                at, gram, around = anchors(np.frombuffer(t[a:b], np.uint8), np.array([b - a]))
                own = (at + a >= lo) & (at + a < lo + kept)
                yield np.full(own.sum(), i), at[own] + a, gram[own], around[own]
            continue
        if size + len(t) > chunk and some:
            yield together()
            some, size = {}, 0
        some[i] = t
        size += len(t)
    if some:
        yield together()


_PACK = zstandard.ZstdCompressor(level=1)


def _packed(*columns: np.ndarray) -> bytes:
    return _PACK.compress(b"".join(c.tobytes() for c in columns))


def _unpacked(blob: bytes, n: int, *kinds) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_KINDS = {"run": pa.int64(), "idx": pa.int32(), "k1": pa.int64(), "k2": pa.int64(), "r": pa.int64(), "n": pa.int64(), "copied": pa.bool_(), "cell": pa.int32(), "body": pa.binary()}
_ROWS = "run long, idx int, k1 long, k2 long, r long, n long, copied boolean, cell int, body binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))


def _runs(keyed: DataFrame, n_cells: int, chunk: int) -> DataFrame:
    """Rows of texts (body is null) and of cells of runs: anchors in order of their k-gram's hash, cut into ranges of it;
    of runs with hot k-grams also one of their places (cell is null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        held, seen, size = [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            idx, at, gram, around = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.lexsort((around, gram))
            idx, at, gram, around = idx[order], at[order], gram[order], around[order]
            rows = []
            names, starts, count = np.unique(gram, return_index=True, return_counts=True)
            hot = np.repeat(count > HOT, count)
            if hot.any():
                body = _packed(gram[hot], around[hot], idx[hot].astype(np.uint16), at[hot].astype(np.uint32))
                rows.append((number, None, None, None, None, int(hot.sum()), None, None, body))
            new = np.r_[True, (around[1:] != around[:-1]) | (gram[1:] != gram[:-1])]
            different = np.add.reduceat(new, starts) if len(starts) else starts  # surroundings of each k-gram
            hot_names, different = names[count > HOT], different[count > HOT]
            idx, at, gram, around = idx[~hot], at[~hot], gram[~hot], around[~hot]
            of = lambda g: (g * np.uint64(n_cells)) >> np.uint64(_BITS)
            cell, hot_cell = of(gram), of(hot_names)
            for c in np.union1d(cell, hot_cell):
                lo, hi = np.searchsorted(cell, [c, c + np.uint64(1)])
                first, last = np.searchsorted(hot_cell, [c, c + np.uint64(1)])
                six = around[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                g = np.diff(gram[lo:hi], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                hots = np.uint32(last - first).tobytes() + hot_names[first:last].tobytes() + different[first:last].astype(np.uint32).tobytes()
                body = hots + _packed(np.ascontiguousarray(g.T), np.ascontiguousarray(six), idx[lo:hi].astype(np.uint16), at[lo:hi].astype(np.uint32))
                rows.append((number, None, None, None, None, int(hi - lo), None, int(c), body))
            for i in range(0, len(rows), 512):
                yield _batch(rows[i : i + 512])

        for b in batches:
            rows, new = [], []

            def fresh(b=b, rows=rows, new=new) -> Iterator[bytes]:
                """Texts that the run hasn't had; the others are noted as copies."""
                for k1, k2, r, t in zip(*(b.column(c) for c in ("k1", "k2", "r", "text")), strict=True):
                    k1, k2, r, x = k1.as_py(), k2.as_py(), r.as_py(), (t.as_py() or "").encode()
                    if len(x) < LENGTH:
                        continue
                    if (k1, k2) in seen:  # noqa: B023
                        for row in {seen[k1, k2], r}:  # noqa: B023
                            rows.append((number, None, k1, k2, row, len(x), True, None, None))  # noqa: B023
                        continue
                    seen[k1, k2] = r  # noqa: B023
                    rows.append((number, len(seen) - 1, k1, k2, r, len(x), False, None, None))  # noqa: B023
                    new.append(len(seen) - 1)  # noqa: B023
                    yield x

            for which, at, gram, around in text_anchors(fresh(), chunk):
                held.append((np.array(new)[which], at, gram, around))
                size += len(at)
            if rows:
                yield _batch(rows)
            if held and (size >= RUN_ANCHORS or len(seen) >= RUN_DOCS // 2):
                yield from flush()
                held, seen, size, number = [], {}, 0, number + 1
        if held:
            yield from flush()

    return keyed.mapInArrow(lean(run), _ROWS)


def _spread(around: np.ndarray, run: int, parts: np.ndarray) -> np.ndarray:
    """Which of its group's parts a suffix goes to."""
    h = (around ^ np.uint64(run * _ODD & (1 << 64) - 1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(32)) % parts.astype(np.uint64)).astype(np.int32)


def _occurrences(rows: DataFrame, most: int) -> DataFrame:
    """Rows without a cell as they are; per run, the anchors that occur again: whether settled, into how many parts their
    group goes, and the one that their suffix goes to (-1: none). A cell's runs must follow each other."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def done() -> None:
            grams, arounds, idxs, ats, runs, hots = [], [], [], [], [], []
            for i, (number, n, body) in enumerate(held):
                m = int.from_bytes(body[:4], "little")
                names, different = np.frombuffer(body, np.uint64, m, 4), np.frombuffer(body, np.uint32, m, 4 + 8 * m)
                hots.append((names, different))
                g, six, idx, at = _unpacked(body[4 + 12 * m :], n, (np.uint8, 6), (np.uint8, 6), np.uint16, np.uint32)
                wide = lambda x: np.concatenate([x, np.zeros((n, 2), np.uint8)], 1).copy().view("<u8").ravel()  # noqa: B023, E731
                grams.append(np.cumsum(wide(g.reshape(6, n).T), dtype=np.uint64))
                arounds.append(wide(six))
                idxs.append(idx)
                ats.append(at)
                runs.append(np.full(n, i))
            gram, around, run = np.concatenate(grams), np.concatenate(arounds), np.concatenate(runs)
            order = np.lexsort((around, gram))
            gram, around, run, idx, at = gram[order], around[order], run[order], np.concatenate(idxs)[order], np.concatenate(ats)[order]
            new_gram = np.r_[True, gram[1:] != gram[:-1]][: len(gram)]
            new_both = new_gram | np.r_[True, around[1:] != around[:-1]][: len(gram)]
            both = np.cumsum(new_both) - 1
            settled = np.bincount(both)[both] > 1 if len(both) else new_both
            # of each k-gram, how many surroundings (those of hot ones are counted by run)
            names = np.unique(np.concatenate([gram, *(n for n, _ in hots)]))
            of = np.searchsorted(names, gram)
            total = np.bincount(of, new_both, len(names)) if len(of) else np.zeros(len(names))
            for n, different in hots:
                total[np.searchsorted(names, n)] += different
            parts = np.maximum(1, -(-total.astype(np.int64) // most))
            go = (total[of] > 1) & new_both
            for i, ((number, _, _), (hot, _)) in enumerate(zip(held, hots, strict=True)):
                k = np.flatnonzero((settled | go) & (run == i))
                hot = hot[total[np.searchsorted(names, hot)] > 1]
                if len(k) + len(hot):
                    of_hot = parts[np.searchsorted(names, hot)].astype(np.int32)
                    part = np.where(go[k], _spread(around[k], number, parts[of[k]]), np.int32(-1))
                    columns = [idx[k], at[k], settled[k], parts[of[k]].astype(np.int32), part.astype(np.int32), gram[k]]
                    more = [np.full(len(hot), MANY, np.uint16), np.zeros(len(hot), np.uint32), np.zeros(len(hot), bool), of_hot, of_hot, hot]
                    body = _packed(*(np.concatenate(x) for x in zip(columns, more, strict=True)))
                    out.append((number, None, None, None, None, len(k) + len(hot), None, now, body))
            held.clear()

        for b in batches:
            plain = b.column("cell").is_null()
            if (text := b.filter(plain)).num_rows:
                yield text
            rest = b.filter(pc.invert(plain))
            for run, n, cell, body in zip(rest.column("run").to_pylist(), rest.column("n").to_pylist(), rest.column("cell").to_pylist(), rest.column("body"), strict=True):
                if cell != now and held:
                    done()
                now = cell
                held.append((run, n, body.as_py()))
                if len(out) >= 256:
                    yield _batch(out)
                    out.clear()
        if held:
            done()
        if out:
            yield _batch(out)

    return rows.mapInArrow(lean(merge), _ROWS)


def _per_text(rows: DataFrame) -> DataFrame:
    """k1, k2, r, spans (of settled anchors, or all of a text with a copy), places, grams, parts and bigs of suffixes to
    sort. A run's rows must follow each other."""

    def of_run(number: int, parts: list[tuple[int, bytes]], hot: list[tuple[int, bytes]], texts: dict) -> Iterator[tuple]:
        opened = [_unpacked(body, n, np.uint16, np.uint32, np.bool_, np.int32, np.int32, np.uint64) for n, body in parts]
        idx, at, settled, size, part, gram = (np.concatenate([o[i] for o in opened] or [np.zeros(0, np.int64)]) for i in range(6))
        if hot:
            many = idx == MANY
            answered, into = gram[many], size[many]
            g, around, i, a = _unpacked(hot[0][1], hot[0][0], np.uint64, np.uint64, np.uint16, np.uint32)
            new = np.r_[True, (g[1:] != g[:-1]) | (around[1:] != around[:-1])]
            which = np.cumsum(new) - 1
            again = np.bincount(which)[which] > 1
            order = np.argsort(answered)
            where = np.minimum(np.searchsorted(answered[order], g), max(0, len(answered) - 1))
            known = answered[order][where] == g if len(answered) else np.zeros(len(g), bool)
            hot_size = np.where(known, into[order][where], 1) if len(answered) else np.ones(len(g), np.int64)
            hot_part = np.where(known & new, _spread(around, number, hot_size), -1)
            columns = (i, a, again, hot_size, hot_part, g)
            idx, at, settled, size, part, gram = (np.concatenate([x[~many], y]) for x, y in zip((idx, at, settled, size, part, gram), columns, strict=True))
        order = np.lexsort((at, idx))
        idx, at, settled, big, part, gram = idx[order], at[order].astype(np.int64), settled[order].astype(bool), size[order] > 1, part[order].astype(np.int32), gram[order].astype(np.uint64)
        cuts = np.searchsorted(idx, np.arange(int(idx.max()) + 2)) if len(idx) else []
        for i in np.unique(idx).tolist():
            here = slice(cuts[i], cuts[i + 1])
            k1, k2, r, n = texts[i]
            p = at[here][settled[here]]
            spans = merged(np.stack([np.maximum(0, p - REACH), np.minimum(p, n - LENGTH) + LENGTH], 1))
            go = part[here] >= 0
            row = (k1, k2, r, spans.tobytes(), at[here][go].tobytes(), gram[here][go].tobytes(), part[here][go].tobytes(), big[here][go].tobytes())
            if go.any():
                yield row
            elif len(p):
                yield (*row[:4], None, None, None, None)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, hot, texts = None, [], [], {}
        out: list[tuple] = []
        for b in batches:
            for run, idx, k1, k2, r, n, copied, cell, body in zip(*(b.column(c).to_pylist() for c in ("run", "idx", "k1", "k2", "r", "n", "copied", "cell", "body")), strict=True):
                if run != now:
                    if parts or hot:
                        out += of_run(now, parts, hot, texts)
                    now, parts, hot, texts = run, [], [], {}
                if copied:
                    out.append((k1, k2, r, np.array([[0, n]], np.int64).tobytes(), None, None, None, None))
                elif body is not None:
                    (hot if cell is None else parts).append((n, body))
                else:
                    texts[idx] = (k1, k2, r, n)
                if len(out) >= 256:
                    yield made(out)
                    out = []
        if parts or hot:
            out += of_run(now, parts, hot, texts)
        for i in range(0, len(out), 256):
            yield made(out[i : i + 256])

    names = ["k1", "k2", "r", "spans", "places", "grams", "parts", "bigs"]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 3 else pa.binary()) for i, c in enumerate(zip(*rows, strict=True))], names=names)

    return rows.mapInArrow(lean(gather), "k1 long, k2 long, r long, spans binary, places binary, grams binary, parts binary, bigs binary")


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) in order, joined where they touch."""
    if len(spans) < 2:
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.r_[True, spans[1:, 0] > far[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(spans) - 1]
    return np.stack([spans[new, 0], far[last]], 1)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def front_coded(items: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run of (suffix, rest): shared length, own length, length of the rest, own bytes, rest."""
    out, before = [], b""
    for suffix, rest in items:
        n = shared_prefix(before, suffix)
        out += [bytes((n, len(suffix) - n)), len(rest).to_bytes(2, "big"), suffix[n:], rest]
        before = suffix
    return _PACK.compress(b"".join(out))


def opened_run(blob: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(length shared with the one before, suffix, rest) of a run, in order."""
    raw, at, suffix = zstandard.ZstdDecompressor().decompress(blob), 0, b""
    while at < len(raw):
        n, own, rest = raw[at], raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        at += 4
        suffix = suffix[:n] + raw[at : at + own]
        at += own + rest
        yield n, suffix, raw[at - rest : at]


class LoserTree:
    """Merges sorted runs of (length shared with the one before, suffix, rest).

    Each node keeps the run that lost there and the length that its head shares with the winner that
    passed. Of two heads, that which shares more with the last suffix put out is the lesser; only if
    they share as much are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, bytes]]]) -> None:
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.head: list[tuple[bytes, bytes] | None] = [None] * self.size
        self.shared = [-1] * self.size  # -1: the run has ended, and loses to all
        for i, run in enumerate(runs):
            if (x := next(run, None)) is not None:
                self.head[i], self.shared[i] = x[1:], 0
        self.loser = [0] * self.size
        self.top = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared length becomes that with the winner."""
        sa, sb = self.shared[a], self.shared[b]
        if sa != sb:
            return (a, b) if sa > sb else (b, a)
        if sa < 0:
            return a, b
        x, y = self.head[a][0], self.head[b][0]
        n = shared_prefix(x, y, sa)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            self.shared[b] = n
            return a, b
        self.shared[a] = n
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes]]:
        while self.shared[self.top] >= 0:
            i = self.top
            yield self.shared[i], *self.head[i]
            x = next(self.runs[i], None)
            self.head[i], self.shared[i] = (None, -1) if x is None else (x[1:], x[0])
            node = (i + self.size) // 2
            while node:
                i, self.loser[node] = self._play(i, self.loser[node])
                node //= 2
            self.top = i


def _suffix_runs(texts: DataFrame, n_cells: int) -> DataFrame:
    """cell, body: sorted, front-coded runs of the suffixes to sort, by k-gram and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, list[tuple[bytes, bytes]]] = {}
        size = 0

        def put() -> Iterator[pa.RecordBatch]:
            rows = [(c, front_coded(sorted(x))) for c, x in cells.items()]
            for i in range(0, len(rows), 256):
                c, b = zip(*rows[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(b, pa.binary())], names=["cell", "body"])

        for b in batches:
            for row in zip(*(b.column(c) for c in ("k1", "k2", "r", "text", "places", "grams", "parts", "bigs")), strict=True):
                k1, k2, r, t, places, grams, parts, bigs = (v.as_py() for v in row)  # a text at a time
                x = t.encode()
                for p, g, part, big in zip(np.frombuffer(places, np.int64).tolist(), np.frombuffer(grams, np.uint64).tolist(), np.frombuffer(parts, np.int32).tolist(), np.frombuffer(bigs, np.bool_).tolist(), strict=True):
                    head = b"%c%c" % (big, 0) + part.to_bytes(4, "big") + b"".join(v.to_bytes(8, "big", signed=True) for v in (p, k1, k2, r))
                    # the part leads the rest, so that equal suffixes of a group's parts stay apart when cells hold several
                    item = (x[p : p + LENGTH], head + x[max(0, p - REACH) : p])
                    cells.setdefault((g + part * 7919) % n_cells, []).append(item)
                    size += LENGTH + REACH + 200
            if size > HELD:
                yield from put()
                cells, size = {}, 0
        if cells:
            yield from put()

    return texts.mapInArrow(lean(run), "cell int, body binary")


def _twice(values: np.ndarray) -> np.ndarray:
    """Of each column, which values it holds twice or more."""
    order = np.argsort(values, axis=0, kind="stable")
    s = np.take_along_axis(values, order, 0)
    same = s[1:] == s[:-1]
    twice = np.zeros(values.shape, bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(values.shape, bool)
    np.put_along_axis(out, order, twice, 0)
    return out


def repeated_strings(group: list[tuple[bytes, bytes]], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted (suffix, bytes before it), and how many bytes each suffix shares with the one before: which strings
    (row: suffix, column c: from c bytes before it) are found in two rows or more, and which are whole."""
    n, columns = len(group), np.arange(REACH + 1)
    left, right = np.array([len(x) for _, x in group]), np.array([len(x) for x, _ in group])
    back = np.zeros((n, REACH), np.uint8)
    for i, (_, before) in enumerate(group):
        back[i, : len(before)] = np.frombuffer(before, np.uint8)[::-1]
    by_length = np.argsort(left, kind="stable")
    order = by_length[np.argsort(back[by_length].view(f"S{REACH}").ravel(), kind="stable")]
    s, size = back[order], left[order]
    differ = s[1:] != s[:-1]
    alike = np.minimum(np.where(differ.any(1), differ.argmax(1), REACH), np.minimum(size[1:], size[:-1]))
    found, whole = np.zeros((n, REACH + 1), bool), (columns <= left[:, None]) & (LENGTH - columns <= right[:, None])
    for lo in range(0, REACH + 1, 16):
        c = columns[lo : lo + 16]
        before = np.empty((n, len(c)), np.int64)
        before[order] = np.concatenate([np.zeros((1, len(c)), np.int64), np.cumsum(alike[:, None] < c, axis=0)])
        runs = np.cumsum(shared[:, None] < LENGTH - c, axis=0) * n + before
        runs = np.where(whole[:, lo : lo + 16], runs, -1 - np.arange(n)[:, None])
        found[:, lo : lo + 16] = _twice(runs)
    return found, whole


def _names(group: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the string at every row and column of repeated_strings."""
    out = np.zeros((2, len(group), REACH + 1), np.uint64)
    for lo in range(0, len(group), 1024):  # only the hashes are held for all
        some = group[lo : lo + 1024]
        m = np.zeros((len(some), REACH + LENGTH), np.uint8)
        for i, (suffix, before) in enumerate(some):
            m[i, REACH - len(before) : REACH] = np.frombuffer(before, np.uint8)
            m[i, REACH : REACH + len(suffix)] = np.frombuffer(suffix, np.uint8)
        for k, of_byte in enumerate((_Hasher.TABLE, _Hasher.TABLE[::-1])):
            sums = np.zeros((len(some), REACH + LENGTH + 1), np.uint64)
            # strings that are equal have their anchor at the same distance, so places may have weights
            np.cumsum(of_byte[m] * _Hasher.COLUMNS, axis=1, out=sums[:, 1:])
            out[k, lo : lo + 1024] = (sums[:, LENGTH:] - sums[:, : REACH + 1])[:, ::-1]
    return out[0] * np.uint64(_ODD) + np.arange(REACH + 1, dtype=np.uint64), out[1]


def _found(runs: DataFrame) -> DataFrame:
    """k1, k2, r, start, stop of repeated strings; for parts of big groups also, with s1 and s2, all that may repeat
    elsewhere. A cell's runs must follow each other."""

    def solve(some: list[tuple[bytes, bytes]], shared: np.ndarray, big: bool, out: list[list]) -> None:
        group = [(s, r[38:]) for s, r in some]
        found, whole = repeated_strings(group, shared)
        at = np.array([int.from_bytes(r[6:14], "big") for _, r in some])
        keys = np.array([[int.from_bytes(r[i : i + 8], "big", signed=True) for i in (14, 22, 30)] for _, r in some])
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, near = np.nonzero(edge == 1)
        far = np.nonzero(edge == -1)[1] - 1
        if len(row):
            out.append([*keys[row].T, at[row] - far, at[row] - near + LENGTH, None, None])
        if big:
            s1, s2 = _names(group)
            row, column = np.nonzero(whole)
            _, one = np.unique(s1[row, column], return_index=True)  # a string of each kind
            row, column = row[one], column[one]
            out.append([*keys[row].T, at[row] - column, at[row] - column + LENGTH, s1[row, column].astype(np.int64), s2[row, column].astype(np.int64)])

    def together(rows: list[tuple[int, bytes, bytes]], out: list[list]) -> None:
        shared = np.array([n for n, _, _ in rows])
        big = np.array([r[0] for _, _, r in rows], bool)
        alone = (shared < GRAM) & np.r_[shared[1:] < GRAM, True] & ~big
        part = np.array([int.from_bytes(r[2:6], "big") for _, _, r in rows])
        of = np.cumsum(shared < GRAM)  # which k-gram
        sets = [(np.flatnonzero(~alone & ~big), False)]
        if big.any():
            at = np.flatnonzero(big)
            at = at[np.lexsort((at, part[at], of[at]))]
            sets += [(x, True) for x in np.split(at, np.flatnonzero((np.diff(of[at]) != 0) | (np.diff(part[at]) != 0)) + 1)]
        for at, is_big in sets:
            if len(at) > 1 or (len(at) and is_big):
                # what suffixes share that are neighbours only without those between
                common = np.minimum.reduceat(np.r_[shared, 0], at + 1)[: len(at) - 1]
                solve([rows[i][1:] for i in at.tolist()], np.r_[0, common], is_big, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bodies, out = None, [], []

        def cell() -> Iterator[pa.RecordBatch]:
            rows: list[tuple[int, bytes, bytes]] = []
            for x in LoserTree([opened_run(x) for x in bodies]):
                if x[0] < GRAM and len(rows) >= TOGETHER:
                    together(rows, out)
                    rows = []
                rows.append(x)
            together(rows, out)
            bodies.clear()
            if sum(len(o[0]) for o in out) > 10_000:
                yield made(out)
                out.clear()

        for b in batches:
            for c, body in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if c != now and bodies:
                    yield from cell()
                now = c
                bodies.append(body.as_py())
        if bodies:
            yield from cell()
        if out:
            yield made(out)

    def made(out: list[list]) -> pa.RecordBatch:
        columns = [pa.array(np.concatenate([o[i] for o in out]), pa.int64()) for i in range(5)]
        columns += [pa.concat_arrays([pa.nulls(len(o[0]), pa.int64()) if o[i] is None else pa.array(o[i], pa.int64()) for o in out]) for i in (5, 6)]
        return pa.RecordBatch.from_arrays(columns, names=["k1", "k2", "r", "start", "stop", "s1", "s2"])

    return runs.mapInArrow(lean(run), "k1 long, k2 long, r long, start long, stop long, s1 long, s2 long")


def repeated_spans(keyed: DataFrame, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """k1, k2, r, and in packed and more the spans (start, stop) of the bytes to remove, from rows (k1, k2: key of the
    text, r: of the row, text).

    Rows with any span are named one by one, copies too (a copied text is removed whole, so no copy needs what is found
    for another): the joins with the texts have no key that many rows share.
    """
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_cell = F.coalesce(F.col("cell").cast("long"), F.xxhash64("run", "k1", "r"))
    rows = _runs(keyed, max(64, 4 * parts), chunk).repartition(parts, by_cell).sortWithinPartitions("cell")
    found = stash(_occurrences(rows, group), "suffix-anchors")
    texts = stash(_per_text(found.repartition(parts, F.col("run")).sortWithinPartitions("run")), "suffix-texts")
    sort = texts.filter("places IS NOT NULL").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("r").alias("p_r"), "places", "grams", "parts", "bigs")
    here = keyed.join(sort, (F.col("k1") == F.col("p1")) & (F.col("k2") == F.col("p2")) & (F.col("r") == F.col("p_r")))
    runs = _suffix_runs(here.select("k1", "k2", "r", "text", "places", "grams", "parts", "bigs"), 4 * parts).repartition(parts, F.col("cell")).sortWithinPartitions("cell")
    strings = stash(_found(runs), "suffix-strings")
    again = strings.filter("s1 IS NOT NULL")
    twice = again.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    across = again.join(twice, (F.col("s1") == F.col("t1")) & (F.col("s2") == F.col("t2"))).select("k1", "k2", "r", "start", "stop")
    pair = lambda df: df.select("k1", "k2", "r", F.struct("start", "stop").alias("span"))
    more = pair(strings.filter("s1 IS NULL")).unionByName(pair(across)).groupBy("k1", "k2", "r").agg(F.collect_set("span").alias("more"))
    more = more.select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("r").alias("m_r"), "more")
    settled = texts.groupBy("k1", "k2", "r").agg(F.collect_set("spans").alias("packed"))
    return settled.join(more, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")) & (F.col("r") == F.col("m_r")), "left").drop("m1", "m2", "m_r")


def deduplicated(docs: DataFrame, text: str = "text", row_key: str = "doc_id", outputs: tuple[str, ...] = ("kept", "spans"), carry: list[str] | None = None, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """The columns `carry` (all, if None) and the wanted of: kept (the bytes left), spans (start, stop of those
    removed), kept_text (what of them is UTF-8), and the digests n_bytes, n_removed, n_spans, kept_sha256."""
    carry = list(docs.columns) if carry is None else carry
    if clash := set(carry) & {*OWN, *outputs}:
        raise ValueError(f"columns {sorted(clash)} are the operator's own")
    kinds = {"kept": "binary", "spans": "array<struct<start:bigint,stop:bigint>>", "kept_text": "string", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string"}
    arrow = {"kept": pa.binary(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept_text": pa.string(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    keys = {"_k1": F.xxhash64(F.col(text)), "_k2": F.xxhash64(F.lit("second"), F.col(text)), "_r": F.xxhash64(F.col(row_key))}
    keyed = docs.select(*carry, F.col(text).alias("_text"), *(v.alias(k) for k, v in keys.items()))
    spans = repeated_spans(keyed.select(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), F.col("_r").alias("r"), F.col("_text").alias("text")), group, chunk)
    spans = spans.toDF("_p1", "_p2", "_p_r", "_packed", "_more")
    both = keyed.join(spans, (F.col("_k1") == F.col("_p1")) & (F.col("_k2") == F.col("_p2")) & (F.col("_r") == F.col("_p_r")), "left")
    source = both.select(*carry, "_text", "_packed", "_more")
    schema = StructType([*source.schema.fields[: len(carry)], *StructType.fromDDL(", ".join(f"{o} {kinds[o]}" for o in outputs)).fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[str, list] = {o: [] for o in outputs}
            for t, packed, more in zip(*b.columns[len(carry) :], strict=True):
                x = (t.as_py() or "").encode()
                some = [np.frombuffer(p, np.int64).reshape(-1, 2) for p in packed.as_py() or []]
                if more.is_valid:
                    some.append(np.array([[s["start"], s["stop"]] for s in more.as_py()], np.int64))
                gone = merged(np.concatenate(some)) if some else np.zeros((0, 2), np.int64)
                keep, at = [], 0
                for start, stop in gone.tolist():
                    keep.append(x[at:start])
                    at = stop
                left = b"".join([*keep, x[at:]])
                row = {"kept": left, "n_bytes": len(x), "n_removed": len(x) - len(left), "n_spans": len(gone)}
                if "spans" in made:
                    row["spans"] = [{"start": s, "stop": e} for s, e in gone.tolist()]
                if "kept_text" in made:
                    row["kept_text"] = left.decode(errors="ignore")
                if "kept_sha256" in made:
                    row["kept_sha256"] = hashlib.sha256(left).hexdigest()
                for o in outputs:
                    made[o].append(row[o])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], *(pa.array(made[o], arrow[o]) for o in outputs)], names=[*b.schema.names[: len(carry)], *outputs])

    return source.mapInArrow(lean(cut), schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"), outputs=("n_bytes", "n_removed", "n_spans", "kept_sha256"), carry=["doc_id"])


def cut_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the passages that repeat (what is left of a character cut in two goes, too).

    Defined cases as above; null texts become empty; columns of any name and type pass through; n_chars, where there is
    one, is the length of what is left."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("doc")  # texts are sent once
    got = deduplicated(docs.select(others, "doc_id", "text"), outputs=("kept_text",), carry=["doc"])
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType if "n_chars" in docs.columns else "long")}
    return got.select(*(new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


SQL = None
