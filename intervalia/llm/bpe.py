"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary gives
every token that starts at every byte of a piece. A piece is encoded from the longest token onwards:
a token may follow another if merging the bytes of the two alone gives back just these two (found by
taking back their merges; answers are memoised); where none may follow, the last token is taken back for a shorter one. A byte from
which no way leads on is never tried again, so the time is linear in the piece. As a prefix has just
one encoding, the result is that of merging by rank.

Workers open the vocabulary at its path, which must be the same on all of them.

Defined cases: a null text counts as empty and has no tokens; strings that look like special tokens
are ordinary text; a very long text is encoded whole, in memory in proportion to it (pieces of over
LONGEST characters aren't remembered); repeated rows and empty tables need no care, as rows are
independent; a carried column named like an output is an error.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

#: Pieces and pairs remembered by a worker before it forgets all and starts anew.
REMEMBERED = 400_000
#: Above all ranks.
NEVER = 1 << 62
#: Characters of a piece that is remembered.
LONGEST = 256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: join the adjacent pair of least rank, leftmost first, until none is a token."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 256), i) for i in range(len(parts) - 1))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.split: dict[int, tuple[int, ...] | None] = {}
        self.follows: dict[tuple[int | None, int], bool] = {}
        self.known: dict[str, tuple[tuple[int, ...], bytes]] = {}

    def halves(self, t: int) -> tuple[int, int] | tuple[()] | None:
        """The two tokens whose merge makes t, none for a byte; None if merging never makes it."""
        if t not in self.split:
            parts = [self.token[t][i : i + 1] for i in range(len(self.token[t]))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.split[t] = () if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.split[t]

    def _apart(self, a: int, b: int) -> bool:
        """Takes back the merges inside a and b, the latest first: nowhere may the tokens that then meet have merged before it."""
        before = NEVER
        while self.ranks.get(self.token[a] + self.token[b], NEVER) >= before:
            later_a = a > b
            if not (half := self.halves(a if later_a else b)):
                later_a = not later_a
                if not (half := self.halves(a if later_a else b)):
                    return True
            if later_a:
                before, a = a, half[1]
            else:
                before, b = b + 1, half[0]
        return False

    def may_follow(self, a: int | None, b: int) -> bool:
        """Whether the bytes of a and b, merged alone, are these two tokens (of b, if there's no a); a is one that merging makes."""
        if (got := self.follows.get((a, b))) is None:
            if len(self.follows) >= REMEMBERED:
                self.follows.clear()
            got = self.follows[a, b] = self.halves(b) is not None and (a is None or self._apart(a, b))
        return got

    def encode_piece(self, piece: bytes) -> list[int]:
        if (one := self.ranks.get(piece)) is not None:
            return [one]
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]
        for last, found in self.automaton.iter(piece.decode("latin-1")):
            starts[last - found[1] + 1].append(found)  # the longest comes last
        # every byte is reached once, as the tokens before it are settled: what was tried there needn't be kept
        dead, asked = bytearray(len(piece) + 1), self.follows.get
        ids: list[int | None] = [None]
        sizes: list[int] = []
        at = 0
        while at < len(piece):
            found, last = starts[at], ids[-1]
            while found:
                i, n = found.pop()
                if not dead[at + n]:
                    if (ok := asked((last, i))) is None:
                        ok = self.may_follow(last, i)
                    if ok:
                        ids.append(i)
                        sizes.append(n)
                        at += n
                        break
            else:
                dead[at] = 1
                ids.pop()
                at -= sizes.pop()
        return ids[1:]

    def _piece(self, piece: str) -> tuple[tuple[int, ...], bytes]:
        if (got := self.known.get(piece)) is None:
            ids = tuple(self.encode_piece(piece.encode()))
            got = ids, b" ".join(b"%d" % i for i in ids)
            if len(piece) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[piece] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self._piece(p)[0] for p in self.pieces(text or "")))

    def encode_listed(self, text: str | None) -> tuple[list[int], bytes]:
        """The ids, and the same in decimal joined by a space."""
        known, pieces = self.known, self.pieces(text or "")
        both = [known.get(p) or self._piece(p) for p in pieces]
        return list(chain.from_iterable([x[0] for x in both])), b" ".join([x[1] for x in both])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Lengths(dict):
    """How many tokens a piece has, by piece."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> int:
        n = len(self.codec.encode_piece(piece.encode()))
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


@lru_cache(maxsize=4)
def lengths(path: str, pattern: str) -> Lengths:
    return Lengths(codec(path, pattern))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


#: What encoded() can add, by name.
OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "decoded": pa.binary(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encoded(docs: DataFrame, path: str, pattern: str, outputs: tuple[str, ...] = ("ids",), text: str = "text", carry: list[str] | None = None, forget: bool = False) -> DataFrame:
    """The columns `carry` (all, if None) and the wanted OUTPUTS; the decoded ones come from the ids.

    Workers keep the vocabulary and what they remember for their next task; with `forget`, they give both up as a task ends, so
    that they don't stand beside the stages that follow.
    """
    carry = list(docs.columns) if carry is None else carry
    if clash := set(carry) & set(outputs):
        raise ValueError(f"columns {sorted(clash)} exist already")
    source = docs.select(F.col(text).alias("_text"), *carry)
    names = {"ids": "array<int>", "n_tokens": "long", "decoded": "binary", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]] + [f"{o} {names[o]}" for o in outputs])

    def encode(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        made: dict[str, list] = {o: [] for o in outputs}
        for x in batch.column(0):
            ids, listed = c.encode_listed(x.as_py())
            back = c.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
            row = {"ids": ids, "n_tokens": len(ids), "decoded": back}
            if "ids_sha256" in made:
                row["ids_sha256"] = hashlib.sha256(listed).hexdigest()
            if "decoded_sha256" in made:
                row["decoded_sha256"] = hashlib.sha256(back).hexdigest()
            for o in outputs:
                made[o].append(row[o])
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(made[o], OUTPUTS[o]) for o in outputs)], names=[*batch.schema.names[1:], *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        try:
            for batch in batches:
                yield encode(c, batch)
        finally:
            if forget:
                codec.cache_clear()

    return source.mapInArrow(lean(run), schema)


def counted(docs: DataFrame, paths: dict[str, str], pattern: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all, if None) and, by name, how many tokens the text has in each vocabulary; texts are split once for all."""
    carry = list(docs.columns) if carry is None else carry
    if clash := set(carry) & set(paths):
        raise ValueError(f"columns {sorted(clash)} exist already")
    source = docs.select(F.col(text).alias("_text"), *carry)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]] + [f"`{n}` long" for n in paths])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [lengths(path, pattern).__getitem__ for path in paths.values()]
        split = codec(next(iter(paths.values())), pattern).pieces
        for batch in batches:
            got = []
            for x in batch.column(0):
                pieces = split(x.as_py() or "")
                got.append([sum(map(k, pieces)) for k in known])
            columns = zip(*got, strict=True) if got else [[] for _ in paths]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(c, pa.int64()) for c in columns)], names=[*batch.schema.names[1:], *paths])

    return source.mapInArrow(lean(run), schema)


def decoded(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for (null: none)."""

    @F.udf("binary", useArrow=True)
    def back(x):
        return None if x is None else codec(path, pattern).decode(x)

    return df.withColumn(out, back(ids))


def default_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers as public

    return public.path(name), public.PATTERN


DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_vocabulary()
    return encoded(table(spark, sf_dir, "documents"), path, pattern, DIGESTS, carry=["doc_id"])


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the digests of what op5_bpe returns, for the documents left (their other columns aren't read).

    Defined cases: as above; a document that the mix took twice has two rows."""
    path, pattern = default_vocabulary()
    return encoded(docs, path, pattern, DIGESTS, carry=["doc_id"], forget=True)


SQL = None
