import hashlib
import sys

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from intervalia.llm import bpe

PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="abeht n\n'sé ", max_size=60))
def test_same_as_library(library, text):
    c = bpe.codec(PATH, PATTERN)
    assert c.encode(text) == library.encode_ordinary(text)
    assert c.decode(c.encode(text)) == text.encode()


def test_every_character_is_cut_alike(library):
    c = bpe.codec(PATH, PATTERN)
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    odd = [x for x in chars[:0x3100] if c.encode(f"a{x} {x}1{x}") != library.encode_ordinary(f"a{x} {x}1{x}")]
    assert odd == []


def test_pieces_as_merged_by_rank():
    c = bpe.codec(PATH, PATTERN)
    for piece in (b"aaaaaaaaaaaaaaaaaaaaaaaa", b"ononthannedtionstible", "élelleaeaux".encode(), bytes(range(256))):
        assert c.encode_piece(piece) == ([c.ranks[piece]] if piece in c.ranks else bpe.merge_by_rank(piece, c.ranks))
    assert regex.findall(PATTERN, "a  b") == ["a", " ", " b"]


def test_rows(spark, library):
    texts = ["Hello <|endoftext|> world", "", None, "x" * 50_000, "two\r\n  spaces\t", "Hello <|endoftext|> world"]
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, token string")
    got = bpe.encoded(docs, PATH, PATTERN, ("ids", "decoded", *bpe.DIGESTS)).orderBy("doc_id").collect()
    for row, text in zip(got, texts, strict=True):
        ids = library.encode_ordinary(text or "")
        assert row["ids"] == ids and row["n_tokens"] == len(ids) and bytes(row["decoded"]) == (text or "").encode()
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    again = bpe.decoded(bpe.encoded(docs, PATH, PATTERN).select("doc_id", "ids"), PATH, PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in again.collect()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encoded(docs.limit(0), PATH, PATTERN).count() == 0


def test_counts(spark, library):
    texts = ["Hello <|endoftext|> world", "", None, "x" * 50_000, "two\r\n  spaces\t é¿ß漢字 ", "z" * 300 + " a b"]
    multi = bpe.default_vocabulary("byte_bpe_multi_50k.tiktoken")[0]
    other = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(multi), special_tokens={})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.counted(docs, {"a": PATH, "b": multi}, PATTERN, carry=["doc_id"]).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(i, len(library.encode_ordinary(t or "")), len(other.encode_ordinary(t or ""))) for i, t in enumerate(texts)]
    assert bpe.counted(docs.limit(0), {"a": PATH}, PATTERN).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_tokens_that_may_follow(name):
    c = bpe.codec(*bpe.default_vocabulary(name))
    ids = sorted(c.token)
    for k in range(4000):
        a, b = ids[k * 7919 % len(ids)], ids[k * k * 31 % len(ids)]
        assert c.may_follow(a, b) == (bpe.merge_by_rank(c.token[a] + c.token[b], c.ranks) == [a, b])
