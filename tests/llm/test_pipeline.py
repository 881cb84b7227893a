"""The pipeline against a plain version of each stage, on the driver's smallest tables."""

import hashlib
import os
from collections import Counter

import pytest

import corpus_pipeline
from intervalia.llm import bpe, mixing, ngram_join, quality_rules
from intervalia.llm.common import table

from .conftest import SF
from .test_texts import cut_plainly, joined_plainly

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_join", "suffix_dedup", "mixing", "bpe"]

    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    verdict = {r["doc_id"] for r in quality_rules.op1_quality_rules(spark, SF).filter("kept").collect()}
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == verdict and len(verdict) > 50

    one = corpus_pipeline.near_copies(spark, kept, SF).cache()
    rows = sorted(kept.collect(), key=lambda r: r["doc_id"])
    _, _, top = joined_plainly([r["text"] for r in rows])
    assert {r["doc_id"] for r in one.collect()} == {r["doc_id"] for i, r in enumerate(rows) if top[i] == i}

    cut = corpus_pipeline.repeats(spark, one, SF).cache()
    rows = sorted(one.collect(), key=lambda r: r["doc_id"])
    want = {r["doc_id"]: d for r, d in zip(rows, cut_plainly([r["text"] for r in rows]), strict=True)}
    for r in cut.collect():
        n, gone, _, sha = want[r["doc_id"]]
        if gone == 0:
            assert hashlib.sha256(r["text"].encode()).hexdigest() == sha
        assert len(r["text"].encode()) <= n - gone and r["n_chars"] == len(r["text"])

    mix = corpus_pipeline.mix(spark, cut, SF).cache()
    taken = {r["doc_id"]: len(r["_draws"]) for r in mixing.mixed(cut).collect()}
    assert mix.columns == columns and Counter(r["doc_id"] for r in mix.collect()) == Counter({k: v for k, v in taken.items() if v})

    out = corpus_pipeline.encode(spark, mix, SF)
    path, pattern = bpe.default_vocabulary()
    codec = bpe.codec(path, pattern)
    want = Counter((r["doc_id"], len(codec.encode(r["text"])), hashlib.sha256(r["text"].encode()).hexdigest()) for r in mix.collect())
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out.collect()) == want
    assert corpus_pipeline.run(spark, SF).count() == mix.count()
    assert ngram_join.PERCENT == 80
