"""What a stage leaves behind in the Python workers, which serve the stages that follow."""

import gc
import os

import pyarrow as pa
import pytest

from intervalia.llm import bpe

from .conftest import SF

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_encoding_stage_gives_its_vocabulary_up(spark, monkeypatch):
    path, pattern = bpe.default_vocabulary()
    pattern += "|(?!)"  # matches nothing: tells this test's codecs from others
    monkeypatch.setattr(bpe, "default_vocabulary", lambda: (path, pattern))
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(8)
    assert bpe.encode_documents(spark, docs, SF).count() == docs.count()

    def held(batches):
        for _ in batches:
            pass
        n = sum(isinstance(x, bpe.Codec) and x.pieces.__self__.pattern == pattern for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    assert {r["n"] for r in spark.range(0, 64, 1, 16).mapInArrow(held, "n long").collect()} == {0}
