"""What the operators of this subpackage share: tables, written intermediates, words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stash  # noqa: F401

#: The bytes that separate words (space, and tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """At most n rows, those of least hash of the key. Others are dropped by hash first, so that what
    tasks pass on for the choice is a few times n in all, not in each of them."""
    total, size = df.count(), 1 << 40
    few = df.withColumn("_hash", F.pmod(F.xxhash64(key), F.lit(size)))
    if total > 4 * n:
        few = few.filter(F.col("_hash") < int(size * 4 * n / total))
    return few.orderBy("_hash").limit(n).drop("_hash")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow, giving memory back to the system: arrays as they are freed, the rest as a task ends.

    Workers live on after a task, next to others of their executor; where the C library has no such calls, nothing is done.
    """

    @wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = ctypes.CDLL(None)
        if hasattr(c, "mallopt"):
            c.mallopt(-3, 256 << 10)  # M_MMAP_THRESHOLD: larger blocks are mapped, and unmapped when freed
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(c, "malloc_trim"):
                c.malloc_trim(0)

    return task


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def packed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """`doc`, a struct of all columns, and those named: whatever else docs has can't clash; `doc.*` brings it back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *columns)


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")
