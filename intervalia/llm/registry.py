"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import bpe, epsilon_grid, hmm, mixing, ngram_join, quality_fm, quality_rules, suffix_dedup, token_counts, warc

_MODULES = (quality_rules, ngram_join, mixing, hmm, bpe, suffix_dedup, token_counts, warc, quality_fm, epsilon_grid)


def _shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(f) for m in _MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for m in _MODULES for name in vars(m) if name.startswith("op") and name[2].isdigit() and getattr(m, "SQL", None)}
