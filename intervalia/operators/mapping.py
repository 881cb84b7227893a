"""Matching of label sequences to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def resampled(slots: DataFrame, labels: DataFrame, page: Cols, slot_order: Cols, label_order: Cols, label: str) -> DataFrame:
    """Each page's labels on its slots: one to one if they are as many, else the label at the half-even rounded place in proportion."""
    s = slots.withColumns({"_i": F.row_number().over(Window.partitionBy(*page).orderBy(*slot_order)) - 1, "_n": F.count(F.lit(1)).over(Window.partitionBy(*page))})
    t = labels.select(*page, F.col(label), (F.row_number().over(Window.partitionBy(*page).orderBy(*label_order)) - 1).alias("_j"), F.count(F.lit(1)).over(Window.partitionBy(*page)).alias("_m"))
    sizes = t.groupBy(*page).agg(F.max("_m").alias("_m"))
    at = F.when(F.col("_n") > 1, F.bround(F.col("_i") * (F.col("_m") - 1) / (F.col("_n") - 1))).otherwise(0).cast("int")
    s = s.join(sizes, page).withColumn("_j", at).drop("_m")
    return s.join(t.drop("_m"), [*page, "_j"]).withColumn("slot_no", F.col("_i")).drop("_i", "_n", "_j")


def best_candidate(wanted: DataFrame, candidates: DataFrame, key: Cols, candidate_id: str, count: str, wanted_count: str, source_rank: str, length: str) -> DataFrame:
    """Per key the candidate nearest in count; then of better source, then longer, then of least id."""
    df = wanted.join(candidates, key)
    order = [F.abs(F.col(count) - F.col(wanted_count)), F.col(source_rank), F.col(length).desc(), F.col(candidate_id)]
    return df.withColumn("_b", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_b = 1").drop("_b")


def segmented(rows: DataFrame, part: Cols, order: Cols, opens_page: str, opens_row: str) -> DataFrame:
    """rows with page_no (rows that open a page, so far) and row_no (rows that open one, so far on the page)."""
    df = rows.withColumn("page_no", F.sum(F.col(opens_page).cast("long")).over(Window.partitionBy(*part).orderBy(*order)))
    return df.withColumn("row_no", F.sum(F.col(opens_row).cast("long")).over(Window.partitionBy(*part, "page_no").orderBy(*order)))


def last_entries(entries: DataFrame, key: Cols, ordinal: str) -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in entries.columns if c not in key]
    return entries.groupBy(*key).agg(F.max_by(F.struct(*rest), ordinal).alias("_e")).select(*key, "_e.*")


def guides_in_order(guides: DataFrame, page: Cols, order: str, top: str, bottom: str, height: str, slack: float = 1.0) -> DataFrame:
    """Per page whether guides lie on it and their tops don't fall (by more than the slack) from one to the next."""
    w = Window.partitionBy(*page).orderBy(order)
    bad = ~((F.col(bottom) > F.col(top)) & (F.col(top) >= 0) & (F.col(bottom) <= F.col(height)))
    df = guides.filter(F.col(top).isNotNull()).withColumn("_bad", bad | F.coalesce(F.col(top) < F.lag(top).over(w) - slack, F.lit(False)))
    return df.groupBy(*page).agg((~F.bool_or("_bad")).alias("in_order"), F.count(F.lit(1)).alias("n_guides"))
