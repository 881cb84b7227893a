"""Overlays, edits and differences: tables that take precedence over others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def overlaid(base: DataFrame, overlay: DataFrame, key: str, replaced_key: str | None = None, pages: DataFrame | None = None, page: str = "page") -> DataFrame:
    """base without rows that the overlay replaces (by key, and on pages it rules), with the overlay's rows; origin says whose."""
    gone = overlay.select(F.col(replaced_key or key).alias(key)).distinct()
    kept = base.join(gone, key, "left_anti")
    if pages is not None:
        kept = kept.join(pages.select(page).distinct(), page, "left_anti")
    return kept.withColumn("origin", F.lit("base")).unionByName(overlay.withColumn("origin", F.lit("overlay")), allowMissingColumns=True)


def upserted(old: DataFrame, new: DataFrame, key: Cols) -> DataFrame:
    """Documents merged by field: the new value, else the old one."""
    fields = [c for c in old.columns if c not in key] + [c for c in new.columns if c not in old.columns]
    o = old.select(*key, *(F.col(c).alias(f"_o_{c}") for c in old.columns if c not in key))
    n = new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in new.columns if c not in key))
    pick = [F.coalesce(*(F.col(f"{s}{c}") for s, df in (("_n_", n), ("_o_", o)) if f"{s}{c}" in df.columns)).alias(c) for c in fields]
    return o.join(n, key, "full_outer").select(*key, *pick)


def changed(before: DataFrame, after: DataFrame, key: Cols, value: str) -> DataFrame:
    """Keys of both whose value differs (null equals null): before_value, after_value."""
    b, a = before.select(*key, F.col(value).alias("before_value")), after.select(*key, F.col(value).alias("after_value"))
    return b.join(a, key).filter(~F.col("before_value").eqNullSafe(F.col("after_value")))


def key_difference(expected: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are unknown, duplicate and missing in what was returned, and whether it is accepted."""
    e, r = expected.select(key).distinct(), returned.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = e.withColumn("_e", F.lit(1)).join(r, key, "full_outer")
    got = both.agg(
        F.count_if(F.col("_e").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("duplicate"), F.count_if(F.col("n").isNull()).alias("missing")
    )
    return got.withColumn("accepted", (F.col("unknown") == 0) & (F.col("duplicate") == 0) & (F.col("missing") == 0))


def overlapping_pairs(rows: DataFrame, page: Cols, key: str, order: str, condition) -> DataFrame:
    """(key, earlier): rows that overlap one before them on their page; condition takes two name -> column functions."""
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{p}") == F.col(f"b.{p}") for p in page] + [F.col(f"b.{order}") < F.col(f"a.{order}"), condition(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))]
    where = on[0]
    for c in on[1:]:
        where &= c
    return a.join(b, where).select(*(F.col(f"a.{p}") for p in page), F.col(f"a.{key}"), F.col(f"b.{key}").alias("earlier"))


def last_wins(edits: DataFrame, key: Cols, order: Cols, value: str, reject: Column | None = None) -> DataFrame:
    """Per key the last edit that isn't rejected."""
    ok = edits if reject is None else edits.filter(reject.isNull())
    return ok.groupBy(*key).agg(F.max_by(value, F.struct(*order)).alias(value), F.count(F.lit(1)).alias("n_applied"))


#: Edit types and what each needs of its row; fixed values.
EDITS = {
    "set_system_start": ("system", "number"),
    "set_measure_number": ("measure", "number"),
    "clear_measure_number": ("measure", None),
    "set_labels_mode": (None, "mode"),
    "set_rest_measure": ("measure", "count"),
    "set_pickup_measure": ("measure", "flag"),
    "set_rest_staff": ("system", "count"),
    "set_ending": ("measure", "ending"),
}


def judged_edits(edits: DataFrame, measures: DataFrame, systems: DataFrame, job: Cols) -> DataFrame:
    """edits (job, ord, type, target_id, value) with reject_reason, null for those that apply.

    Ids are looked up in the state before the batch, so an edit can't address what another one makes.
    """
    m = measures.select(*job, F.col("measure_id").alias("target_id"), F.lit(True).alias("_m"), F.col("excluded").alias("_x"))
    s = systems.select(*job, F.col("system_id").alias("target_id"), F.lit(True).alias("_s"))
    df = edits.join(m, [*job, "target_id"], "left").join(s, [*job, "target_id"], "left")
    kind = lambda what, i: F.col("type").isin(*(t for t, need in EDITS.items() if need[i] == what))
    blank = F.coalesce(F.trim("target_id"), F.lit("")) == ""
    number = F.trim("value").try_cast("int")
    reason = (
        F.when(~F.coalesce(F.col("type").isin(*EDITS), F.lit(False)), "unsupported_edit_type")
        .when(kind("system", 0) & F.col("_s").isNull(), "unknown_system_id")
        .when(kind("measure", 0) & blank, "missing_measure_id")
        .when(kind("measure", 0) & F.col("_m").isNull(), "unknown_measure_id")
        .when(kind("measure", 0) & F.col("_x"), "measure_excluded_from_counting")
        .when(kind("number", 1) & number.isNull(), "invalid_value")
        .when(kind("number", 1) & ~number.between(0, 1_000_000), "value_out_of_range")
        .when(kind("count", 1) & (number.isNull() | (number < 0)), "invalid_measure_count")
        .when(kind("mode", 1) & ~F.coalesce(F.lower(F.trim("value")).isin("system_only", "all_measures"), F.lit(False)), "invalid_value")
        .when(kind("flag", 1) & ~F.coalesce(F.lower("value").isin("true", "false"), F.lit(False)), "invalid_value")
        .when(kind("ending", 1) & ~F.coalesce(F.trim("value"), F.lit("")).isin("", "none", "1", "2"), "invalid_ending_value")
    )
    return df.withColumn("reject_reason", reason).drop("_m", "_s", "_x")


def exclusive_flags(edits: DataFrame, parent: Cols, child: str, order: Cols, flag: str) -> DataFrame:
    """The child that holds its parent's flag in the end: the last one set, unless it was cleared later."""
    by = F.struct(*order)
    last = edits.filter(flag).groupBy(*parent).agg(F.max_by(child, by).alias(child), F.max(by).alias("_at"))
    cleared = edits.filter(~F.col(flag)).groupBy(*parent, child).agg(F.max(by).alias("_off"))
    got = last.join(cleared, [*parent, child], "left").filter(F.col("_off").isNull() | (F.col("_off") < F.col("_at")))
    return got.select(*parent, child)


def keep_last(rows: DataFrame, part: Cols, order: Cols, n: int) -> DataFrame:
    """The last n rows of each partition."""
    at = F.row_number().over(Window.partitionBy(*part).orderBy(*(F.col(c).desc() for c in order)))
    return rows.withColumn("_n", at).filter(F.col("_n") <= n).drop("_n")
