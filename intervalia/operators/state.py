"""The state of a job: systems and measures with their edits, refreshed as a whole.

systems: job, system_id, page, y_top, y_bottom, x_left, source, start (first number or null)
measures: job, measure_id, system_id, page, x_left, x_right, y_top, y_bottom, source, excluded
edits: job, measure_id, override, rest, pickup, ending (one row a measure with any)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import layout, numbering


def sane_edits(edits: DataFrame) -> DataFrame:
    """Values out of range are dropped, and rows left with none."""
    df = edits.filter(F.coalesce(F.trim("measure_id"), F.lit("")) != "").select(
        "job", "measure_id", F.when(F.col("override").between(0, 1_000_000), F.col("override")).alias("override"), F.when(F.col("rest") > 0, F.col("rest")).alias("rest"),
        F.coalesce("pickup", F.lit(False)).alias("pickup"), F.when(F.trim("ending").isin("1", "2"), F.trim("ending")).alias("ending"),
    )
    return df.filter("override IS NOT NULL OR rest IS NOT NULL OR pickup OR ending IS NOT NULL")


def without_orphans(tables: dict[str, DataFrame], measures: DataFrame) -> dict[str, DataFrame]:
    """Every table by measure, without the rows of measures that are gone."""
    ids = measures.select("job", "measure_id")
    return {name: df.join(ids, ["job", "measure_id"], "left_semi") for name, df in tables.items()}


def inherited_rows(rows: DataFrame, systems: DataFrame) -> DataFrame:
    """Edited rows (job, system_id, source_system_id) with the start of the system they were, or came from."""
    by = lambda name: systems.select("job", F.col("system_id").alias(name), F.col("start").alias(f"_{name}"))
    df = rows.join(by("system_id"), ["job", "system_id"], "left").join(by("source_system_id"), ["job", "source_system_id"], "left")
    return df.withColumn("start", F.coalesce("_system_id", "_source_system_id")).drop("_system_id", "_source_system_id")


def placed(measures: DataFrame, systems: DataFrame, ruled_pages: DataFrame | None = None) -> DataFrame:
    """measures with the system that they lie in; drawn rows, and pages that edits rule, keep theirs."""
    judged = layout.short_outliers(systems.withColumn("_h", F.col("y_bottom") - F.col("y_top")).filter("source <> 'manual'"), ["job", "page"], "_h")
    free = measures.filter("source <> 'manual'")
    if ruled_pages is not None:
        free = free.join(ruled_pages.select("job", "page").distinct(), ["job", "page"], "left_anti")
    best = layout.assign_intervals(free, judged.withColumnsRenamed({"system_id": "best_id", "y_top": "_st", "y_bottom": "_sb"}), ["job", "page"], "measure_id", "best_id", "y_top", "y_bottom", "_st", "_sb", "is_short")
    df = measures.join(best.select("job", "page", "measure_id", "best_id"), ["job", "page", "measure_id"], "left")
    return df.withColumns({"reassigned": F.coalesce(F.col("best_id") != F.col("system_id"), F.lit(False)), "system_id": F.coalesce("best_id", "system_id")}).drop("best_id")


def refreshed(systems: DataFrame, measures: DataFrame, edits: DataFrame, ruled_pages: DataFrame | None = None, staff_rests: DataFrame | None = None) -> DataFrame:
    """measures placed, indexed and numbered: reassigned, parent_index, local_index, global_index, label; staff_rests as in with_carry."""
    at = placed(measures, systems, ruled_pages)
    df = numbering.reindexed(at, systems, ["job"], "system_id", ["page", "y_top", "x_left", "system_id"], ["x_left", "measure_id"])
    df = df.join(sane_edits(edits), ["job", "measure_id"], "left").withColumn("pickup", F.coalesce("pickup", F.lit(False)))
    first = systems.withColumn("_n", F.row_number().over(Window.partitionBy("job").orderBy("page", "y_top", "x_left", "system_id"))).filter("_n = 1").select("job", F.col("start").alias("_start"))
    df = df.join(first, "job", "left")
    if staff_rests is None:
        return numbering.numbered_with_endings(df, ["job"], ["global_index"], kind="ending", start="_start").drop("_start")
    return numbering.numbered_with_endings(with_carry(df, staff_rests), ["job"], ["global_index"], kind="ending", start="_start", carry="_carry").drop("_start", "_carry")


def with_carry(indexed: DataFrame, staff_rests: DataFrame) -> DataFrame:
    """indexed with _carry: where a system begins, the rest (job, system_id, rest) of the whole one before it, unless a counted measure
    there has a rest of its own."""
    own = indexed.filter("NOT coalesce(excluded, false) AND rest > 0").select("job", "system_id").distinct()
    whole = staff_rests.filter("rest > 0").select("job", "system_id", F.col("rest").alias("_whole")).join(own, ["job", "system_id"], "left_anti").withColumnRenamed("system_id", "_before")
    before = F.lag("system_id").over(Window.partitionBy("job").orderBy("global_index"))
    df = indexed.withColumn("_before", before).withColumn("_before", F.when(F.col("_before") != F.col("system_id"), F.col("_before")))
    return df.join(whole, ["job", "_before"], "left").withColumn("_carry", F.coalesce("_whole", F.lit(0))).drop("_before", "_whole")


def system_labels(state: DataFrame, systems: DataFrame) -> DataFrame:
    """job, system_id, label: the first label of each system, else what it began with."""
    first = numbering.first_labels(state, ["job", "system_id"], ["global_index"])
    return systems.join(first, ["job", "system_id"], "left").select("job", "system_id", "page", F.coalesce("first_label", "start").alias("label"))


def warnings(state: DataFrame, systems: DataFrame) -> DataFrame:
    """job, page, system_id, warning: short rows, rows without measures, and starts that come again on a page."""
    judged = layout.short_outliers(systems.withColumn("_h", F.col("y_bottom") - F.col("y_top")), ["job", "page"], "_h")
    short = judged.filter("is_short").select("job", "page", "system_id", F.lit("suspicious_partial_staff").alias("warning"))
    empty = systems.join(state.select("job", "system_id"), ["job", "system_id"], "left_anti").select("job", "page", "system_id", F.lit("system_has_no_measures").alias("warning"))
    labels = system_labels(state, systems).join(systems.select("job", "system_id", "y_top"), ["job", "system_id"]).filter("label IS NOT NULL").withColumn("label", F.col("label").cast("string"))
    again = layout.repeated_later(labels, ["job", "page"], ["y_top", "system_id"], "label").select("job", "page", F.lit(None).cast("string").alias("system_id"), F.lit("duplicate_later_system_start").alias("warning"))
    return short.unionByName(empty).unionByName(again)


def quality(state: DataFrame, systems: DataFrame) -> DataFrame:
    """One row a job: status, counts, sorted pages with warnings."""
    w = warnings(state, systems).groupBy("job").agg(F.count(F.lit(1)).alias("n_warnings"), F.sort_array(F.collect_set("page")).alias("pages"))
    n = systems.groupBy("job").agg(F.count(F.lit(1)).alias("n_systems"))
    m = state.groupBy("job").agg(F.count(F.lit(1)).alias("n_measures"), F.count_if("reassigned").alias("n_reassigned"))
    df = n.join(m, "job", "left").join(w, "job", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return df.select("job", F.when(F.col("n_warnings") > 0, "warning").otherwise("ok").alias("status"), "n_systems", count("n_measures"), count("n_reassigned"), count("n_warnings"), F.coalesce("pages", F.array().cast("array<int>")).alias("pages"))


def auto_rows(state: DataFrame) -> DataFrame:
    """Per system its bounds and its measures as boxes, in order."""
    box = F.struct("x_left", "x_right", "measure_id", "excluded")
    return state.filter("source <> 'manual'").groupBy("job", "page", "system_id").agg(F.min("x_left").alias("left"), F.max("x_right").alias("right"), F.min("y_top").alias("top"), F.max("y_bottom").alias("bottom"), F.array_sort(F.collect_list(box)).alias("boxes"))


def drawn_labels(state: DataFrame, systems: DataFrame, mode: str, forced: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """job, measure_id, label, hidden: every label, or the first of each visual row; forced ones always, hidden ones marked."""
    all_ = state.filter("label IS NOT NULL").select("job", "measure_id", "system_id", "global_index", "label")
    if mode == "all_measures":
        some = all_
    else:
        first = all_.withColumn("_n", F.row_number().over(Window.partitionBy("job", "system_id").orderBy("global_index"))).filter("_n = 1").drop("_n")
        heads = layout.same_row_groups(systems.select("job", "page", "system_id", "y_top", "y_bottom", "x_left"), ["job", "page"], "system_id", "y_top", "y_bottom", ["x_left", "system_id"])
        left = heads.join(first.select("job", "system_id", "global_index"), ["job", "system_id"])
        keep = left.withColumn("_n", F.row_number().over(Window.partitionBy("job", "page", "row_head").orderBy("x_left", "global_index"))).filter("_n = 1").select("job", "system_id")
        some = first.join(keep, ["job", "system_id"], "left_semi")
    if forced is not None:
        more = all_.join(forced.select("job", "measure_id").distinct(), ["job", "measure_id"], "left_semi").join(some.select("job", "measure_id"), ["job", "measure_id"], "left_anti")
        some = some.unionByName(more)
    off = (hidden.select("job", "measure_id").distinct() if hidden is not None else some.select("job", "measure_id").limit(0)).withColumn("_off", F.lit(True))
    return some.join(off, ["job", "measure_id"], "left").select("job", "measure_id", "label", F.coalesce("_off", F.lit(False)).alias("hidden"))


def version(state: DataFrame) -> DataFrame:
    """job, version: 16 hex digits that change with any label, place or flag of its measures, and with their number. Rows are
    hashed one by one and added up, so that no job is gathered in one row and equal rows all count."""
    names = ("measure_id", "system_id", "global_index", "label", "excluded")
    cells = [x for c in names for x in (F.col(c).isNull(), F.col(c))]  # a hash passes over nulls
    sums = [F.sum(F.xxhash64(F.lit(i), *cells).cast("decimal(38,0)")) for i in range(2)]
    whole = state.groupBy("job").agg(F.count(F.lit(1)).alias("n"), *(s.alias(f"s{i}") for i, s in enumerate(sums)))
    return whole.select("job", F.substring(F.sha1(F.concat_ws("|", "n", "s0", "s1").cast("binary")), 1, 16).alias("version"))
