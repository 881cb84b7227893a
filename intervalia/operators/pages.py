"""Bounds, counters, guides and summaries of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def visual_bounds(systems: DataFrame, measures: DataFrame, key: Cols) -> DataFrame:
    """key, left, right, top, bottom of systems (anchor_x, anchor_top, anchor_bottom, x_left, x_right, y_top, y_bottom), from
    their measures, their anchor and their own edges; those without an inside have no row.

    A measure's sides count if it has a width, its bottom if it has a height; the anchor's place stands in
    for measures' sides; a system's own right edge counts only beside a left one.
    """
    right, bottom = F.coalesce("x_right", "x_left"), F.coalesce("y_bottom", "y_top")
    wide, high = right > F.col("x_left"), bottom > F.col("y_top")
    whole = measures.filter("x_left IS NOT NULL AND y_top IS NOT NULL")
    m = whole.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min(F.when(wide, F.col("x_left"))).alias("_l"), F.max(F.when(wide, right)).alias("_r"), F.min("y_top").alias("_t"), F.max(F.when(high, bottom)).alias("_b"))
    on = [F.col(k) == F.col(f"_{k}") for k in key]
    left = F.least(F.coalesce("_l", "anchor_x"), "x_left")
    both = systems.join(m, on, "left").select(
        *key, left.alias("left"), F.greatest(F.coalesce("_r", F.col("anchor_x") + 1), F.when(left.isNotNull(), F.col("x_right"))).alias("right"),
        F.least("_t", "anchor_top", "y_top").alias("top"), F.greatest("_b", F.when(F.col("anchor_top").isNotNull(), F.col("anchor_bottom")), "y_bottom").alias("bottom"),
    )
    return both.filter("right > left AND bottom > top")


def bar_counts(staves: DataFrame, page: Cols, order: Cols, bars: str, index: str, left_edges: list[str], right_edge: str, spacing: str, start: int = 1) -> DataFrame:
    """staves with increment, counter_before, left_carry and right_carry: a page's running number of measures by its bar-lines.

    A bar-line at a staff's left edge (but for the page's first system) or right edge ends no measure of its
    own; staves of one bar-line always count it.
    """
    n, edge = F.size(bars), F.coalesce(*left_edges)
    reach = F.greatest(F.lit(8.0), F.when(F.col(spacing) > 0, 0.7 * F.col(spacing)).otherwise(8.0))
    left = F.coalesce((n > 1) & (F.col(index) > 0) & (F.abs(F.array_min(bars) - edge) <= reach), F.lit(False))
    after = n - left.cast("int")
    right = F.coalesce((after > 1) & (F.abs(F.col(right_edge) - F.array_max(bars)) <= reach), F.lit(False))
    df = staves.withColumns({"left_carry": left, "right_carry": right, "increment": F.greatest(F.lit(0), after - right.cast("int"))})
    before = Window.partitionBy(*page).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("counter_before", start + F.coalesce(F.sum("increment").over(before), F.lit(0)))


def rebuilt_guides(guides: DataFrame, labels: DataFrame, page: Cols, index: str, page_width: Column, page_height: Column) -> DataFrame:
    """page, index, x, top, bottom (null where there's none), source and warning, of a page's system guides (x, top, bottom).

    A guide that lacks is taken from the system's label; all are kept on the page; one that lies more
    than a point above the last sound one is out of order.
    """
    on = [*page, index]
    label = labels.select(*(F.col(c).alias(f"_{c}") for c in on), F.col("x").alias("_x"), F.col("top").alias("_top"), F.col("bottom").alias("_bottom"))
    both = guides.join(label, [F.col(c) == F.col(f"_{c}") for c in on], "left")
    from_label = F.col("x").isNull()
    inside = lambda c, most: F.greatest(F.lit(0.0), F.least(F.when(from_label, F.col(f"_{c}")).otherwise(F.col(c)), most))
    missing = from_label & F.col("_x").isNull()
    df = both.select(
        *on, F.when(~missing, F.when(from_label, "label_anchor").otherwise("primary")).alias("source"), *(F.when(~missing, inside(c, most)).alias(c) for c, most in (("x", page_width), ("top", page_height), ("bottom", page_height)))
    )
    sound = F.col("bottom") > F.col("top")
    df = df.withColumns({c: F.when(sound, F.col(c)) for c in ("x", "top", "bottom")})
    last = F.last("top", ignorenulls=True).over(Window.partitionBy(*page).orderBy(index).rowsBetween(Window.unboundedPreceding, -1))
    why = F.when(F.col("source").isNull(), "missing_system_guide").when(F.col("top").isNull(), "invalid_system_span").when(F.col("top") + 1 < last, "bad_system_vertical_order")
    return df.withColumn("warning", why)


def ids_on_pages(measures: DataFrame, pages: DataFrame, key: Cols, measure_id: str = "measure_id", source: str | None = None) -> DataFrame:
    """The ids of measures on the pages (key), of one source if it is named."""
    some = measures if source is None else measures.filter(F.col("source") == source)
    return some.join(pages.select(*key), key, "left_semi").filter(F.trim(F.col(measure_id)) != "").select(measure_id).distinct()


def candidates(measures: DataFrame, order: Cols, excluded: str = "excluded") -> DataFrame:
    """Measures that count, in their order."""
    return measures.filter(~F.coalesce(F.col(excluded), F.lit(False))).orderBy(*order)


def trace_summary(traces: DataFrame, job: Cols, order: Cols, most: int = 50) -> DataFrame:
    """job, history_count, history_max, last_result, last_trace_id of traces (result, trace_id): at most `most` are remembered."""
    last = F.max_by(F.struct("result", "trace_id"), F.struct(*order))
    df = traces.groupBy(*job).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("history_count"), last.alias("_last"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.select(*job, "history_count", F.lit(most).alias("history_max"), blank(F.col("_last.result")).alias("last_result"), blank(F.col("_last.trace_id")).alias("last_trace_id"))


def rejected_pages(rejected: DataFrame, measures: DataFrame, job: Cols) -> DataFrame:
    """rejected (page, measure_id, reason) with the page of the edit, else of its measure (null if neither has one)."""
    m = measures.select(*(F.col(c).alias(f"_{c}") for c in job), F.col("measure_id").alias("_m"), F.col("page").alias("_page"))
    both = rejected.join(m, [*(F.col(c) == F.col(f"_{c}") for c in job), F.trim("measure_id") == F.col("_m")], "left")
    page = F.when(F.col("page") > 0, F.col("page")).when(F.col("_page") > 0, F.col("_page"))
    reason = F.trim(F.coalesce("reason", F.lit("")))
    return both.withColumns({"page": page, "reason": F.when(reason == "", "edit_rejected").otherwise(reason)}).drop(*(f"_{c}" for c in job), "_m", "_page")


def previews(rows: DataFrame, part: Cols, order: Cols, first: int, last: int = 0) -> DataFrame:
    """Of each partition the first rows, and the last ones."""
    w = Window.partitionBy(*part)
    df = rows.withColumn("_n", F.row_number().over(w.orderBy(*order)))
    if last:
        df = df.withColumn("_left", F.count(F.lit(1)).over(w) - F.col("_n"))
    return df.filter((F.col("_n") <= first) | (F.col("_left") < last) if last else F.col("_n") <= first).drop("_n", "_left")


def newest_first(jobs: DataFrame, created: str, tie: str) -> DataFrame:
    return jobs.orderBy(F.col(created).desc_nulls_last(), tie)


def unique_match(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """wanted keys (trimmed, in capitals) with match: found, not_found or not_unique."""
    name = F.upper(F.trim(F.col(key)))
    n = rows.groupBy(F.upper(F.trim(F.col(key))).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    got = wanted.withColumn("_w", name).join(n, F.col("_w") == F.col("_k"), "left")
    return got.withColumn("match", F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "not_unique").otherwise("found")).drop("_w", "_k", "_n")
