"""Choices by priority and by place: fallbacks, nearest rows, rows that nothing covers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import away as distance
from .search import candidates

Cols = list[str]


def first_of(rows: DataFrame, part: Cols, order: list[Column]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter("_n = 1").drop("_n")


def first_candidate(candidates: DataFrame, job: Cols, priority: str, found: str, stale: Column) -> DataFrame:
    """Per job the candidate of least priority number that was found; stale_run is set where it is of another run."""
    return first_of(candidates.filter(F.col(found)), job, [F.col(priority)]).withColumn("stale_run", F.coalesce(stale, F.lit(False)))


def next_run(dispatches: DataFrame, runs: DataFrame, key: Cols, at: str, run_at: str, run_id: str, slack: int = 120) -> DataFrame:
    """Each dispatch with the first run of its key that began no more than `slack` seconds before it, or later (null if none)."""
    r = runs.select(*key, F.col(run_at).alias("_at"), F.col(run_id).alias("run"))
    near = dispatches.join(r, key).filter(F.unix_timestamp("_at") >= F.unix_timestamp(at) - slack)
    best = near.groupBy(*dispatches.columns).agg(F.min_by("run", F.struct("_at", "run")).alias("run"))
    return dispatches.join(best.select(*key, at, "run"), [*key, at], "left")


def page_file(pages: DataFrame, manifest: DataFrame, page: Cols, file: str, default: Column) -> DataFrame:
    """pages with the file that the manifest names for them, else the default."""
    m = manifest.select(*page, F.col(file).alias("_f"))
    return pages.join(m, page, "left").withColumn(file, F.coalesce("_f", default)).drop("_f")


def usable_rows(rows: DataFrame, part: Cols, first: Column, second: Column) -> DataFrame:
    """The rows of a partition that hold the first condition; where none does, those that hold the second. tier is 1 or 2."""
    w = Window.partitionBy(*part)
    df = rows.withColumns({"_one": F.coalesce(first, F.lit(False)), "_two": F.coalesce(second, F.lit(False))})
    df = df.withColumn("_any", F.bool_or("_one").over(w))
    return df.filter(F.when(F.col("_any"), F.col("_one")).otherwise(F.col("_two"))).withColumn("tier", F.when(F.col("_any"), 1).otherwise(2)).drop("_one", "_two", "_any")


def uncovered(items: DataFrame, covers: DataFrame, page: Cols, key: str, top: str, bottom: str, c_top: str, c_bottom: str, reach: float = 0.25) -> DataFrame:
    """Items whose centre lies in no cover of their page, covers reaching out by a share of the item's height."""
    c = covers.select(*page, F.col(c_top).alias("_ct"), F.col(c_bottom).alias("_cb"))
    i = items.select(*page, key, ((F.col(top) + F.col(bottom)) / 2).alias("_m"), (reach * (F.col(bottom) - F.col(top))).alias("_r"))
    hit = i.join(c, page).filter((F.col("_m") >= F.col("_ct") - F.col("_r")) & (F.col("_m") <= F.col("_cb") + F.col("_r"))).select(*page, key)
    return items.join(hit, [*page, key], "left_anti")


def nearest_span(items: DataFrame, spans: DataFrame, part: Cols, key: str, hint: str, x: str, top: str, bottom: str, tolerance: float = 2.0) -> DataFrame:
    """Each item with one span of its partition: the left-most that covers its hint, else that of nearest middle, else (without a hint) the left-most.

    Each is looked up in a tree over the partition's spans (as doubles), so no table of pairs is made.
    """
    s = spans.filter(F.col(bottom) > F.col(top)).select(*part, F.col(x).alias("_x"), F.col(top).alias("span_top"), F.col(bottom).alias("span_bottom"))
    middle, end = (F.col("span_top") + F.col("span_bottom")) / 2, F.col("span_bottom") + tolerance
    known = lambda c: F.when(F.isnan(c), F.lit(float("inf"))).otherwise(c)
    held = {"from": F.col("span_top") - tolerance, "to": known(end), "c": known(middle)}

    def score(q, least, most):
        covers = (q("hint") >= least("from")) & (q("hint") <= most("to"))
        return np.where(covers, 0.0, 1.0), np.where(covers, 0.0, distance(q("hint"), least("c"), most("c")))

    df = candidates(items, s, part, [F.col("_x"), F.col("span_top"), F.col("span_bottom")], {"hint": F.col(hint)}, held, ("from", "to"), score)
    covers = F.col(hint).between(F.col("span_top") - tolerance, F.col("span_bottom") + tolerance)
    away = F.abs(middle - F.col(hint))
    tier = F.when(F.coalesce(covers, F.lit(False)), 0).otherwise(1)
    order = [tier, F.when(tier == 0, F.lit(0.0)).otherwise(F.coalesce(away, F.lit(0.0))), F.col("_x"), F.col("span_top"), F.col("span_bottom")]
    return first_of(df, [*part, key], order).drop("_x")


def header_symbol(staves: DataFrame, symbols: DataFrame, part: Cols, staff: str, named: str, symbol_id: str, left: str, top: str, bottom: str, s_left: str, s_top: str, s_bottom: str, likely: str, penalty: float = 1000.0) -> DataFrame:
    """Each staff with the symbol that its header names, else the left-most of those that overlap it, unlikely ones being moved right by the penalty."""
    s = symbols.select(*part, F.col(symbol_id).alias("_id"), F.col(s_left).alias("_l"), F.col(s_top).alias("_t"), F.col(s_bottom).alias("_b"), F.col(likely).alias("_ok"))
    df = staves.join(s, part)
    by_name = F.coalesce(F.col("_id") == F.col(named), F.lit(False))
    df = df.filter(by_name | ((F.least("_b", bottom) > F.greatest("_t", top)) & (F.col("_l") >= F.col(left))))
    place = F.col("_l") + F.when(F.col("_ok"), 0.0).otherwise(penalty)
    return first_of(df, [*part, staff], [by_name.desc(), place, F.col("_id")]).withColumnRenamed("_id", "symbol").drop("_l", "_t", "_b", "_ok")


def pushed_left(starts: DataFrame, symbols: DataFrame, part: Cols, key: str, x: str, left: str, right: str, rounds: int = 4) -> DataFrame:
    """starts moved to the left end of the left-most symbol that they lie inside, again from there, `rounds` times at most."""
    s = symbols.select(*part, F.col(left).alias("_l"), F.col(right).alias("_r"))
    for _ in range(rounds):
        hit = starts.select(*part, key, x).join(s, part).filter((F.col("_l") < F.col(x)) & (F.col(x) < F.col("_r"))).groupBy(*part, key).agg(F.min("_l").alias("_to"))
        starts = starts.join(hit, [*part, key], "left").withColumn(x, F.coalesce("_to", x)).drop("_to")
    return starts


def stacked_labels(anchors: DataFrame, system: Cols, order: Cols, numbers: str, x: str, y: str, dx: float = 14.0, dy: float = 8.0) -> DataFrame:
    """A row a number of each anchor; anchors of a system stand to the right of and above the ones before."""
    i = F.row_number().over(Window.partitionBy(*system).orderBy(*order)) - 1
    df = anchors.withColumn("_i", i).select("*", F.posexplode(numbers).alias("number_no", "number"))
    return df.withColumns({"label_x": F.col(x) + dx * F.col("_i"), "label_y": F.col(y) - dy * F.col("_i")}).drop("_i")


def explicit_meters(rows: DataFrame, key: Cols, order: Cols, meter: str) -> DataFrame:
    """Per key the last meter that is written; none is carried on to the next."""
    return rows.filter(F.col(meter).isNotNull()).groupBy(*key).agg(F.max_by(meter, F.struct(*order)).alias(meter))


def wide_blocks(blocks: DataFrame, document: Cols, page: str, left: str, right: str, top: str, page_width: str, share: float = 0.6) -> DataFrame:
    """Blocks wider than a share of their page, numbered from the first page's top on."""
    df = blocks.filter(F.col(right) - F.col(left) > share * F.col(page_width))
    return df.withColumn("number", F.row_number().over(Window.partitionBy(*document).orderBy(page, top, left)))


def structure_counts(staves: DataFrame, symbols: DataFrame, part: Cols, least_barlines: int = 2) -> DataFrame:
    """Per archive its systems, staves and bar-lines, and whether they make a score."""
    s = staves.groupBy(*part).agg(F.count_distinct("sheet_no", "system_index").alias("n_systems"), F.count(F.lit(1)).alias("n_staves"))
    b = symbols.filter("tag = 'barline'").groupBy(*part).agg(F.count(F.lit(1)).alias("n_barlines"))
    df = s.join(b, part, "full_outer").select(*part, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_systems", "n_staves", "n_barlines")))
    return df.withColumn("is_score", (F.col("n_systems") >= 1) & (F.col("n_staves") >= 1) & (F.col("n_barlines") >= least_barlines))


def unique_names(rows: DataFrame, base: Column, order: Cols, out: str = "name") -> DataFrame:
    """Names from a base: the first of equal ones as it is, the others with -2, -3, ..."""
    df = rows.withColumn("_b", base)
    n = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col("_b")).otherwise(F.concat_ws("-", "_b", n.cast("string")))).drop("_b")
