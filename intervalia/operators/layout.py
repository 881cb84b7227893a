"""Intervals on pages: outliers, assignment, neighbours, rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stash
from .search import away, candidates

Cols = list[str]


def short_outliers(rows: DataFrame, part: Cols, height: str, ratio: float = 0.65) -> DataFrame:
    """rows with median_height and is_short: below ratio * the median of its partition (of positive heights)."""
    h = F.when(F.col(height) > 0, F.col(height))
    df = rows.withColumn("median_height", F.median(h).over(Window.partitionBy(*part)))
    return df.withColumn("is_short", F.coalesce((F.col(height) > 0) & (F.col(height) < ratio * F.col("median_height")), F.lit(False)))


def assign_intervals(items: DataFrame, targets: DataFrame, on: Cols, item_id: str, target_id: str, lo: str, hi: str, t_lo: str, t_hi: str, suspicious: str, tolerance: float = 5.0) -> DataFrame:
    """For each item the target of its partition that it overlaps best: item_id, target_id, overlap.

    First of targets that aren't suspicious and overlap (within tolerance); else the only overlapping one,
    if that is suspicious; else of all that aren't suspicious; else of all. Ties: nearer centre, higher target, id.

    Only the best sound target and, where that doesn't overlap, the best two suspicious ones are judged: they decide (places are
    compared as doubles there). They are looked up in a tree over the partition's targets, so no table of pairs is made.
    """
    t = targets.filter(F.col(t_hi) > F.col(t_lo)).select(*on, target_id, F.col(t_lo).alias("_tl"), F.col(t_hi).alias("_th"), F.col(suspicious).alias("_s"))
    i = items.select(*on, item_id, F.col(lo).alias("_l"), F.col(hi).alias("_h"))
    known = lambda c, other: F.coalesce(F.when(F.isnan(c), F.lit(other)).otherwise(c.cast("double")), F.lit(other))
    inf, l, h, th = float("inf"), F.col("_l").cast("double"), F.col("_h").cast("double"), known(F.col("_th").cast("double"), float("inf"))
    asked = {"l": F.coalesce(l, F.lit(-inf)), "h": known(h, inf), "c": known((l + h) / 2, -inf)}
    held = {"tl": F.col("_tl"), "th": th, "w": th - F.col("_tl"), "c": known((F.col("_tl") + F.col("_th")) / 2, inf)}

    def score(q, least, most):
        overlap = np.minimum(np.minimum(q("h"), most("th")) - np.maximum(q("l"), least("tl")), most("w")) + tolerance
        overlap[np.isnan(overlap)] = np.inf  # as Spark orders it
        return -overlap, away(q("c"), least("c"), most("c"))

    suspect = F.coalesce(F.col("_s"), F.lit(True))
    df = candidates(i, t, on, [F.col("_tl"), F.col(target_id)], asked, held, ("tl", "th"), score, suspect)
    df = df.withColumns(
        {
            "overlap": F.least("_h", "_th") - F.greatest("_l", "_tl") + F.lit(tolerance),
            "_away": F.abs((F.col("_l") + F.col("_h")) / 2 - (F.col("_tl") + F.col("_th")) / 2),
        }
    )
    mine = Window.partitionBy(*on, item_id)
    hits = F.col("overlap") > 0
    df = df.withColumns({"_hits": F.sum(hits.cast("int")).over(mine), "_sound": F.sum((hits & ~F.col("_s")).cast("int")).over(mine)})
    tier = F.when(hits & ~F.col("_s"), 0).when((F.col("_sound") == 0) & (F.col("_hits") == 1) & hits, 1).when(~F.col("_s"), 2).otherwise(3)
    best = F.row_number().over(mine.orderBy(tier, F.col("overlap").desc(), "_away", "_tl", target_id))
    return df.withColumn("_best", best).filter("_best = 1").select(*on, item_id, target_id, "overlap")


def neighbour_median(rows: DataFrame, part: Cols, key: str, value: str) -> DataFrame:
    """rows with the median of the others in their partition (null with fewer than two others)."""
    part_, value_ = Window.partitionBy(*part), F.col(value).cast("double")
    df = rows.withColumns({"_r": F.row_number().over(part_.orderBy(value_.asc_nulls_last(), key)), "_n": F.count(F.lit(1)).over(part_) - 1})
    # the middle two of the others have ranks next to the middle of all: three values a partition tell them
    low = F.floor((F.col("_n") + 1) / 2)
    df = df.withColumns({f"_m{i}": F.max(F.when(F.col("_r") == low + i, value_)).over(part_) for i in range(3)})
    upper = F.floor(F.col("_n") / 2) + 1  # of the others' ranks, the middle ones are low and upper
    at = lambda rank: F.get(F.array("_m0", "_m1", "_m2"), (rank + (F.col("_r") <= rank).cast("int") - low).cast("int"))
    mid, n = (at(low) + at(upper)) / 2, F.col("_n")
    return df.withColumn("others_median", F.when(n >= 2, mid)).drop("_r", "_n", "_m0", "_m1", "_m2")


def neighbours(rows: DataFrame, part: Cols, at: str) -> DataFrame:
    """rows with prev_at and next_at: the nearest strictly lower and higher places in their partition."""
    places = rows.select(*part, at).distinct()
    w = Window.partitionBy(*part).orderBy(at)
    places = places.withColumns({"prev_at": F.lag(at).over(w), "next_at": F.lead(at).over(w)})
    return rows.join(places, [*part, at])


def repeated_later(rows: DataFrame, part: Cols, order: Cols, value: str, least: int = 2) -> DataFrame:
    """Values that come `least` times or more after a partition's first row, with how often."""
    df = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter((F.col("_n") > 1) & (F.col(value) != ""))
    return df.groupBy(*part, value).agg(F.count(F.lit(1)).alias("n_later")).filter(F.col("n_later") >= least)


def empty_parents(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    return parents.join(children.select(F.col(child_key).alias(key)), key, "left_anti")


def bounding_box(rows: DataFrame, part: Cols, left: str, top: str, right: str, bottom: str) -> DataFrame:
    return rows.groupBy(*part).agg(F.min(left).alias("x_left"), F.min(top).alias("y_top"), F.max(right).alias("x_right"), F.max(bottom).alias("y_bottom"))


def deviation_gate(rows: DataFrame, part: Cols, value: str, least: int = 6, most_mad: float = 0.25, most: float = 2.0) -> DataFrame:
    """Median and median absolute deviation of a partition, and whether they can be trusted."""
    med = rows.groupBy(*part).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    mad = rows.join(med, part).groupBy(*part).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    ok = (F.col("n") >= least) & (F.col("mad") <= most_mad) & (F.abs("median") <= most)
    return med.join(mad, part).withColumn("accepted", ok)


def same_row_groups(rows: DataFrame, page: Cols, key: str, top: str, bottom: str, order: Cols, height_ratio: float = 0.55, centre: float = 0.45, overlap: float = 0.30, rounds: int = 60) -> DataFrame:
    """rows with row_head: the first (in order) of those that lie in one visual row with them, directly or through others.

    Two rows match if their heights, centres and common part are alike. Heads spread from neighbour to neighbour and to
    the heads that these had, which take along what they head, until no two matching rows have different ones; an error
    if `rounds` don't do. Each round is written to the shared folder.
    """
    first = F.row_number().over(Window.partitionBy(*page).orderBy(*order))
    a = rows.select(*page, F.col(key).alias("_a"), F.col(top).alias("_at"), F.col(bottom).alias("_ab"), first.alias("_ai"))
    b = a.select(*page, F.col("_a").alias("_b"), F.col("_at").alias("_bt"), F.col("_ab").alias("_bb"), F.col("_ai").alias("_bi"))
    ha, hb = F.col("_ab") - F.col("_at"), F.col("_bb") - F.col("_bt")
    like = (
        (F.least(ha, hb) >= height_ratio * F.greatest(ha, hb))
        & (F.abs((F.col("_at") + F.col("_ab") - F.col("_bt") - F.col("_bb")) / 2) <= centre * F.greatest(ha, hb))
        & (F.least("_ab", "_bb") - F.greatest("_at", "_bt") >= overlap * F.least(ha, hb))
    )
    links = a.join(b, page).filter(like).select(*page, F.col("_ai").alias("_x"), F.col("_bi").alias("_y"))
    links = stash(links, "row-links")
    heads = stash(links.groupBy(*page, "_x").agg(F.min("_y").alias("_h")), "row-heads")
    for _ in range(rounds):
        step = links.join(heads.select(*page, F.col("_x").alias("_y"), F.col("_h").alias("_g")), [*page, "_y"]).groupBy(*page, "_x").agg(F.min("_g").alias("_h"))
        # what a row has come to know goes to its old head, too
        told = step.withColumnRenamed("_h", "_g").join(heads, [*page, "_x"]).select(*page, F.col("_h").alias("_x"), F.col("_g").alias("_h"))
        step = stash(step.unionByName(told).groupBy(*page, "_x").agg(F.min("_h").alias("_h")), "row-steps")
        jump = step.select(*page, F.col("_x").alias("_h"), F.col("_h").alias("_j"))
        heads = stash(step.join(jump, [*page, "_h"]).select(*page, "_x", F.least("_h", "_j").alias("_h")), "row-heads")
        x = links.join(heads.select(*page, "_x", F.col("_h").alias("_hx")), [*page, "_x"]).join(heads.select(*page, F.col("_x").alias("_y"), F.col("_h").alias("_hy")), [*page, "_y"])
        if not x.filter("_hx <> _hy").limit(1).collect():
            break
    else:
        raise RuntimeError("row heads did not settle")
    named = heads.join(a.select(*page, F.col("_ai").alias("_x"), F.col("_a").alias(key)), [*page, "_x"]).join(a.select(*page, F.col("_ai").alias("_h"), F.col("_a").alias("row_head")), [*page, "_h"])
    return rows.join(named.select(*page, key, "row_head"), [*page, key])
