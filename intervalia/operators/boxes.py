"""From bar-lines to boxes: cuts, gaps and windows along one axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def keep_apart(values: Column, tolerance: float) -> Column:
    """Of an array of numbers, in order, those that are over tolerance from the last one kept."""
    zero = F.array().cast("array<double>")
    return F.aggregate(
        F.array_sort(F.filter(values, lambda x: x.isNotNull())).cast("array<double>"), zero,
        lambda kept, x: F.when((F.size(kept) == 0) | (x - F.try_element_at(kept, F.lit(-1)) > tolerance), F.concat(kept, F.array(x))).otherwise(kept),
    )


def boxes_from_starts(rows: DataFrame, part: Cols, starts: str, tail: str, least_width: float) -> DataFrame:
    """A box from each start to the next (the last to the tail); narrow ones go, local_index keeps their numbers."""
    df = rows.select(*part, F.col(tail).alias("_tail"), F.col(starts).alias("_s")).select("*", F.posexplode("_s").alias("local_index", "x_left"))
    df = df.withColumn("x_right", F.coalesce(F.get("_s", F.col("local_index") + 1), F.col("_tail")))
    return df.filter(F.col("x_right") - F.col("x_left") >= least_width).select(*part, "local_index", "x_left", "x_right")


def lead_boxes(points: DataFrame, part: Cols, at: str, tail: Column, least_width: float) -> DataFrame:
    """boxes_from_starts for starts that are rows: no arrays are gathered."""
    w = Window.partitionBy(*part).orderBy(at)
    df = points.select(*part, F.col(at).alias("x_left"), F.coalesce(F.lead(at).over(w), tail).alias("x_right"), (F.row_number().over(w) - 1).alias("local_index"))
    return df.filter(F.col("x_right") - F.col("x_left") >= least_width)


def boxes_from_cuts(rows: DataFrame, part: Cols, left: str, right: str, cuts: str) -> DataFrame:
    """The pieces of a row between its left end, its cuts and its right end, if the cuts rise strictly inside it."""
    edges = F.concat(F.array(F.col(left)), F.coalesce(F.col(cuts), F.array().cast("array<double>")), F.array(F.col(right)))
    df = rows.withColumn("_e", edges)
    rising = F.forall(F.zip_with(F.slice("_e", F.lit(1), F.size("_e") - 1), F.slice("_e", F.lit(2), F.size("_e") - 1), lambda a, b: a < b), lambda x: x)
    df = df.filter(rising).select(*part, "_e", F.posexplode(F.slice("_e", F.lit(1), F.size("_e") - 1)).alias("local_index", "x_left"))
    return df.select(*part, "local_index", "x_left", F.get("_e", F.col("local_index") + 1).alias("x_right"))


def tail_estimate(points: DataFrame, part: Cols, at: str, least: float = 0.0) -> DataFrame:
    """Per partition the median of the gaps above `least` between neighbours."""
    gap = F.col(at) - F.lag(at).over(Window.partitionBy(*part).orderBy(at))
    return points.withColumn("_gap", gap).filter(F.col("_gap") > least).groupBy(*part).agg(F.median("_gap").alias("median_gap"), F.count("_gap").alias("n_gaps"))


def best_window(points: DataFrame, part: Cols, at: str, size: int = 5) -> DataFrame:
    """Per partition the `size` neighbours whose gaps deviate least in sum from their mean (the first of equals)."""
    w = Window.partitionBy(*part).orderBy("_p")
    df = points.select(*part, F.col(at).cast("double").alias("_p"))
    df = df.withColumns({"window_no": F.row_number().over(w), "_w": F.collect_list("_p").over(w.rowsBetween(0, size - 1))})
    df = df.filter(F.size("_w") == size)
    mean = (F.get("_w", F.lit(size - 1)) - F.get("_w", F.lit(0))) / (size - 1)
    off = F.aggregate(F.zip_with(F.slice("_w", 1, size - 1), F.slice("_w", 2, size - 1), lambda a, b: F.abs(b - a - mean)), F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("deviation", F.round(off, 6))
    best = F.row_number().over(Window.partitionBy(*part).orderBy("deviation", "window_no"))
    return df.withColumn("_b", best).filter("_b = 1").select(*part, "window_no", "deviation", F.get("_w", F.lit(0)).alias("first_at"), F.get("_w", F.lit(size - 1)).alias("last_at"))


def gap_sessions(points: DataFrame, part: Cols, at: str, most_gap: float, least: int) -> DataFrame:
    """Runs of points no more than most_gap from the one before, of `least` points or more."""
    w = Window.partitionBy(*part).orderBy(at)
    df = points.withColumn("_new", (F.col(at) - F.lag(at).over(w) > most_gap).cast("int"))
    df = df.withColumn("session", F.coalesce(F.sum("_new").over(w), F.lit(0)).cast("long"))
    got = df.groupBy(*part, "session").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n_points"))
    return got.filter(F.col("n_points") >= least)


def runs_above(points: DataFrame, part: Cols, at: str, value: str, threshold: float) -> DataFrame:
    """Centres of runs of neighbouring whole places whose value is above the threshold."""
    df = points.filter(F.col(value) > threshold)
    island = F.col(at) - F.row_number().over(Window.partitionBy(*part).orderBy(at))
    df = df.withColumn("_i", island).groupBy(*part, "_i").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    return df.withColumn("centre", F.floor((F.col("first_at") + F.col("last_at")) / 2).cast("long")).drop("_i")


def accept_second_pass(first: Column, second: Column, target: Column) -> Column:
    """Whether a second count is larger than the first, strictly nearer to its target, and not far over it."""
    return F.coalesce((second > first) & (F.abs(second - target) < F.abs(first - target)) & (second <= F.greatest(F.lit(3.0), 1.6 * target)), F.lit(False))


def under_split(count: Column, target: Column) -> Column:
    """Whether a count is suspiciously low against its neighbours' median (not without one)."""
    return target.isNotNull() & F.coalesce(count <= F.greatest(F.lit(2), F.floor(0.4 * target)), F.lit(False))
