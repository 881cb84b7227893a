"""Sequential numbering of ordered rows, with anchors, rests, pickups and alternative endings.

Every function works within a partition (a job), in a given order that must end in a unique column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Cols = list[str]


def _running(part: Cols, order: Cols):
    return Window.partitionBy(*part).orderBy(*order)


def _before(part: Cols, order: Cols):
    return _running(part, order).rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, part: Cols, order: Cols, override: str = "override", rest: str = "rest", excluded: str = "excluded", pickup: str = "pickup", start: str = "start", carry: str | None = None) -> DataFrame:
    """rows with `label`: the number of each, null for excluded ones.

    A step is either to set the next number or to add to it, so islands between rows that set it
    (overrides, an opening pickup) need sums only. override, rest (numbers a row takes), carry
    (added before the row) and start (the first number) are whole numbers or null.
    """
    out, here, before = F.col(excluded), _running(part, order), _before(part, order)
    first_counted = (F.sum((~out).cast("int")).over(here) == 1) & ~out
    takes = F.when(F.col(rest) > 0, F.col(rest)).otherwise(F.lit(1))
    extra = F.coalesce(F.col(carry), F.lit(0)) if carry else F.lit(0)
    first = F.row_number().over(here) == 1
    opening = F.col(pickup) & first_counted
    df = rows.withColumns(
        {
            "_start": F.when(first, F.coalesce(F.col(override), F.col(start), F.lit(1))),
            "_set": F.when(out, None).when(opening, F.when(F.col(rest) > 0, F.col(rest)).otherwise(F.lit(1))).when(~F.col(pickup), F.col(override) + takes),
            "_add": extra + F.when(out, 0).when(F.col(pickup), F.when(F.col(rest) > 0, F.col(rest) - 1).otherwise(F.lit(0))).otherwise(takes),
            "_extra": extra,
            "_opening": opening,
        }
    )
    df = df.withColumns({"_island": F.coalesce(F.count("_set").over(before), F.lit(0)), "_base": F.coalesce(F.last("_set", True).over(before), F.first("_start", True).over(here))})
    since = F.coalesce(F.sum("_add").over(Window.partitionBy(*part, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.col("_base") + since + F.col("_extra")
    label = F.when(out, None).when(F.col("_opening"), 0).when(F.col(pickup), at - 1).otherwise(F.coalesce(F.col(override), at))
    return df.withColumn("label", label.cast("long")).drop("_start", "_set", "_add", "_extra", "_opening", "_island", "_base")


def ending_groups(rows: DataFrame, part: Cols, order: Cols, kind: str = "kind", excluded: str = "excluded", pickup: str = "pickup") -> DataFrame:
    """rows with group_id, branch_index, first_len, second_len of valid ending groups, and ignored: why a row with a kind is in none.

    A group is a run of "1" followed at once by a run of "2"; any other row ends it.
    """
    k = F.coalesce(F.trim(F.col(kind)), F.lit(""))
    why = (
        F.when(k == "", None).when(F.col(excluded), "excluded_from_counting").when(~k.isin("1", "2"), "invalid_kind").when(F.col(pickup), "pickup_blocked")
    )
    here = _running(part, order)
    df = rows.withColumns({"_why": why, "_k": F.when(why.isNull() & k.isin("1", "2"), k)})
    begins = F.col("_k").isNull() | ((F.col("_k") == "1") & ~F.coalesce(F.lag("_k").over(here) == "1", F.lit(False)))
    df = df.withColumn("_seg", F.sum(begins.cast("int")).over(here))
    run = Window.partitionBy(*part, "_seg")
    df = df.withColumns({"_ones": F.sum((F.col("_k") == "1").cast("int")).over(run), "_twos": F.sum((F.col("_k") == "2").cast("int")).over(run)})
    valid = F.col("_k").isNotNull() & (F.col("_ones") > 0) & (F.col("_twos") > 0)
    branch = F.row_number().over(Window.partitionBy(*part, "_seg", "_k").orderBy(*order)) - 1
    df = df.withColumns({"_valid": valid, "_branch": branch})
    opens = (F.col("_valid") & (F.col("_k") == "1") & (F.col("_branch") == 0)).cast("int")
    df = df.withColumn("_group", F.sum(opens).over(here) - 1)
    ignored = F.coalesce("_why", F.when(F.col("_k").isNotNull() & ~F.col("_valid"), F.when(F.col("_ones") > 0, "incomplete_group").otherwise("orphan_ending2")))
    only = lambda c: F.when(F.col("_valid"), c).cast("long")
    df = df.withColumns({"group_id": only(F.col("_group")), "branch_index": only(F.col("_branch")), "first_len": only(F.col("_ones")), "second_len": only(F.col("_twos")), "ignored": ignored})
    return df.drop("_why", "_k", "_seg", "_ones", "_twos", "_valid", "_branch", "_group")


def _fold(part: pd.DataFrame) -> pd.DataFrame:
    """Labels of one partition in order: endings restart at their group's first number, and what follows goes on from the higher."""
    whole = lambda x: None if pd.isna(x) else int(x)
    labels: list[int | None] = []
    value, group, state, counted, first = None, None, {}, False, True
    for r in part.itertuples():
        over, rest, here = whole(r.override), whole(r.rest) or 0, whole(r.group_id)
        if first:
            value = over if over is not None else (whole(r.start) if whole(r.start) is not None else 1)
            first = False
        if group is not None and here != group:
            value, group, state = max(value, *(state[b] for b in ("1", "2") if b in state)), None, {}
        value += whole(r.carry) or 0
        if r.excluded:
            labels.append(None)
            continue
        opening, counted = not counted, True
        if r.pickup:
            label = 0 if opening else value - 1
            value = label + rest if rest else (1 if opening else value)
        elif here is not None:
            if group is None:
                group, start = here, over if over is not None else value
                state = {"start": start}
            branch = "1" if r.kind == "1" else "2"
            label = over if over is not None else state.get(branch, state["start"])
            state[branch] = label + (rest or 1)
            if branch == "1":
                value = state[branch]
        else:
            label = over if over is not None else value
            value = label + (rest or 1)
        labels.append(label)
    return part.assign(label=pd.array(labels, dtype="Int64"))


def numbered_with_endings(rows: DataFrame, part: Cols, order: Cols, kind: str = "kind", override: str = "override", rest: str = "rest", excluded: str = "excluded", pickup: str = "pickup", start: str = "start", carry: str | None = None) -> DataFrame:
    """numbered() with ending groups. Closing a group takes a maximum, which no sum over a window can: partitions
    (jobs, which are small) are folded one at a time."""
    df = ending_groups(rows, part, order, kind, excluded, pickup)
    df = df.withColumn("_at", F.row_number().over(_running(part, order)))
    use = df.select(*part, "_at", F.trim(kind).alias("kind"), F.col(override).alias("override"), F.col(rest).alias("rest"), F.col(excluded).alias("excluded"), F.col(pickup).alias("pickup"), F.col(start).alias("start"), (F.col(carry) if carry else F.lit(0)).alias("carry"), "group_id")

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        return _fold(p.sort_values("_at"))[[*part, "_at", "label"]]

    kinds = ", ".join(f"{c} {use.schema[c].dataType.simpleString()}" for c in [*part, "_at"])
    got = use.groupBy(*part).applyInPandas(solve, f"{kinds}, label long")
    return df.join(got, [*part, "_at"]).drop("_at")


def ending_pairs(starts: DataFrame, part: Cols, order: Cols, kind: str = "kind") -> DataFrame:
    """Start events paired: a "1" and the "2" right after it; others stay single. pair_no counts from 1, slot is 1 or 2."""
    here = _running(part, order)
    second = (F.col(kind) == "2") & F.coalesce(F.lag(kind).over(here) == "1", F.lit(False))
    df = starts.withColumn("_second", second)
    paired = F.col("_second") | F.coalesce(F.lead("_second").over(here), F.lit(False))
    df = df.withColumns({"pair_no": F.sum((~F.col("_second")).cast("long")).over(here), "slot": F.when(F.col("_second"), 2).otherwise(1), "is_paired": paired})
    return df.drop("_second")


def carried(rows: DataFrame, part: Cols, order: Cols, value: str, stop: Column, out: str = "carried") -> DataFrame:
    """The last value set before or at a row, until a row where stop holds clears it."""
    change = F.when(stop, F.struct(F.lit(None).cast(rows.schema[value].dataType).alias("v"))).when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v")))
    return rows.withColumn(out, F.last(change, True).over(_running(part, order))["v"])


def reindexed(children: DataFrame, parents: DataFrame, job: Cols, parent_key: str, parent_order: Cols, child_order: Cols) -> DataFrame:
    """Children with parent_index (of their parent in its job), local_index and global_index, all from 0; orphans go."""
    p = parents.withColumn("parent_index", F.row_number().over(_running(job, parent_order)) - 1).select(*job, parent_key, "parent_index")
    df = children.join(p, [*job, parent_key])
    local = F.row_number().over(_running([*job, parent_key], child_order)) - 1
    return df.withColumns({"local_index": local, "global_index": F.row_number().over(_running(job, ["parent_index", *child_order])) - 1})


def first_labels(rows: DataFrame, part: Cols, order: Cols, label: str = "label") -> DataFrame:
    """Per partition, the first label that isn't null."""
    return rows.filter(F.col(label).isNotNull()).groupBy(*part).agg(F.min_by(label, F.struct(*order)).alias("first_label"))


def running_counter(rows: DataFrame, part: Cols, order: Cols, amount: str, out: str = "counter") -> DataFrame:
    """A counter that never falls below 0: the sum so far, less the least sum so far if that is negative."""
    df = rows.withColumn("_sum", F.sum(amount).over(_running(part, order)))
    least = F.min("_sum").over(_running(part, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(out, F.col("_sum") - F.least(F.lit(0), least)).drop("_sum")
