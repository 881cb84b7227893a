"""Batches of edits applied to the states of jobs, all jobs at once.

edits: job, ord, type, target_id, value, page, left, top, right, bottom; what a type doesn't use is null. Edits are judged by the
ids of the state before the batch and don't see each other, so what holds in the end is the last one of each key; only pickups are
coupled, as a system has one.

The state, beside measures and systems (operators/state.py):
settings: job, mode
marks: job, measure_id, override, rest, pickup, ending
staff_rests: job, system_id, rest
label_marks: job, measure_id, hidden, forced, page, left, top
areas: job, page, left, top, right, bottom
rows: job, kind (manual or auto), page, row_id and what else a row has
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import validate
from . import overlay, state

#: The types that overlay.judged_edits doesn't know, a label's prefix and how far one may be moved.
LABEL_TYPES = ("hide_label", "show_label", "move_label")
ROW_TYPES = {"replace_manual_rows_for_page": "manual", "replace_auto_rows_for_page": "auto"}
LABEL, FARTHEST = "label:", 5000.0
MARK = ["job", "measure_id"]


def _is(*types: str) -> Column:
    return F.coalesce(F.col("type").isin(*types), F.lit(False))


def judged(edits: DataFrame, measures: DataFrame, systems: DataFrame, payload: DataFrame | None = None) -> DataFrame:
    """edits with measure_id (that they are about, if any) and reject_reason, null for those that apply.

    payload (job, ord, row_no, reason, ...): the rows that replace a page's, with why one can't be taken; the first such rejects its edit.
    """
    target = F.coalesce(F.trim("target_id"), F.lit(""))
    old = overlay.judged_edits(edits.withColumn("target_id", target), measures, systems, ["job"])
    of_label = F.when(target.startswith(LABEL), F.trim(F.substring(target, len(LABEL) + 1, 1 << 30)))
    about = F.when(_is("hide_label", "move_label"), of_label).when(_is("show_label"), F.coalesce(of_label, target)).when(_is(*(t for t, need in overlay.EDITS.items() if need[0] == "measure")), target)
    first = measures.groupBy("job", F.col("system_id").alias("target_id")).agg(F.min_by("measure_id", F.struct("x_left", "measure_id")).alias("_first"))
    df = old.join(first, ["job", "target_id"], "left").withColumn("measure_id", F.when(_is("set_system_start"), F.col("_first")).otherwise(about))
    df = df.join(measures.select(*MARK, F.lit(True).alias("_m")), MARK, "left")
    if payload is None:
        df = df.withColumn("_row", F.lit(None).cast("string"))
    else:
        bad = payload.filter("reason IS NOT NULL").groupBy("job", "ord").agg(F.min_by("reason", "row_no").alias("_row"))
        df = df.join(bad, ["job", "ord"], "left")
    far = lambda c: ~F.coalesce(F.col(c).between(0.0, FARTHEST), F.lit(False))
    page = F.coalesce(F.col("page"), F.lit(0)) > 0
    fits = validate.erase_area(F.col("page"), F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))
    new = (
        F.when(_is("hide_label", "move_label") & F.col("_m").isNull(), "invalid_label_id")
        .when(_is("show_label") & F.col("_m").isNull(), "invalid_measure_id")
        .when(_is("move_label") & (~page | far("left") | far("top")), "invalid_label_position")
        .when(_is("remove_label_area") & ~F.coalesce(fits, F.lit(False)), "invalid_label_erase_area")
        .when(_is(*ROW_TYPES) & ~page, "invalid_page")
        .when(_is(*ROW_TYPES), F.col("_row"))
    )
    known = _is(*LABEL_TYPES, *ROW_TYPES, "remove_label_area")
    no_measure = F.when(_is("set_system_start") & F.col("_first").isNull(), "unknown_measure_id")
    return df.withColumn("reject_reason", F.when(known, new).otherwise(F.coalesce("reject_reason", no_measure))).drop("_first", "_m", "_row")


def _last(value: Column, *types: str) -> Column:
    """The value of the last edit of these types, in a struct; null if there is none."""
    return F.max_by(F.struct(value.alias("v")), F.when(_is(*types), F.col("ord")))


def _or(new: str, old: str) -> Column:
    return F.when(F.col(new).isNotNull(), F.col(f"{new}.v")).otherwise(F.col(old)).alias(old)


def pickups(ok: DataFrame, marks: DataFrame, measures: DataFrame) -> DataFrame:
    """job, measure_id of the pickups: the last one set in each system, unless cleared later; saved ones stay where none was set."""
    system = measures.select(*MARK, F.coalesce(F.nullif(F.trim("system_id"), F.lit("")), F.concat(F.lit("\0"), "measure_id")).alias("_part"))
    events = ok.filter(_is("set_pickup_measure")).select(*MARK, "ord", (F.lower(F.trim("value")) == "true").alias("_on")).join(system, MARK)
    held = overlay.exclusive_flags(events, ["job", "_part"], "measure_id", ["ord"], "_on").select(*MARK)
    saved = marks.filter("pickup").select(*MARK).distinct().join(system, MARK, "left")
    saved = saved.join(events.filter("_on").select("job", "_part"), ["job", "_part"], "left_anti").select(*MARK)
    return held.unionByName(saved.join(events.filter("NOT _on").select(*MARK), MARK, "left_anti"))


def marks_after(ok: DataFrame, marks: DataFrame, measures: DataFrame) -> DataFrame:
    """marks once the edits that apply have been."""
    number, ending = F.trim("value").try_cast("int"), F.trim("value")
    events = ok.filter(_is("set_system_start", "set_measure_number", "clear_measure_number", "set_rest_measure", "set_ending")).groupBy(*MARK).agg(
        _last(F.when(~_is("clear_measure_number"), number), "set_system_start", "set_measure_number", "clear_measure_number").alias("_o"),
        _last(F.when(number > 0, number), "set_rest_measure").alias("_r"),
        _last(F.when(ending.isin("1", "2"), ending), "set_ending").alias("_e"),
    )
    df = marks.drop("pickup").join(events, MARK, "full_outer").select(*MARK, _or("_o", "override"), _or("_r", "rest"), _or("_e", "ending"))
    df = df.join(pickups(ok, marks, measures).withColumn("pickup", F.lit(True)), MARK, "full_outer").withColumn("pickup", F.coalesce("pickup", F.lit(False)))
    return df.filter("override IS NOT NULL OR rest IS NOT NULL OR ending IS NOT NULL OR pickup")


def staff_rests_after(ok: DataFrame, staff_rests: DataFrame) -> DataFrame:
    """staff_rests likewise; a rest of 0 takes it away."""
    n = F.trim("value").try_cast("int")
    events = ok.filter(_is("set_rest_staff")).groupBy("job", F.col("target_id").alias("system_id")).agg(_last(n, "set_rest_staff").alias("_n"))
    return staff_rests.join(events, ["job", "system_id"], "full_outer").select("job", "system_id", _or("_n", "rest")).filter("rest > 0")


def settings_after(ok: DataFrame, settings: DataFrame) -> DataFrame:
    """settings likewise."""
    events = ok.filter(_is("set_labels_mode")).groupBy("job").agg(_last(F.lower(F.trim("value")), "set_labels_mode").alias("_v"))
    return settings.join(events, "job", "full_outer").select("job", _or("_v", "mode"))


def label_marks_after(ok: DataFrame, label_marks: DataFrame) -> DataFrame:
    """label_marks likewise: showing a label forces it, takes back that it is hidden, and puts it where it belongs."""
    place = F.when(_is("move_label"), F.struct("page", F.round("left", 3).alias("left"), F.round("top", 3).alias("top")))
    events = ok.filter(_is(*LABEL_TYPES)).groupBy(*MARK).agg(
        _last(_is("hide_label"), "hide_label", "show_label").alias("_h"), F.bool_or(_is("show_label")).alias("_f"), _last(place, "move_label", "show_label").alias("_p")
    )
    df = label_marks.join(events, MARK, "full_outer")
    at = lambda c: F.when(F.col("_p").isNotNull(), F.col(f"_p.v.{c}")).otherwise(F.col(c)).alias(c)
    flag = lambda c: F.coalesce(c, F.lit(False))
    df = df.select(*MARK, flag(_or("_h", "hidden")).alias("hidden"), (flag(F.col("forced")) | flag(F.col("_f"))).alias("forced"), at("page"), at("left"), at("top"))
    return df.filter("hidden OR forced OR page IS NOT NULL")


def areas_after(ok: DataFrame, areas: DataFrame) -> DataFrame:
    """areas with those that edits add; an area equal to one before it, to 2 places, isn't added."""
    sides = ["left", "top", "right", "bottom"]
    key = F.struct("job", "page", *(F.round(c, 2).alias(c) for c in sides))
    new = ok.filter(_is("remove_label_area")).groupBy(key.alias("_key")).agg(F.min_by(F.struct("job", "page", *sides), "ord").alias("_a"))
    new = new.join(areas.select(key.alias("_key")), "_key", "left_anti").select("_a.*")
    return areas.unionByName(new)


def rows_after(ok: DataFrame, rows: DataFrame, payload: DataFrame) -> DataFrame:
    """rows, with those of a page and kind replaced by the payload (job, ord and the columns of a row) of the last edit that says so."""
    kind = F.element_at(F.create_map(*(F.lit(x) for pair in ROW_TYPES.items() for x in pair)), F.col("type"))
    last = ok.filter(_is(*ROW_TYPES)).groupBy("job", kind.alias("kind"), "page").agg(F.max("ord").alias("ord"))
    kept = rows.join(last, ["job", "kind", "page"], "left_anti")
    new = payload.drop("kind", "page", "row_no", "reason").join(last, ["job", "ord"])
    return kept.unionByName(new.select(*(c for c in rows.columns if c in new.columns)), allowMissingColumns=True)


def ruled_pages_after(ok: DataFrame, pages: DataFrame) -> DataFrame:
    """job, page: the pages whose rows edits have drawn, which no later reading moves."""
    return pages.select("job", "page").unionByName(ok.filter(_is("replace_auto_rows_for_page")).select("job", "page")).distinct()


def applied(edits: DataFrame, measures: DataFrame, systems: DataFrame, marks: DataFrame, staff_rests: DataFrame, ruled_pages: DataFrame | None = None) -> DataFrame:
    """The state refreshed once the batch has been applied to marks and staff rests (state.refreshed)."""
    ok = judged(edits, measures, systems).filter("reject_reason IS NULL")
    return state.refreshed(systems, measures, marks_after(ok, marks, measures), ruled_pages, staff_rests_after(ok, staff_rests))
