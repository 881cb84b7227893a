"""Layout, boxes, overlays, reports, ledgers and suggestions on hand-written rows; values stated by hand."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from intervalia.functions import coerce
from intervalia.operators import boxes, layout, ledger, mapping, overlay, pages, reports, suggestions


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


def test_short_rows_and_assignment(spark):
    systems = spark.createDataFrame([(1, "s0", 0.0, 40.0), (1, "s1", 30.0, 50.0), (1, "s2", 80.0, 120.0)], "page int, system string, t double, b double").withColumn("h", F.col("b") - F.col("t"))
    judged = layout.short_outliers(systems, ["page"], "h")
    assert sorted(rows(judged, "system", "median_height", "is_short")) == [("s0", 40.0, False), ("s1", 40.0, True), ("s2", 40.0, False)]
    items = spark.createDataFrame([(1, "m0", 32.0, 38.0), (1, "m1", 200.0, 210.0), (1, "m2", 44.0, 60.0)], "page int, m string, t double, b double")
    got = layout.assign_intervals(items, judged.withColumnsRenamed({"t": "st", "b": "sb"}), ["page"], "m", "system", "t", "b", "st", "sb", "is_short")
    # m2: overlaps s0 (within tolerance) and the short row, and s0 goes first
    assert dict(rows(got, "m", "system")) == {"m0": "s0", "m1": "s2", "m2": "s0"}
    only = layout.assign_intervals(items.filter("m = 'm2'").withColumn("t", F.lit(48.0)), judged.withColumnsRenamed({"t": "st", "b": "sb"}), ["page"], "m", "system", "t", "b", "st", "sb", "is_short")
    assert rows(only, "system") == [("s1",)]


def test_neighbours_and_rows(spark):
    df = spark.createDataFrame([(1, "a", 10), (1, "b", 2), (1, "c", 9), (2, "d", 1)], "page int, k string, n int")
    assert dict(rows(layout.neighbour_median(df, ["page"], "k", "n"), "k", "others_median")) == {"a": 5.5, "b": 9.5, "c": 6.0, "d": None}
    at = layout.neighbours(spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (1, "c", 4.0)], "page int, k string, y double"), ["page"], "y")
    assert sorted(rows(at, "k", "prev_at", "next_at")) == [("a", None, 4.0), ("b", None, 4.0), ("c", 1.0, None)]
    side = spark.createDataFrame([(1, "left", 40.0, 60.0, 1), (1, "right", 42.0, 61.0, 2), (1, "next", 90.0, 110.0, 3)], "page int, k string, t double, b double, i int")
    assert dict(rows(layout.same_row_groups(side, ["page"], "k", "t", "b", ["i"]), "k", "row_head")) == {"left": "left", "right": "left", "next": "next"}
    starts = spark.createDataFrame([(1, i, v) for i, v in enumerate(["1", "42", "42", "42"])], "page int, i int, v string")
    assert rows(layout.repeated_later(starts, ["page"], ["i"], "v"), "v", "n_later") == [("42", 3)]


def test_rows_against_their_order(spark):
    """A chain whose first row is at one end, while the order falls away from it."""
    n = 40
    chain = [(1, i, 4.0 * i, 4.0 * i + 10, 0 if i == 0 else n - i) for i in range(n)]
    df = spark.createDataFrame(chain, "page int, k int, t double, b double, i int")
    assert set(rows(layout.same_row_groups(df, ["page"], "k", "t", "b", ["i"]), "row_head")) == {(0,)}
    with pytest.raises(RuntimeError):
        layout.same_row_groups(df, ["page"], "k", "t", "b", ["i"], rounds=1)


def test_deviation_gate(spark):
    df = spark.createDataFrame([("a", x) for x in (0.1, 0.2, 0.2, 0.3, 0.1, 0.2)] + [("b", 0.2)], "p string, v double")
    assert {r["p"]: r["accepted"] for r in layout.deviation_gate(df, ["p"], "v").collect()} == {"a": True, "b": False}


def test_boxes(spark):
    df = spark.createDataFrame([(1, [10.0, 30.0, 31.4, 60.0], 200.0)], "k int, xs array<double>, tail double")
    assert df.select(boxes.keep_apart(F.col("xs"), 2.0)).first()[0] == [10.0, 30.0, 60.0]
    assert df.select(boxes.keep_apart(F.col("xs"), 1.0)).first()[0] == [10.0, 30.0, 31.4, 60.0]
    assert rows(boxes.boxes_from_starts(df, ["k"], "xs", "tail", 6.0), "local_index", "x_left", "x_right") == [(0, 10.0, 30.0), (2, 31.4, 60.0), (3, 60.0, 200.0)]
    cut = spark.createDataFrame([("r", 12.0, 90.0, [40.0, 65.0]), ("bad", 12.0, 90.0, [40.0, 40.0]), ("none", 0.0, 5.0, None)], "row string, l double, r double, cuts array<double>")
    got = sorted(rows(boxes.boxes_from_cuts(cut, ["row"], "l", "r", "cuts"), "row", "x_left", "x_right"))
    assert got == [("none", 0.0, 5.0), ("r", 12.0, 40.0), ("r", 40.0, 65.0), ("r", 65.0, 90.0)]
    pts = spark.createDataFrame([(1, float(x)) for x in (0, 10, 20, 30, 40, 55, 90)], "k int, y double")
    assert rows(boxes.best_window(pts, ["k"], "y"), "first_at", "last_at", "deviation") == [(0.0, 40.0, 0.0)]
    accept = spark.createDataFrame([(2, 6, 10.0), (2, 2, 10.0), (2, 18, 10.0), (2, 3, None)], "a int, b int, t double")
    assert [r[0] for r in accept.select(boxes.accept_second_pass(F.col("a"), F.col("b"), F.col("t"))).collect()] == [True, False, False, False]


def test_mapping(spark):
    slots = spark.createDataFrame([(1, i) for i in range(5)], "page int, s int")
    labels = spark.createDataFrame([(1, i, x) for i, x in enumerate("abc")], "page int, l int, label string")
    assert [r["label"] for r in mapping.resampled(slots, labels, ["page"], ["s"], ["l"], "label").orderBy("s").collect()] == ["a", "a", "b", "c", "c"]
    one = labels.limit(1)
    assert {r["label"] for r in mapping.resampled(slots, one, ["page"], ["s"], ["l"], "label").collect()} == {"a"}


def test_overlay_and_edits(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "system string, page int")
    over = spark.createDataFrame([("x", 1, "a")], "system string, page int, was string")
    got = overlay.overlaid(base, over, "system", "was", spark.createDataFrame([(2,)], "page int"))
    assert sorted(rows(got, "system", "origin")) == [("b", "base"), ("x", "overlay")]
    measures = spark.createDataFrame([(1, "m1", False), (1, "m2", True)], "job int, measure_id string, excluded boolean")
    systems = spark.createDataFrame([(1, "s1")], "job int, system_id string")
    edits = [(1, "set_measure_number", "m1", "5"), (2, "set_measure_number", "m9", "5"), (3, "set_measure_number", "", "5"), (4, "set_measure_number", "m2", "5"), (5, "set_measure_number", "m1", "x"), (6, "set_measure_number", "m1", "1000001"), (7, "set_rest_measure", "m1", "-1"), (8, "set_ending", "m1", "3"), (9, "set_ending", "m1", "none"), (10, "set_labels_mode", None, "other"), (11, "set_system_start", "s2", "1"), (12, "paint", None, None), (13, "set_pickup_measure", "m1", "TRUE")]
    df = spark.createDataFrame([(1, *e) for e in edits], "job int, ord int, type string, target_id string, value string")
    assert [r["reject_reason"] for r in overlay.judged_edits(df, measures, systems, ["job"]).orderBy("ord").collect()] == [
        None, "unknown_measure_id", "missing_measure_id", "measure_excluded_from_counting", "invalid_value", "value_out_of_range", "invalid_measure_count", "invalid_ending_value", None, "invalid_value", "unknown_system_id", "unsupported_edit_type", None,
    ]
    flags = spark.createDataFrame([(1, "s", "a", 1, True), (1, "s", "b", 2, True), (1, "t", "c", 1, True), (1, "t", "c", 2, False)], "job int, s string, m string, ord int, on boolean")
    assert rows(overlay.exclusive_flags(flags, ["job", "s"], "m", ["ord"], "on"), "s", "m") == [("s", "b")]


def test_reports(spark):
    history = spark.createDataFrame([(1, f"t{i}", i) for i in range(55)], "job int, t string, i int")
    kept = overlay.keep_last(history, ["job"], ["i"], 50).orderBy("i").collect()
    assert (kept[0]["t"], kept[-1]["t"], len(kept)) == ("t5", "t54", 50)
    maps = spark.createDataFrame([(1, {"invalid_payload": 1, "unknown_system_id": 2}), (1, {"unknown_system_id": 3})], "job int, r map<string,bigint>")
    assert dict(rows(reports.reason_counts(maps, ["job"], "r"), "reason", "n")) == {"invalid_payload": 1, "unknown_system_id": 5}
    tries = spark.createDataFrame([(1, 1, "first", False), (1, 2, "retry", True), (2, 1, "first", True), (3, 1, "first", False), (3, 2, "raster", False)], "page int, attempt int, kind string, success boolean")
    got = {r["page"]: r for r in reports.attempt_rollup(tries, ["page"]).collect()}
    assert got[1]["recovered_on_retry"] and got[1]["n_attempts"] == 2 and not got[2]["recovered_on_retry"] and not got[3]["succeeded"]
    calls = spark.createDataFrame([(1, 1, 1_000_000, 100_000, Decimal(1), Decimal(5)), (1, 2, 1_000_000, 100_000, Decimal(9), Decimal(9)), (2, 1, 5, None, Decimal(1), Decimal(5)), (3, 1, 5, 5, None, None)], "job int, ord int, i long, o long, ri decimal(20,6), ro decimal(20,6)")
    cost = {r["job"]: r for r in reports.cost_rollup(calls, ["job"], "ord", "i", "o", "ri", "ro").collect()}
    assert cost[1]["cost_usd"] == 3 and cost[1]["tokens_in"] == 2_000_000
    assert (cost[2]["cost_usd"], cost[2]["status"], cost[3]["status"]) == (None, "usage_missing", "rate_unavailable")


@pytest.mark.parametrize(("systems", "charges"), [(1, 2), (2, 3), (3, 5), (4, 6), (5, 8), (6, 9)])
def test_charges(spark, systems, charges):
    df = spark.createDataFrame([(1, i) for i in range(systems)], "job int, i int")
    assert rows(ledger.grouped_charges(df, ["job"], ["i"]), "n_charges") == [(charges,)]


def test_ledgers(spark):
    events = spark.createDataFrame([(1, 1, 60), (1, 2, -50), (1, 3, -60), (1, 4, 140)], "w int, i int, a long")
    assert rows(ledger.balance_and_debt(events, ["w"], ["i"], "a").orderBy("i"), "remaining", "debt") == [(60, 0), (10, 0), (0, 50), (90, 0)]
    day = lambda m, d: datetime.datetime(2026, m, d)
    sources = spark.createDataFrame([(1, "friend", day(8, 1), 0, 5), (1, "pro", day(7, 20), 1, 5), (1, "purchased", None, 2, 9), (2, "pro", day(7, 20), 1, 0), (2, "purchased", None, 2, 1)], "o int, kind string, e timestamp, r int, left int")
    assert sorted(rows(ledger.chosen_source(sources, ["o"], "e", "r", "left"), "o", "kind")) == [(1, "pro"), (2, "purchased")]
    t0 = datetime.datetime(2026, 1, 1)
    fails = spark.createDataFrame([(1, t0 + datetime.timedelta(seconds=s), i) for i, s in enumerate((0, 100, 899, 900, 1000, 1001, 1002, 1003))], "o int, t timestamp, i int")
    got = ledger.anchored_limit(fails, ["o"], "t", ["i"]).orderBy("i").collect()
    assert [(r["n_in_window"], r["blocked"]) for r in got] == [(1, False), (2, False), (3, False), (1, False), (2, False), (3, False), (4, False), (5, True)]
    held = spark.createDataFrame([("old", t0), ("new", t0 + datetime.timedelta(seconds=1)), ("odd", None)], "id string, t timestamp")
    assert {r[0] for r in rows(ledger.expired(held, "t", F.lit(t0 + datetime.timedelta(seconds=900)), 900), "id")} == {"old", "odd"}


def test_suggestions(spark):
    kinds = "job int, measure_id string, label string, rest_count string, confidence string, maybe_label string, maybe_rest_count string, completeness string, reason string, time_signature string"
    data = [
        (1, "a", "uncertain", None, "low", "multi_measure_rest", None, "unclear", "x", None), (1, "b", "normal", "4", "high", None, None, "unclear", "x", "C"),
        (1, "c", "pickup", None, "HIGH", None, None, "incomplete", " ".join("abcdefghijklmn"), "3 / 4"), (1, "d", "multi_measure_rest", "1", "??", None, None, None, None, "99/123"),
        (1, "e", "uncertain", None, "medium", "pickup", "2", "complete", "x", "cut"), (1, "f", "multi_measure_rest", "7", "high", None, None, "complete", "x", None),
    ]
    got = {r["measure_id"]: r for r in suggestions.normalised(spark.createDataFrame(data, kinds)).collect()}
    assert [got[m]["label"] for m in "abcdef"] == ["uncertain", "normal", "pickup", "normal", "uncertain", "multi_measure_rest"]
    assert got["a"]["maybe_label"] is None and got["e"]["maybe_label"] is None and got["f"]["rest_count"] == 7
    assert (got["c"]["reason"], got["c"]["time_signature"], got["b"]["time_signature"], got["d"]["time_signature"], got["e"]["time_signature"]) == (None, "3/4", "common_time", None, "cut_time")
    assert [got[m]["completeness"] for m in "abcdef"] == ["unclear", "unclear", "incomplete", "unclear", "unclear", "full"]
    assert rows(suggestions.kept_and_omitted(suggestions.normalised(spark.createDataFrame(data, kinds))), "n_suggestions", "normal_omitted") == [(4, 2)]


def test_scalars(spark):
    df = spark.createDataFrame([(" 5 ", "Yes", "nan"), ("4.7", "off", "1.5"), ("x", "?", "")], "i string, b string, d string")
    assert rows(df.select(coerce.to_int(F.col("i"), -1), coerce.to_bool(F.col("b")), coerce.to_double(F.col("d"), 0.0))) == [(5, True, 0.0), (-1, False, 1.5), (-1, None, 0.0)]
    assert df.limit(1).select(coerce.nearest_rank(F.array(*map(F.lit, (1.0, 2.0, 3.0, 10.0))), 0.05)).first()[0] == 1.0
    assert df.limit(1).select(coerce.slug(F.lit("--a b/c?.pdf."))).first()[0] == "a-b-c-.pdf"
    assert df.limit(1).select(coerce.json_object(F.lit('note ```json\n{"a": {"b": 1}}\n``` end'))).first()[0] == '{"a": {"b": 1}}'


def test_bounds_without_a_side(spark):
    kinds = "s string, anchor_x double, anchor_top double, anchor_bottom double, x_left double, x_right double, y_top double, y_bottom double"
    systems = [("anchor only", 5.0, 1.0, 9.0, None, None, None, None), ("no anchor", None, None, None, None, 80.0, 1.0, 9.0), ("own left", None, None, None, 2.0, 80.0, 1.0, 9.0), ("measures", 5.0, 1.0, 9.0, None, None, None, None)]
    measures = spark.createDataFrame([("measures", 10.0, 30.0, 0.0, 20.0), ("measures", 40.0, 40.0, -3.0, None), ("measures", None, 99.0, 0.0, 99.0)], "s string, x_left double, x_right double, y_top double, y_bottom double")
    got = {r["s"]: tuple(r)[1:] for r in pages.visual_bounds(spark.createDataFrame(systems, kinds), measures, ["s"]).collect()}
    assert got == {"anchor only": (5.0, 6.0, 1.0, 9.0), "own left": (2.0, 80.0, 1.0, 9.0), "measures": (10.0, 30.0, -3.0, 20.0)}


def test_second_pass_of_the_neighbours(spark):
    one = spark.range(1)
    accept = lambda a, b, m: one.select(boxes.accept_second_pass(F.lit(a), F.lit(b), F.lit(m).cast("double"))).first()[0]
    assert [accept(2, 6, 10), accept(2, 2, 10), accept(2, 18, 10), accept(2, 3, None), accept(1, 17, 10), accept(1, 3, 1.9)] == [True, False, False, False, False, False]
    assert one.select(boxes.under_split(F.lit(1), F.lit(None).cast("double"))).first()[0] is False


def test_limit_of_owners_in_any_batch(spark):
    import random

    rng = random.Random(2)
    t0 = datetime.datetime(2026, 1, 1)
    rows_ = [(o, t0 + datetime.timedelta(seconds=rng.randrange(20_000)), i) for i, o in enumerate([*range(40)] * 5 + [7] * 3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r["i"]: (r["window_start"], r["n_in_window"]) for r in ledger.anchored_limit(spark.createDataFrame(rows_, "o int, t timestamp, i int"), ["o"], "t", ["i"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, open_ = {}, {}
    for o, t, i in sorted(rows_):
        s = t.replace(tzinfo=datetime.timezone.utc).timestamp()
        start, n = open_.get(o, (None, 0))
        open_[o] = want[i] = (int(s), 1) if start is None or s - start >= 900 else (start, n + 1)
    assert got == want
