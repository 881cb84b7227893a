"""Batches of edits on a score of twelve measures in four systems; values stated by hand."""

import pytest

from intervalia.operators import edits, state
from tests.test_state import EDITS as MARKS
from tests.test_state import job, labels  # noqa: F401

BATCH = "job int, ord int, type string, target_id string, value string, page int, `left` double, top double, `right` double, bottom double"
RESTS = "job int, system_id string, rest int"


def batch(spark, *rows):
    return spark.createDataFrame([(1, i, *r, *[None] * (8 - len(r))) for i, r in enumerate(rows)], BATCH)


@pytest.mark.parametrize(("rows", "want"), [
    ([("set_measure_number", "p1_s1_m1", "20")], [1, 4, 22, 25]),
    ([("set_system_start", " p1_s1 ", "20")], [1, 20, 23, 26]),
    ([("set_measure_number", "p1_s1_m1", "20"), ("clear_measure_number", "p1_s1_m1")], [1, 4, 7, 10]),
    ([("set_pickup_measure", "p1_s1_m1", "true")], [1, 4, 6, 9]),
    ([("set_pickup_measure", "p1_s1_m1", "true"), ("set_pickup_measure", "p1_s1_m2", "true"), ("set_pickup_measure", "p1_s1_m2", "false")], [1, 4, 7, 10]),
    ([("set_rest_staff", "p1_s0", "5")], [1, 9, 12, 15]),
    ([("set_rest_staff", "p1_s0", "5"), ("set_rest_staff", "p1_s0", "0")], [1, 4, 7, 10]),
    ([("set_rest_staff", "p1_s0", "5"), ("set_rest_measure", "p1_s0_m1", "2")], [1, 5, 8, 11]),
    ([("set_rest_staff", "p2_s0", "5")], [1, 4, 7, 10]),
    ([("set_measure_number", "p1_s1_m1", "2000000"), ("paint", "p1_s1_m1", "3"), (None, None, None)], [1, 4, 7, 10]),
])
def test_applied(spark, job, rows, want):  # noqa: F811
    systems, measures = job
    got = edits.applied(batch(spark, *rows), measures, systems, spark.createDataFrame([], MARKS), spark.createDataFrame([], RESTS))
    assert sorted(labels(got, systems).items()) == list(zip(["p1_s0", "p1_s1", "p1_s2", "p2_s0"], want, strict=True))


def test_reasons(spark, job):  # noqa: F811
    systems, measures = job
    alone = systems.unionByName(systems.limit(1).selectExpr("job", "'none' AS system_id", "page", "y_top", "y_bottom", "x_left", "source", "start"))
    rows = [
        ("set_system_start", "none", "3"), ("set_system_start", "gone", "3"), ("set_labels_mode", None, " ALL_measures"), ("set_labels_mode", None, None), ("set_ending", "p1_s0_m0", None), ("set_ending", "p1_s0_m0", "None"),
        ("hide_label", "p1_s0_m0"), ("hide_label", "label: p1_s0_m0"), ("show_label", "p1_s0_m0"), ("show_label", "label:"), ("move_label", "label:p1_s0_m0", None, 1, 5.0, 5000.0), ("move_label", "label:p1_s0_m0", None, 1, float("nan"), 0.0),
        ("move_label", "label:p1_s0_m0", None, 1, -1.0, 0.0), ("remove_label_area", None, None, 1, 0.0, 0.0, 96.0, 48.0), ("remove_label_area", None, None, 1, 0.0, 0.0, 97.0, 48.0), ("replace_auto_rows_for_page", None, None, 2), ("replace_auto_rows_for_page",), (None,),
    ]
    payload = spark.createDataFrame([(1, 15, 0, None), (1, 15, 1, "missing_boxes"), (1, 15, 2, "invalid_rect")], "job int, ord int, row_no int, reason string")
    got = {r["ord"]: r["reject_reason"] for r in edits.judged(batch(spark, *rows), measures, alone, payload).collect()}
    assert [got[i] for i in range(len(rows))] == [
        "unknown_measure_id", "unknown_system_id", None, "invalid_value", None, "invalid_ending_value", "invalid_label_id", None, None, "invalid_measure_id", None, "invalid_label_position",
        "invalid_label_position", None, "invalid_label_erase_area", "missing_boxes", "invalid_page", "unsupported_edit_type",
    ]


def test_settings_and_pages(spark, job):  # noqa: F811
    systems, measures = job
    ok = edits.judged(batch(spark, ("set_labels_mode", None, "system_only"), ("set_labels_mode", None, "All_Measures "), ("replace_auto_rows_for_page", None, None, 2), ("replace_manual_rows_for_page", None, None, 3)), measures, systems)
    saved = spark.createDataFrame([(1, "system_only"), (2, "system_only")], "job int, mode string")
    assert sorted(map(tuple, edits.settings_after(ok, saved).collect())) == [(1, "all_measures"), (2, "system_only")]
    pages = spark.createDataFrame([(1, 1), (1, 2)], "job int, page int")
    assert sorted(map(tuple, edits.ruled_pages_after(ok, pages).collect())) == [(1, 1), (1, 2)]
    none = ok.limit(0)
    assert edits.settings_after(none, saved).count() == 2 and edits.areas_after(none, spark.createDataFrame([], "job int, page int, left double, top double, right double, bottom double")).count() == 0


def test_carry(spark):
    rows = spark.createDataFrame([(1, s, i, r, x) for i, (s, r, x) in enumerate([("a", None, False), ("a", 3, True), ("b", 2, False), ("c", None, False), ("a", None, False), ("b", None, None)])], "job int, system_id string, global_index int, rest int, excluded boolean")
    rests = spark.createDataFrame([(1, "a", 5), (1, "b", 7), (1, "c", 0), (2, "a", 9)], RESTS)
    got = {r["global_index"]: r["_carry"] for r in state.with_carry(rows, rests).collect()}
    assert got == {0: 0, 1: 0, 2: 5, 3: 0, 4: 0, 5: 5}
