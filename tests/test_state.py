"""A job's state refreshed as a whole; values stated by hand."""

import pytest

from intervalia.operators import state

SYSTEMS = "job int, system_id string, page int, y_top double, y_bottom double, x_left double, source string, start int"
MEASURES = "job int, measure_id string, system_id string, page int, x_left double, x_right double, y_top double, y_bottom double, source string, excluded boolean"
EDITS = "job int, measure_id string, override int, rest int, pickup boolean, ending string"


@pytest.fixture(scope="module")
def job(spark):
    tops = [("p1_s0", 1, 10.0), ("p1_s1", 1, 50.0), ("p1_s2", 1, 90.0), ("p2_s0", 2, 10.0)]
    systems = [(1, s, p, y, y + 10, 10.0, "auto", 1 if i == 0 else None) for i, (s, p, y) in enumerate(tops)]
    measures = [(1, f"{s}_m{j}", s, p, 10.0 + 20 * j, 25.0 + 20 * j, y, y + 10, "auto", False) for s, p, y in tops for j in range(3)]
    return spark.createDataFrame(systems[::-1], SYSTEMS), spark.createDataFrame(measures[::-1], MEASURES)


def labels(state_, systems):
    return {r["system_id"]: r["label"] for r in state.system_labels(state_, systems).collect()}


def test_refresh(spark, job):
    systems, measures = job
    none = state.refreshed(systems, measures, spark.createDataFrame([], EDITS)).cache()
    assert labels(none, systems) == {"p1_s0": 1, "p1_s1": 4, "p1_s2": 7, "p2_s0": 10}
    edits = spark.createDataFrame([(1, "p1_s1_m1", 20, -3, None, "9"), (1, "p1_s2_m0", None, 0, False, None), (1, " ", 5, None, None, None), (1, "p2_s0_m0", 2_000_000, None, None, None)], EDITS)
    got = state.refreshed(systems, measures, edits)
    assert labels(got, systems) == {"p1_s0": 1, "p1_s1": 4, "p1_s2": 22, "p2_s0": 25}
    versions = {r["version"] for df in (none, got) for r in state.version(df).collect()}
    assert len(versions) == 2 and state.version(none.union(none)).first()["version"] not in versions and state.version(none).first() == state.version(state.refreshed(systems, measures, spark.createDataFrame([], EDITS))).first()
    assert [tuple(r)[1:6] for r in state.quality(none, systems).collect()] == [("ok", 4, 12, 0, 0)]
    rows = state.auto_rows(none).collect()
    assert len(rows) == 4 and all([b["x_left"] for b in r["boxes"]] == [10.0, 30.0, 50.0] for r in rows)


def test_placing_and_warnings(spark):
    systems = spark.createDataFrame([(1, "s0", 1, 0.0, 40.0, 10.0, "auto", 1), (1, "s1", 1, 30.0, 50.0, 10.0, "auto", None), (1, "s2", 1, 80.0, 120.0, 10.0, "auto", None)], SYSTEMS)
    measures = spark.createDataFrame([(1, "a", "s0", 1, 10.0, 20.0, 0.0, 40.0, "auto", False), (1, "b", "s1", 1, 25.0, 30.0, 32.0, 38.0, "auto", False), (1, "c", "s2", 1, 10.0, 30.0, 80.0, 120.0, "auto", False), (1, "d", "s1", 1, 90.0, 99.0, 81.0, 119.0, "manual", False)], MEASURES)
    got = {r["measure_id"]: (r["system_id"], r["reassigned"]) for r in state.placed(measures, systems).collect()}
    assert got == {"a": ("s0", False), "b": ("s0", True), "c": ("s2", False), "d": ("s1", False)}
    ruled = state.placed(measures, systems, spark.createDataFrame([(1, 1)], "job int, page int"))
    assert {r["measure_id"]: r["system_id"] for r in ruled.collect()}["b"] == "s1"
    fresh = state.refreshed(systems, measures.filter("measure_id <> 'd'"), spark.createDataFrame([], EDITS))
    assert {(r["system_id"], r["warning"]) for r in state.warnings(fresh, systems).collect()} == {("s1", "suspicious_partial_staff"), ("s1", "system_has_no_measures")}
    q = state.quality(fresh, systems).first()
    assert (q["status"], q["n_reassigned"], q["n_warnings"], q["pages"]) == ("warning", 1, 2, [1])


def test_drawn_labels_and_cascade(spark, job):
    systems, measures = job
    side = systems.unionByName(spark.createDataFrame([(1, "p1_right", 1, 51.0, 61.0, 80.0, "auto", None)], SYSTEMS))
    more = measures.unionByName(spark.createDataFrame([(1, "r0", "p1_right", 1, 80.0, 95.0, 52.0, 60.0, "manual", False)], MEASURES))
    got = state.refreshed(side, more, spark.createDataFrame([], EDITS))
    ids = lambda df: {r["measure_id"]: r["hidden"] for r in df.collect()}
    assert len(ids(state.drawn_labels(got, side, "all_measures"))) == 13
    one = lambda m: spark.createDataFrame([(1, m)], "job int, measure_id string")
    drawn = ids(state.drawn_labels(got, side, "system_only", one("p1_s0_m2"), one("p1_s1_m0")))
    assert drawn == {"p1_s0_m0": False, "p1_s1_m0": True, "p1_s2_m0": False, "p2_s0_m0": False, "p1_s0_m2": False}
    edits = spark.createDataFrame([(1, "r0", 5, None, None, None), (1, "gone", 5, None, None, None)], EDITS)
    assert [r["measure_id"] for r in state.without_orphans({"edits": edits}, more)["edits"].collect()] == ["r0"]
    rows = spark.createDataFrame([(1, "p1_s0", None), (1, "new", "p1_s0")], "job int, system_id string, source_system_id string")
    assert [r["start"] for r in state.inherited_rows(rows, systems).collect()] == [1, 1]
