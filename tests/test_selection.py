"""Choices by priority and place; values stated by hand."""

from pyspark.sql import functions as F

from intervalia.operators import selection


def test_candidates_and_files(spark):
    c = spark.createDataFrame([(1, 2, True, 7), (1, 1, False, 7), (1, 3, True, 9), (2, 1, True, 9)], "job int, p int, found boolean, run int")
    got = {r["job"]: (r["p"], r["stale_run"]) for r in selection.first_candidate(c, ["job"], "p", "found", F.col("run") != 7).collect()}
    assert got == {1: (2, False), 2: (1, True)}
    pages = spark.createDataFrame([(1,), (2,)], "page int")
    named = spark.createDataFrame([(2, "x.omr")], "page int, file string")
    assert {r["page"]: r["file"] for r in selection.page_file(pages, named, ["page"], "file", F.lit("sheet")).collect()} == {1: "sheet", 2: "x.omr"}


def test_ladder(spark):
    rows = spark.createDataFrame([(1, "a", "staff_lines", 0), (1, "b", "barlines", 3), (2, "c", "barlines", 3), (2, "d", "barlines", 0), (3, "e", "none", 0)], "s int, k string, src string, n int")
    got = {r["k"]: r["tier"] for r in selection.usable_rows(rows, ["s"], F.col("src") == "staff_lines", F.col("n") > 0).collect()}
    assert got == {"a": 1, "c": 2}


def test_header_symbol(spark):
    staves = spark.createDataFrame([(1, "s1", "h2", 10.0, 0.0, 40.0), (1, "s2", None, 10.0, 50.0, 90.0), (1, "s3", "gone", 10.0, 200.0, 240.0)], "sys int, staff string, named string, l double, t double, b double")
    symbols = spark.createDataFrame([(1, "h1", 12.0, 0.0, 40.0, True), (1, "h2", 99.0, 300.0, 310.0, False), (1, "n1", 11.0, 52.0, 80.0, False), (1, "g1", 30.0, 52.0, 88.0, True)], "sys int, id string, x double, y double, y2 double, clef boolean")
    got = selection.header_symbol(staves, symbols, ["sys"], "staff", "named", "id", "l", "t", "b", "x", "y", "y2", "clef")
    assert {r["staff"]: r["symbol"] for r in got.collect()} == {"s1": "h2", "s2": "g1"}


def test_pushed_and_stacked(spark):
    starts = spark.createDataFrame([(1, "a", 30.0), (1, "b", 5.0)], "p int, k string, x double")
    symbols = spark.createDataFrame([(1, 25.0, 35.0), (1, 18.0, 26.0), (1, 29.0, 31.0)], "p int, l double, r double")
    assert {r["k"]: r["x"] for r in selection.pushed_left(starts, symbols, ["p"], "k", "x", "l", "r").collect()} == {"a": 18.0, "b": 5.0}
    anchors = spark.createDataFrame([(1, 1, [1, 2], 10.0, 50.0), (1, 2, [3], 10.0, 50.0)], "s int, o int, n array<int>, x double, y double")
    assert sorted((r["number"], r["label_x"], r["label_y"]) for r in selection.stacked_labels(anchors, ["s"], ["o"], "n", "x", "y").collect()) == [(1, 10.0, 50.0), (2, 10.0, 50.0), (3, 24.0, 42.0)]
    meters = spark.createDataFrame([("m1", 1, "3/4"), ("m1", 2, "4/4"), ("m2", 3, None)], "m string, o int, meter string")
    assert [tuple(r) for r in selection.explicit_meters(meters, ["m"], ["o"], "meter").collect()] == [("m1", "4/4")]


def test_structure(spark):
    staves = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 1, 1), ("b", 1, 0)], "path string, sheet_no int, system_index int")
    symbols = spark.createDataFrame([("a", "barline"), ("a", "barline"), ("a", "clef"), ("b", "barline"), ("c", "barline")], "path string, tag string")
    got = {r["path"]: tuple(r)[1:] for r in selection.structure_counts(staves, symbols, ["path"]).collect()}
    assert got == {"a": (2, 3, 2, True), "b": (1, 1, 1, False), "c": (0, 0, 1, False)}
