"""Golden rows of a score of twelve measures in four systems."""

import random

import pytest
from pyspark.sql import functions as F

from intervalia.operators import numbering

SYSTEMS = ["p1_s0", "p1_s1", "p1_s2", "p2_s0"]
KINDS = "job int, place int, system string, measure string, override int, rest int, excluded boolean, pickup boolean, start int, kind string, carry int"


def score(**edits):
    """Rows of the score; edits: measure -> {column: value}, carry: system -> numbers added after it."""
    rows, carry = [], edits.pop("carry", {})
    for i, s in enumerate(SYSTEMS):
        for j in range(3):
            m = f"{s[-2:]}m{j}" if s.startswith("p1") else f"p2m{j}"
            e = edits.get(m, {})
            before = carry.get(SYSTEMS[i - 1], 0) if j == 0 and i else 0
            rows.append((1, 3 * i + j, s, m, e.get("override"), e.get("rest"), e.get("excluded", False), e.get("pickup", False), 1, e.get("kind"), before))
    return rows


CASES = [
    ({}, [1, 4, 7, 10], {}),
    ({"s1m1": {"override": 20}}, [1, 4, 22, 25], {}),
    ({"s1m1": {"pickup": True}}, [1, 4, 6, 9], {"s1m1": 4, "s1m2": 5}),
    ({"s1m1": {"rest": 3}}, [1, 4, 9, 12], {"s1m1": 5, "s1m2": 8}),
    ({"s1m1": {"kind": "1"}, "s1m2": {"kind": "2"}}, [1, 4, 6, 9], {"s1m1": 5, "s1m2": 5}),
    ({"carry": {"p1_s1": 2}}, [1, 4, 9, 12], {}),
    ({"s1m0": {"override": 20}}, [1, 20, 23, 26], {}),
    ({"s1m0": {"override": 20}, "p2m0": {"override": 50}}, [1, 20, 23, 50], {}),
    ({"s1m1": {"kind": "1"}, "s1m2": {"kind": "2"}, "s2m0": {"kind": "2"}}, [1, 4, 6, 9], {"s1m1": 5, "s1m2": 5, "s2m0": 6}),
    ({"s1m1": {"kind": "1"}, "s1m2": {"kind": "1"}, "s2m0": {"kind": "2"}, "s2m1": {"kind": "2"}, "s2m2": {"kind": "2"}}, [1, 4, 5, 8], {"s1m2": 6, "s2m2": 7}),
    ({"s1m1": {"kind": "1"}, "s2m0": {"kind": "2"}, "p2m1": {"kind": "2"}}, [1, 4, 7, 10], {}),
    ({"s0m0": {"excluded": True}}, [1, 3, 6, 9], {"s0m0": None, "s0m1": 1}),
    ({"s0m0": {"pickup": True}}, [0, 3, 6, 9], {"s0m0": 0, "s0m1": 1}),
]


@pytest.fixture(scope="module")
def numbered_cases(spark):
    rows = [(n, *r[1:]) for n, (edits, _, _) in enumerate(CASES) for r in score(**dict(edits))]
    df = spark.createDataFrame(rows, KINDS)
    got = numbering.numbered_with_endings(df, ["job"], ["place"], carry="carry")
    return {(r["job"], r["measure"]): r for r in got.collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_golden(numbered_cases, n):
    _, systems, some = CASES[n]
    by_system = {}
    for (job, _), r in sorted(numbered_cases.items(), key=lambda x: x[1]["place"]):
        if job == n and r["label"] is not None:
            by_system.setdefault(r["system"], r["label"])
    assert [by_system[s] for s in SYSTEMS] == systems
    assert {m: numbered_cases[n, m]["label"] for m in some} == some


def test_windows_equal_the_fold(spark):
    """Without endings, islands and the fold agree on any edits."""
    rng = random.Random(9)
    rows = []
    for job in range(60):
        for r in score():
            some = lambda p, v: v if rng.random() < p else None
            rows.append((job, *r[1:4], some(0.15, rng.randrange(100)), some(0.2, rng.randrange(4)), rng.random() < 0.15, rng.random() < 0.1, rng.randrange(1, 5), None, rng.choice([0, 0, 0, 2])))
    df = spark.createDataFrame(rows, KINDS)
    a = numbering.numbered(df, ["job"], ["place"], carry="carry").select("job", "place", "label")
    b = numbering.numbered_with_endings(df, ["job"], ["place"], carry="carry").select("job", "place", "label")
    assert a.exceptAll(b).count() == 0 and a.count() == b.count() == 720


def test_group_reasons(spark):
    kinds = ["2", "1", "2", "x", "1", None, "1", "1", "2", "1", "2", "2"]
    rows = [(1, i, k, i == 4, i == 9) for i, k in enumerate(kinds)]
    got = numbering.ending_groups(spark.createDataFrame(rows, "job int, place int, kind string, excluded boolean, pickup boolean"), ["job"], ["place"]).orderBy("place").collect()
    assert [(r["group_id"], r["branch_index"], r["ignored"]) for r in got] == [
        (None, None, "orphan_ending2"), (0, 0, None), (0, 0, None), (None, None, "invalid_kind"), (None, None, "excluded_from_counting"), (None, None, None),
        (1, 0, None), (1, 1, None), (1, 0, None), (None, None, "pickup_blocked"), (None, None, "orphan_ending2"), (None, None, "orphan_ending2"),
    ]


def test_pairs(spark):
    starts = [(1, 1, "1"), (1, 3, "2"), (2, 1, "1"), (2, 2, "1"), (2, 4, "2"), (3, 1, "2"), (3, 2, "2")]
    got = numbering.ending_pairs(spark.createDataFrame(starts, "job int, place int, kind string"), ["job"], ["place"]).orderBy("job", "place").collect()
    assert [(r["pair_no"], r["slot"], r["is_paired"]) for r in got] == [(1, 1, True), (1, 2, True), (1, 1, False), (2, 1, True), (2, 2, True), (1, 1, False), (2, 1, False)]


def test_carry_and_reindex(spark):
    rows = spark.createDataFrame([(1, 1, None, False), (1, 2, "a", False), (1, 3, None, False), (1, 4, None, True), (1, 5, None, False)], "job int, place int, v string, stop boolean")
    assert [r["carried"] for r in numbering.carried(rows, ["job"], ["place"], "v", F.col("stop")).orderBy("place").collect()] == [None, "a", "a", None, None]
    parents = spark.createDataFrame([(1, "b", 5.0), (1, "a", 9.0)], "job int, system string, y double")
    children = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "b", 1.0), (1, "gone", 0.0)], "job int, system string, x double")
    got = numbering.reindexed(children, parents, ["job"], "system", ["y"], ["x"]).collect()
    assert {(r["system"], r["x"]): (r["parent_index"], r["local_index"], r["global_index"]) for r in got} == {("b", 1.0): (0, 0, 0), ("b", 2.0): (0, 1, 1), ("a", 1.0): (1, 0, 2)}
