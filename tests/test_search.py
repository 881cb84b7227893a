"""Best targets of items, without a table of pairs: against all pairs in plain Python, and the rows that the plan makes."""

import math
import random

import pytest

from intervalia.operators import layout, search, selection

PLACES = [None, math.nan, math.inf, -math.inf]


def most_rows(df):
    """The most rows that a step of the plan makes."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        made = p.metrics().get("numOutputRows")
        return max([made.get().value() if made.isDefined() else 0, *map(walk, below)])

    return walk(plan)


def place(r, odd):
    return r.choice(PLACES) if r.random() < odd else r.randrange(40_000) / 100


def intervals(r, n, odd, width):
    for _ in range(n):
        a = place(r, odd)
        yield r.choice([None, 1, 2, 3]), a, place(r, odd) if r.random() < odd else None if a is None else a + r.randrange(width) / 100


def first(pairs):
    """Spark's order: null, numbers, NaN."""
    rank = lambda v: (0, 0) if v is None else (2, 0) if v != v else (1, v)
    return min(pairs, key=lambda p: tuple(rank(v) for v in p[0]))[1]


def least(*v):
    known = [x for x in v if x is not None]
    return min([x for x in known if x == x], default=math.nan) if known else None


def greatest(*v):
    known = [x for x in v if x is not None]
    return math.nan if any(x != x for x in known) else max(known, default=None)


def above(a, b):
    return a is not None and b is not None and b == b and (a != a or a > b)


def assigned_plainly(items, targets, tolerance=5.0):
    """layout.assign_intervals as its docstring has it, over all pairs."""
    got = {}
    for part, i, l, h in items:
        near = []
        for p, k, tl, th, odd in targets:
            if p == part and p is not None and above(th, tl):
                overlap = least(h, th) - greatest(l, tl) + tolerance
                away = None if l is None or h is None else abs((l + h) / 2 - (tl + th) / 2)
                near.append((overlap if overlap != overlap else -overlap, -math.inf if overlap != overlap else -overlap, away, tl, k, odd is False, above(overlap, 0.0)))
        hits, sound = [t for t in near if t[6]], [t for t in near if t[5]]
        some = [t for t in hits if t[5]] or (hits if len(hits) == 1 else sound or near)
        if some:
            got[i] = first([((t[1], *t[2:5]), t[4]) for t in some])
    return got


@pytest.mark.parametrize("block, odd, suspicious", [(32_768, 0.0, 0.3), (32_768, 0.05, 0.9), (20, 0.02, 0.95), (7, 0.0, 1.0)])
def test_assigned_as_over_all_pairs(spark, monkeypatch, block, odd, suspicious):
    monkeypatch.setattr(search, "BLOCK", block)  # small ones deal partitions into blocks of targets and chunks of items
    r = random.Random(block + suspicious)
    items = [(p, i, l, h) for i, (p, l, h) in enumerate(intervals(r, 150, odd, 10_000))]
    targets = [(p, f"t{k}", l, h, None if r.random() < odd else r.random() < suspicious) for k, (p, l, h) in enumerate(intervals(r, 90, odd, 6_000))]
    a = spark.createDataFrame(items, "page int, m int, l double, h double"), spark.createDataFrame(targets, "page int, t string, lo double, hi double, odd boolean")
    got = layout.assign_intervals(*a, ["page"], "m", "t", "l", "h", "lo", "hi", "odd")
    assert {r["m"]: r["t"] for r in got.collect()} == assigned_plainly(items, targets)


def test_assigned_without_all_pairs(spark):
    n, m = 2000, 300
    items = spark.range(n).selectExpr("1 AS page", "id AS m", "id * 1.0D AS l", "id + 100.0D AS h")
    targets = spark.range(m).selectExpr("1 AS page", "id AS t", "id * 7.0D AS lo", "id * 7.0D + 200 AS hi", "id % 4 = 0 AS odd")
    got = layout.assign_intervals(items, targets, ["page"], "m", "t", "l", "h", "lo", "hi", "odd")
    assert got.count() == n and most_rows(got) <= 4 * n


def nearest_plainly(items, spans, tolerance=2.0):
    """selection.nearest_span as its docstring has it, over all pairs."""
    got = {}
    for part, i, hint in items:
        near = []
        for p, x, top, bottom in spans:
            if p == part and p is not None and above(bottom, top):
                covers = hint is not None and hint >= top - tolerance and hint <= bottom + tolerance
                away = 0.0 if covers or hint is None else abs((top + bottom) / 2 - hint)
                near.append(((not covers, away, x, top, bottom), (top, bottom)))
        if near:
            got[i] = first(near)
    return got


@pytest.mark.parametrize("block", [32_768, 20])
def test_nearest_as_over_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    r = random.Random(block)
    items = [(p, i, None if a != a else a) for i, (p, a, _) in enumerate(intervals(r, 200, 0.05, 100))]
    finite = lambda v: v if v is None or math.isfinite(v) else 7.0
    spans = [(p, r.choice([None, 1.0, 2.0]), finite(a), finite(b)) for p, a, b in intervals(r, 90, 0.05, 2_000)]
    a = spark.createDataFrame(items, "p int, k int, hint double"), spark.createDataFrame(spans, "p int, x double, t double, b double")
    got = selection.nearest_span(*a, ["p"], "k", "hint", "x", "t", "b")
    assert got.columns == ["p", "k", "hint", "span_top", "span_bottom"]
    assert {r["k"]: (r["span_top"], r["span_bottom"]) for r in got.collect()} == nearest_plainly(items, spans)


def test_nearest_without_all_pairs(spark):
    n, m = 2000, 300
    items = spark.range(n).selectExpr("1 AS p", "id AS k", "IF(id % 5 > 0, id * 1.0D, NULL) AS hint")
    spans = spark.range(m).selectExpr("1 AS p", "id * 1.0D AS x", "id * 7.0D AS t", "id * 7.0D + 50 * (id % 9) AS b")
    got = selection.nearest_span(items, spans, ["p"], "k", "hint", "x", "t", "b")
    assert got.count() == n and most_rows(got) <= 4 * n
