"""Operators that SQL can express: against DuckDB on the driver's smallest tables, and on odd rows."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from intervalia.llm import epsilon_grid, mixing, quality_rules, token_counts, warc

from .conftest import CASES, SF

SQL = {"op1_quality_rules": quality_rules, "op3_mixing": mixing, "op8_warc": warc, "op10_epsilon_grid": epsilon_grid}


def plain(rows):
    return Counter(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SQL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = getattr(SQL[name], name)(spark, SF)
    cols = sorted(got.columns)
    want = con.execute(f"select {', '.join(cols)} from ({SQL[name].SQL})").fetchall()
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)


def words(text):
    return [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]


def repeat_words(ws):
    grams = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    return len({p for i in range(len(ws) - 7) if grams[tuple(ws[i : i + 8])] > 1 for p in range(i, i + 8)})


def test_measures_of_odd_rows(odd):
    got = quality_rules.judged(odd).orderBy("doc_id").collect()
    assert len(got) == len(CASES)
    for r in got:
        ws, t = words(r["text"]), r["text"] or ""
        lines = [x for x in t.split("\n") if words(x)]
        assert r["_n_words"] == len(ws) and r["_word_chars"] == sum(map(len, ws))
        assert r["_n_dup_lines"] == len(lines) - len(set(lines)) and r["_n_repeat_words"] == repeat_words(ws)
        assert r["_base_failed"] == (len(ws) < 20 or 100 * r["_n_repeat_words"] > 30 * len(ws))
        assert not (r["_kept"] and r["_base_failed"])
    assert quality_rules.judged(odd.limit(0)).count() == 0
    assert quality_rules.filter_documents(odd.sparkSession, odd, "").columns == odd.columns


def test_fences_follow_their_group(spark):
    """A symbol rate that is usual in one source is an outlier in another."""
    text = lambda i, s: " ".join(f"word{i}x{j}" + ("#" if j < s else "") for j in range(50))
    rows = [(i, text(i, 0), "en", "prose") for i in range(40)] + [(100 + i, text(i, 40), "en", "code") for i in range(40)] + [(999, text(999, 40), "en", "prose")]
    got = {r["doc_id"]: r["_kept"] for r in quality_rules.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[999] and all(v for k, v in got.items() if k != 999)


def test_mix_of_odd_rows(odd):
    got = mixing.mixed(odd).collect()
    assert len(got) == len(CASES)
    for r in got:
        assert r["_size"] == len(words(r["text"])) and len(r["_draws"]) <= 2
        assert sorted(d["pass"] for d in r["_draws"]) == list(range(len(r["_draws"])))
    assert mixing.mixed(odd.limit(0)).count() == 0
    again = mixing.mixed(odd.repartition(3)).collect()
    key = lambda rows: sorted((str(r["doc_id"]), r["_size"], str(r["_draws"])) for r in rows)
    assert key(got) == key(again)
    assert mixing.mix_documents(odd.sparkSession, odd, "").columns == odd.columns


def test_targets(spark):
    """Shares that would be over the limit go to the others, by weight."""
    rows = [("a", 10), ("b", 1000), ("c", 1000), ("d", 1000), (None, 0)]
    got = {r["_source"]: r["_target"] for r in mixing.source_targets(spark.createDataFrame([(*r, 1) for r in rows], "_source string, _size long, _docs long")).collect()}
    weight, size = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, dict(rows)
    want, full = dict.fromkeys(size, 0.0), set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        want = {s: 2.0 * size[s] if s in full else rest * weight[s] / sum(w for x, w in weight.items() if x not in full) for s in size}
        over = {s for s in size if s not in full and want[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(want)


def test_tree_deals_all_blocks(spark):
    quotas = {"a": 1000, "b": 37, "c": 1, None: 0, "d": 400}
    got = {r["_source"]: r["_ends"] for r in mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "_source string, _blocks long"), 8).collect()}
    per = {s: [b - a for a, b in zip([0, *e], e, strict=False)] for s, e in got.items()}
    assert {s: e[-1] for s, e in got.items()} == quotas and all(n >= 0 for x in per.values() for n in x)
    sizes = [sum(x[i] for x in per.values()) for i in range(8)]
    assert max(sizes) - min(sizes) <= 3
    assert all(90 < n < 160 for n in per["a"])


def test_hypergeometric_draws(spark):
    """The inverse distribution has the mean and variance of the hypergeometric."""
    df = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    k = mixing._hypergeometric(F.lit(30).cast("long"), F.lit(40).cast("long"), F.lit(100).cast("long"), F.col("u"))
    mean, var, low, high = df.select(k.alias("k")).agg(F.avg("k"), F.var_pop("k"), F.min("k"), F.max("k")).first()
    assert mean == pytest.approx(12, abs=0.02) and var == pytest.approx(30 * 0.4 * 0.6 * 70 / 99, rel=0.02) and 0 <= low and high <= 30


def test_rollup(spark, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/r")
    assert r.totals().count() == 0
    kinds = "source string, lang string, tokenizer string, n_tokens long"
    old = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", 5), (None, None, "v1", None)], kinds)
    assert r.commit("1", token_counts.inserts(old)) and not r.commit("1", token_counts.inserts(old))
    state = lambda: {tuple(x)[:3]: tuple(x)[3:] for x in r.totals().collect()}
    assert state() == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0)}
    new = spark.createDataFrame([("a", "en", "v2", 7)], kinds)
    assert r.commit("2", token_counts.revisions(old.filter("n_tokens = 5"), new)) and r.commit("3", token_counts.inserts(old.limit(0)))
    want = {("a", "en", "v1"): (1, 10), ("a", "en", "v2"): (1, 7), (None, None, "v1"): (1, 0)}
    assert state() == want
    old.write.parquet(f"file://{tmp_path}/r/data/dead")  # attempts that didn't end
    (tmp_path / "r/drafts/dead").write_text("5\ndata/dead")
    assert r.compact("c1") and not r.compact("c1")
    assert state() == want and r.committed() == ["c1"] and not r.commit("2", token_counts.inserts(old))
    # what others did at the same time: the entry is there when ours is moved
    log = r.log()
    r.log = lambda: []
    assert not r.commit("2", token_counts.inserts(old)) and not r.compact("c2")
    del r.log
    assert state() == want and r.log() == log
    assert r.commit("4", token_counts.deletes(old)) and state() == {("a", "en", "v1"): (-1, -5), ("a", "en", "v2"): (1, 7)}


def test_archives(spark, tmp_path):
    big = "<p>" + "same text " * 200
    rows = [(1, "http://a/1", big, "z"), (5, "http://a/5", big, "z"), (3, None, big, "z"), (7, "http://a/ 7\r\nX: y", "short", "z"), (8, None, "short", "z"), (None, "u", None, None), (9, "u9", "é" * 600, None), (9, "u9", "é" * 600, None), (10, "u", "x" * 3_000_000, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    folder = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.write_archives(pages, folder), folder, with_payload=True).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert [(by_id[i]["record_type"], by_id[i]["refers_to"]) for i in (1, 3, 5, 7, 8, 9)] == [("revisit", 5), ("revisit", 5), ("response", None), ("response", None), ("response", None), ("response", None)]
    assert bytes(by_id[5]["payload"]).decode() == big and by_id[1]["payload"] is None and by_id[1]["payload_bytes"] == len(big)
    assert by_id[None]["payload_bytes"] == 0 and by_id[9]["payload_bytes"] == 1200 and by_id[10]["payload_bytes"] == 3_000_000
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"{folder}2"), f"{folder}2").count() == 0


def test_archive_is_frames_after_a_dictionary():
    import io
    import struct

    import zstandard

    made = [warc.record(i, f"http://x/{i}", f"<html>{'text ' * 50}{i}".encode(), "d", None, None) for i in range(300)]
    raw = warc.archive(made)
    magic, size = struct.unpack("<II", raw[:8])
    assert magic == 0x184D2A5D
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
    rest, frames = raw[8 + size :], []
    while rest:
        one = d.decompressobj()
        frames.append(one.decompress(rest))
        rest = one.unused_data
    assert frames == made and len(raw) < sum(map(len, made)) / 3
    assert len(list(warc.records(io.BytesIO(raw)))) == 300


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.3]), (4, [0.9, 0.6]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 0.0]), (9, [None, 1.0]), (10, []), (1, [1.0, 0.0]), (None, [0.0, 5.0]), (12, [0.01, 5.0]), (13, [-1.0, -0.0]), (14, [-1.0]), (15, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, k int")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in epsilon_grid.joined(df).collect()), key=str)
    sound = [(n, i, v) for n, (i, v) in enumerate(rows) if v and all(x is not None and abs(x) < inf for x in v) and any(v)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    links = {(m, n) for m, _, a in sound for n, _, b in sound if m != n and cos(a, b) >= 0.95}
    reach = {n: {n} for n in range(len(rows))}
    for _ in rows:
        for m, n in links:
            reach[m] |= reach[n]
    least = lambda n: min((rows[x][0] for x in reach[n] if rows[x][0] is not None), default=None)
    assert got == sorted(((i, sum(m == n for m, _ in links), least(n)) for n, (i, _) in enumerate(rows)), key=str)
    assert epsilon_grid.joined(df.limit(0)).count() == 0 and epsilon_grid.joined(df.filter("vec_id in (5, 6)")).count() == 2


def test_grid_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + rng.normal(scale=0.25, size=(500, 16)), np.repeat(centres[:1], 40, 0)])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r for r in epsilon_grid.joined(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), block=64, interval=16).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(1))
    assert [got[i]["component_id"] for i in range(len(x))] == label.tolist()


def test_grid_of_very_small_and_large_vectors(spark):
    v = [[3.0, 4.0], [3e-170, 4e-170], [3e200, 4e200], [3e-320, 4e-320], [-4.0, 3.0], [-4e-170, 3e-170]]
    got = epsilon_grid.joined(spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
    assert [(r["n_links"], r["component_id"]) for r in got] == [(3, 0)] * 4 + [(1, 4)] * 2
