"""Operators on whole texts that SQL can't express: against plain versions."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import chain

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from intervalia.llm import components, hmm, ngram_join, quality_fm, suffix_dedup

from .conftest import CASES


def least_reachable(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=40))
def test_forest(edges):
    f = components.Forest()
    for a, b in edges:
        f.link(a, b)
    groups = {x: {x} for x in chain.from_iterable(edges)}
    for a, b in edges:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    assert {x: f.root(x) for x in groups} == {x: min(g) for x, g in groups.items()}


def test_components(spark):
    rng = random.Random(3)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(90)]
    edges = path + star + loose + [(5000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    top = least_reachable(2200, path + star + loose)
    assert got == {i: top[i] for i in {x for e in edges[:-1] for x in e} if top[i] != i}
    assert components.components(df.limit(0)).count() == 0


# n-gram join


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def joined_plainly(texts):
    sets = [shingle_set(t) for t in texts]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    return sets, links, least_reachable(len(sets), links)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("block", "hot"), [(256, 32), (8, 32), (8, 1)])
def test_join_against_all_pairs(spark, monkeypatch, block, hot):
    monkeypatch.setattr(ngram_join, "FAMILY", block)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "RUN_TOKENS", 3000)
    rng = random.Random(block)
    texts = family(rng, 60, 120, 6) + family(rng, 10, 12, 1) * 3 + family(rng, 25, 300, 9) + [f"only {i} a b c d" for i in range(20)]
    shared = " ".join(f"passage{i}" for i in range(40))  # in many texts, few of them alike
    texts += [f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(30))} {shared}" for _ in range(30)] + [shared + f" {i}" for i in range(5)]
    rng.shuffle(texts)
    sets, links, top = joined_plainly(texts)
    got = ngram_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    degree = Counter(chain.from_iterable(links))
    assert [r["n_shingles"] for r in got] == [len(s) for s in sets]
    assert [r["n_links"] for r in got] == [degree[i] for i in range(len(texts))]
    assert [r["component_id"] for r in got] == top and len(set(top)) < len(texts) - 60


def successive(rng, n, words=60):
    """Texts of which each goes on six words after the one before: only neighbours are alike."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words + 6 * n)]
    return [" ".join(base[6 * i : 6 * i + words]) for i in range(n)]


def test_join_of_chains(spark):
    rng = random.Random(5)
    texts = [t for n in (5, 9, 30, 70) for t in successive(rng, n)]
    rng.shuffle(texts)
    sets, links, top = joined_plainly(texts)
    assert len(links) == len(texts) - 4 and len(set(top)) == 4
    got = ngram_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).orderBy("doc_id").collect()
    degree = Counter(chain.from_iterable(links))
    assert [(r["component_id"], r["n_links"]) for r in got] == [(t, degree[i]) for i, t in enumerate(top)]


@settings(max_examples=200, deadline=None)
@given(st.permutations(range(12)), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=8), st.integers(1, 12))
def test_least_labels(order, more, length):
    for links in ([(0, 4), (1, 2), (2, 3), (3, 4)], [*zip(order[:length], order[1:length], strict=False), *more]):
        assert ngram_join.least_labels(12, np.array(links, np.int64).reshape(-1, 2)).tolist() == least_reachable(12, links)


def test_join_of_odd_rows(odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in ngram_join.joined(odd).collect()), key=str)
    sets, links, top = joined_plainly([r[1] for r in CASES])
    ids = [r[0] for r in CASES]
    classes = defaultdict(list)
    for i, t in enumerate(top):
        classes[t].append(ids[i])
    degree = Counter(chain.from_iterable(links))
    want = [(ids[i], len(sets[i]), min((x for x in classes[t] if x is not None), default=None), degree[i]) for i, t in enumerate(top)]
    assert got == sorted(want, key=str)
    assert ngram_join.joined(odd.limit(0)).count() == 0
    kept = ngram_join.keep_one_of_each(odd.sparkSession, odd, "")
    assert kept.columns == odd.columns and {2, 7}.isdisjoint({r["doc_id"] for r in kept.collect()})


def test_one_of_each_with_repeated_and_null_ids(spark):
    near, far, alone = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(1, near, "x"), (1, near, "x"), (2, near, "x"), (None, near, "x"), (3, far, "x"), (2, alone, "x"), (None, alone, "x")]
    rows += [(None, "only null", None), (None, "only null", None), (4, "two", None), (4, "two", "x"), (5, "", "x"), (5, "", "x"), (6, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = Counter(tuple(r) for r in ngram_join.keep_one_of_each(spark, docs, "").collect())
    two = [r for r in got if r[0] == 4]
    assert len(two) == 1 and got.pop(two[0]) == 1
    assert got == Counter([(1, near, "x"), (3, far, "x"), (2, alone, "x"), (None, "only null", None), (5, "", "x"), (5, "", "x"), (6, None, "x")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 50), min_size=1, max_size=80), st.integers(0, 20))
def test_prefix_has_the_tokens_asked_for(df, unique):
    n = len(df) + unique
    if len(df) < ngram_join.least_overlap(n):
        return
    asked = ngram_join.matches_asked(np.array(sorted(df), np.uint32), n)
    assert 1 <= asked <= ngram_join.least_overlap(n)
    assert n - ngram_join.least_overlap(n) + asked <= n


# suffixes


def cut_plainly(texts):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


DIGESTS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def passages(rng):
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    long, edge, short = noise(900), noise(200), noise(199)
    texts = [noise(rng.randrange(0, 500)) + long[rng.randrange(300) : rng.randrange(500, 900)] + noise(rng.randrange(300)) for _ in range(40)]
    texts += [noise(50) + edge + noise(50) for _ in range(3)] + [noise(50) + short + noise(50) for _ in range(3)]
    texts += [long, long, "ab" * 700, noise(150) + "z" * 450, "z" * 200, "z" * 199, noise(100) * 5, edge, "", None]
    near = noise(1500)
    for _ in range(30):
        i = rng.randrange(1500)
        texts.append(near[:i] + rng.choice("xyz") + near[i + 1 :])
    return texts


@pytest.mark.parametrize(("group", "chunk", "hot"), [(16_384, suffix_dedup.CHUNK, 32), (5, 2500, 32), (5, 2500, 1), (16_384, 2500, 2)])
def test_cut_against_all_strings(spark, monkeypatch, group, chunk, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", group)
    texts = passages(random.Random(group))
    docs = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, run string").repartition(5)
    got = suffix_dedup.deduplicated(docs, outputs=(*DIGESTS, "spans", "kept"), group=group, chunk=chunk).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in DIGESTS) for r in got] == cut_plainly(texts)
    for r in got:
        assert len(r["spans"]) == r["n_spans"] and sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


def test_cut_odd_rows(odd):
    got = suffix_dedup.deduplicated(odd, outputs=DIGESTS, carry=["doc_id", "text"]).collect()
    want = Counter(zip([r[0] for r in CASES], cut_plainly([r[1] for r in CASES]), strict=True))
    assert Counter((r["doc_id"], tuple(r[c] for c in DIGESTS)) for r in got) == want
    assert suffix_dedup.deduplicated(odd.limit(0)).count() == 0
    assert suffix_dedup.cut_documents(odd.sparkSession, odd, "").columns == odd.columns


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=8), min_size=1, max_size=9))
def test_loser_tree(runs):
    made = [suffix_dedup.opened_run(suffix_dedup.front_coded(sorted((x, b"r%d" % i) for x in run))) for i, run in enumerate(runs)]
    got = list(suffix_dedup.LoserTree(made))
    assert sorted((s, r) for _, s, r in got) == sorted((x, b"r%d" % i) for i, run in enumerate(runs) for x in run)
    assert [s for _, s, _ in got] == sorted(s for _, s, _ in got)
    for (_, a, _), (n, b, _) in zip(got, got[1:], strict=False):
        assert n == suffix_dedup.shared_prefix(a, b)


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(1)
    s = rng.integers(97, 123, 200, dtype=np.uint8)
    for _ in range(20):
        a, b = (rng.integers(97, 123, rng.integers(0, 300), dtype=np.uint8) for _ in range(2))
        data = np.concatenate([a, s, b])
        at, _, _ = suffix_dedup.anchors(data, np.array([len(data)]))
        alone, _, _ = suffix_dedup.anchors(s, np.array([200]))
        assert len(alone) == 1 and alone[0] + len(a) in at


# language model


def test_forward_and_expected_counts_against_all_paths(monkeypatch):
    rng = np.random.default_rng(2)
    k, n = 3, 5
    p = lambda *s: (x := rng.random(s)) / x.sum(-1, keepdims=True)
    m = hmm.Model(p(k), p(k, k), p(k, n).T.copy())
    seqs = [rng.integers(0, n, size).astype(np.int32) for size in (1, 4, 2, 4, 6)]
    want, start, move, emit = [], np.zeros(k), np.zeros((k, k)), np.zeros((n, k))
    for s in seqs:
        paths = np.array(np.meshgrid(*[range(k)] * len(s))).reshape(len(s), -1).T
        weight = np.array([m.start[q[0]] * np.prod([m.emit[x, y] for x, y in zip(s, q, strict=True)]) * np.prod([m.move[a, b] for a, b in zip(q, q[1:], strict=False)]) for q in paths])
        want.append(np.log10(weight.sum()))
        for q, w in zip(paths, weight / weight.sum(), strict=True):
            start[q[0]] += w
            for x, y in zip(s, q, strict=True):
                emit[x, y] += w
            for a, b in zip(q, q[1:], strict=False):
                move[a, b] += w
    assert hmm.log10_likelihood(m, seqs) == pytest.approx(want)
    e = hmm.Expected(k, n)
    e.add(m, seqs)
    assert e.start == pytest.approx(start, rel=1e-4) and e.emit == pytest.approx(emit, rel=1e-4) and e.move * m.move == pytest.approx(move, rel=1e-4)
    monkeypatch.setattr(hmm, "SMOOTH", 1e-9)
    better = e.model(m, np.full(n, 1 / n))
    assert hmm.log10_likelihood(better, seqs).sum() > hmm.log10_likelihood(m, seqs).sum() - 1


def test_language_model(spark, odd):
    docs = odd.select("doc_id", "text", "word")
    counts = hmm.stash(hmm.word_counts(docs.select("text")), "counts")
    texts = [r[1] for r in CASES]
    want = Counter(chain.from_iterable([*hmm.tokens(t), b""] for t in texts))
    assert {r["word"].encode(): r["n"] for r in counts.collect()} == dict(want)
    v = hmm.vocabulary(counts)
    assert (v.total, v.distinct, v.ends) == (sum(want.values()), len(want), len(texts))
    m = hmm.trained(docs.select("text"), v, texts[:4])
    got = hmm.scored(docs, counts, v, m).collect()
    score = {(r["doc_id"], r["n_tokens"]): r for r in got}
    for r in CASES:
        ws = [*hmm.tokens(r[1]), b""]
        x = score[r[0], len(ws)]
        assert x["n_known"] == len(ws)
        assert x["base_score"] == pytest.approx(sum(np.log10((want[w] + 0.5) / (v.total + 0.5 * (v.distinct + 1))) for w in ws))
        assert x["score"] == pytest.approx(hmm.log10_likelihood(m, [v.symbols(r[1])])[0])
    none = hmm.stash(hmm.word_counts(docs.limit(0).select("text")), "counts")
    v = hmm.vocabulary(none)
    assert v.total == 0 and hmm.scored(docs, none, v, hmm.trained(docs.limit(0).select("text"), v, [])).count() == len(CASES)


def test_words_beyond_the_known(spark):
    """Shares of words that have no symbol of their own add up; joined counts are those of all words."""
    texts = ["a a a b b c c d e f", "a b c zz", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = hmm.stash(hmm.word_counts(docs.select("text")), "counts")
    v = hmm.vocabulary(counts, own=2, known=3, endings=2)
    assert {w for w, (s, _) in v.known.items() if s <= 2} == {b"a", b"b"} and len(v.known) == 3
    want = Counter(chain.from_iterable([*hmm.tokens(t), b""] for t in texts))
    for s in (3, 4):
        ws = [w for w in want if w and w not in (b"a", b"b") and v.ending(w) == s]
        assert v.own_total[s] == sum(want[w] for w in ws) and v.own_distinct[s] == len(ws)
    m = hmm.Model(np.ones(1), np.ones((1, 1)), np.full((5, 1), 0.2))
    got = {r["doc_id"]: r for r in hmm.scored(spark.createDataFrame([(9, "a q d")], "doc_id long, text string"), counts, v, m).collect()}[9]
    share = lambda w: (want[w] + 0.5) / (v.own_total[v.ending(w)] + 0.5 * (v.own_distinct[v.ending(w)] + 1))
    assert got["score"] == pytest.approx(4 * np.log10(0.2) + np.log10(share(b"q")) + np.log10(share(b"d")))
    assert got["n_known"] == 3 and got["base_score"] == pytest.approx(sum(np.log10((want[w] + 0.5) / (v.total + 0.5 * (v.distinct + 1))) for w in (b"a", b"q", b"d", b"")))


# classifier


def test_sum_of_squares_identity():
    rng = np.random.default_rng(4)
    m = quality_fm.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    at, x = np.sort(rng.choice(50, 12, replace=False)), rng.normal(size=12)
    pairs = sum((m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(12) for j in range(i))
    assert m.margin(at, x) == pytest.approx(0.3 + m.w[at] @ x + pairs)


def test_classifier_learns(spark, odd):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    good = [" ".join(word() for _ in range(60)) for _ in range(150)]
    bad = [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(75)] + [" ".join(["buy now cheap"] * 20) for _ in range(75)]
    rows = [(i, t, int(i < 150), len(t)) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame([(i, t, n) for i, t, _, n in rows], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows], "doc_id long, quality int")
    m = quality_fm.train(docs, labels.filter("doc_id % 3 <> 0"), rows=120)
    got = {r["doc_id"]: r["score"] for r in quality_fm.scored(docs, m).collect()}
    held = [i for i in got if i % 3 == 0]
    assert np.mean([(got[i] >= 0.3) == (i < 150) for i in held]) > 0.95
    odd_scores = quality_fm.scored(odd, m).collect()
    assert len(odd_scores) == len(CASES) and all(0 <= r["score"] <= 1 for r in odd_scores)
    assert quality_fm.scored(odd.limit(0), m).count() == 0
    flat = quality_fm.train(docs, labels.limit(0))
    assert quality_fm.scored(docs.limit(1), flat).first()["score"] == 0.5
