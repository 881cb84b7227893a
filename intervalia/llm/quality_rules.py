"""Quality rules whose cutoffs adapt to each language and source.

Every text is measured with built-in expressions. Per (lang, source) group, mergeable quantile
sketches (Greenwald-Khanna summaries, merged from the map side up) give the quartiles of each
measure; upper and lower fences around them replace fixed cutoffs. The fences are joined back
to the measured rows, which are then judged.

Windows of words are compared by 64-bit hashes within their text: two different ones of a text of n
windows pass for equal in about n * n / 2^65 of cases.

Defined cases: a null text counts as empty and fails the base rules; null lang or source forms a
group of its own; repeated rows are judged one by one; a very long text is measured whole, in one row's
memory (an array entry a word); an empty table gives an empty result; columns that are carried must not
be named like OWN (filter_documents takes any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, let, packed, stash, table, without, words

#: Symbols counted by the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: measure -> (least distance of the fence from its quartile, in hundredths; upper, lower fence used)
FENCES = {
    "sym": (20, True, False),  # symbols per 100 words
    "dup": (40, True, False),  # repeated lines per 100 lines with a word
    "rep": (25, True, False),  # repeated words per 100 words
    "len": (150, True, True),  # characters per 100 words
}
SPREAD = 4
#: Columns that judged() adds, or needs on the way.
OWN = tuple("_n_words _word_chars _n_symbols _n_lines _n_dup_lines _n_repeat_words _sym _dup _rep _len _base_failed _kept _lang _source _by_word _by_line".split()) + tuple(f"_{end}_{m}" for end in ("hi", "lo", "q") for m in FENCES)
ACCURACY = 10_000


def _window_hashes(w: Column) -> Column:
    return F.when(
        F.size(w) > WINDOW,
        F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def spread(s: Column) -> Column:
        same = lambda e, j: F.coalesce(e["h"] == F.get(s, j)["h"], F.lit(False))
        places = F.transform(s, lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
        return F.aggregate(
            F.array_sort(F.filter(places, lambda i: i.isNotNull())),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    in_order = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(in_order(h), spread)))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _n_words, _word_chars, _n_symbols, _n_lines, _n_dup_lines and _n_repeat_words (all long)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    bare = without(whole, SPACES)
    lines = F.filter(F.split(whole, "\n"), lambda x: without(x, SPACES) != "")
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_word = let(words(whole), lambda w: F.struct(F.size(w).alias("n"), _covered(_window_hashes(w)).alias("rep")))
    got = docs.withColumn("_by_word", by_word).withColumn("_by_line", by_line)
    return got.withColumns(
        {
            "_n_words": F.col("_by_word.n").cast("long"),
            "_word_chars": F.length(bare).cast("long"),
            "_n_symbols": (F.length(whole) - F.length(without(whole, SYMBOLS))).cast("long"),
            "_n_lines": F.col("_by_line.n").cast("long"),
            "_n_dup_lines": F.col("_by_line.dup").cast("long"),
            "_n_repeat_words": F.col("_by_word.rep").cast("long"),
        }
    ).drop("_by_word", "_by_line")


def _hundredths(n: str, d: str) -> Column:
    return F.expr(f"CASE WHEN {d} > 0 THEN 100 * {n} DIV {d} ELSE 0 END").cast("long")


def _with_ratios(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "_sym": _hundredths("_n_symbols", "_n_words"),
            "_dup": _hundredths("_n_dup_lines", "_n_lines"),
            "_rep": _hundredths("_n_repeat_words", "_n_words"),
            "_len": _hundredths("_word_chars", "_n_words"),
            "_base_failed": F.expr(f"_n_words < {MIN_WORDS} OR 100 * _n_repeat_words > {MAX_REPEAT_PERCENT} * _n_words"),
        }
    )


def fences(ratios: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Per (lang, source): _hi_* and _lo_* for each measure, from quantile sketches of the rows that pass the base rules."""
    quarts = [F.percentile_approx(f"_{m}", F.array(F.lit(0.25), F.lit(0.75)), ACCURACY).alias(f"_q_{m}") for m in FENCES]
    q = ratios.filter(~F.col("_base_failed")).groupBy(F.col(lang).alias("_lang"), F.col(source).alias("_source")).agg(*quarts)
    out = []
    for m, (least, _, _) in FENCES.items():
        low, high = F.col(f"_q_{m}")[0], F.col(f"_q_{m}")[1]
        reach = F.greatest(SPREAD * (high - low), F.lit(least))
        out += [(high + reach).alias(f"_hi_{m}"), (low - reach).alias(f"_lo_{m}")]
    return q.select("_lang", "_source", *out)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all, if None) with the measures, _base_failed and _kept.

    The measured rows are written once to the shared folder, so that no text is measured twice;
    the fences, one row a group, are joined to them (broadcast only if Spark finds their file
    under its threshold).
    """
    if clash := set(docs.columns) & set(OWN):
        raise ValueError(f"columns {sorted(clash)} are the rules' own")
    rows = _with_ratios(measured(docs, text))
    names = [c for c in rows.columns if carry is None or c in carry or c in OWN or c in (lang, source)]
    rows = stash(rows.select(*names), "quality-measures")
    cut = stash(fences(rows, lang, source), "quality-fences")
    passes = F.lit(True)
    for m, (_, upper, lower) in FENCES.items():
        if upper:
            passes &= F.col(f"_{m}") <= F.col(f"_hi_{m}")
        if lower:
            passes &= F.col(f"_{m}") >= F.col(f"_lo_{m}")
    both = rows.join(cut, F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source")), "left")
    return both.withColumn("_kept", ~F.col("_base_failed") & F.coalesce(passes, F.lit(True)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = judged(docs, carry=["doc_id"])
    counts = [F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return got.select("doc_id", *counts, F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def filter_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that pass, in the columns they came with (of any name and type).

    Defined cases: as above; documents without text fail the base rules and go.
    """
    return judged(packed(docs, "text", "lang", "source"), carry=["doc"]).filter("_kept").select("doc.*")


_WORDS_SQL = """list_filter(string_split(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '      '), ' '), lambda x: x <> '')"""
_FENCE_SQL = ",\n".join(
    f"quantile_disc({m}, 0.75) + greatest({SPREAD} * (quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25)), {least}) AS hi_{m}, "
    f"quantile_disc({m}, 0.25) - greatest({SPREAD} * (quantile_disc({m}, 0.75) - quantile_disc({m}, 0.25)), {least}) AS lo_{m}"
    for m, (least, _, _) in FENCES.items()
)
_PASS_SQL = " AND ".join(
    test for m, (_, upper, lower) in FENCES.items() for test in [f"{m} <= hi_{m}"] * upper + [f"{m} >= lo_{m}"] * lower
)

JUDGED_SQL = f"""
d AS (SELECT row_number() OVER () AS rid, * FROM {{docs}}),
w AS (SELECT rid, {_WORDS_SQL} AS ws, coalesce(text, '') AS t FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+{WINDOW - 1}], ' ') AS g
        FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
m AS (SELECT w.rid, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
        length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(ls) AS n_lines,
        len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
r AS (SELECT d.*, m.* EXCLUDE (rid),
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 100 * n_symbols // n_words ELSE 0 END AS sym,
        CASE WHEN n_lines > 0 THEN 100 * n_dup_lines // n_lines ELSE 0 END AS dup,
        CASE WHEN n_words > 0 THEN 100 * n_repeat_words // n_words ELSE 0 END AS rep,
        CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS len
      FROM d JOIN m USING (rid)),
f AS (SELECT lang AS g_lang, source AS g_source, {_FENCE_SQL} FROM r WHERE NOT base_failed GROUP BY ALL),
judged AS (SELECT r.*, NOT base_failed AND coalesce({_PASS_SQL}, true) AS kept
      FROM r LEFT JOIN f ON lang IS NOT DISTINCT FROM g_lang AND source IS NOT DISTINCT FROM g_source)"""

SQL = f"""WITH {JUDGED_SQL.format(docs="documents")}
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, kept FROM judged"""
