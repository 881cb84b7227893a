"""Recorded classification results: normalised, checked and merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import from_vocabulary, meter, to_int

#: The words a result may use.
LABELS = ("normal", "multi_measure_rest", "pickup", "uncertain")
CONFIDENCE = ("low", "medium", "high")
SECOND_GUESSES = ("pickup", "multi_measure_rest")
COMPLETENESS = ("full", "incomplete", "unclear")
UNCLEAR_REASONS = ("time_signature_not_clear", "too_dense_to_count", "crop_cut_off", "split_may_be_wrong", "ornament_or_tie_confusion", "not_enough_visual_evidence")
SCORE_TYPES = ("single", "grand", "score")


def normalised(suggestions: DataFrame) -> DataFrame:
    """Suggestions (job, measure_id, label, rest_count, confidence, maybe_label, maybe_rest_count, completeness, reason, time_signature),
    within their vocabularies: a rest of fewer than 2 counts as normal, and a second guess that could not stand alone goes. Pickups are incomplete and rests full,
whatever they say; a reason that isn't known is null."""
    label = from_vocabulary(F.coalesce("label", F.lit("")), LABELS, "normal")
    maybe = F.lower(F.trim("maybe_label"))
    n, m = to_int(F.col("rest_count")), to_int(F.col("maybe_rest_count"))
    df = suggestions.withColumns({"_l": F.when((label == "multi_measure_rest") & ~F.coalesce(n >= 2, F.lit(False)), "normal").otherwise(label), "_n": n, "_m": m, "_p": maybe})
    sound = F.col("_p").isin(*SECOND_GUESSES) & (F.col("_l") == "uncertain") & ((F.col("_p") != "multi_measure_rest") | F.coalesce(F.col("_m") >= 2, F.lit(False)))
    sound &= ~((F.col("_p") != "multi_measure_rest") & F.col("_m").isNotNull())
    return df.select(
        "job", "measure_id", F.col("_l").alias("label"), F.when(F.col("_l") == "multi_measure_rest", F.col("_n")).alias("rest_count"),
        from_vocabulary(F.coalesce("confidence", F.lit("")), CONFIDENCE, "low").alias("confidence"), F.when(sound, F.col("_p")).alias("maybe_label"),
        F.when(sound & (F.col("_p") == "multi_measure_rest"), F.col("_m")).alias("maybe_rest_count"),
        F.when(F.col("_l") == "pickup", "incomplete").when(F.col("_l") == "multi_measure_rest", "full").otherwise(from_vocabulary(F.coalesce("completeness", F.lit("")), COMPLETENESS, "unclear")).alias("completeness"),
        from_vocabulary(F.col("reason"), UNCLEAR_REASONS, None).alias("reason"), meter(F.col("time_signature")).alias("time_signature"),
    )


def kept_and_omitted(normal: DataFrame) -> DataFrame:
    """Per job how many suggestions say something, and how many are normal and left out."""
    return normal.groupBy("job").agg(F.count_if(F.col("label") != "normal").alias("n_suggestions"), F.count_if(F.col("label") == "normal").alias("normal_omitted"))


def merged_by_id(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Both tables by key, the new one's row winning."""
    return new.unionByName(old.join(new.select(*key), key, "left_anti"))


def pair_confidence(events: DataFrame, pair: list[str], confidence: str = "confidence") -> DataFrame:
    """The least confident word of each pair's events, as it stands; words that aren't known are the least."""
    known = F.create_map(*(F.lit(x) for i, c in enumerate(CONFIDENCE) for x in (c, i)))
    word = F.lower(F.trim(F.coalesce(F.col(confidence), F.lit("low"))))
    return events.groupBy(*pair).agg(F.min_by(word, F.struct(F.coalesce(known[word], F.lit(0)).alias("rank"), word.alias("word"))).alias("confidence"))
