"""Reports over attempts, logs and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import cost

Cols = list[str]


def full_status(expected: DataFrame, actual: DataFrame, key: str, ok: Column, reason: str) -> DataFrame:
    """All keys of both sides, with whether each succeeded and why not."""
    e = expected.withColumn("_e", F.lit(True))
    a = actual.withColumn("_a", F.lit(True))
    df = e.join(a, key, "full_outer")
    why = F.when(F.col("_e").isNull(), "not_expected").when(F.col("_a").isNull(), "missing").when(~F.coalesce(ok, F.lit(False)), F.coalesce(F.col(reason).cast("string"), F.lit("unknown_failure")))
    return df.withColumns({"success": F.coalesce(F.col("_e") & F.col("_a") & ok, F.lit(False)), "failure": why}).drop("_e", "_a")


def reason_counts(rows: DataFrame, part: Cols, reasons: str) -> DataFrame:
    """Sums of the counts in a column of maps (reason -> count)."""
    return rows.select(*part, F.explode(reasons).alias("reason", "n")).groupBy(*part, "reason").agg(F.sum("n").cast("long").alias("n"))


#: What logs say, as names and patterns.
CLUES = {
    "transcription_did_not_complete": r"transcription did not complete", "export_failed": r"could not export|export failed", "no_mxl_files": r"no_mxl|no mxl|no .*mxl",
    "no_parts_or_measures": r"parts_or_measures_zero|no parts|no measures", "staff_system_warning": r"staff|stave|system", "measure_warning": r"measure",
    "timeout_or_killed": r"timeout|timed out|killed|137", "crash_or_exception": r"exception|traceback|error: process completed with exit code",
}


def clues(text: Column, patterns: dict[str, str] = CLUES) -> Column:
    """Names of the patterns found in a text, sorted."""
    t = F.lower(text)
    return F.array_sort(F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(name)) for name, p in patterns.items()))))


def last_lines(logs: DataFrame, text: str, n: Column) -> DataFrame:
    """The last n lines of each log as rows, in order (line_no from 0)."""
    df = logs.withColumn("_l", F.split(F.col(text), "\n")).withColumn("_k", F.size("_l"))
    df = df.withColumn("_from", F.greatest(F.lit(0), F.col("_k") - n)).select("*", F.posexplode("_l").alias("line_no", "line"))
    return df.filter(F.col("line_no") >= F.col("_from")).drop("_l", "_k", "_from")


def attempt_rollup(attempts: DataFrame, page: Cols, attempt: str = "attempt", kind: str = "kind", success: str = "success") -> DataFrame:
    """Per page: attempts, whether the last succeeded, and if it recovered from an earlier failure, by its kind."""
    before = Window.partitionBy(*page).orderBy(attempt).rowsBetween(Window.unboundedPreceding, -1)
    df = attempts.withColumn("_failed", F.coalesce(F.bool_or(~F.col(success)).over(before), F.lit(False)))
    last = df.groupBy(*page).agg(F.count(F.lit(1)).alias("n_attempts"), F.max_by(F.struct(F.col(kind).alias("kind"), F.col(success).alias("ok"), "_failed"), attempt).alias("_l"))
    again = F.col("_l.ok") & F.col("_l._failed")
    return last.select(
        *page, "n_attempts", F.col("_l.ok").alias("succeeded"), (again & (F.col("_l.kind") == "retry")).alias("recovered_on_retry"),
        (again & (F.col("_l.kind") == "raster")).alias("recovered_on_raster"), (again & (F.col("_l.kind") == "grid")).alias("recovered_on_grid"),
    )


def document_report(pages: DataFrame, document: Cols, page: str, status: str) -> DataFrame:
    """Per document and status the sorted pages."""
    return pages.groupBy(*document, status).agg(F.sort_array(F.collect_set(page)).alias("pages"))


def best_by(rows: DataFrame, part: Cols, value: str, order: list[Column], tie: str) -> DataFrame:
    """The value whose tuple is greatest; of equals, the first by tie."""
    w = Window.partitionBy(*part).orderBy(*(c.desc() for c in order), tie)
    return rows.withColumn("_b", F.row_number().over(w)).filter("_b = 1").select(*part, value, tie)


def cost_rollup(calls: DataFrame, part: Cols, order: str, tokens_in: str, tokens_out: str, rate_in: str, rate_out: str) -> DataFrame:
    """Tokens and the exact cost of a job at its first rates; the cost is null if any call lacks its usage or there are no rates."""
    known = F.col(tokens_in).isNotNull() & F.col(tokens_out).isNotNull()
    rate = lambda c: F.min_by(c, F.when(F.col(rate_in).isNotNull() & F.col(rate_out).isNotNull(), F.col(order)))
    df = calls.groupBy(*part).agg(
        F.sum(F.coalesce(tokens_in, F.lit(0))).cast("long").alias("tokens_in"), F.sum(F.coalesce(tokens_out, F.lit(0))).cast("long").alias("tokens_out"),
        F.count_if(~known).alias("_lacking"), rate(rate_in).alias("_ri"), rate(rate_out).alias("_ro"),
    )
    status = F.when(F.col("_lacking") > 0, "usage_missing").when(F.col("_ri").isNull(), "rate_unavailable").otherwise("complete")
    total = F.when(status == "complete", cost(F.col("tokens_in"), F.col("tokens_out"), F.col("_ri"), F.col("_ro")))
    return df.select(*part, "tokens_in", "tokens_out", total.cast("decimal(38,12)").alias("cost_usd"), status.alias("status"))
