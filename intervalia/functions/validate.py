"""Rules that accept a row or say why not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import valid_rect


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that holds (null counts as holding); null if none does."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(checks):
        out = F.when(F.coalesce(fails, F.lit(True)), name).otherwise(out)
    return out


def rising_inside(cuts: Column, left: Column, right: Column) -> Column:
    """Whether an array of numbers rises strictly between two others."""
    edges = F.concat(F.array(left), F.coalesce(cuts, F.array().cast("array<double>")), F.array(right))
    pairs = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: a < b)
    return F.forall(pairs, lambda x: F.coalesce(x, F.lit(False)))


def manual_row_reason(row_id: Column, page: Column, staff_kind: Column, left: Column, top: Column, right: Column, bottom: Column, cuts: Column) -> Column:
    return first_reason(
        ("missing_row_id", F.coalesce(F.trim(row_id), F.lit("")) == ""), ("invalid_page", ~(page > 0)), ("invalid_staff_kind", ~staff_kind.isin("single", "grand")),
        ("invalid_rect", ~valid_rect(left, top, right, bottom)), ("invalid_cuts", ~rising_inside(cuts, left, right)),
    )


def kept_boxes(boxes: Column, left: Column, right: Column, least_width: float = 2.0) -> Column:
    """Reading: boxes (measure_id, left, right) inside the row, in order; bad, narrow and overlapping ones go, the others stay."""
    fits = F.filter(boxes, lambda b: (b["left"] >= left) & (b["right"] <= right) & (b["right"] - b["left"] >= least_width) & b["measure_id"].isNotNull())
    ordered = F.array_sort(F.transform(fits, lambda b: F.struct(b["left"].alias("left"), b["right"].alias("right"), b["measure_id"].alias("measure_id"))))
    zero = F.filter(ordered, lambda b: F.lit(False))
    return F.aggregate(ordered, zero, lambda kept, b: F.when((F.size(kept) == 0) | (F.try_element_at(kept, F.lit(-1))["right"] <= b["left"]), F.concat(kept, F.array(b))).otherwise(kept))


def auto_row_reason(boxes: Column, left: Column, top: Column, right: Column, bottom: Column, least_width: float = 2.0) -> Column:
    """Editing: one bad box rejects the row."""
    ids = F.transform(boxes, lambda b: b["measure_id"])
    ordered = F.array_sort(F.transform(boxes, lambda b: F.struct(b["left"].alias("left"), b["right"].alias("right"))))
    apart = F.forall(F.zip_with(F.slice(ordered, F.lit(1), F.size(ordered) - 1), F.slice(ordered, F.lit(2), F.size(ordered) - 1), lambda a, b: a["right"] <= b["left"]), lambda x: x)
    return first_reason(
        ("invalid_rect", ~valid_rect(left, top, right, bottom)), ("missing_boxes", ~(F.size(boxes) > 0)),
        ("missing_measure_id", F.exists(ids, lambda i: F.coalesce(F.trim(i), F.lit("")) == "")), ("duplicate_measure_id", F.size(F.array_distinct(ids)) < F.size(ids)),
        ("box_outside_row", F.exists(boxes, lambda b: ~((b["left"] >= left) & (b["right"] <= right)))), ("box_too_narrow", F.exists(boxes, lambda b: ~(b["right"] - b["left"] >= least_width))),
        ("overlapping_boxes", (F.size(boxes) > 1) & ~apart),
    )


#: Codes and words of errors that may pass, and words of those that won't.
PASSING_CODES = (408, 429, 500, 502, 503, 504)
PASSING_WORDS = (
    "timed out", "timeout", "connection reset", "connection aborted", "connection refused", "temporarily unavailable",
    "service unavailable", "try again", "rate limit", "too many requests", "backend error", "internal error",
)
MODEL_PASSING_WORDS = ("throttlingexception", "serviceunavailableexception", "internalserverexception", "modeltimeoutexception", "timeout", "timed out", "connection")
MODEL_LASTING_WORDS = (
    "provider_not_configured", "malformed_provider_response", "invalidsignatureexception", "accessdeniedexception", "unauthorized",
    "validationexception", "on-demand throughput isn", "not authorized",
)
OVERLOADED_CODE, OVERLOADED_WORD = 529, "overloaded_error"


def _says(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(F.coalesce(text, F.lit(""))), w))


def retryable(status: Column, message: Column) -> Column:
    """Errors worth another try: by their code, or by what the message says."""
    return F.coalesce(status.isin(*PASSING_CODES), F.lit(False)) | _says(message, PASSING_WORDS)


def model_retryable(status: Column, detail: Column) -> Column:
    """The same for calls of a model: words of a lasting fault go before all else."""
    return ~_says(detail, MODEL_LASTING_WORDS) & (_says(detail, MODEL_PASSING_WORDS) | F.coalesce(status.isin(*PASSING_CODES), F.lit(False)))


def overloaded(status: Column, detail: Column) -> Column:
    return F.coalesce(status == OVERLOADED_CODE, F.lit(False)) | _says(detail, (OVERLOADED_WORD,))


def upload_reason(name: Column, mime: Column, size: Column, most_mb: int = 25) -> Column:
    pdf = F.lower(name).endswith(".pdf") | (F.lower(mime) == "application/pdf")
    return F.when(~F.coalesce(pdf, F.lit(False)), "not_a_pdf").when(~F.coalesce(size > 0, F.lit(False)), "empty_file").when(size > most_mb << 20, "file_too_large")


def is_uuid(x: Column) -> Column:
    return F.coalesce(F.lower(x).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def row_source(source: Column, manual_id: Column, system_id: Column, prefix: str = "manual_") -> Column:
    manual = (F.lower(F.trim(source)) == "manual") | (F.coalesce(F.trim(manual_id), F.lit("")) != "") | system_id.startswith(prefix)
    return F.when(F.coalesce(manual, F.lit(False)), "manual").otherwise("auto")


def transaction_reason(product: Column, products: tuple[str, ...], bundle: Column, expected_bundle: str, transaction_id: Column, environment: Column) -> Column:
    return first_reason(
        ("unknown_product", ~product.isin(*products)), ("wrong_bundle", bundle != expected_bundle), ("missing_transaction", F.coalesce(F.trim(transaction_id), F.lit("")) == ""),
        ("wrong_environment", ~environment.isin("Production", "Sandbox")),
    )


def run_state(status: Column, conclusion: Column) -> Column:
    """One word for an external run; a status that isn't known stands for itself."""
    s, c = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (status, conclusion))
    done = F.when(c == "success", "succeeded").when(c == "cancelled", "cancelled").otherwise("failed")
    return F.when(s == "completed", done).when(s.isin("queued", "requested", "waiting", "pending"), "queued").when(s.isin("in_progress", "running"), "running").when(s == "", "unknown").otherwise(s)


def failure_stage(structural: Column, omr: Column, mxl: Column, parts: Column, measures: Column, success: Column, reason: Column) -> Column:
    """How far a page's recognition came."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    return (
        F.when(yes(structural), "grid_structural_ok").when(~yes(omr), "omr_missing").when(~yes(mxl), "mxl_missing_after_omr_created")
        .when(~some(parts) | ~some(measures), "mxl_has_no_parts_or_measures").when(~yes(success), F.when(F.coalesce(reason, F.lit("")) == "", "unknown_failure").otherwise(reason)).otherwise("ok")
    )


def next_try(stage: Column, log_clues: Column, image_clues: Column) -> Column:
    """What to try next, by what is known of the image, then of the stage, then of the log (arrays of clues)."""
    has = lambda clues, *names: F.arrays_overlap(clues, F.array(*(F.lit(n) for n in names)))
    return (
        F.when(has(image_clues, "staff_lines_weak", "staff_lines_broken"), "medium_staff_line_repair").when(has(image_clues, "major_skew", "minor_skew"), "deskew_then_medium_raster")
        .when(has(image_clues, "dark_borders"), "crop_or_border_cleanup").when(stage.isin("mxl_missing_after_omr_created", "mxl_has_no_parts_or_measures"), "medium_raster_cleanup")
        .when(has(log_clues, "crash_or_exception", "timeout_or_killed"), "retry_or_split_page").otherwise("inspect_page_manually")
    )


#: Fixed value: what a log says where a grid helps.
GRID_LOG = "metronomeinter|textbuilder|texts step|transcription did not complete|could not export"


def wants_grid(omr_created: Column, log: Column) -> Column:
    return F.coalesce(omr_created, F.lit(False)) & F.coalesce(F.lower(log).rlike(GRID_LOG), F.lit(False))


def erase_area(page: Column, left: Column, top: Column, right: Column, bottom: Column, most_wide: float = 96.0, most_high: float = 48.0) -> Column:
    """Whether an area may be erased: on a page, with an inside, and small."""
    return F.coalesce(page > 0, F.lit(False)) & valid_rect(left, top, right, bottom) & (right - left <= most_wide) & (bottom - top <= most_high)
