"""Tolerant conversions, keys and small scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of true and false.
TRUE = ("1", "true", "yes", "y", "on")
FALSE = ("0", "false", "no", "n", "off")

#: How ids of manual systems and measures begin; attributes that say what a symbol is.
MANUAL_SYSTEM, MANUAL_MEASURE = "manual_sys_", "manual_measure_"
CLEF_ATTRIBUTES = ("shape", "type", "kind", "name", "family")


def to_int(x: Column, default: int | None = None) -> Column:
    """Whole numbers in text; anything else is the default."""
    return F.coalesce(F.trim(x.cast("string")).try_cast("int"), F.lit(default))


def to_bool(x: Column, default: bool | None = None) -> Column:
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*TRUE), True).when(t.isin(*FALSE), False).otherwise(F.lit(default))


def to_double(x: Column, default: float | None = None) -> Column:
    v = F.trim(x.cast("string")).try_cast("double")
    return F.coalesce(F.when(~F.isnan(v), v), F.lit(default))


def valid_rect(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    return F.coalesce((right > left) & (bottom > top), F.lit(False))


def from_vocabulary(x: Column, allowed: tuple[str, ...], default: str) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t.isin(*allowed), t).otherwise(F.lit(default))


def slug(x: Column) -> Column:
    """Letters, digits, dot, underscore and hyphen; runs of others become a hyphen, ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")


def stable_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def overlap_ratio(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Length in common over the shorter of two spans; 0 where one is empty."""
    short = F.least(hi_a - lo_a, hi_b - lo_b)
    return F.when(short > 0, F.greatest(F.lit(0.0), F.least(hi_a, hi_b) - F.greatest(lo_a, lo_b)) / short).otherwise(0.0)


def strongly_overlap(a: dict[str, Column], b: dict[str, Column], least: float = 0.5) -> Column:
    """Rectangles (left, right, top, bottom) that share at least so much of the shorter side, both ways."""
    return (overlap_ratio(a["left"], a["right"], b["left"], b["right"]) >= least) & (overlap_ratio(a["top"], a["bottom"], b["top"], b["bottom"]) >= least)


def nearest_rank(values: Column, p: float) -> Column:
    """The value at the half-even rounded rank p * (n - 1) of an array; no interpolation."""
    s = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    return F.get(s, F.bround((F.size(s) - 1) * F.lit(p)).cast("int"))


def first_words(text: Column, n: int) -> Column:
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.array_join(F.slice(w, 1, n), " ")


#: Words that say that nothing is known.
NOTHING = ("", "unknown", "none", "null", "n/a")


def bounded_words(text: Column, n: int, otherwise: str) -> Column:
    """The text in single spaces if it says something in at most n words."""
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    flat = F.array_join(w, " ")
    return F.when((F.size(w) <= n) & ~F.lower(flat).isin(*NOTHING), flat).otherwise(F.lit(otherwise))


def bounded_chars(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


#: Spellings of the two meters that have names.
COMMON_TIME = ("common_time", "common", "commonmeter", "c")
CUT_TIME = ("cut_time", "cut", "alla_breve", "cuttime")


def meter(x: Column) -> Column:
    """common_time, cut_time or n/m (one or two digits each); null for others. Spaces and hyphens count as underscores."""
    t = F.translate(F.lower(F.regexp_replace(x, r"^\s+|\s+$", "")), "- ", "__")
    plain = F.translate(t, "_", "")
    return F.when(t.isin(*COMMON_TIME), "common_time").when(t.isin(*CUT_TIME), "cut_time").when(plain.rlike("^[0-9]{1,2}/[0-9]{1,2}$"), plain)


def json_object(text: Column) -> Column:
    """The outermost object in a text that may be fenced or surrounded by prose."""
    bare = F.regexp_replace(text, r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    return F.regexp_extract(bare, r"(?s)(\{.*\})", 1)


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Exact price of a call, rates being per million tokens."""
    dec = lambda c: c.cast("decimal(20,6)")
    return ((dec(tokens_in) * dec(rate_in)).cast("decimal(30,6)") + (dec(tokens_out) * dec(rate_out)).cast("decimal(30,6)")) / F.lit(1_000_000).cast("decimal(7,0)")


def gs_parts(uri: Column) -> Column:
    """bucket and blob of a gs:// address; null if it is none."""
    t = F.trim(uri)
    whole = r"(?s)^gs://([^/]+)/(.+)$"
    return F.when(t.rlike(whole), F.struct(F.regexp_extract(t, whole, 1).alias("bucket"), F.regexp_extract(t, whole, 2).alias("blob")))


def job_id(uri: Column, most: int = 96) -> Column:
    """The slug of a gs:// address's file name without its last ending; empty for other addresses."""
    name = F.regexp_extract(gs_parts(uri)["blob"], r"([^/]*)/*$", 1)
    return F.coalesce(F.substring(slug(F.regexp_replace(name, r"\.[^.]*$", "")), 1, most), F.lit(""))


def manual_id(row_id: Column, place: Column | None = None) -> Column:
    """Id of a manual row's system or, with a place, of its measure there."""
    key = slug(F.trim(F.coalesce(row_id, F.lit(""))))
    key = F.when(key == "", "row").otherwise(key)
    if place is None:
        return F.concat(F.lit(MANUAL_SYSTEM), key)
    return F.concat(F.lit(MANUAL_MEASURE), key, F.lit("_m"), F.greatest(F.lit(0), place).cast("string"))


def fallback_confidence(bars: Column, increment: Column, carried: Column) -> Column:
    """How far a count by bar-lines is to be trusted."""
    low = (increment <= 0) | (increment > 8) | (bars - increment >= 2)
    return F.when(low, "low").when(carried, "medium").otherwise("high")


def sheet_tokens(name: Column, text: Column) -> Column:
    """sheet and n of a field that lists a sheet's systems; null for other fields."""
    sheet = F.regexp_extract(F.trim(name), r"^source-sheet-(\d+)$", 1).try_cast("int")
    n = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != ""))
    return F.when(sheet.isNotNull(), F.struct(sheet.alias("sheet"), n.alias("n")))


def looks_like_clef(tag: Column, attributes: Column) -> Column:
    """Whether a symbol's tag or one of the attributes that say what it is names a clef."""
    says = [F.coalesce(F.lower(F.try_element_at(attributes, F.lit(a))).contains("clef"), F.lit(False)) for a in CLEF_ATTRIBUTES]
    out = F.coalesce(F.lower(tag).endswith("clef"), F.lit(False))
    for x in says:
        out = out | x
    return out
