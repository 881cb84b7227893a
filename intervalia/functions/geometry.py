"""Coordinates and boxes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_page(x: Column, pixels: Column, page: Column, crop: Column | float = 0.0) -> Column:
    """A pixel place on a page of that many points, shifted by the crop's offset."""
    return x * page / pixels + crop


def to_pixels(x: Column, pixels: Column, page: Column, crop: Column | float = 0.0) -> Column:
    return (x - crop) * pixels / page


def clamp(x: Column, lo: Column, hi: Column) -> Column:
    return F.greatest(lo, F.least(hi, x))


def label_box(x: Column, y: Column, width: Column, height: Column, page_width: Column, page_height: Column, pad: float = 2.0) -> Column:
    """left, top, right, bottom of a label centred on x above y, kept on the page."""
    left = clamp(x - width / 2 - pad, F.lit(0.0), page_width - width - 2 * pad)
    top = clamp(y - height - 2 * pad, F.lit(0.0), page_height - height - 2 * pad)
    return F.struct(left.alias("left"), top.alias("top"), (left + width + 2 * pad).alias("right"), (top + height + 2 * pad).alias("bottom"))


def crop_band(top: Column, bottom: Column, prev_bottom: Column, next_top: Column, pad: Column, share: float = 0.75) -> Column:
    """top and bottom of a crop: the band and its padding, but no more than a share of the gap to each neighbour."""
    up = F.when(prev_bottom.isNotNull() & (prev_bottom < top), F.least(pad, share * (top - prev_bottom))).otherwise(pad)
    down = F.when(next_top.isNotNull() & (next_top > bottom), F.least(pad, share * (next_top - bottom))).otherwise(pad)
    return F.struct((top - up).alias("top"), (bottom + down).alias("bottom"))


def barline(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Middle, top and bottom of a bar-line: of its median segment, else of its bounds."""
    segment = F.struct(((x1 + x2) / 2).alias("x"), F.least(y1, y2).alias("top"), F.greatest(y1, y2).alias("bottom"))
    bounds = F.struct((x + w / 2).alias("x"), y.alias("top"), (y + h).alias("bottom"))
    whole = x1.isNotNull() & x2.isNotNull() & y1.isNotNull() & y2.isNotNull()
    return F.when(whole, segment).when(x.isNotNull() & w.isNotNull(), bounds)


def start_left(candidates: list[Column], limit: Column, pad: float = 6.0) -> Column:
    """The first of the candidates that there is, a pad to the left, never left of the limit."""
    return F.greatest(limit, F.coalesce(*candidates) - pad)
