"""Scalar functions on sizes, turns and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quarter_turns(degrees: Column) -> Column:
    """Counter-clockwise quarter turns, 0 to 3."""
    return F.pmod(F.rint(degrees / 90.0), F.lit(4.0)).cast("int")


def rotated(rotation: Column, degrees: Column) -> Column:
    """A page's rotation after another turn, 0 to 359."""
    return F.pmod(rotation + degrees, F.lit(360))


#: Longer side, in points, of pages that all have one size: 297 mm. Fixed value.
LONG_SIDE = 297 / 25.4 * 72


def uniform_page(aspect: Column) -> Column:
    """(w, h) in points of a page of an aspect whose longer side is ``LONG_SIDE``."""
    tall = aspect <= 1
    return F.struct(F.when(tall, F.lit(LONG_SIDE) * aspect).otherwise(F.lit(LONG_SIDE)).alias("w"), F.when(tall, F.lit(LONG_SIDE)).otherwise(F.lit(LONG_SIDE) / aspect).alias("h"))


#: (w, h) in points of pages of a fixed size, and the aspect where there are no pages. Fixed values.
PAGE_SIZES = {"a4": (210 / 25.4 * 72, 297 / 25.4 * 72), "letter": (8.5 * 72, 11.0 * 72)}
A4_ASPECT = 210 / 297


def page_size(mode: Column, aspect: Column) -> Column:
    """(w, h) in points by mode: ``uniform`` by the aspect (A4's where it is null or 0), ``a4``, ``letter``; null for ``fit`` and anything else."""
    size = F.when(mode == "uniform", uniform_page(F.coalesce(F.nullif(aspect, F.lit(0.0)), F.lit(A4_ASPECT))))
    for name, (w, h) in PAGE_SIZES.items():
        size = size.when(mode == name, F.struct(F.lit(w).alias("w"), F.lit(h).alias("h")))
    return size


def padded(width: Column, height: Column, aspect: Column) -> Column:
    """(w, h, left, top): the smallest size of an aspect that holds a picture unscaled, and where the picture begins in it."""
    wide = width / height < aspect
    w = F.when(wide, F.rint(height * aspect).cast("int")).otherwise(width)
    h = F.when(wide, height).otherwise(F.rint(width / aspect).cast("int"))
    half = lambda a, b: F.floor((a - b) / 2).cast("int")
    return F.struct(w.alias("w"), h.alias("h"), half(w, width).alias("left"), half(h, height).alias("top"))


def fitted(width: Column, height: Column, page: Column, dpi: float) -> Column:
    """(w, h) of a picture scaled down to at most ``dpi`` on a page (w, h) in points, never up; as it is where the page is null."""
    scale = F.least(F.lit(1.0), page["w"] / 72 * dpi / width, page["h"] / 72 * dpi / height)
    side = lambda x: F.when(page.isNull() | (scale >= 1), x).otherwise(F.greatest(F.lit(1), F.floor(x * scale).cast("int")))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def analysis_size(width: Column, height: Column, target: int) -> Column:
    """(w, h) scaled down to the target width, at least 8 pixels each, never up."""
    scale = F.least(F.lit(1.0), F.lit(float(target)) / F.greatest(width, F.lit(1)))
    side = lambda x: F.greatest(F.lit(8), F.rint(x * scale).cast("int"))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def quality(width: Column, height: Column) -> Column:
    """The shorter side of a frame; its height if the width is unknown; null without either."""
    w, h = F.nullif(width, F.lit(0)), F.nullif(height, F.lit(0))
    return F.when(w.isNotNull() & h.isNotNull(), F.least(w, h)).otherwise(h)


def clock(seconds: Column) -> Column:
    """Seconds as mm:ss.s, never below zero; ties of ten times the seconds go to the even digit."""
    t = F.greatest(seconds, F.lit(0.0))
    return F.format_string("%02d:%04.1f", F.floor(t / 60).cast("int"), F.rint((t - F.floor(t / 60) * 60) * 10) / 10)


def fill_fraction(a: Column, b: Column) -> Column:
    """Share of a page left empty when one aspect is fitted into another."""
    return F.lit(1.0) - F.least(a, b) / F.greatest(a, b)
