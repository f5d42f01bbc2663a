"""Rectangles, rotations and sizes, as column expressions over whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quarter turns clockwise of each rotation name.
STEPS = {"none": 0, "cw90": 1, "rot180": 2, "ccw90": 3}


def steps(rotation: Column) -> Column:
    return F.when(rotation == "cw90", 1).when(rotation == "rot180", 2).when(rotation == "ccw90", 3).otherwise(0)


def rotation_of(step: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STEPS)), (F.pmod(step, F.lit(4)) + 1).cast("int"))


def combine(a: Column, b: Column) -> Column:
    """The rotation that two rotations make together."""
    return rotation_of(steps(a) + steps(b))


def info_rotation(flags: Column) -> Column:
    """Rotation of a page header's flag byte."""
    low = flags.cast("int").bitwiseAND(7)
    return F.when(low == 5, "cw90").when(low == 2, "rot180").when(low == 6, "ccw90").otherwise("none")


def rotate_rect(x: Column, y: Column, w: Column, h: Column, page_w: Column, page_h: Column, step: Column) -> Column:
    """struct<x, y, w, h> of a rectangle on the turned page; differences below 0 are 0."""
    right, below = F.greatest(page_w - x - w, F.lit(0)), F.greatest(page_h - y - h, F.lit(0))
    nx = F.when(step == 1, below).when(step == 2, right).when(step == 3, y).otherwise(x)
    ny = F.when(step == 1, x).when(step == 2, below).when(step == 3, right).otherwise(y)
    odd = step.isin(1, 3)
    return F.struct(nx.alias("x"), ny.alias("y"), F.when(odd, h).otherwise(w).alias("w"), F.when(odd, w).otherwise(h).alias("h"))


def whole(a: Column, b: Column) -> Column:
    """a div b of whole numbers (a >= 0), null for b = 0."""
    a, b = a.cast("long"), b.cast("long")
    return F.when(b != 0, (a - F.pmod(a, b)) / b).cast("long")


def scale_rect(rect: Column, from_w: Column, from_h: Column, to_w: Column, to_h: Column) -> Column:
    """Truncating scale of a struct<x, y, w, h>; unchanged if the old size is 0."""
    still = (from_w == 0) | (from_h == 0)

    def axis(v: Column, a: Column, b: Column) -> Column:
        return F.when(still, v.cast("long")).otherwise(whole(v.cast("long") * b, a))

    return F.struct(axis(rect["x"], from_w, to_w).alias("x"), axis(rect["y"], from_h, to_h).alias("y"), axis(rect["w"], from_w, to_w).alias("w"), axis(rect["h"], from_h, to_h).alias("h"))


def flip_y(y: Column, h: Column, page_h: Column) -> Column:
    """Top-left y of a rectangle given by its bottom-left corner."""
    return F.greatest(page_h - (y + h), F.lit(0))


def display_size(w: Column, h: Column, rotation: Column) -> Column:
    odd = rotation.isin("cw90", "ccw90")
    return F.struct(F.when(odd, h).otherwise(w).alias("w"), F.when(odd, w).otherwise(h).alias("h"))


def at_dpi(size: Column, dpi: Column, native: Column) -> Column:
    return F.greatest(F.lit(1), F.round(size * dpi / native)).cast("int")


def fit_to_width(w: Column, h: Column, to: Column) -> Column:
    return F.struct(to.cast("int").alias("w"), F.greatest(F.lit(1), F.round(h * to / w)).cast("int").alias("h"))


def fit_to_height(w: Column, h: Column, to: Column) -> Column:
    return F.struct(F.greatest(F.lit(1), F.round(w * to / h)).cast("int").alias("w"), to.cast("int").alias("h"))


def fit_to_box(w: Column, h: Column, box_w: Column, box_h: Column) -> Column:
    s = F.least(box_w / w, box_h / h)
    return F.struct(F.greatest(F.lit(1), F.round(w * s)).cast("int").alias("w"), F.greatest(F.lit(1), F.round(h * s)).cast("int").alias("h"))


def px_to_pt(v: Column, dpi: Column) -> Column:
    return v * 72.0 / dpi


def percent_box(rect: Column, page_w: Column, page_h: Column) -> Column:
    """left, top, width, height of a rectangle in percent of the page, to 4 places."""
    p = lambda v, of: F.round(v * 100.0 / of, 4)
    return F.struct(p(rect["x"], page_w).alias("left"), p(rect["y"], page_h).alias("top"), p(rect["w"], page_w).alias("width"), p(rect["h"], page_h).alias("height"))


def polygon_box(xs: Column, ys: Column) -> Column:
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def points_box(x: Column, y: Column) -> Column:
    """Box of a group of points, as an aggregate."""
    return F.struct(F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x) - F.min(x)).alias("w"), (F.max(y) - F.min(y)).alias("h"))
