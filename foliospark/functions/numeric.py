"""Colour, gamma, index and cost arithmetic, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright((306 * r + 601 * g + 117 * b).cast("int"), 10)


def normalize(v: Column) -> Column:
    """A coefficient as a sample: 6 fractional bits rounded off, within a signed byte."""
    return clamp(F.shiftright((v + 32).cast("int"), 6), -128, 127)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    t1 = cr + F.shiftright(cr, 1)
    t2 = y + 128 - F.shiftright(cb, 2)
    return F.struct(clamp(y + 128 + t1, 0, 255).alias("r"), clamp(t2 - F.shiftright(t1, 1), 0, 255).alias("g"), clamp(t2 + F.shiftleft(cb, 1), 0, 255).alias("b"))


def gamma_lut(gamma: Column) -> Column:
    """256 corrected levels; the identity if gamma is not positive or close to 2.2."""
    power = gamma / 2.2
    same = gamma.isNull() | (gamma <= 0) | (F.abs(power - 1.0) < 1e-4)
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.when(same, i).otherwise(clamp(F.floor(255.0 * F.pow(i / 255.0, power) + 0.5).cast("int"), 0, 255)))


def zigzag_row(i: Column) -> Column:
    """Row of a coefficient: the odd bits of its index, highest last."""
    bit = lambda k: F.shiftright(i, k).bitwiseAND(1)
    return sum((bit(2 * k + 1) * (1 << (4 - k)) for k in range(1, 5)), bit(1) * 16)


def zigzag_col(i: Column) -> Column:
    bit = lambda k: F.shiftright(i, k).bitwiseAND(1)
    return sum((bit(2 * k) * (1 << (4 - k)) for k in range(1, 5)), bit(0) * 16)


def best_subsample(scale: Column) -> Column:
    """The largest of 1, 2, 4, 8 that is at most 1.5 / scale; 1 for scales that are not between 0 and 1."""
    k = F.floor(1.5 / scale)
    return F.when(scale.isNull() | (scale <= 0) | (scale >= 1), 1).when(k >= 8, 8).when(k >= 4, 4).when(k >= 2, 2).otherwise(1)


def plane_step_q24(plane: Column, out: Column) -> Column:
    """Plane samples per output pixel with 24 fractional bits."""
    return F.when(out > 0, F.floor(F.shiftleft(plane.cast("long"), 24) / out).cast("long"))


def packed_bytes(pixels: Column) -> Column:
    return F.floor((pixels + 7) / 8).cast("long")


def index_bytes(count: Column) -> Column:
    """Bytes to name one of ``count`` symbols."""
    return F.ceil(F.length(F.bin(F.greatest(count, F.lit(1)))) / 8).cast("long")


def symbol_bytes(w: Column, h: Column) -> Column:
    """About what a symbol takes in full: rows of whole bytes and a head of 3."""
    return (F.floor((w + 7) / 8) * h + 3).cast("long")


def refined_bytes(distance: Column, count: Column) -> Column:
    """About what a symbol takes as a change of one of ``count`` others of another size: a head of 5, the number, the pixels."""
    return 5 + index_bytes(count) + packed_bytes(distance)


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Column:
    """Levels of the wavelet planes of a colour, as the coder takes them: a luma of weights 1, 2, 1 and differences to green."""
    y = F.shiftright(r + F.shiftleft(g, 1) + b, 2) - 128
    return F.struct(clamp(y, -128, 127).alias("y"), clamp(b - g, -256, 255).alias("cb"), clamp(r - g, -256, 255).alias("cr"))


def parse_hex_color(c: Column) -> Column:
    """struct<r, g, b> of ``#rrggbb`` (the # may lack), else null."""
    body = F.regexp_replace(c, "^#", "")
    part = lambda i: F.conv(F.substring(body, i, 2), 16, 10).cast("int")
    return F.when(body.rlike("^[0-9A-Fa-f]{6}$"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def uint_be(data: Column, at: int, size: int) -> Column:
    """An unsigned big-endian number in a binary column, ``at`` counted from 0."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def page_info(data: Column) -> Column:
    """Fields of a 10-byte page header, with an error instead of an exception if it is short."""
    low, high = uint_be(data, 6, 1), uint_be(data, 7, 1)
    gamma = uint_be(data, 8, 1)
    return F.when(
        F.octet_length(data) >= 10,
        F.struct(
            uint_be(data, 0, 2).cast("int").alias("width"), uint_be(data, 2, 2).cast("int").alias("height"),
            uint_be(data, 4, 1).cast("int").alias("minor"), (low + 256 * high).cast("int").alias("dpi"),
            F.when(gamma == 0, F.lit(2.2)).otherwise(gamma / 10.0).cast("float").alias("gamma"),
            uint_be(data, 9, 1).cast("int").alias("flags"), F.lit(None).cast("string").alias("error"),
        ),
    ).otherwise(F.struct(*[F.lit(None).cast(t).alias(n) for n, t in (("width", "int"), ("height", "int"), ("minor", "int"), ("dpi", "int"), ("gamma", "float"), ("flags", "int"))], F.lit("truncated").alias("error")))
