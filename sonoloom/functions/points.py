"""Column functions on points and lines given by coordinate columns or arrays of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Tolerances of point comparison, paste and selection, in their units.
SAME_POINT, SAME_LINE_SQUARED, PICK_SQUARED = 1e-6, 1e-3, 4.0


def ras_lps(points: Column, given: Column, wanted: str) -> Column:
    """Points in the ``wanted`` space: x and y change sign if the tag (missing: RAS) says another one."""
    turned = F.transform(points, lambda p: F.array(-p[0], -p[1], p[2]))
    return F.when(F.coalesce(given, F.lit("RAS")) == wanted, points).otherwise(turned)


def round_exact(value: Column, digits: int = 2) -> Column:
    """A double rounded to ``digits`` (at most 6) decimals by its exact binary value, halves to even: 0.125 is a tie, 0.135 lies above one.

    The product with the power of ten is taken with its rounding error, by splitting the value into two halves of
    its bits, so the comparison with one half is exact. Numbers from 10^9 on, nulls and what is no number stay as they are.
    """
    v, scale = value.cast("double"), float(10**digits)
    big = v * 134217729.0
    high = big - (big - v)
    product = v * scale
    error = (high * scale - product) + (v - high) * scale
    whole = F.floor(product).cast("double")
    beyond = (product - whole - 0.5) + error
    odd = F.pmod(whole, F.lit(2.0))
    return F.when(F.abs(v) < 1e9, (whole + F.when(beyond > 0, 1.0).when(beyond < 0, 0.0).otherwise(odd)) / scale).otherwise(v)


def angle_degrees(dx: Column, dy: Column, y_down: bool = True) -> Column:
    """Direction in 0..360 degrees, two decimals; 0 for no distance."""
    raw = F.degrees(F.atan2(-dy if y_down else dy, dx))
    turned = F.when(raw < 0, raw + 360).otherwise(raw)
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(round_exact(turned))


def sector_corners(x1: Column, y1: Column, x2: Column, y2: Column, cx: float, cy: float, r1: float, r2: float) -> Column:
    """struct of ul, ll, ur, lr (x, y): where the rays from a centre through two points meet the inner and the outer circle."""
    at = lambda x, y, r: F.struct((cx + r * (x - cx) / F.hypot(x - cx, y - cy)).alias("x"), (cy + r * (y - cy) / F.hypot(x - cx, y - cy)).alias("y"))
    return F.struct(at(x1, y1, r1).alias("ul"), at(x1, y1, r2).alias("ll"), at(x2, y2, r1).alias("ur"), at(x2, y2, r2).alias("lr"))


def segment_distance_squared(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment, by clamped projection."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / F.when(length != 0, length))))
    return F.pow(px - x1 - t * dx, F.lit(2)) + F.pow(py - y1 - t * dy, F.lit(2))


def line_coefficients(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column, Column]:
    """A, B, C with Ax + By = C through two points."""
    a, b = y2 - y1, x1 - x2
    return a, b, a * x1 + b * y1


def intersection(one: tuple[Column, ...], two: tuple[Column, ...]) -> tuple[Column, Column]:
    """Where two lines meet; null for parallel ones."""
    (a1, b1, c1), (a2, b2, c2) = one, two
    det = a1 * b2 - a2 * b1
    safe = F.when(F.abs(det) > 1e-12, det)
    return (b2 * c1 - b1 * c2) / safe, (a1 * c2 - a2 * c1) / safe


def move(m: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A point under a row-major 4x4 matrix."""
    return tuple(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3] for r in range(3))


def apply_affine(m: Column, x: Column, y: Column, z: Column) -> Column:
    """Rounded integer pixel of a point under a row-major 4x4 matrix."""
    row = lambda r: F.bround(m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3]).cast("int")
    return F.array(row(0), row(1), row(2))


def hsv_to_rgb(h: Column, s: float, v: float) -> Column:
    """array(r, g, b) in 0..1 of a hue in 0..1."""
    channel = lambda n: v - v * s * F.greatest(F.lit(0.0), F.least(F.pmod(n + h * 6, F.lit(6.0)), 4 - F.pmod(n + h * 6, F.lit(6.0)), F.lit(1.0)))
    return F.array(channel(F.lit(5.0)), channel(F.lit(3.0)), channel(F.lit(1.0)))


#: Hues that pleura lines and B-lines start from, their saturation, and the colours of no rater.
PLEURA_HUE, B_HUE, SATURATION = 0.66, 0.33, 0.95
NO_RATER = ((1.0, 0.0, 0.0), (1.0, 0.5, 0.0))


def rater_colors(rater: Column, rank: Column) -> tuple[Column, Column]:
    """(pleura, B-line) colours as array(r, g, b): golden-ratio steps around the colour circle by the rater's rank; fixed ones for none."""
    step = (math.sqrt(5) - 1) / 2
    known = F.trim(F.coalesce(rater, F.lit(""))) != ""
    hue = lambda start: F.pmod(F.lit(start) + rank * step, F.lit(1.0))
    return tuple(F.when(known, hsv_to_rgb(hue(start), SATURATION, 1.0)).otherwise(F.array(*map(F.lit, plain))) for start, plain in zip((PLEURA_HUE, B_HUE), NO_RATER))
