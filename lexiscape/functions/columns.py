"""Column expressions shared by the operators. All stay in the JVM."""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """To unit length; the norm is bound once, not worked out for every element."""
    return F.get(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


# --- text -------------------------------------------------------------------------------------


def nfkc(w: Column) -> Column:
    """Compatibility composition, which no built-in function has; ASCII is left as it is."""

    @F.pandas_udf("string")
    def composed(column: pd.Series) -> pd.Series:
        return column.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return composed(w)


def keyword_compact(w: Column) -> Column:
    """Trimmed, lower-cased, without ASCII and ideographic spaces; nfkc comes before."""
    return F.translate(F.lower(F.trim(w)), " 　", "")


def keyword_ascii_lower(w: Column) -> Column:
    """Trimmed; lower-cased only if it is ASCII."""
    t = F.trim(w)
    return F.when(t.rlike(r"[^\x00-\x7F]"), t).otherwise(F.lower(t))


def bigrams(w: Column) -> Column:
    return F.array_distinct(F.when(F.char_length(w) > 1, F.transform(F.sequence(F.lit(1), F.char_length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))).otherwise(F.array().cast("array<string>")))


def similar(a: Column, b: Column) -> Column:
    """One holds the other, or their bigrams overlap by half of the smaller set."""
    x, y = bigrams(a), bigrams(b)
    least = F.least(F.size(x), F.size(y))
    return F.contains(a, b) | F.contains(b, a) | ((least > 0) & (F.size(F.array_intersect(x, y)) >= 0.5 * least))


def split_name(name: Column, separators: str = "・とのや ", longest: int = 7) -> Column:
    """A name of over `longest` characters is cut after the separator nearest to its middle (the first of equals)."""
    n = F.char_length(name)
    cuts = F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.instr(F.lit(separators), F.substring(name, i, F.lit(1))) > 0)
    best = F.array_min(F.transform(cuts, lambda i: F.struct(F.abs(i - n / 2).alias("d"), i.alias("i"))))["i"]
    return F.when((n <= longest) | best.isNull(), F.array(name)).otherwise(F.array(F.substring(name, F.lit(1), best), F.substring(name, best + 1, n)))


# --- geometry ---------------------------------------------------------------------------------


def sphere_xyz(theta: Column, phi: Column) -> list[Column]:
    return [(F.sin(theta) * F.cos(phi)).alias("x"), (F.sin(theta) * F.sin(phi)).alias("y"), F.cos(theta).alias("z")]


def torus_xyz(u: Column, v: Column, big: float = 3.0, small: float = 1.0) -> list[Column]:
    ring = F.lit(big) + small * F.cos(v)
    return [(ring * F.cos(u)).alias("x"), (ring * F.sin(u)).alias("y"), (small * F.sin(v)).alias("z")]


def torus_distance(a: list[Column], b: list[Column], size: float = 2 * math.pi) -> Column:
    """Euclidean distance where every axis is periodic."""
    each = [F.pmod(F.abs(x - y), F.lit(size)) for x, y in zip(a, b)]
    return F.sqrt(reduce(lambda p, q: p + q, [F.pow(F.least(d, size - d), F.lit(2)) for d in each]))


def inside(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges to the right."""
    hits = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, polygon[1:] + polygon[:1]):
        if y1 != y2:
            crosses = (F.lit(y1) > y) != (F.lit(y2) > y)
            hits = hits + F.when(crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return hits % 2 == 1


# --- colour -----------------------------------------------------------------------------------

# The published OKLab matrices.
_LMS = ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))
_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def linear_rgb(light: Column, a: Column, b: Column) -> list[Column]:
    lms = [F.pow(light + p * a + q * b, F.lit(3)) for p, q in _LMS]
    return [sum((k * x for k, x in zip(row, lms)), F.lit(0.0)) for row in _RGB]


def from_srgb(r: Column, g: Column, b: Column) -> list[Column]:
    """light, a, b of OKLab for sRGB channels from 0 to 1: the inverse of the matrices above, by Cramer's rule on the driver."""
    flat = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    lms = [F.signum(x) * F.pow(F.abs(x), F.lit(1 / 3)) for x in (sum((k * c for k, c in zip(row, flat)), F.lit(0.0)) for row in _inverse(_RGB))]
    mixed = _inverse(tuple((1.0, *row) for row in _LMS))
    return [sum((k * x for k, x in zip(row, lms)), F.lit(0.0)).alias(n) for row, n in zip(mixed, ("light", "a", "b"))]


def _inverse(m: tuple) -> list[list[float]]:
    minor = lambda i, j: [[m[p][q] for q in range(3) if q != j] for p in range(3) if p != i]
    cofactor = lambda i, j: (-1) ** (i + j) * (minor(i, j)[0][0] * minor(i, j)[1][1] - minor(i, j)[0][1] * minor(i, j)[1][0])
    det = sum(m[0][j] * cofactor(0, j) for j in range(3))
    return [[cofactor(j, i) / det for j in range(3)] for i in range(3)]


def srgb(linear: Column) -> Column:
    return F.when(linear <= 0.0031308, 12.92 * linear).otherwise(1.055 * F.pow(F.greatest(linear, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def in_gamut(light: Column, a: Column, b: Column, slack: float = 1e-6) -> Column:
    return reduce(lambda p, q: p & q, [(c >= -slack) & (c <= 1 + slack) for c in linear_rgb(light, a, b)])


def clamped_chroma(light: Column, chroma: Column, hue: Column, steps: int = 16) -> Column:
    """The largest chroma in gamut, by bisection."""
    start = F.struct(F.lit(0.0).alias("lo"), chroma.alias("hi"))

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        fits = in_gamut(light, mid * F.cos(hue), mid * F.sin(hue))
        return F.struct(F.when(fits, mid).otherwise(s["lo"]).alias("lo"), F.when(fits, s["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)["lo"]
    return F.when(in_gamut(light, chroma * F.cos(hue), chroma * F.sin(hue)), chroma).otherwise(found)


def rgb255(light: Column, a: Column, b: Column) -> list[Column]:
    return [F.rint(clip(srgb(c), 0.0, 1.0) * 255).cast("short") for c in linear_rgb(light, a, b)]


def hex_channel(code: Column, i: int) -> Column:
    return F.conv(F.substring(code, 2 + 2 * i, 2), 16, 10).cast("short")
