"""Scalar expressions: safe division, the index catalogue, cleaning, geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where |b| <= EPS or either is missing."""
    return F.when(F.abs(b) > EPS, a / b)


def missing(v: Column, nodata: float | None = None) -> Column:
    """NaN, infinities and the NoData value as null."""
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return F.when(ok & (v != nodata) if nodata is not None else ok, v)


def indices(b: Column, g: Column, r: Column, re1: Column, re2: Column, nir: Column) -> dict[str, Column]:
    """The named spectral indices from six bands."""
    d = safe_divide
    return {
        "NDVI": d(nir - r, nir + r), "GNDVI": d(nir - g, nir + g), "NDRE1": d(nir - re1, nir + re1), "NDRE2": d(nir - re2, nir + re2),
        "RENDVI1": d(re1 - r, re1 + r), "RENDVI2": d(re2 - r, re2 + r), "RVI": d(nir, r), "DVI": nir - r,
        "SAVI": d(1.5 * (nir - r), nir + r + 0.5), "EVI": d(2.5 * (nir - r), nir + 6 * r - 7.5 * b + 1), "CI_RE1": d(nir, re1) - 1, "CI_RE2": d(nir, re2) - 1,
    }


def parse_number(raw: Column) -> Column:
    """Text as a number: blanks, per cent signs and thousands commas go; what isn't a plain decimal is null."""
    t = F.regexp_replace(F.trim(raw), "[%,，\\s]", "")
    return F.when(t.rlike(r"^[+-]?(?=\.?\d)\d*\.?\d*([eE][+-]?\d+)?$"), t.try_cast("double"))


def lens_area(d: Column, r: Column) -> Column:
    """Area that two circles of radius r share at distance d."""
    lens = 2 * r * r * F.acos(F.least(d / (2 * r), F.lit(1.0))) - 0.5 * d * F.sqrt(F.greatest(4 * r * r - d * d, F.lit(0.0)))
    return F.when((r <= 0) | (d >= 2 * r), 0.0).when(d <= 0, F.pi() * r * r).otherwise(lens)


def dms(degrees: Column, digits: int, positive: str, negative: str) -> Column:
    """Degrees, minutes and seconds with a hemisphere letter; carries are made in units of the last digit."""
    unit = 10**digits
    total = F.bround(F.abs(degrees) * 3600 * unit).cast("long")
    whole, rest = F.floor(total / (3600 * unit)), total % (3600 * unit)
    return F.format_string(f"%d°%02d′%0{3 + digits}.{digits}f″%s", whole, F.floor(rest / (60 * unit)), (rest % (60 * unit)) / unit, F.when(degrees < 0, negative).otherwise(positive))


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are there; null under 3 rows or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when((F.count(a) >= 3) & (spread > 1e-12), F.covar_pop(a, b) / F.when(spread > 1e-12, spread))
