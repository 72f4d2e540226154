"""Column functions: keys, zones, similarity of strings, coordinates, formats."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

#: Earth radii: metres for neighbour search, kilometres for draw weights.
RADIUS_M, RADIUS_KM = 6_371_008.8, 6371.0


def padded_code(x: Column, width: int) -> Column:
    """A numeric code as text with leading zeros; longer codes are not cut; null stays null."""
    text = x.cast("bigint").cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def stripped_zone(zone: Column) -> Column:
    """Zones that begin with A lose the digits at their end."""
    return F.when(zone.startswith("A"), F.regexp_replace(zone, "[0-9]+$", "")).otherwise(zone)


def canonical_zone(zone: Column) -> Column:
    """Upper case, A zones without digits, B as X; null stays null and never matches."""
    up = F.upper(zone)
    return F.when(up == "B", F.lit("X")).otherwise(stripped_zone(up))


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def first_positive(net: list[Column], gross: list[Column]) -> Column:
    """The sum of the first list if positive, else that of the second; null parts count as 0."""

    def total(parts: list[Column]) -> Column:
        out = F.lit(0.0)
        for p in parts:
            out = out + F.coalesce(p.cast("double"), F.lit(0.0))
        return out

    return F.when(total(net) > 0, total(net)).otherwise(total(gross))


def year_of(text: Column) -> Column:
    """The year of a date in text; null if it is none."""
    return F.year(F.try_to_timestamp(text))


def finite(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in lower case; 1 if both are empty, 0 if one is."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longest)


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = list(b)
    left, places = [], []
    for i, c in enumerate(a):
        lo, hi = max(0, i - reach), min(len(b), i + reach + 1)
        at = next((j for j in range(lo, hi) if free[j] == c), None)
        if at is not None:
            free[at] = ""
            left.append(c)
            places.append(at)
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(x != b[j] for x, j in zip(left, sorted(places), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler_similarity(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """In lower case, prefix weight 0.1 of up to 4 letters, whatever the base similarity. Nothing built in has this rule."""
    for a, b in parts:
        yield pd.Series([None if x is None or y is None else _jaro_winkler(x.lower(), y.lower()) for x, y in zip(a, b, strict=True)], dtype="float64")


def contains_similarity(a: Column, b: Column) -> Column:
    return F.contains(F.lower(b), F.lower(a)).cast("double")


def similarity(a: Column, b: Column, method: str) -> Column:
    """By name; an unknown name means equality."""
    found = {"levenshtein": levenshtein_similarity, "jaro_winkler": jaro_winkler_similarity, "contains": contains_similarity}.get(method)
    return found(a, b) if found else (a == b).cast("double")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_M) -> Column:
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(((lon + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600 + utm_zone(lon)).otherwise(32700 + utm_zone(lon)).cast("int")


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Spherical Mercator metres (EPSG 3857)."""
    r = 6378137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of spherical Mercator metres."""
    r = 6378137.0
    return F.degrees(2 * F.atan(F.exp(y / r)) - F.lit(math.pi / 2)), F.degrees(x / r)


# The ellipsoid of WGS 84, the scale and false origins of UTM.
MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N = FLATTENING / (2 - FLATTENING)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
_RADIUS = MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Coefficients of the series in the third flattening, to its fourth power.
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_BACKWARD = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _series(a: Column, b: Column, terms: tuple[float, ...], sign: int) -> tuple[Column, Column]:
    """a and b and a sum over even multiples of them, along and across the meridian."""
    x, y = a, b
    for j, c in enumerate(terms, 1):
        x = x + sign * c * F.sin(2 * j * a) * F.cosh(2 * j * b)
        y = y + sign * c * F.cos(2 * j * a) * F.sinh(2 * j * b)
    return x, y


def to_utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """Easting and northing in metres, in the zone of the longitude or a given one; good to a fraction of a millimetre."""
    away = F.radians(lon - ((utm_zone(lon) if zone is None else zone) * 6 - 183))
    t = F.sin(F.radians(lat))
    conformal = F.sinh(F.atanh(t) - _E * F.atanh(_E * t))
    x, y = _series(F.atan2(conformal, F.cos(away)), F.asinh(F.sin(away) / F.sqrt(conformal * conformal + F.cos(away) * F.cos(away))), _FORWARD, 1)
    return FALSE_EAST + SCALE * _RADIUS * y, SCALE * _RADIUS * x + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a point in a zone; ``south``: is it of the southern grid?"""
    x, y = (north - F.when(south, FALSE_NORTH).otherwise(0.0)) / (SCALE * _RADIUS), (east - FALSE_EAST) / (SCALE * _RADIUS)
    x, y = _series(x, y, _BACKWARD, -1)
    conformal = F.asin(F.sin(x) / F.cosh(y))
    lat = conformal
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * conformal)
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + zone * 6 - 183


def zip_digit_group(code: Column, distinct_groups: Column | None = None, groups: int | None = None) -> Column:
    """Half of the fourth digit of the padded code; modulo groups only where there would be more."""
    base = F.floor(F.substring(padded_code(code, 5), 4, 1).cast("int") / 2).cast("int")
    return base if groups is None or distinct_groups is None else F.when(distinct_groups > groups, base % groups).otherwise(base)


def hex_row_column(x: Column, y: Column, width: float) -> tuple[Column, Column]:
    """Row and column of the nearest centre of a grid of pointy-top hexagons; odd rows lie half a width to the right."""
    height = width * 2 / math.sqrt(3)
    step = height * 0.75

    def near(row: Column) -> tuple[Column, Column, Column]:
        shift = F.pmod(row, F.lit(2)) * (width / 2)
        col = F.round((x - shift) / width)
        away = F.pow(x - shift - col * width, 2) + F.pow(y - row * step, 2)
        return row, col, away

    lo, hi = near(F.floor(y / step)), near(F.floor(y / step) + 1)
    pick = lo[2] <= hi[2]
    return F.when(pick, lo[0]).otherwise(hi[0]).cast("bigint"), F.when(pick, lo[1]).otherwise(hi[1]).cast("bigint")


def significance_stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def fixed(x: Column, digits: int) -> Column:
    return F.regexp_replace(F.format_number(x.cast("double"), digits), ",", "")


def format_p(p: Column) -> Column:
    return F.when(p < 0.001, "<0.001").otherwise(fixed(p, 3))


def format_interval(lo: Column, hi: Column, digits: int = 3) -> Column:
    return F.concat(F.lit("["), fixed(lo, digits), F.lit(", "), fixed(hi, digits), F.lit("]"))


def format_coefficient(x: Column, se: Column | None = None, p: Column | None = None, digits: int = 3) -> Column:
    out = fixed(x, digits) if p is None else F.concat(fixed(x, digits), significance_stars(p))
    return out if se is None else F.concat(out, F.lit(" ("), fixed(se, digits), F.lit(")"))


def format_f(f: Column, df1: Column, df2: Column, p: Column | None = None) -> Column:
    head = F.concat(F.lit("F("), df1.cast("string"), F.lit(", "), df2.cast("string"), F.lit(") = "), fixed(f, 2))
    return head if p is None else F.concat(head, F.lit(", p = "), format_p(p))


def format_count(n: Column, label: str = "N") -> Column:
    return F.concat(F.lit(f"{label} = "), F.format_number(n, 0))


def format_percent(x: Column, digits: int = 1, detect_scale: bool = True) -> Column:
    scaled = F.when(F.abs(x) <= 1, x * 100).otherwise(x) if detect_scale else x * 100
    return F.concat(fixed(scaled, digits), F.lit("%"))


def format_difference(x: Column, digits: int = 3) -> Column:
    return F.concat(F.when(x > 0, "+").otherwise(""), fixed(x, digits))


def row_hash(*columns: str | Column) -> Column:
    return F.xxhash64(*columns)
