"""Cleaning of published values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catchwork.constants import DEFAULT_N, MATERIAL_N, SHAPES, lookup


def number(value: Column, zero_missing: bool = False) -> Column:
    """A published number or numeric text as a double; blank or other text is null, and 0 too where the source uses it for missing."""
    out = F.trim(value.cast("string")).try_cast("double")
    return F.nullif(out, F.lit(0.0)) if zero_missing else out


def without_sentinel(value: Column, policy: Column) -> Column:
    """value under a policy: `zero` (0 is missing), `none` (all real) or `below:<floor>` (only values above the floor are real)."""
    floor = F.when(policy.startswith("below:"), F.substring(policy, 7, 20)).try_cast("double")
    return F.when(policy == "zero", F.nullif(value, F.lit(0.0))).when(floor.isNotNull(), F.when(value > floor, value)).otherwise(value)


def banded(value: Column, low: float, high: float) -> Column:
    """value inside a plausible band, else null."""
    return F.when(value.between(low, high), value)


def below_rim(invert: Column, rim: Column) -> Column:
    """An invert, unless it lies above its own rim; without a rim it stays."""
    return F.when(rim.isNull() | (invert <= rim), invert)


def diameter_m(text: Column, unit: str = "mm") -> Column:
    """The first number in a text such as `300 mm`, in metres; no positive number gives null."""
    size = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(size > 0, size / {"mm": 1000.0, "cm": 100.0, "m": 1.0}[unit])


def roughness(material: Column, default: float = DEFAULT_N) -> Column:
    """Manning's n of a material code in any case, else the default."""
    return lookup(MATERIAL_N, F.upper(F.trim(material)), default)


def material_code(text: Column) -> Column:
    """A short code for a spelled-out material: aliases first, then leading words, then the part after a dash."""
    t = F.upper(F.trim(text))
    return (
        F.when(t.contains("REINFORCED CONCRETE"), "RC").when(t.startswith("CONC"), "CONC").when(t.startswith("POLYVINYL") | (t == "P.V.C."), "PVC")
        .when(t.startswith("CORRUGATED"), "CSP").when(t.contains("CLAY"), "VC").when(t.contains("-"), F.substring_index(t, "-", -1)).otherwise(t)
    )


def section_shape(raw: Column, height: Column, width: Column) -> Column:
    """Struct (shape, height_m, width_m): a section other than a circle needs both dimensions, else it is a circle without them."""
    kind = lookup(SHAPES, F.upper(F.trim(F.coalesce(raw.cast("string"), F.lit("")))))
    shaped = F.coalesce((kind != "CIRCULAR") & (height > 0) & (width > 0), F.lit(False))
    return F.struct(F.when(shaped, kind).otherwise("CIRCULAR").alias("shape"), F.when(shaped, height).alias("height_m"), F.when(shaped, width).alias("width_m"))


def safe_name(raw: Column) -> Column:
    """A published id without the characters that object names can't hold."""
    return F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[^A-Za-z0-9._-]+", "")


def underscored(raw: Column) -> Column:
    """A published id with white space as underscores."""
    return F.regexp_replace(F.trim(raw), r"\s+", "_")


def system_of(content: Column) -> Column:
    """storm_minor, combined or sanitary by what a pipe carries; null for other words."""
    c = F.lower(F.trim(content))
    return F.when(c.contains("combined"), "combined").when(c.contains("sanitary") | c.contains("waste") | c.contains("foul"), "sanitary").when(c.contains("storm") | c.contains("surface"), "storm_minor")


def has_token(text: Column, tokens: list[str]) -> Column:
    """Whether any word of a free text is one of the tokens, in any case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,;:/()._-]+")
    return F.arrays_overlap(words, F.array(*map(F.lit, tokens)))


def haversine_m(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance in metres."""
    from catchwork.constants import EARTH_RADIUS_M

    p, q = F.radians(lat_a), F.radians(lat_b)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def flat_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Distance in km with fixed factors of a mid-latitude degree: 71.5 km of longitude, 111.32 km of latitude."""
    return F.sqrt(F.pow((lon_b - lon_a) * 71.5, 2) + F.pow((lat_b - lat_a) * 111.32, 2))


def bearing(dx: Column, dy: Column) -> Column:
    """Compass bearing in degrees of a vector, null for the zero vector."""
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0)))


def bbox_text(w: Column, s: Column, e: Column, n: Column) -> Column:
    """Box as text with 6 decimals."""
    return F.concat_ws(",", *(F.format_string("%.6f", x) for x in (w, s, e, n)))


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    zone = F.least(F.lit(60), F.floor((lon + 180) / 6).cast("int") + 1)
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)


def local_hours(lon: Column, lat: Column) -> Column:
    """Hours of local standard time from UTC: a fifteenth of the longitude, halves to even, without its exceptions."""
    return F.rint(lon / 15).cast("int")
