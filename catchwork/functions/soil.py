"""Soil texture and soil group from clay and sand percent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catchwork import constants as k


def _region(bounds: dict[str, tuple[float | None, float | None]]) -> str:
    """SQL condition of one row of the triangle's table."""
    parts = []
    for name, (low, high) in bounds.items():
        above, below = (">", "<=") if name == "sand" else (">=", "<")
        parts += [f"{name} {sign} {edge}" for sign, edge in ((above, low), (below, high)) if edge is not None]
    return " AND ".join(parts)


def texture_sql() -> str:
    """The texture class as a SQL expression of clay, sand, silt (0 at least) and raw (what clay and sand leave of 100)."""
    rows = " ".join(f"WHEN {_region(bounds)} THEN '{name}'" for name, bounds in k.TEXTURES)
    return f"CASE WHEN clay < 0 OR sand < 0 OR raw < {-k.TEXTURE_SLACK} THEN '{k.TEXTURE_UNKNOWN}' {rows} ELSE '{k.TEXTURE_UNKNOWN}' END"


def texture(clay: Column, sand: Column) -> Column:
    """Texture class of the published triangle; impossible mixtures are loam."""
    given = {"clay": clay, "sand": sand, "raw": 100 - clay - sand, "silt": F.greatest(100 - clay - sand, F.lit(0.0))}
    given |= {"silt + 1.5 * clay": given["silt"] + 1.5 * clay, "silt + 2 * clay": given["silt"] + 2 * clay}
    out = F.when((clay < 0) | (sand < 0) | (given["raw"] < -k.TEXTURE_SLACK), k.TEXTURE_UNKNOWN)
    for name, bounds in k.TEXTURES:
        inside = F.lit(True)
        for quantity, (low, high) in bounds.items():
            x = given[quantity]
            if low is not None:
                inside = inside & ((x > low) if quantity == "sand" else (x >= low))
            if high is not None:
                inside = inside & ((x <= high) if quantity == "sand" else (x < high))
        out = out.when(inside, name)
    return out.otherwise(k.TEXTURE_UNKNOWN)


def soil_group(clay: Column, sand: Column) -> Column:
    """Soil group code 1 to 4 (A to D) from clay and sand percent; 255 without data."""
    sandy = (sand >= k.GROUP_A_SAND) & (clay < k.GROUP_A_CLAY)
    return F.when((clay <= 0) & (sand <= 0), 255).when(clay >= k.GROUP_D_CLAY, 4).when(clay >= k.GROUP_C_CLAY, 3).when(sandy, 1).otherwise(2)
