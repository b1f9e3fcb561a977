"""From raw municipal features to canonical pipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import ranked
from catchwork.functions import values as v


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeated names get `_2`, `_3` ... in arrival order."""
    return _suffixed(df, name, F.col(name), order)


def unique_folded(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names that differ only by case count as repeated too."""
    return _suffixed(df, name, F.lower(name), order)


def _suffixed(df: DataFrame, name: str, same: Column, order: str) -> DataFrame:
    x = ranked(df, [same], [order], "_number")
    n = F.col("_number")
    return x.withColumn("unique_name", F.when(n > 1, F.concat_ws("_", F.col(name), n.cast("string"))).otherwise(F.col(name))).drop("_number")


def ends(pipes: DataFrame) -> DataFrame:
    """One row for each end of each pipe: (file_seq, name, node_key, invert, side)."""
    a = pipes.select("file_seq", "name", F.col("up_key").alias("node_key"), F.col("inv_up").alias("invert"), F.lit("up").alias("side"))
    return a.unionByName(pipes.select("file_seq", "name", F.col("dn_key").alias("node_key"), F.col("inv_dn").alias("invert"), F.lit("dn").alias("side")))


def resolved_ends(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """End points by node id; an unknown id takes the other end's point and is counted as dangling, two unknown ids stay null."""
    u = nodes.select(F.col("node_key").alias("up_key"), F.col("lon").alias("u_lon"), F.col("lat").alias("u_lat"))
    d = nodes.select(F.col("node_key").alias("dn_key"), F.col("lon").alias("d_lon"), F.col("lat").alias("d_lat"))
    both = pipes.join(u, "up_key", "left").join(d, "dn_key", "left")
    return both.select("file_seq", "name", "up_key", "dn_key",
        F.coalesce("u_lon", "d_lon").alias("a_lon"), F.coalesce("u_lat", "d_lat").alias("a_lat"),
        F.coalesce("d_lon", "u_lon").alias("b_lon"), F.coalesce("d_lat", "u_lat").alias("b_lat"),
        (F.col("u_lon").isNull().cast("int") + F.col("d_lon").isNull().cast("int")).alias("n_dangling"))


def safe_labels(points: DataFrame, decimals: int = 5) -> DataFrame:
    """Labels with a verdict: kept, dropped (blank, or one case-folded label at several places) or reserved (`n` and a number)."""
    x = points.withColumn("clean", v.safe_name(F.col("label"))).withColumn("key", F.lower("clean"))
    x = x.withColumn("place", F.struct(F.round("lon", decimals), F.round("lat", decimals)))
    places = x.where("clean <> ''").groupBy("key").agg(F.count_distinct("place").alias("places"))
    x = x.join(places, "key", "left")
    verdict = F.when(F.col("clean") == "", "dropped").when(F.col("key").rlike(r"^n[1-9]\d*$"), "reserved").when(F.col("places") != 1, "dropped").otherwise("kept")
    return x.withColumn("verdict", verdict).drop("place", "places", "key")


def canonical(features: DataFrame, config: DataFrame) -> DataFrame:
    """Raw pipes of any city by its configuration row: features (city, file_seq, props map) and config (city, name_fields, inv_up, inv_dn, diameter, divisor, material, policy).

    The configuration is one row for each city, so Spark broadcasts it by its size; the first non-empty name field wins.
    """
    x = features.join(config, "city")
    prop = lambda c: F.try_element_at("props", F.col(c))
    name = F.get(F.filter(F.transform("name_fields", lambda f: F.trim(F.try_element_at("props", f))), lambda t: t.isNotNull() & (t != "")), 0)
    inverts = [v.without_sentinel(v.number(prop(c)), F.col("policy")).alias(c) for c in ("inv_up", "inv_dn")]
    size = v.number(prop("diameter"))
    return x.select("city", "file_seq", v.safe_name(name).alias("name"), *inverts, F.when(size > 0, size / F.col("divisor")).alias("diameter_m"), v.roughness(v.material_code(prop("material"))).alias("roughness_n"))


def within(value: Column, low: Column, high: Column) -> Column:
    """value inside a band whose ends may be open."""
    return F.when((low.isNull() | (value >= low)) & (high.isNull() | (value <= high)), value)


def by_city_rules(pipes: DataFrame, rules: DataFrame) -> DataFrame:
    """Pipes of many cities with each city's sentinel policy and bands applied to inverts and rims: pipes (city, inv_up, inv_dn, rim_m, ...). A row of an unlisted city has no rule and is dropped; the rules are one row a city."""
    x = pipes.join(rules, "city")
    for c in ("inv_up", "inv_dn"):
        x = x.withColumn(c, within(v.without_sentinel(F.col(c), F.col("policy")), F.col("invert_low"), F.col("invert_high")))
    x = x.withColumn("rim_m", within(F.nullif("rim_m", F.lit(0.0)), F.col("rim_low"), F.col("rim_high")))
    return x.drop("policy", "invert_low", "invert_high", "rim_low", "rim_high")


def carriers(symbols: DataFrame, kind: str = "symbol_type") -> DataFrame:
    """symbols with `carries`: rim or seed by their type, a row for each where a type does both; types of neither, and null, go. Types compare without case and outer blanks."""
    name = F.upper(F.trim(F.col(kind)))
    both = F.array_compact(F.array(F.when(name.isin(*k.RIM_TYPES), "rim"), F.when(name.isin(*k.SEED_TYPES), "seed")))
    return symbols.withColumn("carries", F.explode(both))
