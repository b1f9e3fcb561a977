"""What published map layers are, and how far they can be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import written


def spaced(name: Column) -> Column:
    """Words of camel case apart."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"(?<=[a-z0-9])(?=[A-Z])", " ")


def role(name: Column) -> Column:
    """The first role whose pattern matches; none for names that are no gravity drainage asset."""
    low = F.lower(spaced(name))
    none = low.rlike(k.DERIVATIVE) | low.rlike(k.NOT_DRAINAGE) | low.rlike(k.PRESSURISED) | low.rlike(k.DRAFT)
    chain = F.when(none, F.lit(None).cast("string"))
    for pattern, r in k.ROLE_PATTERNS:
        chain = chain.when(low.rlike(pattern), r)
    return chain


def system(service: Column, layer: Column) -> Column:
    """The layer's name decides; the service's name counts only where it says nothing. A bare `sewer` stays open."""

    def one(name: Column) -> Column:
        low = F.lower(spaced(name))
        return F.when(low.rlike(k.COMBINED), "combined").when(low.rlike(k.SANITARY), "sanitary").when(low.rlike(k.STORM), "storm")

    return F.coalesce(one(layer), one(service))


def relevant(name: Column) -> Column:
    low = F.lower(name)
    return reduce(lambda a, b: a | b, (low.contains(w) for w in k.KEYWORDS))


def geometry_ok(role_name: Column, geometry: Column) -> Column:
    """Whether the geometry is one that the role may have; true for roles without a rule."""
    rules = F.create_map(*(x for r, kinds in k.EXPECTED_GEOMETRY.items() for x in (F.lit(r), F.array(*map(F.lit, kinds)))))
    return F.coalesce(F.array_contains(F.try_element_at(rules, role_name), geometry), F.lit(True))


def classified(layers: DataFrame) -> DataFrame:
    """layers with role, system and skip_reason: a role whose geometry disagrees is cleared and the reason kept."""
    x = layers.withColumn("guess", role(F.col("layer_name"))).withColumn("system", system(F.col("service_name"), F.col("layer_name")))
    ok = geometry_ok(F.col("guess"), F.col("geometry_type"))
    reason = F.when(F.col("guess").isNull(), "unclassified").when(~ok, F.concat(F.lit("geometry disagrees with "), F.col("guess")))
    return x.withColumn("role", F.when(ok, F.col("guess"))).withColumn("skip_reason", reason).drop("guess")


def counts(layers: DataFrame) -> DataFrame:
    """(city_key, system, role, n): features by role within a system; layers without a system lend nothing."""
    return layers.where("role is not null and system is not null and n_features > 0").groupBy("city_key", "system", "role").agg(F.sum("n_features").alias("n"))


def anchors(roles: DataFrame) -> DataFrame:
    """(city_key, system, n_anchors, anchor_role, is_proxy): the first anchor role of the system, in order, that has features."""
    order = F.create_map(*(x for s, rs in k.ANCHORS.items() for x in (F.lit(s), F.array(*map(F.lit, rs)))))
    at = F.array_position(F.try_element_at(order, F.col("system")), F.col("role"))
    x = roles.withColumn("rank", at).where("rank > 0")
    best = x.groupBy("city_key", "system").agg(F.min(F.struct("rank", "role", "n")).alias("b"))
    return best.select("city_key", "system", F.col("b.n").alias("n_anchors"), F.col("b.role").alias("anchor_role"), (F.col("b.role") == "manhole").alias("is_proxy"))


def verdicts(roles: DataFrame) -> DataFrame:
    """(city_key, system, polygon_role, n_polygons, n_anchors, anchor_role, ratio, level): how fine a city's own polygons are against its anchors. The counts, a few rows a city, are written once, so that layers are classified once."""
    roles = written(roles, "layer_counts")
    area = roles.where("role in ('subcatchment', 'catchment')").groupBy("city_key", "system").agg(F.max(F.struct(F.col("role"), F.col("n"))).alias("p"))  # subcatchment sorts last
    x = area.join(anchors(roles), ["city_key", "system"], "left").select("city_key", "system", F.col("p.role").alias("polygon_role"), F.col("p.n").alias("n_polygons"), "n_anchors", "anchor_role", F.round(F.col("p.n") / F.col("n_anchors"), 5).alias("ratio"))
    exact = F.col("n_polygons") / F.col("n_anchors")
    level = F.when(F.col("n_anchors").isNull(), "level_2_review").when(exact < k.RATIO_LEVEL_2, "level_2").when(exact < k.RATIO_CANDIDATE, "level_2_review").otherwise("level_1_candidate")
    return x.withColumn("level", level)


def confirmed(level: Column, rate: Column, n: Column) -> Column:
    """A candidate after outlet agreement was measured: too few units say nothing, too low a rate demotes it."""
    measured = rate.isNotNull() & (n > 0)
    return F.when((level != "level_1_candidate") | ~measured, level).when(n < k.AGREEMENT_SAMPLE, "level_2_review").when(rate < k.AGREEMENT, "level_2").otherwise("level_1")


def coverage_summary(counts: DataFrame, facts: DataFrame) -> DataFrame:
    """(city_key, systems, n_features, has_sanitary, west, south, east, north, typical_error_m, tier) of each city with layers. counts: (city_key, system, n); facts: (city_key, west, south, east, north, typical_error_m, filled), filled being the share of inverts that had to be filled; cities without facts have null."""
    x = counts.groupBy("city_key").agg(F.array_sort(F.collect_set("system")).alias("s"), F.sum("n").alias("n_features"))
    x = x.select("city_key", F.array_join("s", ",").alias("systems"), "n_features", F.exists("s", lambda v: v.contains("sanitary")).alias("has_sanitary")).join(facts, "city_key", "left")
    tier = F.when(F.col("filled") <= 0.10, "A").when(F.col("filled") <= 0.35, "B").when(F.col("filled").isNotNull(), "C")
    return x.withColumn("tier", tier).drop("filled")
