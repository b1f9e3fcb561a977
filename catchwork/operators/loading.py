"""Dry-weather loading of sewer service areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k


def population(areas: DataFrame) -> DataFrame:
    """Adds people and tier: the published population, else dwellings times household size, else area times density. No dwellings is no evidence."""
    homes = F.col("dwelling_units") > 0
    people = F.coalesce(F.col("population"), F.when(homes, F.col("dwelling_units") * k.PERSONS_PER_DWELLING), F.col("area_ha") * k.PERSONS_PER_HA)
    tier = F.when(F.col("population").isNotNull(), "measured").when(homes, "dwellings").otherwise("area_density")
    return areas.withColumn("people", people).withColumn("tier", tier)


def dwf_lps(people: Column, litres: float = k.LITRES_PER_PERSON_DAY) -> Column:
    return people * litres / 86400


def in_units(lps: Column, unit: Column) -> Column:
    """Litres a second in the model's flow unit; an unknown unit stops the job."""
    factor = k.lookup(k.FLOW_UNITS, F.upper(unit))
    return lps * F.when(factor.isNull(), F.raise_error(F.concat(F.lit("no conversion for flow unit "), unit)).cast("double")).otherwise(factor)


def diurnal() -> Column:
    """24 hourly factors with mean 1."""
    mean = sum(k.DIURNAL) / len(k.DIURNAL)
    return F.array(*(F.lit(round(x / mean, 4)) for x in k.DIURNAL))


def totals(areas: DataFrame, by: list[str]) -> DataFrame:
    """Areas, people, flow, counts by tier and the share on assumed density."""
    x = population(areas)
    n = F.count("*")
    tiers = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("measured", "dwellings", "area_density")]
    return x.groupBy(*by).agg(n.alias("n_areas"), F.round(F.sum("people"), 3).alias("people"), F.round(F.sum(dwf_lps(F.col("people"))), 4).alias("lps"), *tiers, F.round(100 * F.count_if(F.col("tier") == "area_density") / n, 4).alias("pct_assumed"))


def infiltration_rows(catchments: DataFrame) -> DataFrame:
    """catchments with the parameters p1 to p5 of their own method. They have method (HORTON, GREEN_AMPT or CURVE_NUMBER), soil_group (a letter), texture and cn.

    HORTON: first and last rate, decay, dry days, greatest volume (0: none), by soil group; GREEN_AMPT: suction, conductivity, deficit, by texture,
    else that of the group; CURVE_NUMBER: number, conductivity, dry days. An unknown group counts as B.
    """
    group = F.coalesce(F.when(F.col("soil_group").isin(*k.HORTON), F.col("soil_group")), F.lit("B"))
    texture = F.coalesce(F.when(F.col("texture").isin(*k.GREEN_AMPT), F.col("texture")), k.lookup(k.GROUP_TEXTURE, group))
    horton = [k.lookup({g: v[i] for g, v in k.HORTON.items()}, group) for i in range(3)] + [F.lit(k.INFILTRATION_DRY_DAYS), F.lit(0.0)]
    green = [k.lookup({t: v[i] for t, v in k.GREEN_AMPT.items()}, texture) for i in range(3)] + [F.lit(None)] * 2
    curve = [F.coalesce("cn", F.lit(k.DEFAULT_CN)), F.lit(k.CURVE_NUMBER_KSAT), F.lit(k.INFILTRATION_DRY_DAYS)] + [F.lit(None)] * 2
    own = lambda i: F.when(F.col("method") == "HORTON", horton[i]).when(F.col("method") == "GREEN_AMPT", green[i]).otherwise(curve[i])
    return catchments.select("*", *(own(i).cast("double").alias(f"p{i + 1}") for i in range(5)))
