"""Queries over sewer service areas and soils."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.functions import soil
from catchwork.operators import loading as op
from catchwork.plans.registry import query

PEOPLE = """x AS (SELECT *, coalesce(population, CASE WHEN dwelling_units > 0 THEN dwelling_units * 2.4::DOUBLE END, area_ha * 45) AS people,
  CASE WHEN population IS NOT NULL THEN 'measured' WHEN dwelling_units > 0 THEN 'dwellings' ELSE 'area_density' END AS tier FROM v_service_area)"""


@query("p31_population_ladder", "v_service_area", sql=f"WITH {PEOPLE} SELECT name, round(people, 6) AS people, tier FROM x")
def p31(areas: DataFrame) -> DataFrame:
    return op.population(areas).select("name", F.round("people", 6).alias("people"), "tier")


@query("p32_dry_weather_flow", "v_service_area", sql=f"""WITH {PEOPLE}, u AS (SELECT *, CASE node_key % 3 WHEN 0 THEN 'CMS' WHEN 1 THEN 'LPS' ELSE 'MGD' END AS unit FROM x)
SELECT name, unit, round(people * 280 / 86400 * CASE unit WHEN 'CMS' THEN 0.001 WHEN 'LPS' THEN 1 ELSE 0.0228245 END, 11) AS flow FROM u""")
def p32(areas: DataFrame) -> DataFrame:
    m = F.col("node_key") % 3
    x = op.population(areas).withColumn("unit", F.when(m == 0, "CMS").when(m == 1, "LPS").otherwise("MGD"))
    return x.select("name", "unit", F.round(op.in_units(op.dwf_lps(F.col("people")), F.col("unit")), 11).alias("flow"))


@query("a15_loading_totals", "v_service_area", sql=f"""WITH {PEOPLE} SELECT node_key % 5 AS city, count(*) AS n_areas, round(sum(people), 3) AS people, round(sum(people * 280 / 86400), 4) AS lps,
  count(*) FILTER (WHERE tier = 'measured') AS n_measured, count(*) FILTER (WHERE tier = 'dwellings') AS n_dwellings, count(*) FILTER (WHERE tier = 'area_density') AS n_area_density,
  round(100.0::DOUBLE * count(*) FILTER (WHERE tier = 'area_density') / count(*), 4) AS pct_assumed FROM x GROUP BY 1""")
def a15(areas: DataFrame) -> DataFrame:
    return op.totals(areas.withColumn("city", F.col("node_key") % 5), ["city"])


@query("a16_dwf_per_node", "v_service_area", sql=f"WITH {PEOPLE} SELECT node_key, round(sum(people * 280 / 86400), 6) AS lps, count(*) AS n_areas FROM x GROUP BY 1")
def a16(areas: DataFrame) -> DataFrame:
    return op.population(areas).groupBy("node_key").agg(F.round(F.sum(op.dwf_lps(F.col("people"))), 6).alias("lps"), F.count("*").alias("n_areas"))


FACTORS = "[0.44, 0.34, 0.29, 0.28, 0.32, 0.55, 1.02, 1.45, 1.61, 1.54, 1.42, 1.32, 1.25, 1.20, 1.15, 1.13, 1.18, 1.30, 1.38, 1.32, 1.16, 0.97, 0.76, 0.58]::DOUBLE[]"


@query("m13_diurnal_flow", "v_service_area", sql=f"""WITH {PEOPLE}, f AS (SELECT {FACTORS} AS a), h AS (SELECT unnest(range(0, 24)) AS hour)
SELECT name, CAST(hour AS INT) AS hour, round(people * 280 / 86400 * round(a[hour + 1] / list_avg(a), 4), 12) AS lps FROM x, f, h""")
def m13(areas: DataFrame) -> DataFrame:
    """Hourly flow of each area: the average day's flow by the pattern."""
    x = op.population(areas).select("name", op.dwf_lps(F.col("people")).alias("q"), F.posexplode(op.diurnal()).alias("hour", "factor"))
    return x.select("name", "hour", F.round(F.col("q") * F.col("factor"), 12).alias("lps"))


@query("p43_surface_guard", "v_service_area", "v_catchment", sql="SELECT s.name FROM v_service_area s WHERE s.name IN (SELECT CASE WHEN cell_key % 10 = 0 THEN 'SSA_' || cell_key ELSE name END FROM v_catchment)")
def p43(areas: DataFrame, catchments: DataFrame) -> DataFrame:
    """Service areas that stand among surface catchments: each is an error."""
    named = catchments.select(F.when(F.col("cell_key") % 10 == 0, F.concat(F.lit("SSA_"), F.col("cell_key").cast("string"))).otherwise(F.col("name")).alias("name"))
    return areas.join(named, "name", "left_semi").select("name")


SOIL = "SELECT p_partkey, (p_size * 37 % 1000)::DOUBLE / 10 AS clay, (p_partkey * 53 % 1000)::DOUBLE / 10 AS sand FROM part"


def _soil(part: DataFrame) -> DataFrame:
    return part.select("p_partkey", ((F.col("p_size") * 37 % 1000).cast("double") / 10).alias("clay"), ((F.col("p_partkey") * 53 % 1000).cast("double") / 10).alias("sand"))


@query("m09_soil_texture", "part", sql=f"WITH s AS ({SOIL}), x AS (SELECT *, 100 - clay - sand AS raw, greatest(0, 100 - clay - sand) AS silt FROM s) SELECT p_partkey, {soil.texture_sql()} AS texture FROM x")
def m09(part: DataFrame) -> DataFrame:
    return _soil(part).select("p_partkey", soil.texture(F.col("clay"), F.col("sand")).alias("texture"))


@query("m10_soil_group", "part", sql=f"""WITH s AS ({SOIL}) SELECT p_partkey, CASE WHEN clay <= 0 AND sand <= 0 THEN 255 WHEN clay >= 40 THEN 4 WHEN clay >= 27 THEN 3 WHEN sand >= 50 AND clay < 10 THEN 1 ELSE 2 END AS code FROM s""")
def m10(part: DataFrame) -> DataFrame:
    return _soil(part).select("p_partkey", soil.soil_group(F.col("clay"), F.col("sand")).alias("code"))


@query("m11_infiltration_lookup", "part", sql="""WITH x AS (SELECT p_partkey, CASE p_size % 16 WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' WHEN 11 THEN 'A' WHEN 12 THEN 'B' WHEN 13 THEN 'C' WHEN 14 THEN 'D' END AS g FROM part)
SELECT p_partkey, g AS letter, CASE coalesce(g, 'B') WHEN 'A' THEN 127 WHEN 'B' THEN 101.6 WHEN 'C' THEN 76.2 ELSE 50.8 END::DOUBLE AS f0, CASE coalesce(g, 'B') WHEN 'A' THEN 9.5 WHEN 'B' THEN 5.7 WHEN 'C' THEN 2.5 ELSE 0.6 END::DOUBLE AS fc,
  CASE coalesce(g, 'B') WHEN 'A' THEN 29.9 WHEN 'B' THEN 6.6 WHEN 'C' THEN 1.0 ELSE 0.3 END::DOUBLE AS ksat FROM x""")
def m11(part: DataFrame) -> DataFrame:
    """Horton and Green-Ampt parameters by soil group; unknown groups take the row of B; drained letters for dual codes."""
    letter = k.lookup(k.GROUP_CODES, F.col("p_size") % 16)
    known = F.coalesce(letter, F.lit("B"))
    horton = [k.lookup({g: v[i] for g, v in k.HORTON.items()}, known).alias(c) for i, c in enumerate(("f0", "fc"))]
    ksat = k.lookup({g: k.GREEN_AMPT[t][1] for g, t in k.GROUP_TEXTURE.items()}, known)
    return part.select("p_partkey", letter.alias("letter"), *horton, ksat.alias("ksat"))


def _case(key: str, values: dict, at: int | None = None) -> str:
    """A SQL lookup of fixed values."""
    rows = " ".join(f"WHEN '{name}' THEN {v if at is None else v[at]}" for name, v in values.items())
    return f"CASE {key} {rows} END"


TEXTURE_NAMES = tuple(k.GREEN_AMPT)


@query("p20_infiltration_rows", "v_catchment", sql=f"""WITH c AS (SELECT cell_key, CASE cell_key % 3 WHEN 0 THEN 'HORTON' WHEN 1 THEN 'GREEN_AMPT' ELSE 'CURVE_NUMBER' END AS method, coalesce(['A', 'B', 'C', 'D'][1 + cell_key % 5], 'B') AS g,
  CASE WHEN cell_key % 13 < 12 THEN {list(TEXTURE_NAMES)}[1 + cell_key % 13] END AS t, CASE WHEN cell_key % 7 <> 0 THEN 40 + cell_key % 50 END AS cn FROM v_catchment),
x AS (SELECT *, coalesce(t, {_case("g", {g: f"'{t}'" for g, t in k.GROUP_TEXTURE.items()})}) AS tt FROM c)
SELECT cell_key, method, CASE method WHEN 'HORTON' THEN {_case("g", k.HORTON, 0)} WHEN 'GREEN_AMPT' THEN {_case("tt", k.GREEN_AMPT, 0)} ELSE coalesce(cn, 61) END::DOUBLE AS p1,
  CASE method WHEN 'HORTON' THEN {_case("g", k.HORTON, 1)} WHEN 'GREEN_AMPT' THEN {_case("tt", k.GREEN_AMPT, 1)} ELSE 0.5 END::DOUBLE AS p2,
  CASE method WHEN 'HORTON' THEN {_case("g", k.HORTON, 2)} WHEN 'GREEN_AMPT' THEN {_case("tt", k.GREEN_AMPT, 2)} ELSE 7 END::DOUBLE AS p3, CASE method WHEN 'HORTON' THEN 7 END::DOUBLE AS p4, CASE method WHEN 'HORTON' THEN 0 END::DOUBLE AS p5 FROM x""")
def p20(catchments: DataFrame) -> DataFrame:
    """The parameters of each catchment's own method."""
    c = F.col("cell_key")
    letters, names = (F.array(*map(F.lit, x)) for x in (("A", "B", "C", "D"), TEXTURE_NAMES))
    x = catchments.select(
        "cell_key", F.when(c % 3 == 0, "HORTON").when(c % 3 == 1, "GREEN_AMPT").otherwise("CURVE_NUMBER").alias("method"), F.get(letters, (c % 5).cast("int")).alias("soil_group"),
        F.get(names, (c % 13).cast("int")).alias("texture"), F.when(c % 7 != 0, 40.0 + c % 50).alias("cn"),
    )
    return op.infiltration_rows(x).select("cell_key", "method", "p1", "p2", "p3", "p4", "p5")


@query("p39_soil_tier", "v_px", sql="SELECT aoi_id, ix, iy, coalesce(CASE WHEN hsg_code <> 4 THEN hsg_code END, CASE WHEN landcover % 2 = 0 THEN 3 END, 2)::BIGINT AS code, CASE WHEN hsg_code <> 4 THEN 'published' WHEN landcover % 2 = 0 THEN 'texture' ELSE 'constant' END AS tier FROM v_px")
def p39(px: DataFrame) -> DataFrame:
    """Soil group of each pixel: published, else from texture, else one constant group."""
    published, derived = F.when(F.col("hsg_code") != 4, F.col("hsg_code")), F.when(F.col("landcover") % 2 == 0, F.lit(3).cast("long"))
    tier = F.when(published.isNotNull(), "published").when(derived.isNotNull(), "texture").otherwise("constant")
    return px.select("aoi_id", "ix", "iy", F.coalesce(published, derived, F.lit(2).cast("long")).alias("code"), tier.alias("tier"))
