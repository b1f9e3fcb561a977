"""Feature collections, text tables and stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
FEATURE = "struct<properties:map<string,string>,attributes:map<string,string>,geometry:struct<type:string,coordinates:string,paths:array<array<array<double>>>,rings:array<array<array<double>>>,x:double,y:double>>"
STORE_VERSION = 1
STORE_ROW = "major int, minor int, config map<string,string>, provenance map<string,string>"


def features(pages: DataFrame, text: str = "value") -> DataFrame:
    """Rows of (props, kind, line, rings, x, y) from pages of either feature dialect; an unreadable or empty geometry is null.

    Lines, also of several parts, become one array of [x, y] in order; polygons, also of several parts, one array of rings. Other
    axes stay in the vertices.
    """
    parsed = F.from_json(text, f"struct<features:array<{FEATURE}>>")
    f = pages.select(F.explode(parsed["features"]).alias("f")).select("f.*")
    single = F.from_json("geometry.coordinates", "array<array<double>>")
    several = F.flatten(F.from_json("geometry.coordinates", "array<array<array<double>>>"))
    line = F.when(F.col("geometry.type") == "LineString", single).when(F.col("geometry.type") == "MultiLineString", several).otherwise(F.flatten("geometry.paths"))
    outline = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    outlines = F.flatten(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry.type") == "Polygon", outline).when(F.col("geometry.type") == "MultiPolygon", outlines).otherwise(F.col("geometry.rings"))
    point = F.when(F.col("geometry.type") == "Point", F.from_json("geometry.coordinates", "array<double>"))
    return f.select(F.coalesce("properties", "attributes").alias("props"), F.coalesce(F.col("geometry.type"), F.when(F.col("geometry.paths").isNotNull(), "paths").when(F.col("geometry.rings").isNotNull(), "rings")).alias("kind"), line.alias("line"), rings.alias("rings"), F.coalesce(F.get(point, 0), "geometry.x").alias("x"), F.coalesce(F.get(point, 1), "geometry.y").alias("y"))


def line_ends(line: Column) -> tuple[Column, Column]:
    """First and last vertex as (x, y); null under two vertices."""
    end = lambda p: F.when(F.size(line) >= 2, F.struct(p[0].alias("x"), p[1].alias("y")))
    return end(F.get(line, 0)), end(F.try_element_at(line, F.lit(-1)))


def idf_tables(files: DataFrame, name: str = "path", text: str = "value") -> DataFrame:
    """(path, years, duration_min, mm_h) from station texts: lines `<n> min|h` and six intensities for 2, 5, 10, 25, 50 and 100 years; lines with +/- are errors, values of 0 or less are missing."""
    rows = files.select(name, F.explode(F.split(text, r"\r?\n")).alias("line"))
    m = r"^\s*(\d+)\s*(min|h)\s+(.*)$"
    x = rows.where(F.col("line").rlike(m) & ~F.col("line").contains("+/-"))
    number = F.regexp_extract("line", m, 1).cast("int")
    minutes = F.when(F.regexp_extract("line", m, 2) == "h", number * 60).otherwise(number)
    values = F.split(F.trim(F.regexp_extract("line", m, 3)), r"\s+")
    years = F.array(*(F.lit(y) for y in (2, 5, 10, 25, 50, 100)))
    long = x.select(name, minutes.alias("duration_min"), F.posexplode(values).alias("at", "v"))
    return long.where("at < 6").select(name, F.get(years, F.col("at")).alias("years"), "duration_min", F.col("v").try_cast("double").alias("mm_h")).where("mm_h > 0")


def idf_coefficients(files: DataFrame, name: str = "path", text: str = "value") -> DataFrame:
    """(path, years, a, b) from station texts: the line `Coefficient (A)` and the line with `Exponent` and `(B)` hold six numbers each, for 2, 5, 10, 25, 50 and 100 years; other counts give nothing, and an a of 0 or less is missing."""
    lines = files.select(name, F.explode(F.split(text, r"\r?\n")).alias("line"))
    numbers = lambda mark: F.transform(F.expr(f"regexp_extract_all(substring_index(line, '{mark}', -1), '-?[0-9]+([.][0-9]+)?', 0)"), lambda v: v.cast("double"))
    a = F.max(F.when(F.col("line").contains("Coefficient (A)"), numbers("(A)")))
    b = F.max(F.when(F.col("line").contains("Exponent") & F.col("line").contains("(B)"), numbers("(B)")))
    six = lines.groupBy(name).agg(a.alias("a"), b.alias("b")).where("size(a) = 6 and size(b) = 6")
    years = F.array(*(F.lit(y) for y in (2, 5, 10, 25, 50, 100)))
    return six.select(name, F.explode(F.arrays_zip(years.alias("years"), "a", "b")).alias("x")).select(name, "x.*").where("a > 0")


def write_store(tables: dict[str, DataFrame], folder: str, config: dict[str, str] | None = None, provenance: dict[str, str] | None = None) -> None:
    """Writes each table by area, and the store's version with its configuration and provenance. Where the store was built is no part of it: `out_dir` is left out."""
    for name, df in tables.items():
        df.write.partitionBy("aoi_id").mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    shared = {c: v for c, v in (config or {}).items() if c != "out_dir"}
    spark.createDataFrame([(STORE_VERSION, 0, shared, provenance or {})], STORE_ROW).write.mode("overwrite").json(f"{folder}/version")


def store_settings(spark: SparkSession, folder: str) -> DataFrame:
    """(part, name, value): configuration and provenance of a store."""
    row = spark.read.schema(STORE_ROW).json(f"{folder}/version")
    both = [row.select(F.lit(part).alias("part"), F.explode(part).alias("name", "value")) for part in ("config", "provenance")]
    return both[0].unionByName(both[1])


def read_store(spark: SparkSession, folder: str, name: str, schema: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """A table of a store: an unknown major version is refused; columns that older stores lack get their defaults."""
    major = spark.read.schema("major int, minor int").json(f"{folder}/version").first()["major"]
    if major != STORE_VERSION:
        raise ValueError(f"store version {major} isn't supported")
    df = spark.read.schema(schema).parquet(f"{folder}/{name}")
    for c, value in (defaults or {}).items():
        df = df.withColumn(c, F.coalesce(c, F.lit(value)))
    return df


#: Unit and name of each forcing series.
FORCING = {
    "rain": ("mm", "precipitation depth per interval"), "flow": ("m3/s", "observed discharge"), "temperature": ("degC", "daily mean air temperature"),
    "evaporation": ("mm/day", "potential evaporation"), "tide": ("m", "predicted water level"),
}


def write_forcing(series: dict[str, tuple[DataFrame, str]], folder: str) -> None:
    """Writes series (ts, value), each on its own times, as one table by variable, with unit, long_name and the stated provenance."""
    for name, (df, provenance) in series.items():
        unit, title = FORCING[name]
        rows = df.select("ts", "value", F.lit(unit).alias("unit"), F.lit(title).alias("long_name"), F.lit(provenance).alias("provenance"), F.lit(name).alias("variable"))
        rows.write.mode("append").partitionBy("variable").parquet(folder)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(member, size, sha256) of a package's files, without its manifest."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    member = F.substring_index("path", "/", -1)
    return files.select(member.alias("member"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).where("member <> 'manifest.json'")


def preview(junctions: DataFrame, outfalls: DataFrame, conduits: DataFrame, catchments: DataFrame) -> DataFrame:
    """(kind, feature): a JSON feature for each junction, outfall, conduit and subcatchment, its measures rounded for the map.

    junctions and outfalls: (name, x, y, invert_m, and max_depth_m or outfall_type); conduits: (name, from_node, to_node, length_m), drawn only where both nodes
    are given; catchments: (name, area_ha, pct_imperv, outlet_node, ring), left out without a ring, which is closed where it is open.
    """

    def feature(kind: str, shape: str, coordinates: Column, *properties: Column) -> list[Column]:
        geometry = F.struct(F.lit(shape).alias("type"), coordinates.alias("coordinates"))
        return [F.lit(kind).alias("kind"), F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("kind"), F.col("name").alias("id"), *properties).alias("properties"), geometry.alias("geometry"))).alias("feature")]

    point, invert = F.array("x", "y"), F.round("invert_m", 2).alias("invert_m")
    at = junctions.select("name", "x", "y").unionByName(outfalls.select("name", "x", "y"))
    a, b = (at.select(F.col("name").alias(f"{s}_node"), F.array("x", "y").alias(f"_{s}")) for s in ("from", "to"))
    ring = F.transform("ring", lambda p: F.array(p["x"], p["y"]))
    closed = F.when(F.get(ring, F.lit(0)) == F.element_at(ring, -1), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    parts = [
        junctions.select(*feature("junction", "Point", point, invert, F.round("max_depth_m", 2).alias("max_depth_m"))),
        outfalls.select(*feature("outfall", "Point", point, invert, F.col("outfall_type"))),
        conduits.join(a, "from_node").join(b, "to_node").select(*feature("conduit", "LineString", F.array("_from", "_to"), F.round("length_m", 1).alias("length_m"), F.col("from_node"), F.col("to_node"))),
        catchments.where(F.size("ring") > 0).select(*feature("subcatchment", "Polygon", F.array(closed), F.round("area_ha", 4).alias("area_ha"), F.round("pct_imperv", 1).alias("pct_imperv"), F.col("outlet_node"))),
    ]
    return reduce(DataFrame.unionByName, parts)
