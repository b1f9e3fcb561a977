"""Climate records, their gates and design storms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.frames import written
from catchwork.operators.grid import inside


def traced(value: Column, flag: Column) -> Column:
    """An observed depth; a missing one flagged `T` (trace) is 0."""
    return F.when(value.isNull() & (flag == "T"), F.lit(0.0)).otherwise(value)


def first_record(obs: DataFrame, keys: list[str], order: str = "file_seq") -> DataFrame:
    """The first record of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return obs.withColumn("_n", n).where("_n = 1").drop("_n")


def on_axis(obs: DataFrame, station: str, ts: str, start: Column, end: Column, step: str) -> DataFrame:
    """Every expected time of every station from start to end, with the record there or nulls. start and end are per-row constants of a station."""
    span = obs.groupBy(station).agg(F.min(start).alias("_s"), F.max(end).alias("_e"))
    axis = span.select(station, F.explode(F.expr(f"sequence(_s, _e, interval {step})")).alias(ts))
    return axis.join(obs, [station, ts], "left")


def completeness(axis: DataFrame, station: str, ts: str, value: str) -> DataFrame:
    """(station, n_expected, n_missing, max_gap, coverage): gaps are islands of missing records on the axis."""
    w = Window.partitionBy(station).orderBy(ts)
    x = axis.withColumn("_miss", F.col(value).isNull())
    x = x.withColumn("_run", F.sum(F.when(F.col("_miss"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = x.groupBy(station, "_run").agg(F.count_if("_miss").alias("gap"), F.count("*").alias("n"))
    n, missing = F.sum("n"), F.sum("gap")
    return runs.groupBy(station).agg(n.alias("n_expected"), missing.alias("n_missing"), F.max("gap").alias("max_gap"), ((n - missing) / n).alias("coverage"))


def hourly_usable(coverage: float = k.HOURLY_COVERAGE, gap: int = k.HOURLY_GAP_H) -> Column:
    return (F.col("coverage") >= coverage) & (F.col("max_gap") <= gap)


def daily_usable(coverage: float = k.DAILY_COVERAGE, gap: int = k.DAILY_GAP_D) -> Column:
    """Coverage decides for long windows, the number of missing days for short ones; the longest gap counts in both."""
    short = (F.col("coverage") >= 0.5) & (F.col("n_missing") <= gap)
    return (F.col("max_gap") <= gap) & ((F.col("coverage") >= coverage) | short)


def totals_disagree(hourly: Column, daily: Column) -> Column:
    """Whether two totals of rain differ by more than 15 %, once either reaches a millimetre."""
    return F.when(F.greatest(hourly, daily) < k.TRACE_MM, False).when(daily <= 0, hourly > 0).otherwise(F.abs(hourly - daily) / daily * 100 > k.MISMATCH_PCT)


def radiation(lat: Column, day: Column) -> Column:
    """Extraterrestrial radiation (MJ/m2/day) of a latitude in degrees on a day of the year, FAO-56 equation 21."""
    phi, turn = F.radians(lat), 2 * F.pi() * day / 365
    near = 1 + 0.033 * F.cos(turn)
    decl = 0.409 * F.sin(turn - 1.39)
    sunset = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.tan(phi) * F.tan(decl))))
    return 24 * 60 / F.pi() * 0.0820 * near * (sunset * F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.sin(sunset))


def evaporation(tmin: Column, tmax: Column, tmean: Column, lat: Column, day: Column) -> Column:
    """Hargreaves potential evaporation (mm/day), never below 0; a maximum below the minimum counts as no range."""
    pet = 0.0023 * 0.408 * radiation(lat, day) * (tmean + 17.8) * F.sqrt(F.greatest(F.lit(0.0), tmax - tmin))
    return F.greatest(F.lit(0.0), pet)


def mean_temperature(tmin: Column, tmax: Column, tmean: Column) -> Column:
    return F.coalesce(tmean, (tmin + tmax) / 2)


def depth_curve(idf: DataFrame) -> DataFrame:
    """Depths by duration of each station, never falling with duration, as segments (d0, v0) to (d1, v1); the last one has no end."""
    w = Window.partitionBy("station_key").orderBy("duration_min")
    x = idf.where("mm_h > 0").withColumn("depth", F.max(F.col("mm_h") * F.col("duration_min") / 60).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lead = lambda c: F.lead(c).over(w)
    return x.select("station_key", F.col("duration_min").cast("double").alias("d0"), F.col("depth").alias("v0"), lead("duration_min").cast("double").alias("d1"), lead("depth").alias("v1"), F.row_number().over(w).alias("piece"))


def depth_at(curve: DataFrame, wanted: DataFrame) -> DataFrame:
    """(station_key, minutes, depth) by log-log interpolation, clamped to the ends of the curve, linear after a zero depth. wanted: (station_key, minutes)."""
    m = F.col("minutes")
    inside = (m >= F.col("d0")) & (F.col("d1").isNull() | (m < F.col("d1")))
    x = wanted.join(curve, "station_key").where(inside | ((F.col("piece") == 1) & (m < F.col("d0"))))
    share = (F.ln(m) - F.ln("d0")) / (F.ln("d1") - F.ln("d0"))
    log = F.exp(F.ln("v0") + share * (F.ln("v1") - F.ln("v0")))
    linear = F.col("v0") + (F.col("v1") - F.col("v0")) * (m - F.col("d0")) / (F.col("d1") - F.col("d0"))
    depth = F.when(F.col("d1").isNull() | (m <= F.col("d0")), F.col("v0")).when(F.col("v0") <= 0, linear).otherwise(log)
    return x.select("station_key", "minutes", depth.alias("depth"))


def alternating_blocks(idf: DataFrame, hours: int = 24) -> DataFrame:
    """(station_key, hour, depth_mm): the hourly blocks of a design storm, the largest in the middle, the others right and left of it in turn."""
    steps = idf.select("station_key").distinct().select("station_key", F.explode(F.sequence(F.lit(1), F.lit(hours))).alias("h")).withColumn("minutes", F.col("h") * 60.0)
    depth = depth_at(depth_curve(idf), steps)
    w = Window.partitionBy("station_key").orderBy("minutes")
    blocks = depth.withColumn("block", F.greatest(F.lit(0.0), F.col("depth") - F.coalesce(F.lag("depth").over(w), F.lit(0.0))))
    rank = F.row_number().over(Window.partitionBy("station_key").orderBy(F.desc("block"), "minutes")) - 1
    centre = hours // 2
    half = F.floor((F.col("i") + 1) / 2).cast("int")
    right = (F.col("i") % 2 == 1) & (half <= hours - 1 - centre)
    return blocks.withColumn("i", rank).select("station_key", F.when(F.col("i") == 0, centre).when(right, centre + half).otherwise(centre - half).alias("hour"), F.col("block").alias("depth_mm"))


def design_intensity(idf: DataFrame, wanted: DataFrame, power: DataFrame | None = None) -> DataFrame:
    """(station_key, minutes, mm_h) at a time of concentration, clamped to the table: by a fitted power law (station_key, a, b) where there is one, else log-log between durations."""
    w = Window.partitionBy("station_key").orderBy("duration_min")
    x = idf.select("station_key", F.col("duration_min").cast("double").alias("d0"), F.col("mm_h").alias("v0"), F.lead("duration_min").over(w).cast("double").alias("d1"), F.lead("mm_h").over(w).alias("v1"))
    span = idf.groupBy("station_key").agg(F.min("duration_min").cast("double").alias("lo"), F.max("duration_min").cast("double").alias("hi"))
    t = wanted.join(span, "station_key").withColumn("t", F.greatest("lo", F.least("hi", "minutes")))
    hit = t.join(x, "station_key").where((F.col("t") >= F.col("d0")) & (F.col("d1").isNull() | (F.col("t") < F.col("d1"))))
    log = F.exp(F.ln("v0") + (F.ln("t") - F.ln("d0")) / (F.ln("d1") - F.ln("d0")) * (F.ln("v1") - F.ln("v0")))
    out = hit.withColumn("table", F.when(F.col("t") == F.col("d0"), F.col("v0")).otherwise(log))
    if power is None:
        return out.select("station_key", "minutes", F.col("table").alias("mm_h"))
    law = F.col("a") * F.pow(F.col("t") / 60, F.col("b"))
    return out.join(power, "station_key", "left").select("station_key", "minutes", F.coalesce(law, "table").alias("mm_h"))


def ranked_stations(places: DataFrame, stations: DataFrame, n: int, distance: Column, east: float, north: float, start: float, key: str = "aoi_id") -> DataFrame:
    """(key, station_key, distance, rank): the n nearest stations of each place, ties to the lesser key; all of them where there are fewer.

    places: (key, x, y); stations: (station_key, lon, lat); distance is a column of x, y, lon and lat. A station at distance d is at most
    d * east degrees away in longitude and d * north in latitude, so those within a radius meet by an equi-join of boxes of that
    size; places with fewer than n in the radius try again with twice as much, until it spans the globe.
    """
    rest, done, radius = written(places.select(key, "x", "y"), "station_places"), None, start
    stations = written(stations.select("station_key", "lon", "lat").distinct(), "stations")
    side = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    while True:
        last = radius * min(east, north) >= 360
        box = lambda c, step: F.floor(F.col(c) / F.lit(radius * step))  # noqa: B023, E731
        s = stations.withColumn("_i", side).withColumn("_j", side).withColumn("_bx", box("lon", east) + F.col("_i")).withColumn("_by", box("lat", north) + F.col("_j")).drop("_i", "_j")
        met = rest.withColumn("_bx", box("x", east)).withColumn("_by", box("y", north)).join(s, ["_bx", "_by"]).withColumn("distance", distance)
        near = met.where(F.col("distance") <= radius).select(key, "station_key", "distance")
        order = Window.partitionBy(key).orderBy("distance", "station_key")
        best = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
        best = written(best.withColumn("_all", F.count("*").over(Window.partitionBy(key))), "stations_near")
        full = best if last else best.where(F.col("_all") >= n)
        done = full if done is None else done.unionByName(full)
        if last:
            return done.drop("_all")
        rest = written(rest.join(full.select(key).distinct(), key, "left_anti"), "station_places")
        if rest.isEmpty():
            return done.drop("_all")
        radius *= 2


def gauge_days(days: DataFrame, stations: DataFrame, ring: Column, first: str, last: str) -> DataFrame:
    """days (station_key, day, ...) of the stations (station_key, x, y) that lie in a ring, from the first to the last day."""
    inside_area = stations.where(inside(ring, F.col("x"), F.col("y"))).select("station_key")
    return days.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).join(inside_area, "station_key", "left_semi")


def daily_stations(candidates: DataFrame, tries: int = k.STATION_TRIES, complete: float = k.COMPLETE) -> DataFrame:
    """(aoi_id, climate_id, coverage, inside): the daily stations of each area.

    candidates: (aoi_id, climate_id, inside, rank, coverage, usable), rank by distance from 1. Every usable station inside the area is taken. Only where there is none, the
    best by coverage, then rank, of the nearest `tries` is; those behind the first usable one that is complete are not looked at.
    """
    inner = candidates.where("inside and usable").select("aoi_id", "climate_id", "coverage", F.lit(True).alias("inside"))
    rest = candidates.where(F.col("usable") & (F.col("rank") <= tries)).join(inner.select("aoi_id").distinct(), "aoi_id", "left_anti")
    stop = rest.where(F.col("coverage") >= complete).groupBy("aoi_id").agg(F.min("rank").alias("stop"))
    seen = rest.join(stop, "aoi_id", "left").where("stop is null or rank <= stop")
    best = seen.groupBy("aoi_id").agg(F.min(F.struct((-F.col("coverage")).alias("c"), "rank", "climate_id")).alias("b"))
    return inner.unionByName(best.select("aoi_id", F.col("b.climate_id").alias("climate_id"), (-F.col("b.c")).alias("coverage"), F.lit(False).alias("inside")))


def hourly_stations(candidates: DataFrame, tries: int = k.STATION_TRIES) -> DataFrame:
    """(aoi_id, climate_id, tried): the first usable hourly station of each area, those inside first, in the order of their distance, among the first `tries`; areas without one are left out. candidates: (aoi_id, climate_id, inside, rank, usable)."""
    order = Window.partitionBy("aoi_id").orderBy(F.desc("inside"), "rank")
    first = candidates.withColumn("tried", F.row_number().over(order)).where(F.col("tried") <= tries)  # each task sends `tries` rows an area at most
    best = first.where("usable").groupBy("aoi_id").agg(F.min(F.struct("tried", "climate_id")).alias("b"))
    return best.select("aoi_id", F.col("b.climate_id").alias("climate_id"), F.col("b.tried").alias("tried"))


def standard_hours(lon: Column, lat: Column) -> Column:
    """Hours from UTC to local standard time: by longitude, but for three areas whose legal clock differs."""
    own = F.when((lon > -59) & (lat > 46.5), -3.5).when((lon > -110.5) & (lon < -101.4) & (lat >= 49) & (lat < 60), -6.0).when((lon > -141.1) & (lon < -123.8) & (lat >= 60), -7.0)
    return own.otherwise(F.rint(lon / 15))


def tide_frames(levels: DataFrame, stations: DataFrame, datums: DataFrame, first: str, last: str) -> tuple[DataFrame, DataFrame]:
    """Levels of each usable station in local standard time above a geodetic datum, and what was decided: (station_key, local_ts, level_m) and (station_key, datum, offset_m, n_hours, expected, verdict).

    levels: (station_key, file_seq, ts, level_m) hourly, UTC, above chart datum; stations: (station_key, lon, lat); datums: (station_key, code, offset_m). The first known
    code of the preference counts; a station without one is refused (no_datum), since chart and geodetic levels don't compare. Of overlapping
    records of one time the first counts. Days from the first to the last are kept; under nine tenths of their hours the station is refused (sparse, or no_data).
    """
    names = k.DATUM_PREFERENCE
    order = F.array_position(F.array(*map(F.lit, names)), F.col("code"))
    one = datums.where(F.col("code").isin(*names) & F.col("offset_m").isNotNull()).groupBy("station_key").agg(F.min_by(F.struct("code", "offset_m"), order).alias("d"))
    known = stations.select("station_key", (standard_hours(F.col("lon"), F.col("lat")) * 3600).cast("long").alias("shift")).join(one, "station_key", "left")
    once = levels.groupBy("station_key", "ts").agg(F.min_by("level_m", "file_seq").alias("level_m"))
    local = F.timestamp_seconds(F.unix_timestamp("ts") + F.col("shift"))
    x = once.join(known, "station_key").withColumn("local_ts", local).where((F.to_date("local_ts") >= F.lit(first).cast("date")) & (F.to_date("local_ts") <= F.lit(last).cast("date")))
    n = x.groupBy("station_key").agg(F.count("*").alias("n_hours"))
    expected = (F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")) + 1) * 24
    said = known.join(n, "station_key", "left").select("station_key", F.col("d.code").alias("datum"), F.col("d.offset_m").alias("offset_m"), F.coalesce("n_hours", F.lit(0)).alias("n_hours"), expected.alias("expected"))
    verdict = F.when(F.col("datum").isNull(), "no_datum").when(F.col("n_hours") == 0, "no_data").when(F.col("n_hours") < k.TIDE_COVERAGE * F.col("expected"), "sparse").otherwise("ok")
    said = written(said.withColumn("verdict", verdict), "tide_verdicts")
    good = said.where("verdict = 'ok'").select("station_key")
    return x.join(good, "station_key", "left_semi").select("station_key", "local_ts", F.round(F.col("level_m") + F.col("d.offset_m"), 3).alias("level_m")), said
