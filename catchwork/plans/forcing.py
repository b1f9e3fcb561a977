"""Queries over climate records, intensities and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchwork import constants as k
from catchwork.functions import values as v
from catchwork.operators import forcing as op
from catchwork.operators.quantiles import percentiles
from catchwork.plans.registry import query

FIRST = """o AS (SELECT climate_id, ts, CASE WHEN precip_raw IS NULL AND flag = 'T' THEN 0 ELSE precip_raw END AS mm FROM (
    SELECT *, row_number() OVER (PARTITION BY climate_id, ts ORDER BY file_seq) AS n FROM v_obs_hourly) WHERE n = 1),
w AS (SELECT date_trunc('day', min(ts)) AS s, date_trunc('day', max(ts)) + INTERVAL 23 HOUR AS e FROM v_obs_hourly)"""
AXIS = FIRST + """,
ax AS (SELECT c.climate_id, unnest(generate_series(w.s, w.e, INTERVAL 1 HOUR)) AS ts FROM (SELECT DISTINCT climate_id FROM v_obs_hourly) c, w),
g AS (SELECT ax.climate_id, ax.ts, o.mm, sum(CASE WHEN o.mm IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY ax.climate_id ORDER BY ax.ts) AS run FROM ax LEFT JOIN o USING (climate_id, ts)),
r AS (SELECT climate_id, run, count(*) FILTER (WHERE mm IS NULL) AS gap, count(*) AS n FROM g GROUP BY ALL),
comp AS (SELECT climate_id, sum(n)::BIGINT AS n_expected, sum(gap)::BIGINT AS n_missing, max(gap) AS max_gap, (sum(n) - sum(gap)) / sum(n)::DOUBLE AS coverage FROM r GROUP BY 1)"""
DAYS = FIRST + """,
dd AS (SELECT climate_id, CAST(ts AS DATE) AS day, CASE WHEN count(mm) >= 20 THEN sum(mm) END AS mm FROM o GROUP BY ALL),
ax AS (SELECT c.climate_id, CAST(unnest(generate_series(w.s, w.e, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT climate_id FROM v_obs_hourly) c, w),
g AS (SELECT ax.climate_id, ax.day, dd.mm, sum(CASE WHEN dd.mm IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY ax.climate_id ORDER BY ax.day) AS run FROM ax LEFT JOIN dd USING (climate_id, day)),
r AS (SELECT climate_id, run, count(*) FILTER (WHERE mm IS NULL) AS gap, count(*) AS n FROM g GROUP BY ALL),
comp AS (SELECT climate_id, sum(n)::BIGINT AS n_expected, sum(gap)::BIGINT AS n_missing, max(gap) AS max_gap, (sum(n) - sum(gap)) / sum(n)::DOUBLE AS coverage FROM r GROUP BY 1)"""


def _first(obs: DataFrame) -> DataFrame:
    x = op.first_record(obs, ["climate_id", "ts"])
    return x.select("climate_id", "ts", op.traced(F.col("precip_raw"), F.col("flag")).alias("mm"))


def _hours(obs: DataFrame) -> DataFrame:
    """Hourly axis over the whole window of the table, for every station."""
    window = obs.agg(F.date_trunc("day", F.min("ts")).alias("s"), (F.date_trunc("day", F.max("ts")) + F.expr("interval 23 hours")).alias("e"))
    axis = obs.select("climate_id").distinct().join(F.broadcast(window)).select("climate_id", F.explode(F.expr("sequence(s, e, interval 1 hour)")).alias("ts"))  # the window is one row
    return axis.join(_first(obs), ["climate_id", "ts"], "left")


def _daily(obs: DataFrame) -> DataFrame:
    """Daily sums of days with 20 or more hours, on the axis of all days."""
    sums = _first(obs).groupBy("climate_id", F.to_date("ts").alias("day")).agg(F.when(F.count("mm") >= 20, F.sum("mm")).alias("mm"))
    window = obs.agg(F.to_date(F.min("ts")).alias("s"), F.to_date(F.max("ts")).alias("e"))
    axis = obs.select("climate_id").distinct().join(F.broadcast(window)).select("climate_id", F.explode(F.expr("sequence(s, e, interval 1 day)")).alias("day"))
    return axis.join(sums, ["climate_id", "day"], "left")


@query("s03_hourly_scan", "v_obs_hourly", sql="SELECT climate_id, file_seq, ts, CASE WHEN precip_raw IS NULL AND flag = 'T' THEN 0 ELSE precip_raw END AS mm FROM v_obs_hourly")
def s03(obs: DataFrame) -> DataFrame:
    return obs.select("climate_id", "file_seq", "ts", op.traced(F.col("precip_raw"), F.col("flag")).alias("mm"))


@query("s04_daily_scan", "v_obs_hourly", sql="""
SELECT climate_id, CAST(ts AS DATE) AS day, round(sum(CASE WHEN precip_raw IS NULL AND flag = 'T' THEN 0 ELSE precip_raw END), 6) AS mm, round(min(precip_raw), 6) AS tmin, round(max(precip_raw), 6) AS tmax FROM v_obs_hourly GROUP BY ALL""")
def s04(obs: DataFrame) -> DataFrame:
    x = obs.groupBy("climate_id", F.to_date("ts").alias("day"))
    return x.agg(F.round(F.sum(op.traced(F.col("precip_raw"), F.col("flag"))), 6).alias("mm"), F.round(F.min("precip_raw"), 6).alias("tmin"), F.round(F.max("precip_raw"), 6).alias("tmax"))


@query("s05_station_scan", "v_station", sql="SELECT station_key, name, province, lon, lat FROM v_station")
def s05(stations: DataFrame) -> DataFrame:
    """One JSON feature a station; only the nested fields asked for are parsed."""
    feature = F.to_json(F.struct(F.struct("station_key", "name", "province", F.lit("open").alias("state")).alias("properties"), F.struct(F.array("lon", "lat").alias("coordinates")).alias("geometry")))
    x = stations.select(F.from_json(feature, "properties struct<station_key: long, name: string, province: string>, geometry struct<coordinates: array<double>>").alias("f"))
    return x.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query("s06_wide_months_to_days", "orders", sql="""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS q FROM orders GROUP BY 1)
SELECT day, round(q, 4) AS flow FROM d WHERE q > 0""")
def s06(orders: DataFrame) -> DataFrame:
    """Month rows with 31 value columns become day rows; nulls and days that a month lacks are dropped."""
    days = orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("q"))
    wide = days.groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(*(F.max(F.when(F.dayofmonth("d") == i, F.col("q"))).alias(f"flow{i}") for i in range(1, 32)))
    long = wide.unpivot(["y", "m"], [f"flow{i}" for i in range(1, 32)], "which", "q").where("q is not null")
    number = F.substring("which", 5, 2).cast("int")
    valid = long.where(number <= F.dayofmonth(F.last_day(F.make_date("y", "m", F.lit(1)))))
    return valid.select(F.make_date("y", "m", number).alias("day"), F.round("q", 4).alias("flow"))


@query("w02_first_of_hour", "v_obs_hourly", sql="SELECT climate_id, ts, file_seq FROM (SELECT *, row_number() OVER (PARTITION BY climate_id, ts ORDER BY file_seq) AS n FROM v_obs_hourly) WHERE n = 1")
def w02(obs: DataFrame) -> DataFrame:
    return op.first_record(obs, ["climate_id", "ts"]).select("climate_id", "ts", "file_seq")


@query("w03_longest_gap", "v_obs_hourly", sql="WITH " + AXIS + " SELECT climate_id, max_gap FROM comp")
def w03(obs: DataFrame) -> DataFrame:
    return op.completeness(_hours(obs), "climate_id", "ts", "mm").select("climate_id", "max_gap")


@query("m16_hourly_axis", "v_obs_hourly", sql="WITH " + AXIS + " SELECT climate_id, ts, mm FROM g")
def m16(obs: DataFrame) -> DataFrame:
    return _hours(obs).select("climate_id", "ts", "mm")


@query("a06_hourly_completeness", "v_obs_hourly", sql="WITH " + AXIS + """, dup AS (SELECT climate_id, count(*) - count(DISTINCT ts) AS n_duplicates FROM v_obs_hourly GROUP BY 1)
SELECT climate_id, n_expected, n_missing, max_gap, round(coverage, 6) AS coverage, n_duplicates, coverage >= 0.9 AND max_gap <= 24 AS usable FROM comp JOIN dup USING (climate_id)""")
def a06(obs: DataFrame) -> DataFrame:
    dup = obs.groupBy("climate_id").agg((F.count("*") - F.count_distinct("ts")).alias("n_duplicates"))
    x = op.completeness(_hours(obs), "climate_id", "ts", "mm").join(dup, "climate_id")
    return x.select("climate_id", "n_expected", "n_missing", "max_gap", F.round("coverage", 6).alias("coverage"), "n_duplicates", op.hourly_usable().alias("usable"))


@query("a05_daily_completeness", "v_obs_hourly", sql="WITH " + DAYS + """
SELECT climate_id, n_expected, n_missing, max_gap, round(coverage, 6) AS coverage, max_gap <= 3 AND (coverage >= 0.9 OR (coverage >= 0.5 AND n_missing <= 3)) AS usable FROM comp""")
def a05(obs: DataFrame) -> DataFrame:
    x = op.completeness(_daily(obs), "climate_id", "day", "mm")
    return x.select("climate_id", "n_expected", "n_missing", "max_gap", F.round("coverage", 6).alias("coverage"), op.daily_usable().alias("usable"))


@query("a07_rain_totals", "v_obs_hourly", sql="WITH " + DAYS + """, t AS (SELECT climate_id, sum(mm) AS h FROM o GROUP BY 1), y AS (SELECT climate_id, coalesce(sum(mm), 0) AS d FROM dd GROUP BY 1)
SELECT climate_id, round(h, 4) AS hourly_mm, round(d, 4) AS daily_mm, round(CASE WHEN d > 0 THEN abs(h - d) / d * 100 WHEN h = 0 THEN 0 ELSE 100 END, 4) AS mismatch_pct,
       CASE WHEN greatest(h, d) < 1 THEN false WHEN d <= 0 THEN h > 0 ELSE abs(h - d) / d * 100 > 15 END AS disagree FROM t JOIN y USING (climate_id)""")
def a07(obs: DataFrame) -> DataFrame:
    h = _first(obs).groupBy("climate_id").agg(F.sum("mm").alias("h"))
    d = _daily(obs).groupBy("climate_id").agg(F.coalesce(F.sum("mm"), F.lit(0.0)).alias("d"))
    a, b = F.col("h"), F.col("d")
    share = F.when(b > 0, F.abs(a - b) / b * 100).when(a == 0, 0.0).otherwise(100.0)
    return h.join(d, "climate_id").select("climate_id", F.round(a, 4).alias("hourly_mm"), F.round(b, 4).alias("daily_mm"), F.round(share, 4).alias("mismatch_pct"), op.totals_disagree(a, b).alias("disagree"))


@query("t01_daily_stations", "v_obs_hourly", sql="WITH " + DAYS + """,
u AS (SELECT *, CAST(substr(climate_id, 3) AS INT) AS rank, max_gap <= 10 AND coverage >= 0.3 AS usable FROM comp),
st AS (SELECT min(rank) AS stop FROM u WHERE usable AND coverage >= 0.999)
SELECT climate_id, round(coverage, 6) AS coverage FROM u, st WHERE usable AND (st.stop IS NULL OR rank <= st.stop) ORDER BY coverage DESC, rank LIMIT 1""")
def t01(obs: DataFrame) -> DataFrame:
    """The best daily station among candidates in their order: those past the first usable one with 99.9 % are not looked at."""
    x = op.completeness(_daily(obs), "climate_id", "day", "mm").withColumn("rank", F.substring("climate_id", 3, 10).cast("int"))
    x = x.where(op.daily_usable(0.3, 10))
    stop = x.where("coverage >= 0.999").agg(F.min("rank").alias("stop"))
    best = F.min(F.struct((-F.col("coverage")).alias("c"), "rank", "climate_id")).alias("b")
    return x.join(F.broadcast(stop)).where("stop is null or rank <= stop").agg(best).where("b is not null").select("b.climate_id", F.round(-F.col("b.c"), 6).alias("coverage"))


@query("t02_hourly_station", "v_obs_hourly", sql="WITH " + AXIS + " SELECT climate_id, n_missing FROM comp WHERE coverage >= 0.3 AND max_gap <= 48 ORDER BY climate_id LIMIT 1")
def t02(obs: DataFrame) -> DataFrame:
    x = op.completeness(_hours(obs), "climate_id", "ts", "mm").where(op.hourly_usable(0.3, 48))
    return x.agg(F.min(F.struct("climate_id", "n_missing")).alias("b")).where("b is not null").select("b.*")


PLACES = """p AS (SELECT n_nationkey AS aoi_id, n_nationkey % 5 * 2e0 AS x, floor(n_nationkey / 5) * 1e0 AS y, n_nationkey % 3 * 1e0 AS reach FROM nation),
cand AS (SELECT p.aoi_id, c.climate_id, c.coverage, c.max_gap, abs(CAST(substr(climate_id, 3) AS INT) * 2 - x) <= reach AND y < 3 AS inside,
         row_number() OVER (PARTITION BY p.aoi_id ORDER BY pow(CAST(substr(climate_id, 3) AS INT) * 2 - x, 2) + pow(1 - y, 2), climate_id) AS rank FROM p, comp c)"""


def _candidates(nation: DataFrame, found: DataFrame) -> DataFrame:
    """Stations of each area by distance: a station a place along a line, areas beside it, some of which hold stations. Both are few."""
    key = F.col("n_nationkey")
    areas = nation.select(key.cast("long").alias("aoi_id"), (key % 5 * 2.0).alias("x"), F.floor(key / 5).cast("double").alias("y"), (key % 3 * 1.0).alias("reach"))
    at = F.substring("climate_id", 3, 10).cast("int") * 2.0
    near = op.ranked_stations(areas, found.select(F.col("climate_id").alias("station_key"), at.alias("lon"), F.lit(1.0).alias("lat")), k.STATION_TRIES, F.sqrt(F.pow(F.col("lon") - F.col("x"), 2) + F.pow(F.col("lat") - F.col("y"), 2)), 1.0, 1.0, 4.0)
    x = near.withColumnRenamed("station_key", "climate_id").join(areas, "aoi_id").join(found, "climate_id")
    return x.withColumn("inside", (F.abs(at - F.col("x")) <= F.col("reach")) & (F.col("y") < 3))


@query("t01_stations_of_areas", "nation", "v_obs_hourly", sql="WITH " + DAYS + f""", {PLACES}, u AS (SELECT * FROM cand WHERE max_gap <= 10 AND coverage >= 0.3),
own AS (SELECT * FROM u WHERE inside), rest AS (SELECT * FROM u ANTI JOIN own USING (aoi_id) WHERE rank <= 40), st AS (SELECT aoi_id, min(rank) AS stop FROM rest WHERE coverage >= 0.999 GROUP BY 1)
SELECT aoi_id, climate_id, round(coverage, 6) AS coverage, true AS inside FROM own UNION ALL
(SELECT aoi_id, climate_id, round(coverage, 6), false FROM rest LEFT JOIN st USING (aoi_id) WHERE stop IS NULL OR rank <= stop QUALIFY row_number() OVER (PARTITION BY aoi_id ORDER BY coverage DESC, rank) = 1)""")
def t01_areas(nation: DataFrame, obs: DataFrame) -> DataFrame:
    """Daily stations of each area: all usable ones inside it, else the best of the nearest."""
    found = op.completeness(_daily(obs), "climate_id", "day", "mm").withColumn("usable", op.daily_usable(0.3, 10))
    return op.daily_stations(_candidates(nation, found)).withColumn("coverage", F.round("coverage", 6))


@query("t02_station_of_areas", "nation", "v_obs_hourly", sql="WITH " + AXIS + f""", {PLACES}, o2 AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY inside DESC, rank) AS tried FROM cand)
SELECT aoi_id, climate_id, CAST(tried AS INTEGER) AS tried FROM o2 WHERE tried <= 40 AND coverage >= 0.3 AND max_gap <= 48 QUALIFY row_number() OVER (PARTITION BY aoi_id ORDER BY tried) = 1""")
def t02_areas(nation: DataFrame, obs: DataFrame) -> DataFrame:
    """The first usable hourly station of each area, those inside it first."""
    found = op.completeness(_hours(obs), "climate_id", "ts", "mm").withColumn("usable", op.hourly_usable(0.3, 48))
    return op.hourly_stations(_candidates(nation, found))


TIDES = """ev AS (SELECT *, CASE WHEN user_id % 20 < 12 THEN user_id % 3 ELSE user_id % 20 END AS station_key FROM events),
st AS (SELECT DISTINCT station_key, -140 + station_key * 4::DOUBLE AS lon, 46 + station_key::DOUBLE AS lat FROM ev),
lv AS (SELECT station_key, event_id AS file_seq, date_trunc('hour', ts) AS ts, round(value / 100, 3) AS level_m FROM ev WHERE station_key <> 17),
one AS (SELECT station_key, ts, min_by(level_m, file_seq) AS level_m FROM lv GROUP BY ALL),
kn AS (SELECT *, CASE WHEN lon > -59 AND lat > 46.5 THEN -3.5 WHEN lon > -110.5 AND lon < -101.4 AND lat >= 49 AND lat < 60 THEN -6 WHEN lon > -141.1 AND lon < -123.8 AND lat >= 60 THEN -7 ELSE round_even(lon / 15, 0) END AS h,
       CASE WHEN station_key % 4 = 1 THEN 'CGVD2013' WHEN station_key % 4 <> 3 THEN 'CGVD28' END AS datum, CASE WHEN station_key % 4 = 1 THEN -0.5 WHEN station_key % 4 <> 3 THEN -1.87 END::DOUBLE AS offset_m FROM st),
x AS (SELECT kn.*, level_m, ts + INTERVAL (CAST(h * 3600 AS BIGINT)) SECOND AS local_ts FROM one JOIN kn USING (station_key)),
y AS (SELECT * FROM x WHERE CAST(local_ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-12'),
vd AS (SELECT kn.station_key, datum, offset_m, coalesce(n, 0) AS n_hours, 240 AS expected, CASE WHEN datum IS NULL THEN 'no_datum' WHEN coalesce(n, 0) = 0 THEN 'no_data' WHEN n < 0.9 * 240 THEN 'sparse' ELSE 'ok' END AS verdict
       FROM kn LEFT JOIN (SELECT station_key, count(*) AS n FROM y GROUP BY 1) USING (station_key))"""


def _tides(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = F.when(F.col("user_id") % 20 < 12, F.col("user_id") % 3).otherwise(F.col("user_id") % 20)
    stations = events.select(s.alias("station_key")).distinct().select("station_key", (-140 + F.col("station_key") * 4.0).alias("lon"), (46.0 + F.col("station_key")).alias("lat"))
    levels = events.where(s != 17).select(s.alias("station_key"), F.col("event_id").alias("file_seq"), F.date_trunc("hour", "ts").alias("ts"), F.round(F.col("value") / 100, 3).alias("level_m"))
    kind = F.col("station_key") % 4
    codes = F.explode(F.array(*(F.struct(F.lit(c).alias("code"), o.alias("offset_m")) for c, o in (("CGVD2013", F.lit(-0.5)), ("CGVD28", F.when(kind != 1, -1.87)), ("IGLD", F.lit(3.0))))))
    datums = stations.select("station_key", codes.alias("d")).select("station_key", "d.code", "d.offset_m").where(~((F.col("station_key") % 4 == 3) & F.col("code").startswith("CGVD")))
    return op.tide_frames(levels, stations, datums, "2024-01-03", "2024-01-12")


@query("m15_tide_levels", "events", sql=f"WITH {TIDES} SELECT station_key, local_ts, round(level_m + y.offset_m, 3) AS level_m FROM y JOIN vd USING (station_key) WHERE verdict = 'ok'")
def m15_levels(events: DataFrame) -> DataFrame:
    """Hourly levels in local standard time above the preferred datum, of the stations whose record is whole enough."""
    return _tides(events)[0]


@query("m15_tide_verdicts", "events", sql=f"WITH {TIDES} SELECT * FROM vd")
def m15_verdicts(events: DataFrame) -> DataFrame:
    return _tides(events)[1]


WEATHER = "SELECT day, 49::DOUBLE AS lat, CAST(extract(doy FROM day) AS INT) AS doy, (extract(doy FROM day) % 25) - 8::DOUBLE AS tmin, (extract(doy FROM day) % 25) - 8 + obs_cms / 100 AS tmax, CASE WHEN extract(doy FROM day) % 3 = 0 THEN obs_cms / 50 - 2 END AS tmean FROM v_flow_obs"


def _weather(flows: DataFrame) -> DataFrame:
    doy = F.dayofyear("day")
    low = (doy % 25) - F.lit(8.0)
    return flows.select("day", F.lit(49.0).alias("lat"), doy.alias("doy"), low.alias("tmin"), (low + F.col("obs_cms") / 100).alias("tmax"), F.when(doy % 3 == 0, F.col("obs_cms") / 50 - 2).alias("tmean"))


@query("m04_evaporation", "v_flow_obs", sql=f"""
WITH w AS ({WEATHER}), x AS (SELECT *, coalesce(tmean, (tmin + tmax) / 2) AS t, radians(lat) AS phi, 1 + 0.033 * cos(2 * pi() * doy / 365) AS dr, 0.409 * sin(2 * pi() * doy / 365 - 1.39) AS dec FROM w),
y AS (SELECT *, acos(greatest(-1, least(1, -tan(phi) * tan(dec)))) AS ws FROM x),
z AS (SELECT *, 24 * 60 / pi() * 0.0820 * dr * (ws * sin(phi) * sin(dec) + cos(phi) * cos(dec) * sin(ws)) AS ra FROM y)
SELECT day, round(ra, 6) AS ra, round(greatest(0, 0.0023 * 0.408 * ra * (t + 17.8) * sqrt(greatest(0, tmax - tmin))), 6) AS pet_mm FROM z""")
def m04(flows: DataFrame) -> DataFrame:
    w = _weather(flows)
    t = op.mean_temperature(F.col("tmin"), F.col("tmax"), F.col("tmean"))
    pet = op.evaporation(F.col("tmin"), F.col("tmax"), t, F.col("lat"), F.col("doy"))
    return w.select("day", F.round(op.radiation(F.col("lat"), F.col("doy")), 6).alias("ra"), F.round(pet, 6).alias("pet_mm"))


@query("m05_mean_temperature", "v_flow_obs", sql=f"WITH w AS ({WEATHER}) SELECT day, round(coalesce(tmean, (tmin + tmax) / 2), 6) AS t FROM w WHERE coalesce(tmean, (tmin + tmax) / 2) IS NOT NULL")
def m05(flows: DataFrame) -> DataFrame:
    t = op.mean_temperature(F.col("tmin"), F.col("tmax"), F.col("tmean"))
    return _weather(flows).select("day", F.round(t, 6).alias("t")).where("t is not null")


CURVE = """c AS (SELECT station_key, duration_min::DOUBLE AS d0, max(mm_h * duration_min / 60) OVER (PARTITION BY station_key ORDER BY duration_min ROWS UNBOUNDED PRECEDING) AS v0 FROM v_idf WHERE mm_h > 0),
s AS (SELECT *, lead(d0) OVER w AS d1, lead(v0) OVER w AS v1, row_number() OVER w AS piece FROM c WINDOW w AS (PARTITION BY station_key ORDER BY d0))"""
DEPTH = CURVE + """, h AS (SELECT k.station_key, g.h, g.h * 60::DOUBLE AS m FROM (SELECT DISTINCT station_key FROM v_idf) k, (SELECT unnest(range(1, 25)) AS h) g),
dp AS (SELECT h.station_key, h.h, h.m, CASE WHEN d1 IS NULL OR m <= d0 THEN v0 ELSE exp(ln(v0) + (ln(m) - ln(d0)) / (ln(d1) - ln(d0)) * (ln(v1) - ln(v0))) END AS depth
       FROM h JOIN s USING (station_key) WHERE (m >= d0 AND (d1 IS NULL OR m < d1)) OR (piece = 1 AND m < d0)),
bl AS (SELECT station_key, h, m, greatest(0, depth - coalesce(lag(depth) OVER (PARTITION BY station_key ORDER BY m), 0)) AS block, depth FROM dp)"""


@query("w09_monotone_depth", "v_idf", sql="WITH " + CURVE + " SELECT station_key, d0, round(v0, 6) AS depth FROM s")
def w09(idf: DataFrame) -> DataFrame:
    return op.depth_curve(idf).select("station_key", "d0", F.round("v0", 6).alias("depth"))


def _steps(idf: DataFrame) -> DataFrame:
    return idf.select("station_key").distinct().select("station_key", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("h")).select("station_key", (F.col("h") * 60.0).alias("minutes"))


@query("m07_depth_at_duration", "v_idf", sql="WITH " + DEPTH + " SELECT station_key, m AS minutes, round(depth, 6) AS depth FROM dp")
def m07(idf: DataFrame) -> DataFrame:
    return op.depth_at(op.depth_curve(idf), _steps(idf)).withColumn("depth", F.round("depth", 6))


@query("w07_incremental_depth", "v_idf", sql="WITH " + DEPTH + " SELECT station_key, m AS minutes, round(block, 6) AS block FROM bl")
def w07(idf: DataFrame) -> DataFrame:
    d = op.depth_at(op.depth_curve(idf), _steps(idf))
    w = Window.partitionBy("station_key").orderBy("minutes")
    return d.select("station_key", "minutes", F.round(F.greatest(F.lit(0.0), F.col("depth") - F.coalesce(F.lag("depth").over(w), F.lit(0.0))), 6).alias("block"))


@query("w06_alternating_blocks", "v_idf", sql="WITH " + DEPTH + """, r AS (SELECT *, row_number() OVER (PARTITION BY station_key ORDER BY block DESC, m) - 1 AS i FROM bl)
SELECT station_key, CAST(CASE WHEN i = 0 THEN 12 WHEN i % 2 = 1 AND (i + 1) // 2 <= 11 THEN 12 + (i + 1) // 2 ELSE 12 - (i + 1) // 2 END AS INT) AS hour, round(block, 6) AS depth_mm FROM r""")
def w06(idf: DataFrame) -> DataFrame:
    return op.alternating_blocks(idf).select("station_key", F.col("hour").cast("int").alias("hour"), F.round("depth_mm", 6).alias("depth_mm"))


@query("m06_design_intensity", "v_idf", sql="""
WITH s AS (SELECT station_key, duration_min::DOUBLE AS d0, mm_h AS v0, lead(duration_min) OVER w::DOUBLE AS d1, lead(mm_h) OVER w AS v1 FROM v_idf WINDOW w AS (PARTITION BY station_key ORDER BY duration_min)),
k AS (SELECT DISTINCT station_key FROM v_idf), t AS (SELECT station_key, m::DOUBLE AS minutes, least(1440, greatest(5, m))::DOUBLE AS t FROM k, (VALUES (2), (7), (15), (45), (200), (2000)) AS v(m))
SELECT station_key, minutes, round(CASE WHEN station_key % 4 = 0 THEN 20 * pow(t / 60, -0.7) WHEN t = d0 THEN v0 ELSE exp(ln(v0) + (ln(t) - ln(d0)) / (ln(d1) - ln(d0)) * (ln(v1) - ln(v0))) END, 6) AS mm_h
FROM t JOIN s USING (station_key) WHERE t >= d0 AND (d1 IS NULL OR t < d1)""")
def m06(idf: DataFrame) -> DataFrame:
    wanted = idf.select("station_key").distinct().select("station_key", F.explode(F.array(*(F.lit(float(m)) for m in (2, 7, 15, 45, 200, 2000)))).alias("minutes"))
    law = idf.where("station_key % 4 = 0").select("station_key", F.lit(20.0).alias("a"), F.lit(-0.7).alias("b")).distinct()
    return op.design_intensity(idf, wanted, law).withColumn("mm_h", F.round("mm_h", 6))


@query("m18_design_storm_record", "v_idf", sql="WITH " + DEPTH + " SELECT station_key, round(max(depth), 6) AS total_mm, '24h alternating block, station ' || station_key AS label FROM dp GROUP BY station_key")
def m18(idf: DataFrame) -> DataFrame:
    total = op.alternating_blocks(idf).groupBy("station_key").agg(F.round(F.sum("depth_mm"), 6).alias("total_mm"))
    return total.select("station_key", "total_mm", F.concat(F.lit("24h alternating block, station "), F.col("station_key").cast("string")).alias("label"))


@query("m19_forcing_tier", "v_obs_hourly", sql="WITH " + AXIS + """
SELECT climate_id, CASE WHEN climate_id = 'ST0' THEN 'design_storm' WHEN coverage >= 0.9 AND max_gap <= 24 THEN 'hourly' WHEN coverage >= 0.5 THEN 'daily' ELSE 'design_storm' END AS tier,
       CASE WHEN climate_id = 'ST0' THEN 'requested' WHEN coverage >= 0.9 AND max_gap <= 24 THEN 'hourly record is complete' WHEN coverage >= 0.5 THEN 'hourly record has gaps' ELSE 'no usable record' END AS reason FROM comp""")
def m19(obs: DataFrame) -> DataFrame:
    x = op.completeness(_hours(obs), "climate_id", "ts", "mm")
    asked, hourly, daily = F.col("climate_id") == "ST0", op.hourly_usable(), F.col("coverage") >= 0.5
    tier = F.when(asked, "design_storm").when(hourly, "hourly").when(daily, "daily").otherwise("design_storm")
    reason = F.when(asked, "requested").when(hourly, "hourly record is complete").when(daily, "hourly record has gaps").otherwise("no usable record")
    return x.select("climate_id", tier.alias("tier"), reason.alias("reason"))


@query("m15_tide_frame", "v_obs_hourly", sql="WITH " + FIRST + """
SELECT climate_id, ts - INTERVAL 5 HOUR AS local_ts, round(mm + 1.25003, 3) AS level_m FROM o WHERE mm IS NOT NULL AND ts - INTERVAL 5 HOUR >= (SELECT s FROM w)""")
def m15(obs: DataFrame) -> DataFrame:
    """Levels from UTC to local standard time and another datum, clipped to the window."""
    window = obs.agg(F.date_trunc("day", F.min("ts")).alias("s"))
    x = _first(obs).where("mm is not null").withColumn("local_ts", F.col("ts") - F.expr("interval 5 hours"))
    return x.join(F.broadcast(window), F.col("local_ts") >= F.col("s")).select("climate_id", "local_ts", F.round(F.col("mm") + 1.25003, 3).alias("level_m"))


@query("a33_series_step", "v_obs_hourly", sql="WITH " + FIRST + """, d AS (SELECT climate_id, extract(epoch FROM ts - lag(ts) OVER (PARTITION BY climate_id ORDER BY ts)) / 60 AS m FROM o WHERE mm IS NOT NULL)
SELECT climate_id, median(m) AS step_min, CASE WHEN median(m) < 1440 THEN 'sub-daily' ELSE 'daily' END AS kind FROM d WHERE m IS NOT NULL GROUP BY 1""")
def a33(obs: DataFrame) -> DataFrame:
    x = _first(obs).where("mm is not null")
    gap = (F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("climate_id").orderBy("ts")))) / 60
    step = percentiles(x.select("climate_id", gap.alias("m")).where("m is not null"), ["climate_id"], "m", 0.5, "step_min")
    return step.select("climate_id", "step_min", F.when(F.col("step_min") < 1440, "sub-daily").otherwise("daily").alias("kind"))


@query("j11_ranked_stations", "v_idf", "v_node", sql="""
WITH a AS (SELECT aoi_id, avg(lon) AS lon, avg(lat) AS lat FROM v_node GROUP BY 1), s AS (SELECT DISTINCT station_key, lon, lat FROM v_idf),
d AS (SELECT aoi_id, station_key, sqrt(pow((s.lon - a.lon) * 71.5, 2) + pow((s.lat - a.lat) * 111.32, 2)) AS km FROM a, s),
r AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY km, station_key) AS n FROM d)
SELECT aoi_id, station_key, round(km, 6) AS km, CAST(n AS INT) AS rank FROM r WHERE n <= 5""")
def j11(idf: DataFrame, nodes: DataFrame) -> DataFrame:
    """The five nearest stations of each area."""
    a = nodes.groupBy("aoi_id").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"))
    km = v.flat_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    found = op.ranked_stations(a, idf, 5, km, 1 / 71.5, 1 / 111.32, 100.0)
    return found.select("aoi_id", "station_key", F.round("distance", 6).alias("km"), "rank")


@query("j12_nearest_idf_station", "v_idf", "v_node", sql="""
WITH a AS (SELECT aoi_id, avg(lon) AS lon, avg(lat) AS lat FROM v_node GROUP BY 1), s AS (SELECT DISTINCT station_key, lon, lat FROM v_idf)
SELECT aoi_id, min_by(station_key, ((s.lon - a.lon) * cos(radians(a.lat))) * ((s.lon - a.lon) * cos(radians(a.lat))) + (s.lat - a.lat) * (s.lat - a.lat)) AS station_key FROM a, s GROUP BY 1""")
def j12(idf: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nearest station in degrees, longitude shrunk by the area's latitude (up to 75 degrees)."""
    a = nodes.groupBy("aoi_id").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"))
    degrees = F.sqrt(F.pow((F.col("lon") - F.col("x")) * F.cos(F.radians("y")), 2) + F.pow(F.col("lat") - F.col("y"), 2))
    return op.ranked_stations(a, idf, 1, degrees, 4.0, 1.0, 1.0).select("aoi_id", "station_key")


@query("j13_nearest_tide_station", "v_idf", "v_node", sql="""
WITH s AS (SELECT DISTINCT station_key, -123.4 + station_key * 0.01 AS lon, 48.4 + station_key * 0.01 AS lat FROM v_idf WHERE station_key % 3 = 0),
d AS (SELECT node_key, station_key, sqrt(pow((s.lon - n.lon) * 71.5, 2) + pow((s.lat - n.lat) * 111.32, 2)) AS km FROM v_node n, s)
SELECT node_key, min_by(station_key, km) AS station_key, round(min(km), 6) AS km FROM d WHERE km <= 15 GROUP BY node_key""")
def j13(idf: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nearest station with the wanted series within 15 km: latitude bands of 15 km meet by equi-join on the own and the adjacent bands."""
    band = lambda lat: F.floor(lat * 111.32 / 15)
    s = idf.where("station_key % 3 = 0").select("station_key").distinct().select("station_key", (F.lit(-123.4) + F.col("station_key") * 0.01).alias("x"), (F.lit(48.4) + F.col("station_key") * 0.01).alias("y"))
    s = s.withColumn("band", F.explode(F.array(*(band(F.col("y")) + i for i in (-1, 0, 1)))))
    n = nodes.select("node_key", "lon", "lat", band(F.col("lat")).alias("band"))
    d = n.join(s, "band").withColumn("km", v.flat_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))).where("km <= 15")
    return d.groupBy("node_key").agg(F.min_by("station_key", F.struct("km", "station_key")).alias("station_key"), F.round(F.min("km"), 6).alias("km"))


@query("m02_flat_distance", "v_node", sql="SELECT node_key, round(sqrt(pow((lon + 123.35) * 71.5, 2) + pow((lat - 48.45) * 111.32, 2)), 6) AS km FROM v_node")
def m02(nodes: DataFrame) -> DataFrame:
    return nodes.select("node_key", F.round(v.flat_km(F.col("lon"), F.col("lat"), F.lit(-123.35), F.lit(48.45)), 6).alias("km"))


@query("p41_rain_event_rows", "v_obs_hourly", sql="WITH " + FIRST + """, x AS (SELECT climate_id, ts, mm, extract(epoch FROM ts - lag(ts) OVER (PARTITION BY climate_id ORDER BY ts))::BIGINT // 60 AS m FROM o WHERE mm IS NOT NULL),
f AS (SELECT climate_id, min_by(m, ts) AS step_min, count(DISTINCT m) > 1 AS uneven FROM x WHERE m IS NOT NULL GROUP BY 1)
SELECT climate_id, ts, mm, step_min, uneven FROM x JOIN f USING (climate_id)""")
def p41(obs: DataFrame) -> DataFrame:
    """Rows of a rain event with the step of the first interval, and whether steps differ."""
    x = _first(obs).where("mm is not null")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(Window.partitionBy("climate_id").orderBy("ts")))
    x = x.withColumn("m", F.floor(gap / 60))
    f = x.where("m is not null").groupBy("climate_id").agg(F.min_by("m", "ts").alias("step_min"), (F.count_distinct("m") > 1).alias("uneven"))
    return x.join(f, "climate_id").select("climate_id", "ts", "mm", "step_min", "uneven")
