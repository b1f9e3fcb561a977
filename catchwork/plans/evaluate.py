"""Queries that score results against observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchwork.operators import forcing as op
from catchwork.plans.registry import query

DAYS = "d AS (SELECT day, obs_cms AS o, sim_cms AS s FROM v_flow_obs JOIN v_flow_sim USING (day))"


def scores(days: DataFrame, by: list[str]) -> DataFrame:
    """Days, Nash-Sutcliffe efficiency, percent bias, means and maxima of (o, s). Sums of squares and products suffice, so one aggregation does."""
    n, so, ss = F.count("*"), F.sum("o"), F.sum("s")
    error = F.sum(F.pow(F.col("s") - F.col("o"), 2))
    spread = F.var_pop("o") * n
    return days.groupBy(*by).agg(n.alias("n_days"), F.round(1 - error / F.nullif(spread, F.lit(0.0)), 4).alias("nse"), F.round(100 * (ss - so) / so, 4).alias("pbias"), F.round(F.avg("o"), 4).alias("mean_obs"), F.round(F.avg("s"), 4).alias("mean_sim"), F.round(F.max("o"), 3).alias("max_obs"), F.round(F.max("s"), 3).alias("max_sim"))


SCORE = "count(*) AS n_days, round(1 - sum(pow(s - o, 2)) / nullif(var_pop(o) * count(*), 0), 4) AS nse, round(100 * (sum(s) - sum(o)) / sum(o), 4) AS pbias, round(avg(o), 4) AS mean_obs, round(avg(s), 4) AS mean_sim, round(max(o), 3) AS max_obs, round(max(s), 3) AS max_sim"


def _days(obs: DataFrame, sim: DataFrame) -> DataFrame:
    return obs.join(sim, "day").select("day", F.col("obs_cms").alias("o"), F.col("sim_cms").alias("s"))


@query("a34_observed_vs_simulated", "v_flow_obs", "v_flow_sim", sql=f"WITH {DAYS} SELECT extract(year FROM day)::INT AS year, {SCORE} FROM d GROUP BY 1")
def a34(obs: DataFrame, sim: DataFrame) -> DataFrame:
    return scores(_days(obs, sim).withColumn("year", F.year("day")), ["year"])


@query("a35_wet_and_dry_days", "v_flow_obs", "v_flow_sim", sql=f"WITH {DAYS} SELECT extract(month FROM day)::INT AS month, o > 150 AS wet, count(*) AS n_days, round(avg(o), 4) AS obs, round(avg(s), 4) AS sim FROM d GROUP BY ALL")
def a35(obs: DataFrame, sim: DataFrame) -> DataFrame:
    return _days(obs, sim).groupBy(F.month("day").alias("month"), (F.col("o") > 150).alias("wet")).agg(F.count("*").alias("n_days"), F.round(F.avg("o"), 4).alias("obs"), F.round(F.avg("s"), 4).alias("sim"))


@query("a36_daily_resample", "v_obs_hourly", sql="SELECT climate_id, CAST(ts AS DATE) AS day, round(avg(precip_raw), 6) AS mean FROM v_obs_hourly GROUP BY ALL")
def a36(obs: DataFrame) -> DataFrame:
    return obs.groupBy("climate_id", F.to_date("ts").alias("day")).agg(F.round(F.avg("precip_raw"), 6).alias("mean"))


FILL = """e AS (SELECT up_key AS n, nullif(inv_up, 0) AS i FROM v_raw_pipe UNION ALL SELECT dn_key, CASE WHEN inv_dn > -90 THEN inv_dn END FROM v_raw_pipe),
f AS (SELECT v.aoi_id, n.n, n.i FROM (SELECT n, min(i) AS i FROM e GROUP BY 1) n JOIN v_node v ON v.node_key = n.n)"""


@query("a38_data_tiers", "v_raw_pipe", "v_node", sql=f"WITH {FILL} SELECT aoi_id, round(1 - count(CASE WHEN n % 5 <> aoi_id THEN i END) / count(*)::DOUBLE, 6) AS fill_share, CASE WHEN 1 - count(CASE WHEN n % 5 <> aoi_id THEN i END) / count(*)::DOUBLE <= 0.10 THEN 'A' WHEN 1 - count(CASE WHEN n % 5 <> aoi_id THEN i END) / count(*)::DOUBLE <= 0.35 THEN 'B' ELSE 'C' END AS tier FROM f GROUP BY 1")
def a38(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Data tier of each area by the share of nodes whose invert had to be filled."""
    from catchwork.operators.ingest import ends

    e = ends(pipes).withColumn("i", F.when(F.col("side") == "up", F.nullif("invert", F.lit(0.0))).when(F.col("invert") > -90, F.col("invert")))
    n = e.groupBy("node_key").agg(F.min("i").alias("i")).join(nodes.select("node_key", "aoi_id"), "node_key")
    share = 1 - F.count(F.when(F.col("node_key") % 5 != F.col("aoi_id"), F.col("i"))) / F.count("*")
    x = n.groupBy("aoi_id").agg(share.alias("q"))
    return x.select("aoi_id", F.round("q", 6).alias("fill_share"), F.when(F.col("q") <= 0.10, "A").when(F.col("q") <= 0.35, "B").otherwise("C").alias("tier"))


@query("a40_fleet_table", "v_raw_pipe", "v_node", sql="""WITH p AS (SELECT v.aoi_id, p.* FROM v_raw_pipe p JOIN v_node v ON v.node_key = p.up_key)
SELECT aoi_id, count(*) AS n_pipes, count(DISTINCT name) AS n_names, count(*) FILTER (WHERE up_key = dn_key) AS n_loops, round(100.0::DOUBLE * count(*) FILTER (WHERE inv_up = 0) / count(*), 4) AS pct_missing, CASE WHEN count(*) > 9000 THEN 'large' ELSE 'ok' END AS status FROM p GROUP BY 1""")
def a40(pipes: DataFrame, nodes: DataFrame) -> DataFrame:
    p = pipes.join(nodes.select(F.col("node_key").alias("up_key"), "aoi_id"), "up_key")
    n = F.count("*")
    return p.groupBy("aoi_id").agg(n.alias("n_pipes"), F.count_distinct("name").alias("n_names"), F.count_if(F.col("up_key") == F.col("dn_key")).alias("n_loops"), F.round(100 * F.count_if(F.col("inv_up") == 0) / n, 4).alias("pct_missing"), F.when(n > 9000, "large").otherwise("ok").alias("status"))


@query("s19_gauge_export", "v_gauge", sql="SELECT station_key, day, round(obs_cms, 1) AS obs_cms FROM v_gauge WHERE lon BETWEEN -110 AND -89.5 AND lat BETWEEN 45 AND 50.5 AND day BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def s19(obs: DataFrame) -> DataFrame:
    """Days of the gauges inside an area. No gauge lies on its edge."""
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-110.0, 45.0), (-89.5, 45.0), (-89.5, 50.5), (-110.0, 50.5), (-110.0, 45.0))))
    stations = obs.select("station_key", F.col("lon").alias("x"), F.col("lat").alias("y")).distinct()
    found = op.gauge_days(obs, stations, ring, "1996-01-01", "1997-06-30")
    return found.select("station_key", "day", F.round("obs_cms", 1).alias("obs_cms"))
