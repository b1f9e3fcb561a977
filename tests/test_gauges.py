"""The gauge export covers all stations that it had before gauges were moved off the area's edge."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchwork.plans import evaluate


def test_stations_on_the_former_edge_stay(spark):
    i = F.col("id")
    days = spark.range(40).select(i.alias("station_key"), (F.lit(-124.95) + i).alias("lon"), (F.lit(44.05) + i % 8).alias("lat"), F.lit("1996-06-01").cast("date").alias("day"), F.lit(1.0).alias("obs_cms"))
    assert sorted(r.station_key for r in evaluate.s19(days).collect()) == [n for n in range(15, 36) if 1 <= n % 8 <= 6]
