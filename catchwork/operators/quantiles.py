"""Exact percentiles of groups of any size: counts of value ranges tell which range holds the wanted rank, until few values are left in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catchwork.frames import discard, written

RANGES = 512  # into which a group's range of values is cut in a round
FEW = 4096  # values that are left to sort
SALTS = 64


def percentiles(rows: DataFrame, keys: list[str], value: str, share: float, out: str = "value") -> DataFrame:
    """(*keys, out): the percentile of each group's values, with linear interpolation between neighbours, as Spark's percentile gives it; null where all values are null.

    No group's values meet in one task. A round counts each group's values by range, cut by cut of the range that holds the wanted rank, and keeps the
    values of that range only, so a group with half of all rows is read a few times and sorted never. Keys may be null; NaN counts
    as the largest value.
    """
    x = rows.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null")
    named = x.withColumn("k1", F.xxhash64(*keys, *(F.isnull(c) for c in keys))).withColumn("k2", F.xxhash64(F.lit(1), *keys, *(F.isnull(c) for c in keys)))
    key = ["k1", "k2"]
    total = named.groupBy(*key).agg(*(F.first(c).alias(c) for c in keys), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    total = written(total, "quantile_groups")
    place = (F.col("n") - 1) * F.lit(float(share))
    both = total.withColumn("r", F.explode(F.array(F.floor(place), F.ceil(place)))).distinct()
    # the wanted rank r, from 0, among the values from lo to hi; before: how many values are less than lo
    goal = written(both.select(*key, "r", "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("held")), "quantile_goals")
    rest = written(named.select(*key, "v", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")), "quantile_values")
    while True:
        big = goal.where(f"held > {FEW} and lo < hi")
        if big.isEmpty():
            break
        wide = big.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # so a group's rows are joined in many tasks
        width = (F.col("hi") - F.col("lo")) / RANGES
        cut = F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor((F.col("v") - F.col("lo")) / width))).cast("int")
        at = rest.join(wide, [*key, "salt"]).where("v between lo and hi").withColumn("cut", F.when(width > 0, cut).otherwise(F.when(F.col("v") < F.col("hi"), 0).otherwise(1)))
        counts = at.groupBy(*key, "r", "cut").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("z"), F.first("before").alias("before"))
        order = Window.partitionBy(*key, "r").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
        upto = counts.withColumn("b", F.col("before") + F.coalesce(F.sum("c").over(order), F.lit(0)))
        one = upto.where("r >= b and r < b + c").select(*key, "r", F.col("a").alias("lo"), F.col("z").alias("hi"), F.col("b").alias("before"), F.col("c").alias("held"))
        new = written(one.unionByName(goal.where(f"held <= {FEW} or lo = hi")), "quantile_goals")
        span = new.where("lo < hi").groupBy(*key).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # two at most
        span = span.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        kept = written(rest.join(span, [*key, "salt"]).where(F.exists("spans", lambda s: F.col("v").between(s["lo"], s["hi"]))).select(*key, "v", "salt"), "quantile_values")
        discard(goal, rest)
        goal, rest = new, kept
    near = rest.join(goal.where("lo < hi"), key).where("v between lo and hi")
    rank = F.row_number().over(Window.partitionBy(*key, "r").orderBy("v")) - 1 + F.col("before")  # FEW rows at most
    found = near.withColumn("at", rank).where("at = r").select(*key, "r", "v").unionByName(goal.where("lo = hi").select(*key, "r", F.col("lo").alias("v")))
    ends = found.groupBy(*key).agg(F.min(F.struct("r", "v")).alias("a"), F.max(F.struct("r", "v")).alias("z"))
    part = place - F.floor(place)
    x = total.join(ends, key).withColumn(out, F.when(F.col("a.r") == F.col("z.r"), F.col("a.v")).otherwise((1 - part) * F.col("a.v") + part * F.col("z.v")))
    every = rows.select(*keys).distinct()
    same = [every[c].eqNullSafe(x[c]) for c in keys]
    return every.join(x, same, "left").select(*(every[c] for c in keys), x[out])
