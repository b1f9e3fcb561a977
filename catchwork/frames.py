"""Helpers that several operators share: written intermediate tables and distributed prefix sums."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary one; a cluster must name one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="catchwork-"))
        found = context.getCheckpointDir()
    path = spark._jvm.org.apache.hadoop.fs.Path(found)  # with the scheme of Spark's own file system, which other readers need
    full = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", full).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/catchwork/{uuid.uuid4().hex}/{name}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, and gives Spark exact sizes for its join choices.

    Shuffle files of the job go when it is done, not when the driver next collects garbage. The setting for that belongs to the session, so
    queries that other threads run in it meanwhile lose their own shuffle files at their own end, too; no result depends on it.

    In a session of measured_joins the job broadcasts by hints alone: both sides are shuffled before a size is measured, so a broadcast saves a sort, but each one
    takes a page of up to 64 MB of the driver, however few rows it has, and rounds make dozens.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    own = {CLEANUP: "true"} | ({MEASURED: "-1"} if spark.conf.get(STATIC) == "-1" else {})
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `written` made and that nothing reads any more, such as the last round but one of a loop. Others are left alone."""
    for table in tables:
        path = getattr(table, "written_path", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()  # new_path gives each table a folder of its own
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def measured_joins(spark: SparkSession) -> SparkSession:
    """The session, which from now on broadcasts a join's side only by its size as measured in a shuffle, up to the threshold that it had.

    Spark plans by the size of compressed files, which says little of the rows: samples of a street come out of one row of a few bytes, pairs and keys pack
    to a tenth and less. Sides that look small then fill the driver. Own broadcast() hints count as before; a session without adaptive execution or broadcasts is left alone.
    """
    most = spark.conf.get(STATIC)
    if most != "-1" and spark.conf.get("spark.sql.adaptive.enabled") == "true":
        if spark.conf.get(MEASURED, None) is None:
            spark.conf.set(MEASURED, most)
        spark.conf.set(STATIC, "-1")
    return spark


def bucket_bits(n_rows: int, rows_per_bucket: int = 200, least: int = 4, most: int = 20) -> int:
    """How many leading hash bits cut n_rows into buckets of about rows_per_bucket."""
    return max(least, min(most, math.ceil(math.log2(max(1, n_rows) / rows_per_bucket + 1))))


def prefix_sum(df: DataFrame, keys: list[str], order_hash: str, ties: list[str], value: Column, out: str, n_rows: int) -> DataFrame:
    """df with out = the sum of value over this row and those before it within keys, in the order of order_hash, then ties.

    order_hash is a non-negative long below 2**60, spread evenly. Its leading bits cut every key into buckets; bucket totals are
    summed first, so a key with a third of all rows is still dealt over many tasks. Rows equal in all of keys, order_hash
    and ties get their sums in any order.
    """
    b, v, base, k1, k2 = (f"_{out}_{x}" for x in ("bucket", "value", "base", "k1", "k2"))
    rows = df.withColumn(b, F.shiftright(order_hash, 60 - bucket_bits(n_rows))).withColumn(v, value)
    earlier = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, b).agg(F.sum(v).alias("_t")).select(*keys, b, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias(base))
    # the join and the window deal rows by a 128-bit hash of key and bucket, so that no earlier partitioning by key alone serves
    part = [*keys, *(F.isnull(k) for k in keys), b]
    named = lambda x: x.withColumn(k1, F.xxhash64(*part)).withColumn(k2, F.xxhash64(F.lit(1), *part))
    joined = named(rows).join(named(totals).select(k1, k2, base), [k1, k2])
    within = Window.partitionBy(k1, k2).orderBy(order_hash, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col(base) + F.sum(v).over(within)).drop(b, v, base, k1, k2)


def ranked(df: DataFrame, keys: list[Column], order: list[str], out: str) -> DataFrame:
    """df with out = 1, 2 ... within keys in the order of the named columns, nulls first. Equal rows get their numbers in any order.

    Ranges of keys and order are dealt over tasks, numbered each by itself, and moved up by what the earlier ranges of their key hold, so a key
    with a third of all rows spans many tasks.
    """
    k1, k2, p, base = (f"_{out}_{x}" for x in ("key1", "key2", "part", "base"))
    both = [*keys, *(F.isnull(k) for k in keys)]
    keyed = df.withColumn(k1, F.xxhash64(*both)).withColumn(k2, F.xxhash64(F.lit(1), *both))
    rows = written(keyed.repartitionByRange(k1, k2, *order).withColumn(p, F.spark_partition_id()), "ranked")
    earlier = Window.partitionBy(k1, k2).orderBy(p).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = rows.groupBy(k1, k2, p).agg(F.count("*").alias("_n"))
    bases = counts.select(k1, k2, p, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias(base))
    within = F.row_number().over(Window.partitionBy(k1, k2, p).orderBy(*order))
    return rows.join(bases, [k1, k2, p]).withColumn(out, F.col(base) + within).drop(k1, k2, p, base)
