"""Joins are broadcast by measured sizes, not by those of compressed files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchwork.frames import MEASURED, STATIC, measured_joins, written
from catchwork.plans import registry

registry.load()


def test_street_samples_are_not_broadcast_by_file_size(spark):
    """120,000 streets are a few kilobytes as a file, and their samples come from an explode that Spark takes for no larger."""
    plan = registry.QUERIES["j17_street_sample_labels"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert spark.conf.get(STATIC) == "-1" and int(spark.conf.get(MEASURED).removesuffix("b")) > 0


def _broadcasts(spark):
    """How many broadcasts the session's queries have made."""
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return sum(found.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0].count("BroadcastExchange") for i in range(found.size()))


def test_written_rounds_do_not_broadcast(spark):
    """A broadcast of a few rows takes a page of the driver's memory, and rounds make dozens."""
    session = measured_joins(spark)
    kept = session.conf.get(MEASURED)
    few = session.range(20).select(F.col("id").alias("a"), (F.col("id") % 3).alias("b")).groupBy("a", "b").count()
    many = session.range(500).select((F.col("id") % 40).alias("a"), (F.col("id") % 3).alias("b"))
    before = _broadcasts(session)
    assert written(many.join(few, ["a", "b"]), "round").count() == sum(i % 40 < 20 and i % 40 % 3 == i % 3 for i in range(500))
    assert _broadcasts(session) == before
    assert session.conf.get(MEASURED) == kept
