"""Queries of this subpackage, one for each of its operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catchwork.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(q, name) for name in sorted(dir(q)) if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from catchwork.llm.oracles import ORACLES

    return dict(ORACLES)
