"""All registered queries: name to callable, name to SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import aggregates, joins, measurement, records, scalars, similarity, sources, state, windows

MODULES = [sources, aggregates, windows, joins, scalars, state, similarity, measurement, records]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a16_cut_structure_distribution"](spark, sf_dir)
