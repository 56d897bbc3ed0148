"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphweft.queries import evaluation, general, graph, surfaces, tables


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**graph.QUERIES, **tables.QUERIES, **general.QUERIES, **surfaces.QUERIES, **evaluation.QUERIES}


def oracles() -> dict[str, str]:
    return {**graph.ORACLES, **tables.ORACLES, **general.ORACLES, **surfaces.ORACLES, **evaluation.ORACLES}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return graph.QUERIES["kg_hop2_count"](spark, folder)
