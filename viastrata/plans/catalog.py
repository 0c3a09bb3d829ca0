"""All queries of the library and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import file_queries, graph_queries, raster_queries, scalar_queries, stream_queries
from .registry import ORACLES, QUERIES, Query

__all__ = ["file_queries", "flagship", "graph_queries", "oracle_sql", "queries", "raster_queries", "scalar_queries", "stream_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_queries.d02_run_scenarios(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
