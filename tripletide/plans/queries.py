"""Registry of the core queries: name -> function(spark, sf_dir) -> DataFrame, and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cascade_queries, corpus_queries, experiment_queries, graph_queries, metric_queries, rule_queries, source_queries, store_queries, stream_queries, study_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (rule_queries, store_queries, text_queries, graph_queries, cascade_queries, corpus_queries, metric_queries, stream_queries, experiment_queries, source_queries, study_queries)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.SQL
    return out
