"""The queries of this subpackage and the SQL that states them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import canonical, components, dedup, mixture, neighbours, quality, survivor, tokenize, variants
from .sql import SQL

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.found(table(spark, d, "entities", "entity_id", "embedding"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "triples", "seq", "batch_id", "subject_name", "subject_type", "predicate", "object_name", "object_type", "validation_status")
    return dedup.found(t, *canonical.tables(spark, d)[1:])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "entities"), table(spark, d, "source_profiles", "source_id", "reliability_score")).select("fingerprint", "field_name", "entity_id")


def p3_currency(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(table(spark, d, "entities"), table(spark, d, "source_profiles", "source_id", "reliability_score"), undated="learned").select("fingerprint", "field_name", "entity_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(*canonical.tables(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.found(table(spark, d, "entities", "entity_id", "entity_name", "entity_type", "aliases"), table(spark, d, "entity_variants", "variant_id", "variant_name", "entity_type"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.found(table(spark, d, "conflict_sets", "conflict_type", "conflicting_items"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode(table(spark, d, "documents", "doc_id", "text"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mixture_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mix(table(spark, d, "documents", "doc_id", "source", "text"), table(spark, d, "mixture_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(table(spark, d, "documents", "doc_id", "text", "lang"), table(spark, d, "common_words", "word"))


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.statistics(table(spark, d, "documents", "doc_id", "text", "lang"), table(spark, d, "common_words", "word"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_currency, p4_found, p5_found, p6_found, p8_ids, p9_mixture, p9_shares, p10_found, p10_statistics)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
