"""Views of the knowledge graph over the tables: facts, edges and nodes, keyed by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ontology as o
from .runtime import table


def fingerprint(name: Column, kind: Column) -> Column:
    """Twelve hex digits from the lower-case name and the type; null if either is."""
    return F.substring(F.md5(F.concat(F.lower(name), F.lit(":"), kind)), 1, 12)


def normal_predicate(p: Column) -> Column:
    """Upper case (ß as SS), spaces as underscores, without white space around; blank counts as null."""
    bare = F.regexp_replace(p, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    x = F.upper(F.replace(F.replace(bare, F.lit(" "), F.lit("_")), F.lit("ß"), F.lit("ss")))
    return F.when(x != "", x)


def normal_type(t: Column) -> Column:
    pairs = [F.lit(x) for kv in o.TYPE_ALIASES.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), t), t)


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Triples as facts, each delivered row once, with both ends keyed by fingerprint and the relation in canonical form.

    (seq, batch_id, s_name, s_type, s_id, pred, o_name, o_type, o_id, conf, doc, text, status)
    """
    t = table(spark, d, "triples", "seq", "batch_id", "subject_name", "subject_type", "predicate", "object_name", "object_type", "extraction_confidence", "source_document_id", "source_text", "validation_status")
    t = t.dropDuplicates(["seq"])
    # 20 relations in two languages, fixed.
    names = table(spark, d, "relation_catalog", "relation_de", "relation_en")
    p = normal_predicate(F.col("predicate"))
    t = t.withColumn("_p", p).join(F.broadcast(names), F.col("_p") == F.col("relation_en"), "left")
    st, ot = normal_type(F.col("subject_type")), normal_type(F.col("object_type"))
    return t.select(
        "seq", "batch_id", F.col("subject_name").alias("s_name"), st.alias("s_type"), fingerprint(F.col("subject_name"), st).alias("s_id"), F.coalesce("relation_de", "_p").alias("pred"),
        F.col("object_name").alias("o_name"), ot.alias("o_type"), fingerprint(F.col("object_name"), ot).alias("o_id"), F.col("extraction_confidence").alias("conf"),
        F.col("source_document_id").alias("doc"), F.col("source_text").alias("text"), F.col("validation_status").alias("status"),
    )


def edges(f: DataFrame) -> DataFrame:
    """The graph that batches are checked against: what history states and nobody rejected."""
    ok = (F.col("batch_id") == 0) & (F.coalesce("status", F.lit("")) != "rejected") & F.col("pred").isNotNull() & F.col("s_id").isNotNull() & F.col("o_id").isNotNull()
    return f.where(ok)


def batch(f: DataFrame) -> DataFrame:
    """New facts that name both ends and a relation."""
    return f.where("batch_id > 0 and pred is not null and s_id is not null and o_id is not null")
