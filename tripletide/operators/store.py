"""The graph store as tables: point reads, searches, writes by copy, exports.

Entities and relations are rows that are never removed: deletion sets ``invalidated_at``. Reads hide invalidated rows unless asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the store's two tables.
ENTITIES = (
    "entity_id string, entity_name string, entity_type string, description string, aliases array<string>, props map<string,string>, embedding array<float>, created_at timestamp_ntz, "
    "invalidated_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, confidence double, validation_status string, source_document string, fingerprint string"
)
RELATIONS = "relation_id string, source_id string, target_id string, relation_type string, confidence double, created_at timestamp_ntz, invalidated_at timestamp_ntz, validation_status string, source_document_id string"


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of a store without content: what clearing one leaves."""
    return spark.createDataFrame([], ENTITIES), spark.createDataFrame([], RELATIONS)


def open_store(spark: SparkSession, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of the snapshot in a folder; an empty store without a folder or where it holds none."""
    from ..sources.sinks import load_snapshot

    got = load_snapshot(spark, path, ["entities", "relations"]) if path else None
    return (got["entities"], got["relations"]) if got else empty(spark)


def valid(df: DataFrame) -> DataFrame:
    return df.where("invalidated_at is null")


def get_entity(entities: DataFrame, entity_id: str, include_invalid: bool = False) -> DataFrame:
    e = entities.where(F.col("entity_id") == entity_id)
    return e if include_invalid else valid(e)


def find_by_name(entities: DataFrame, text: str, kind: str | None = None, how: str = "contains") -> DataFrame:
    """Valid entities whose lower-case name contains (or starts with, or equals) ``text``; the most confident first, then by id."""
    name, x = F.lower("entity_name"), F.lit(text.lower())
    hit = {"contains": name.contains(x), "prefix": name.startswith(x), "exact": name == x}[how]
    e = valid(entities).where(hit)
    if kind:
        e = e.where(F.col("entity_type") == kind)
    return e.orderBy(F.col("confidence").desc_nulls_last(), "entity_id")


def duplicates(entities: DataFrame) -> DataFrame:
    """(entity_id, fingerprint, representative, others): valid entities that share their fingerprint; one row each, not one per pair."""
    e = valid(entities).where("fingerprint is not null")
    g = e.groupBy("fingerprint").agg(F.min("entity_id").alias("representative"), (F.count("*") - 1).alias("others")).where("others > 0")
    return e.join(g, "fingerprint").select("entity_id", "fingerprint", "representative", "others")


def invalidate(entities: DataFrame, which: Column, at: Column, reason: str, status: str = "rejected") -> DataFrame:
    """Copy with the chosen valid rows invalidated: time, status, and the reason appended to the description."""
    now = which & F.col("invalidated_at").isNull()
    return entities.withColumns({
        "description": F.when(now, F.concat(F.coalesce("description", F.lit("")), F.lit(f" [{reason}]"))).otherwise(F.col("description")),
        "validation_status": F.when(now, status).otherwise(F.col("validation_status")),
        "invalidated_at": F.when(now, at).otherwise(F.col("invalidated_at")),
    })


def creatable(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations whose two ends exist and are valid; repeated relations stay, the graph is a multigraph."""
    ids = valid(entities).select("entity_id")
    return relations.join(ids, relations["source_id"] == ids["entity_id"], "left_semi").join(ids, relations["target_id"] == ids["entity_id"], "left_semi")


def find_relations(relations: DataFrame, entities: DataFrame, source: str | None = None, target: str | None = None, kind: str | None = None) -> DataFrame:
    """Valid relations that fit all that is asked (type without regard to case), with both names; ends without an entity keep null."""
    r = valid(relations)
    for c, x in (("source_id", source), ("target_id", target)):
        if x is not None:
            r = r.where(F.col(c) == x)
    if kind is not None:
        r = r.where(F.upper("relation_type") == kind.upper())
    s = entities.select(F.col("entity_id").alias("source_id"), F.col("entity_name").alias("source_name"))
    t = entities.select(F.col("entity_id").alias("target_id"), F.col("entity_name").alias("target_name"))
    return r.join(s, "source_id", "left").join(t, "target_id", "left")


def touching(relations: DataFrame, entity: str) -> DataFrame:
    """Relations that leave or reach an entity."""
    return valid(relations).where((F.col("source_id") == entity) | (F.col("target_id") == entity))


def both_directions(relations: DataFrame) -> DataFrame:
    """(entity_id, relation_id, direction): every relation from both ends; one from an entity to itself comes twice."""
    r = valid(relations)
    out = r.select(F.col("source_id").alias("entity_id"), "relation_id", F.lit("out").alias("direction"))
    return out.union(r.select(F.col("target_id"), "relation_id", F.lit("in")))


def save_triples(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(seq, s_entity, o_entity, s_new, o_new): get or create both ends by fingerprint. A new end gets its fingerprint as id."""
    known = valid(entities).where("fingerprint is not null").groupBy("fingerprint").agg(F.min("entity_id").alias("known"))
    s, t = known.toDF("s_id", "s_known"), known.toDF("o_id", "o_known")
    j = facts.where("pred is not null and s_id is not null and o_id is not null").join(s, "s_id", "left").join(t, "o_id", "left")
    return j.select("seq", F.coalesce("s_known", "s_id").alias("s_entity"), F.coalesce("o_known", "o_id").alias("o_entity"), F.col("s_known").isNull().alias("s_new"), F.col("o_known").isNull().alias("o_new"))


def has_relation(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, known): whether the graph holds an edge of the same names and relation."""
    e = edges.select(F.lower("s_name").alias("s"), F.lower("o_name").alias("t"), "pred").distinct().withColumn("_h", F.lit(True))
    b = batch.select("seq", F.lower("s_name").alias("s"), F.lower("o_name").alias("t"), "pred")
    return b.join(e, ["s", "t", "pred"], "left").select("seq", F.col("_h").isNotNull().alias("known"))


def conflicting(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, n_conflicting): edges of the same subject and relation to a thing of another name. Counts are compared, not pairs: a hot subject costs no more."""
    per = edges.groupBy("s_id", "pred").agg(F.count("*").alias("n_all"))
    same = edges.groupBy("s_id", "pred", F.lower("o_name").alias("o")).agg(F.count("*").alias("n_same"))
    b = batch.select("seq", "s_id", "pred", F.lower("o_name").alias("o"))
    j = b.join(per, ["s_id", "pred"]).join(same, ["s_id", "pred", "o"], "left")
    return j.select("seq", (F.col("n_all") - F.coalesce("n_same", F.lit(0))).alias("n_conflicting")).where("n_conflicting > 0")


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(table_name, total, valid) of both tables."""
    one = lambda df, n: df.agg(F.count("*").alias("total"), F.count_if(F.col("invalidated_at").isNull()).alias("valid")).select(F.lit(n).alias("table_name"), "total", "valid")
    return one(entities, "entities").union(one(relations, "relations"))


def neighbours(entities: DataFrame, relations: DataFrame, start: str, hops: int = 2, limit: int | None = 50) -> DataFrame:
    """(entity_id, hops): valid entities within so many undirected steps, nearest first, at most ``limit``."""
    r = valid(relations)
    e = r.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(r.select("target_id", "source_id")).distinct()
    ids = valid(entities).select(F.col("entity_id").alias("b"))
    e = e.join(ids, "b", "left_semi")
    seen = entities.sparkSession.createDataFrame([(start, 0)], "entity_id string, hops int")
    front = seen
    for h in range(1, hops + 1):
        front = front.select(F.col("entity_id").alias("a")).join(e, "a").select(F.col("b").alias("entity_id")).distinct().join(seen, "entity_id", "left_anti").withColumn("hops", F.lit(h))
        seen = seen.union(front)
    out = seen.where("hops > 0").orderBy("hops", "entity_id")
    return out.limit(limit) if limit is not None else out


def state_at(df: DataFrame, at: Column) -> DataFrame:
    """What the store held at a moment: created by then and not yet invalidated (at the moment itself it is gone)."""
    return df.where((F.col("created_at") <= at) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > at)))


def keyword_search(triples: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(seq, score): accepted triples by how many distinct words of the query they have; predicates count as one word. The best k, then the earlier."""
    words = F.array(*[F.lit(w) for w in dict.fromkeys(query.lower().split())])
    t = triples.where("validation_status = 'accepted'").dropDuplicates(["seq"])
    own = F.split(F.lower(F.concat_ws(" ", "subject_name", "predicate", "object_name")), r"\s+")
    return t.select("seq", F.size(F.array_intersect(own, words)).cast("bigint").alias("score")).where("score > 0").orderBy(F.col("score").desc(), "seq").limit(k)


def export_rows(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the names of both ends, for JSON."""
    return find_relations(relations, entities).select("relation_id", "source_id", "source_name", "relation_type", "target_id", "target_name", "confidence")


def export_cypher(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(line): CREATE statements of valid entities, then of relations whose two ends exist; quotes are escaped, relations without an end are left out."""
    q = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    nodes = valid(entities).select(F.format_string("CREATE (:%s {id: '%s', name: '%s'})", "entity_type", q(F.col("entity_id")), q(F.col("entity_name"))).alias("line"))
    rel = creatable(valid(relations), entities)
    links = rel.select(F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) CREATE (a)-[:%s]->(b)", q(F.col("source_id")), q(F.col("target_id")), "relation_type").alias("line"))
    return nodes.union(links)


def export_plan(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(what, n): entities and relations to export, and relations skipped for an end that is not exported."""
    ok = creatable(valid(relations), entities).agg(F.count("*").alias("n"))
    rows = [("entities", valid(entities).agg(F.count("*").alias("n"))), ("relations", ok)]
    out = None
    for name, df in rows:
        one = df.select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.union(one)
    every = valid(relations).agg(F.count("*").alias("a")).crossJoin(ok)  # two single rows
    return out.union(every.select(F.lit("skipped"), F.col("a") - F.col("n")))


def verify_export(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_left, n_right, equal) of the tables of two stores."""
    out = None
    for name in left:
        a, b = left[name].agg(F.count("*").alias("n_left")), right[name].agg(F.count("*").alias("n_right"))
        one = a.crossJoin(b).select(F.lit(name).alias("table_name"), "n_left", "n_right", (F.col("n_left") == F.col("n_right")).alias("equal"))
        out = one if out is None else out.union(one)
    return out


def first_per(df: DataFrame, keys: list[str], order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in ``order``; rows past them are dropped before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
