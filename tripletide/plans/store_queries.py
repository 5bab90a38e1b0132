"""Queries of the graph store."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from ..operators import store
from ..runtime import table
from .sql import FACTS, with_

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ents(spark, d):
    return table(spark, d, "entities")


def rels(spark, d):
    return table(spark, d, "relations")


@query("SELECT entity_id, entity_type FROM entities WHERE invalidated_at IS NULL")
def store_all_entities(spark, d):
    return store.valid(ents(spark, d)).select("entity_id", "entity_type")


@query("SELECT entity_id, entity_name FROM entities WHERE invalidated_at IS NULL AND entity_id = (SELECT min(entity_id) FROM entities WHERE invalidated_at IS NULL)")
def store_get_entity(spark, d):
    e = ents(spark, d)
    return store.get_entity(e, store.valid(e).agg(F.min("entity_id")).first()[0]).select("entity_id", "entity_name")


@query("SELECT entity_id, confidence FROM entities WHERE invalidated_at IS NULL AND contains(lower(entity_name), 'institut') AND entity_type = 'Organisation'")
def store_find_by_name(spark, d):
    return store.find_by_name(ents(spark, d), "Institut", "Organisation").select("entity_id", "confidence")


@query("SELECT entity_id, confidence FROM entities WHERE invalidated_at IS NULL AND starts_with(lower(entity_name), 'sankt ')")
def store_find_by_prefix(spark, d):
    return store.find_by_name(ents(spark, d), "Sankt ", how="prefix").select("entity_id", "confidence")


@query("""SELECT entity_id, fingerprint, min(entity_id) OVER w AS representative, count(*) OVER w - 1 AS others FROM entities WHERE invalidated_at IS NULL AND fingerprint IS NOT NULL
 WINDOW w AS (PARTITION BY fingerprint) QUALIFY count(*) OVER w > 1""")
def store_duplicates(spark, d):
    return store.duplicates(ents(spark, d))


@query("""SELECT entity_id, CASE WHEN entity_type = 'Ereignis' AND invalidated_at IS NULL THEN coalesce(description, '') || ' [cleanup]' ELSE description END AS description,
 CASE WHEN entity_type = 'Ereignis' AND invalidated_at IS NULL THEN 'rejected' ELSE validation_status END AS validation_status, entity_type = 'Ereignis' OR invalidated_at IS NOT NULL AS gone FROM entities""")
def store_invalidate(spark, d):
    e = store.invalidate(ents(spark, d), F.col("entity_type") == "Ereignis", F.to_timestamp_ntz(F.lit("2026-01-01 00:00:00")), "cleanup")
    return e.select("entity_id", "description", "validation_status", F.col("invalidated_at").isNotNull().alias("gone"))


_VALID = "(SELECT entity_id FROM entities WHERE invalidated_at IS NULL)"


@query(f"SELECT relation_id FROM relations WHERE source_id IN {_VALID} AND target_id IN {_VALID}")
def store_create_relations(spark, d):
    return store.creatable(rels(spark, d), ents(spark, d)).select("relation_id")


@query("""SELECT relation_id, s.entity_name AS source_name, t.entity_name AS target_name FROM relations r LEFT JOIN entities s ON s.entity_id = source_id LEFT JOIN entities t ON t.entity_id = target_id
 WHERE r.invalidated_at IS NULL AND upper(relation_type) = 'LEITET'""")
def store_find_relations(spark, d):
    return store.find_relations(rels(spark, d), ents(spark, d), kind="leitet").select("relation_id", "source_name", "target_name")


@query("SELECT relation_id FROM relations WHERE invalidated_at IS NULL AND (source_id = (SELECT min(source_id) FROM relations) OR target_id = (SELECT min(source_id) FROM relations))")
def store_touching(spark, d):
    r = rels(spark, d)
    return store.touching(r, r.agg(F.min("source_id")).first()[0]).select("relation_id")


@query("""SELECT entity_id, count(*) AS n, count(*) FILTER (dir = 'out') AS n_out FROM (SELECT source_id AS entity_id, 'out' AS dir FROM relations WHERE invalidated_at IS NULL
 UNION ALL SELECT target_id, 'in' FROM relations WHERE invalidated_at IS NULL) GROUP BY entity_id""")
def store_both_directions(spark, d):
    return store.both_directions(rels(spark, d)).groupBy("entity_id").agg(F.count("*").alias("n"), F.count_if(F.col("direction") == "out").alias("n_out"))


@query(with_(FACTS, "known AS (SELECT fingerprint, min(entity_id) k FROM entities WHERE invalidated_at IS NULL GROUP BY 1)") + """SELECT seq, coalesce(s.k, s_id) AS s_entity, coalesce(t.k, o_id) AS o_entity,
 s.k IS NULL AS s_new, t.k IS NULL AS o_new FROM facts LEFT JOIN known s ON s.fingerprint = s_id LEFT JOIN known t ON t.fingerprint = o_id WHERE pred IS NOT NULL AND s_id IS NOT NULL AND o_id IS NOT NULL""")
def store_save_triples(spark, d):
    return store.save_triples(kg.facts(spark, d), ents(spark, d))


@query(with_(FACTS) + "SELECT seq, EXISTS (SELECT 1 FROM edges e WHERE lower(e.s_name) = lower(b.s_name) AND lower(e.o_name) = lower(b.o_name) AND e.pred = b.pred) AS known FROM batch b")
def store_has_relation(spark, d):
    f = kg.facts(spark, d)
    return store.has_relation(kg.batch(f), kg.edges(f))


@query(with_(FACTS) + "SELECT b.seq, count(*) AS n_conflicting FROM batch b JOIN edges e ON e.s_id = b.s_id AND e.pred = b.pred AND lower(e.o_name) <> lower(b.o_name) GROUP BY b.seq")
def store_conflicting_relations(spark, d):
    f = kg.facts(spark, d)
    return store.conflicting(kg.batch(f), kg.edges(f))


@query("""SELECT 'entities' AS table_name, count(*) AS total, count(*) FILTER (invalidated_at IS NULL) AS valid FROM entities UNION ALL
 SELECT 'relations', count(*), count(*) FILTER (invalidated_at IS NULL) FROM relations""")
def store_stats(spark, d):
    return store.stats(ents(spark, d), rels(spark, d))


@query(f"""WITH r AS (SELECT source_id a, target_id b FROM relations WHERE invalidated_at IS NULL), e AS (SELECT a, b FROM r UNION SELECT b, a FROM r), v AS (SELECT * FROM e WHERE b IN {_VALID}),
 s AS (SELECT min(source_id) x FROM relations WHERE invalidated_at IS NULL), one AS (SELECT DISTINCT b FROM v, s WHERE a = x AND b <> x), two AS (SELECT DISTINCT v.b FROM one JOIN v ON v.a = one.b, s WHERE v.b <> x AND v.b NOT IN (SELECT b FROM one))
 SELECT * FROM (SELECT b AS entity_id, 1 AS hops FROM one UNION ALL SELECT b, 2 FROM two) ORDER BY hops, entity_id LIMIT 50""")
def store_neighbours(spark, d):
    r = rels(spark, d)
    return store.neighbours(ents(spark, d), r, store.valid(r).agg(F.min("source_id")).first()[0])


@query("SELECT entity_id FROM entities WHERE created_at <= TIMESTAMP '2024-06-01' AND (invalidated_at IS NULL OR invalidated_at > TIMESTAMP '2024-06-01')")
def store_state_at(spark, d):
    return store.state_at(ents(spark, d), F.to_timestamp_ntz(F.lit("2024-06-01 00:00:00"))).select("entity_id")


@query(r"""SELECT seq, len(list_intersect(list_distinct(regexp_split_to_array(lower(concat_ws(' ', subject_name, predicate, object_name)), '\s+')), ['verlag', 'leitet', 'institut', 'für', 'messtechnik'])) AS score
 FROM (SELECT DISTINCT * FROM triples WHERE validation_status = 'accepted') WHERE score > 0 ORDER BY score DESC, seq LIMIT 20""")
def store_keyword_search(spark, d):
    t = table(spark, d, "triples", "seq", "subject_name", "predicate", "object_name", "validation_status")
    return store.keyword_search(t, "Verlag leitet Institut für Messtechnik")


@query("""SELECT relation_id, source_id, s.entity_name AS source_name, relation_type, target_id, t.entity_name AS target_name, r.confidence FROM relations r
 LEFT JOIN entities s ON s.entity_id = source_id LEFT JOIN entities t ON t.entity_id = target_id WHERE r.invalidated_at IS NULL""")
def export_json_rows(spark, d):
    return store.export_rows(rels(spark, d), ents(spark, d))


_Q = lambda c: f"replace(replace(coalesce({c}, ''), '\\', '\\\\'), '''', '\\''')"


@query(f"""SELECT format('CREATE (:{{}} {{{{id: ''{{}}'', name: ''{{}}''}}}})', entity_type, {_Q("entity_id")}, {_Q("entity_name")}) AS line FROM entities WHERE invalidated_at IS NULL
 UNION ALL SELECT format('MATCH (a {{{{id: ''{{}}''}}}}), (b {{{{id: ''{{}}''}}}}) CREATE (a)-[:{{}}]->(b)', source_id, target_id, relation_type) FROM relations
 WHERE invalidated_at IS NULL AND source_id IN {_VALID} AND target_id IN {_VALID}""")
def export_cypher_text(spark, d):
    return store.export_cypher(rels(spark, d), ents(spark, d))


@query(f"""WITH ok AS (SELECT count(*) n FROM relations WHERE invalidated_at IS NULL AND source_id IN {_VALID} AND target_id IN {_VALID})
 SELECT 'entities' AS what, count(*) AS n FROM entities WHERE invalidated_at IS NULL UNION ALL SELECT 'relations', n FROM ok
 UNION ALL SELECT 'skipped', (SELECT count(*) FROM relations WHERE invalidated_at IS NULL) - n FROM ok""")
def export_plan(spark, d):
    return store.export_plan(rels(spark, d), ents(spark, d))


@query("""SELECT 'entities' AS table_name, (SELECT count(*) FROM entities) AS n_left, (SELECT count(*) FROM entities WHERE invalidated_at IS NULL) AS n_right,
 (SELECT count(*) FROM entities WHERE invalidated_at IS NOT NULL) = 0 AS equal UNION ALL
 SELECT 'relations', (SELECT count(*) FROM relations), (SELECT count(*) FROM relations WHERE invalidated_at IS NULL), (SELECT count(*) FROM relations WHERE invalidated_at IS NOT NULL) = 0""")
def export_verification(spark, d):
    e, r = ents(spark, d), rels(spark, d)
    return store.verify_export({"entities": e, "relations": r}, {"entities": store.valid(e), "relations": store.valid(r)})
