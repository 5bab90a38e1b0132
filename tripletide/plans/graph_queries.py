"""Queries of graph statistics, anomalies and provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from .. import ontology as o
from ..operators import anomaly, provenance
from ..runtime import table
from .rule_queries import parts
from .sql import FACTS, inlist, lit, with_

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DEG = "deg AS (SELECT node, sum(o) AS out_degree, sum(i) AS in_degree FROM (SELECT s_id AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT o_id, 0, 1 FROM edges) GROUP BY node)"
STAT = """stat AS (SELECT count(*) AS n_nodes, coalesce(avg(out_degree) FILTER (out_degree > 0), 0) AS out_mean, coalesce(nullif(stddev_pop(out_degree) FILTER (out_degree > 0), 0), 1) AS out_std,
 coalesce(avg(in_degree) FILTER (in_degree > 0), 0) AS in_mean, coalesce(nullif(stddev_pop(in_degree) FILTER (in_degree > 0), 0), 1) AS in_std FROM deg)"""
TYPES = "tc AS (SELECT type, pred, count(*) AS n FROM (SELECT s_type AS type, pred FROM edges UNION ALL SELECT o_type, pred FROM edges) WHERE type IS NOT NULL GROUP BY ALL)"
PAIRS = "pc AS (SELECT pred, s_type, o_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY pred) AS n_pred FROM edges GROUP BY pred, s_type, o_type)"
COMMON = """com AS (SELECT b.*, coalesce(ds.out_degree, 0) AS out_degree, coalesce(dt.in_degree, 0) AS in_degree, coalesce(np.n_pred, 0) AS n_pred, coalesce(ts.n, 0) AS n_s, coalesce(tt.n, 0) AS n_o, coalesce(p.n, 0) AS n_pair, stat.*
 FROM batch b CROSS JOIN stat LEFT JOIN deg ds ON ds.node = b.s_id LEFT JOIN deg dt ON dt.node = b.o_id LEFT JOIN (SELECT DISTINCT pred, n_pred FROM pc) np ON np.pred = b.pred
 LEFT JOIN tc ts ON ts.type = b.s_type AND ts.pred = b.pred LEFT JOIN tc tt ON tt.type = b.o_type AND tt.pred = b.pred LEFT JOIN pc p ON p.pred = b.pred AND p.s_type = b.s_type AND p.o_type = b.o_type)"""
ALL = (FACTS, DEG, STAT, TYPES, PAIRS, COMMON)


@query(with_(FACTS, DEG) + "SELECT node, out_degree, in_degree FROM deg")
def graph_degrees(spark, d):
    return anomaly.degrees(parts(spark, d)[1])


@query(with_(FACTS, DEG, STAT) + "SELECT n_nodes, round(out_mean, 6) out_mean, round(out_std, 6) out_std, round(in_mean, 6) in_mean, round(in_std, 6) in_std FROM stat")
def graph_statistics(spark, d):
    s = anomaly.statistics(parts(spark, d)[1])
    return s.select("n_nodes", *[F.round(c, 6).alias(c) for c in ("out_mean", "out_std", "in_mean", "in_std")])


@query(with_(FACTS, TYPES) + "SELECT * FROM tc")
def graph_type_counts(spark, d):
    return anomaly.type_counts(parts(spark, d)[1])


@query(with_(FACTS, PAIRS) + "SELECT * FROM pc")
def graph_pair_counts(spark, d):
    return anomaly.pair_counts(parts(spark, d)[1])


_ZS, _ZT = "(out_degree + 1 - out_mean) / out_std", "(in_degree + 1 - in_mean) / in_std"
_DEG = f"""SELECT seq, CASE WHEN {_ZS} > 3 THEN 'subject' ELSE 'object' END AS side, round(CASE WHEN {_ZS} > 3 THEN {_ZS} ELSE {_ZT} END, 6) AS z,
 round(least(0.5 + 0.1 * CASE WHEN {_ZS} > 3 THEN {_ZS} ELSE {_ZT} END, 0.8), 6) AS severity FROM com WHERE n_nodes >= 10 AND ({_ZS} > 3 OR {_ZT} > 3)"""


@query(with_(*ALL) + _DEG)
def anomaly_degree(spark, d):
    return anomaly.degree(*parts(spark, d))


_RT = "SELECT seq, CASE WHEN n_s / n_pred < 0.01 AND n_s < 3 THEN 'subject' ELSE 'object' END AS side FROM com WHERE n_pred > 0 AND ((n_s / n_pred < 0.01 AND n_s < 3) OR (n_o / n_pred < 0.01 AND n_o < 3))"


@query(with_(*ALL) + _RT)
def anomaly_rare_type(spark, d):
    return anomaly.rare_type(*parts(spark, d))


_RP = """SELECT seq, usual FROM com LEFT JOIN (SELECT pred, array_to_string(list(s_type || '-' || o_type ORDER BY n DESC, s_type || '-' || o_type)[1:3], ',') AS usual FROM pc WHERE s_type IS NOT NULL AND o_type IS NOT NULL GROUP BY pred) u USING (pred)
 WHERE n_pred >= 5 AND n_pair / n_pred < 0.01 AND n_pair < 2"""


@query(with_(*ALL) + _RP)
def anomaly_rare_pair(spark, d):
    return anomaly.rare_pair(*parts(spark, d))


_FQ = """SELECT seq, round((own + 1 - n_pred / n_nodes) / sqrt(greatest(n_pred / n_nodes, 1.0)), 6) AS z FROM com JOIN (SELECT s_id, pred, count(*) AS own FROM edges GROUP BY ALL) e USING (s_id, pred)
 WHERE own >= 3 AND (own + 1 - n_pred / n_nodes) / sqrt(greatest(n_pred / n_nodes, 1.0)) > 2.5"""


@query(with_(*ALL) + _FQ)
def anomaly_frequency(spark, d):
    return anomaly.frequency(*parts(spark, d))


_BK = lambda x: f"CASE WHEN {x} < 0.01 THEN 0.8 WHEN {x} < 0.05 THEN 0.5 WHEN {x} < 0.1 THEN 0.3 ELSE 0.0 END::DOUBLE"
_SC = f"""SELECT seq, round(a, 6) AS degree_score, round(b, 6) AS type_score, round(c, 6) AS pair_score, round((a + b + c) / 3, 6) AS score FROM (SELECT seq, least(abs((out_degree + 1 - out_mean) / greatest(out_std, 1.0)) / 5, 1.0)::DOUBLE a,
 {_BK("(n_s / greatest(n_pred, 1))")} b, CASE WHEN n_pred = 0 THEN 0.3::DOUBLE ELSE {_BK("(n_pair / greatest(n_pred, 1))")} END c FROM com)"""


@query(with_(*ALL) + _SC)
def anomaly_scores(spark, d):
    return anomaly.scores(*parts(spark, d))


@query(with_(*ALL) + f"""SELECT seq, count(*) AS n_anomalies FROM (SELECT seq FROM ({_DEG}) UNION ALL SELECT seq FROM ({_RT}) UNION ALL SELECT seq FROM ({_RP}) UNION ALL SELECT seq FROM ({_FQ})
 UNION ALL SELECT seq FROM ({_SC}) WHERE score > 0.6) WHERE (SELECT n_nodes FROM stat) >= 50 GROUP BY seq""")
def anomaly_gate(spark, d):
    return anomaly.gate(*parts(spark, d))


_QUAL = lambda e: f"""SELECT * FROM (SELECT count(*) AS n_edges, round(avg((s_type IN {inlist(o.ENTITY_TYPES)} AND o_type IN {inlist(o.ENTITY_TYPES)} AND pred IN {inlist(o.RELATION_TYPES)})::INT), 6) AS schema_compliance,
 count(*) FILTER (s_id = o_id) AS self_loops, round(1 - count(DISTINCT (s_id, pred, o_id)) / count(*), 6) AS duplicate_rate FROM {e}),
 (SELECT count(*) AS n_nodes, round(avg(g), 6) AS degree_mean, max(g) AS degree_max, round(stddev_pop(g), 6) AS degree_std FROM (SELECT node, count(*) AS g FROM (SELECT s_id AS node FROM {e} UNION ALL SELECT o_id FROM {e}) GROUP BY node))"""  # noqa: E731


@query(with_(FACTS, f"q AS ({_QUAL('edges')})") + "SELECT *, round(n_edges / (n_nodes * (n_nodes - 1)), 9) AS density FROM q")
def graph_quality(spark, d):
    return anomaly.quality(parts(spark, d)[1], o.ENTITY_TYPES, o.RELATION_TYPES)


@query(with_(FACTS, "both_ AS (SELECT * FROM edges UNION ALL SELECT * FROM batch)", f"q1 AS ({_QUAL('edges')})", f"q2 AS ({_QUAL('both_')})") + """SELECT metric, b AS before, a AS after, round(a - b, 6) AS delta, round((a - b) * 100 / nullif(b, 0), 6) AS percent FROM (
 SELECT 'n_edges' AS metric, (SELECT n_edges FROM q1)::DOUBLE AS b, (SELECT n_edges FROM q2)::DOUBLE AS a UNION ALL SELECT 'n_nodes', (SELECT n_nodes FROM q1)::DOUBLE, (SELECT n_nodes FROM q2)::DOUBLE
 UNION ALL SELECT 'degree_mean', (SELECT degree_mean FROM q1), (SELECT degree_mean FROM q2) UNION ALL SELECT 'self_loops', (SELECT self_loops FROM q1), (SELECT self_loops FROM q2))""")
def graph_quality_compare(spark, d):
    b, e = parts(spark, d)
    q = lambda x: anomaly.quality(x, o.ENTITY_TYPES, o.RELATION_TYPES)
    return anomaly.compare(q(e), q(e.unionByName(b)), ["n_edges", "n_nodes", "degree_mean", "self_loops"])


def score_sql(c: str) -> str:
    s = f"lower(coalesce({c}, 'unknown'))"
    trusted = " ".join(f"WHEN contains({s}, {lit(p)}) THEN {v}" for p, v in o.TRUSTED.items())
    return f"(CASE {trusted} {' '.join(f'WHEN contains({s}, {lit(p)}) THEN 0.3' for p in o.UNTRUSTED)} ELSE 0.5 END)::DOUBLE"


@query(f"SELECT source_id, {score_sql('source_id')} AS score FROM source_profiles")
def provenance_initial(spark, d):
    return table(spark, d, "source_profiles", "source_id").select("source_id", provenance.initial_score(F.col("source_id")).alias("score"))


FS = "fs AS (SELECT s_id, pred, o_id, count(DISTINCT doc) AS n_sources FROM edges WHERE doc IS NOT NULL GROUP BY ALL)"


@query(with_(FACTS, FS) + "SELECT * FROM fs")
def provenance_fact_sources(spark, d):
    return provenance.fact_sources(parts(spark, d)[1])


ADJ = f"""adj AS (SELECT seq, {score_sql("doc")} AS source_score, coalesce(n_sources, 0) AS n_sources,
 round(greatest(0.1, least(0.99, coalesce(conf, 1.0) * ({score_sql("doc")} * CASE WHEN doc IS NULL THEN 0.7 ELSE 1.0 END) + least(coalesce(n_sources, 0) * 0.1, 0.3))), 6) AS adjusted FROM batch LEFT JOIN fs USING (s_id, pred, o_id))"""


@query(with_(FACTS, FS, ADJ) + "SELECT * FROM adj")
def provenance_confidence(spark, d):
    return provenance.confidence(*parts(spark, d))


@query(with_(FACTS, FS, ADJ) + "SELECT seq, concat_ws('; ', printf('source score %.6f', source_score), CASE WHEN n_sources > 0 THEN printf('%d earlier sources', n_sources) END, printf('adjusted %.6f', adjusted)) AS explanation FROM adj")
def provenance_explanation(spark, d):
    return provenance.explanation(provenance.confidence(*parts(spark, d)))


def decided(spark, d):
    f = kg.facts(spark, d)
    return f.select("seq", "doc", F.when(F.col("status") == "accepted", True).when(F.col("status") == "rejected", False).alias("accepted"), (F.coalesce("conf", F.lit(1.0)) < 0.6).alias("conflict"))


_DEC = "dec AS (SELECT seq, coalesce(doc, 'unknown') AS doc, CASE status WHEN 'accepted' THEN true WHEN 'rejected' THEN false END AS acc, coalesce(conf, 1.0) < 0.6 AS conflict FROM facts)"


@query(with_(FACTS, _DEC) + "SELECT doc, count(*) AS total, count(*) FILTER (acc) AS accepted, count(*) FILTER (NOT acc) AS rejected, count(*) FILTER (conflict) AS conflicts FROM dec GROUP BY doc")
def provenance_record(spark, d):
    return provenance.record(decided(spark, d))


@query(with_(FACTS, _DEC) + f"""SELECT doc, round(greatest(0.1, least(0.99, coalesce(sum(CASE WHEN u THEN 0.1 * pow(0.9, later) * target END), 0) + pow(0.9, sum(u::INT)) * any_value({score_sql("doc")}))), 6) AS reliability FROM (
 SELECT doc, u, target, coalesce(sum(u::INT) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS later FROM (
 SELECT doc, seq, row_number() OVER w >= 5 AND acc IS NOT NULL AS u, (sum(coalesce(acc, false)::INT) OVER w / row_number() OVER w) * (1 - 0.5 * sum(conflict::INT) OVER w / row_number() OVER w) AS target FROM dec WINDOW w AS (PARTITION BY doc ORDER BY seq))) GROUP BY doc""")
def provenance_learn(spark, d):
    return provenance.learn(decided(spark, d))


@query("""SELECT count(*) AS n_sources, round(avg(reliability_score), 6) AS mean_reliability, min(reliability_score) AS min_reliability, max(reliability_score) AS max_reliability, sum(total_triples) AS total,
 round(sum(accepted_triples) / sum(total_triples), 6) AS acceptance_rate, round(sum(conflicts_caused) / sum(total_triples), 6) AS conflict_rate FROM source_profiles""")
def provenance_statistics(spark, d):
    return provenance.statistics(table(spark, d, "source_profiles"))


_REP = """SELECT source_id, reliability_score, round(coalesce(accepted_triples / nullif(total_triples, 0), 0), 6) AS acceptance_rate, round(coalesce(conflicts_caused / nullif(total_triples, 0), 0), 6) AS conflict_rate,
 CASE WHEN reliability_score >= 0.8 THEN 'high' WHEN reliability_score >= 0.5 THEN 'medium' ELSE 'low' END AS level FROM source_profiles"""


@query(_REP)
def provenance_report(spark, d):
    return provenance.report(table(spark, d, "source_profiles"))


@query(_REP + " ORDER BY reliability_score DESC NULLS LAST, source_id LIMIT 10")
def provenance_top_sources(spark, d):
    return provenance.report(table(spark, d, "source_profiles"), 10)


@query(with_(FACTS) + """SELECT seq, n AS n_docs, CASE WHEN n >= 3 THEN 1.2 WHEN n = 2 THEN 1.1 ELSE 1.0 END::DOUBLE AS boost FROM (SELECT b.seq, (SELECT count(DISTINCT x.doc) FROM (SELECT e.doc FROM edges e WHERE e.s_id = b.s_id AND e.pred = b.pred AND lower(e.o_name) = lower(b.o_name) AND e.doc IS NOT NULL
 UNION ALL SELECT b.doc WHERE b.doc IS NOT NULL) x) AS n FROM batch b)""")
def provenance_graph_boost(spark, d):
    return provenance.graph_boost(*parts(spark, d))
