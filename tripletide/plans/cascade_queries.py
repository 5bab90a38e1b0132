"""Queries of the second stage, resolution, vectors and the router."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from .. import ontology as o
from ..functions import similarity as sim
from ..operators import cascade, embeddings, provenance, resolution
from ..runtime import materialize, table
from .graph_queries import ADJ, FS
from .metric_queries import DEC
from .rule_queries import OUTCOME, outcome, parts
from .sql import FACTS, inlist, lit, recursive, values, with_

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


@query(None)
def similarity_blocking(spark, d):
    return sim.blocking_keys(table(spark, d, "entities", "entity_id", "entity_name", "entity_type"))


SQL["similarity_blocking"] = r"""WITH w AS (SELECT entity_id, coalesce(entity_type, '') AS t, list_distinct(list_transform(list_filter(regexp_split_to_array(lower(entity_name), '[^\pL\pN]+'), lambda x: length(x) >= 3), lambda x: x[1:3])) AS k FROM entities)
 SELECT entity_id, unnest(CASE WHEN len(k) > 0 THEN list_transform(k, lambda x: x || ':' || t) ELSE ['type:' || t] END) AS block FROM w"""


@query(None)
def similarity_names(spark, d):
    """Every entity's name with its first alias: Jaro-Winkler, Cologne code and combined similarity."""
    e = table(spark, d, "entities", "entity_id", "entity_name", "aliases").where("size(aliases) > 0")
    a = F.get("aliases", F.lit(0))
    r = lambda c, n: F.round(c, 6).alias(n)
    return e.select("entity_id", r(sim.jaro_winkler_udf(F.lower("entity_name"), F.lower(a)), "jaro_winkler"), sim.cologne_udf("entity_name").alias("cologne"), r(sim.name_similarity_udf("entity_name", a), "similarity"))


@query(None)
def resolution_pairs(spark, d):
    return resolution.resolve(ents(spark, d))


@query(None)
def resolution_top(spark, d):
    return resolution.top_candidates(resolution.resolve(ents(spark, d)))


@query("""SELECT fingerprint, arg_min(entity_id, (-coalesce(confidence, -1), entity_id)) AS entity_id, arg_min(entity_name, (-length(entity_name), entity_name)) AS entity_name, max(confidence) AS confidence,
 strftime(min(valid_from), '%Y-%m-%d') AS valid_from, strftime(max(valid_until), '%Y-%m-%d') AS valid_until, count(*) AS n_records,
 len(list_filter(list_distinct(flatten(list(list_concat([entity_name], coalesce(aliases, []))))), lambda x: x IS NOT NULL)) - 1 AS n_aliases FROM entities WHERE fingerprint IS NOT NULL GROUP BY fingerprint""")
def resolution_merge(spark, d):
    m = resolution.merge(ents(spark, d))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return m.select("fingerprint", "entity_id", "entity_name", "confidence", day("valid_from"), day("valid_until"), "n_records", F.size("aliases").cast("bigint").alias("n_aliases"))


@query(with_(FACTS) + f"SELECT DISTINCT b.seq, 0.8::DOUBLE AS severity FROM batch b JOIN edges e ON e.s_id = b.s_id AND e.pred = b.pred WHERE b.pred IN {inlist(o.CARDINALITY)} AND lower(e.o_name) <> lower(b.o_name)")
def resolution_contradictory(spark, d):
    return resolution.contradictory(*parts(spark, d), list(o.CARDINALITY))


@query(with_(FACTS) + """SELECT seq, round(a * b, 8) AS multiply, least(a, b) AS least_, round(0.6 * a + 0.4 * b, 8) AS average, round(a * b / nullif(a * b + (1 - a) * (1 - b), 0), 8) AS bayes FROM (SELECT seq, conf AS a, 1 - conf / 2 AS b FROM facts WHERE conf IS NOT NULL)""")
def resolution_combine(spark, d):
    f = kg.facts(spark, d).where("conf is not null")
    a, b = F.col("conf"), 1 - F.col("conf") / 2
    c = lambda m: F.round(resolution.combine(a, b, m), 8)
    return f.select("seq", c("multiply").alias("multiply"), resolution.combine(a, b, "min").alias("least_"), c("weighted_avg").alias("average"), c("bayesian").alias("bayes"))


V = "v AS (SELECT entity_id, embedding::DOUBLE[] AS e FROM entities WHERE len(embedding) = 64)"
ENDS = "ends AS (SELECT relation_id, relation_type, h.e AS h, t.e AS t FROM relations JOIN v h ON h.entity_id = source_id JOIN v t ON t.entity_id = target_id WHERE invalidated_at IS NULL)"
RV = """m AS (SELECT relation_type, pos, avg(x) AS x, count(*) AS n FROM (SELECT relation_type, generate_subscripts(h, 1) AS pos, unnest(list_transform(list_zip(t, h), lambda z: z[1] - z[2])) AS x FROM ends) GROUP BY ALL HAVING count(*) >= 3),
 rv AS (SELECT relation_type, n, list_transform(u, lambda x: x / norm) AS u FROM (SELECT relation_type, max(n) AS n, list(x ORDER BY pos) AS u, sqrt(sum(x * x)) AS norm FROM m GROUP BY relation_type))"""


@query(with_(V, ENDS, RV) + "SELECT relation_type, n, round(u[1], 6) AS first_, round(u[64], 6) AS last_ FROM rv")
def vectors_relations(spark, d):
    r = embeddings.relation_vectors(table(spark, d, "relations"), ents(spark, d))
    return r.select("relation_type", "n", F.round(F.get("vector", F.lit(0)), 6).alias("first_"), F.round(F.get("vector", F.lit(63)), 6).alias("last_"))


@query(with_(V, ENDS, RV) + """SELECT relation_id, round(d, 6) AS distance, round(least(d / 2, 1.0), 6) AS score, CASE WHEN least(d / 2, 1.0) >= 0.5 THEN 0.4::DOUBLE END AS severity FROM (SELECT relation_id, list_distance(list_transform(list_zip(h, u), lambda z: z[1] + z[2]), t) AS d FROM ends JOIN rv USING (relation_type))""")
def vectors_scores(spark, d):
    r, e = table(spark, d, "relations"), ents(spark, d)
    return embeddings.scores(r, e, materialize(embeddings.relation_vectors(r, e), "relation-vectors"))


@query("SELECT relation_type, relation_id FROM relations QUALIFY row_number() OVER (PARTITION BY relation_type ORDER BY created_at, relation_id) <= 50")
def vectors_examples(spark, d):
    return embeddings.examples(table(spark, d, "relations"))


@query("""WITH c AS (SELECT label, list(x ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY label)
 SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS similarity FROM embeddings JOIN c USING (label)""")
def vectors_to_centroid(spark, d):
    return embeddings.to_centroid(table(spark, d, "embeddings"))


INC = values("inc", "pred, other", o.incompatible_pairs())
TRIG = f"""trig AS (SELECT seq, arg_min(reason, k) AS reason FROM (SELECT seq, 'role_conflict' AS reason, 0 AS k FROM batch b JOIN inc USING (pred) WHERE EXISTS (SELECT 1 FROM edges e WHERE e.s_id = b.s_id AND e.o_id = b.o_id AND e.pred = other)
 UNION ALL SELECT seq, 'object_conflict', 1 FROM batch b JOIN inc USING (pred) WHERE EXISTS (SELECT 1 FROM edges e WHERE e.s_id = b.o_id AND e.o_id = b.s_id AND e.pred = other)
 UNION ALL SELECT seq, 'low_confidence', 2 FROM batch WHERE pred IN {inlist(o.DANGEROUS)} AND coalesce(conf, 1.0) < 0.6) GROUP BY seq)"""


@query(with_(FACTS, INC, TRIG) + "SELECT * FROM trig")
def cascade_trigger(spark, d):
    return cascade.trigger(*parts(spark, d))


@query(with_(FACTS, INC, TRIG) + "SELECT reason, count(*) AS n FROM trig GROUP BY reason")
def cascade_trigger_statistics(spark, d):
    return cascade.trigger(*parts(spark, d)).groupBy("reason").agg(F.count("*").alias("n"))


def verdicts(spark, d, stage1=None):
    """The cascade's verdicts; ``stage1``: what `outcome` gave, to be used again."""
    b, e, first = stage1 or outcome(spark, d)
    adjusted = provenance.confidence(b, e)
    con = resolution.contradictory(b, e, list(o.CARDINALITY)).select("seq", F.lit(1).alias("n_conflicts"))
    second = adjusted.join(con, "seq", "left").join(b.select("seq", F.col("text").isNotNull().alias("has_text"), "conf"), "seq")
    c2 = F.coalesce("conf", F.lit(1.0)) * F.when(F.col("n_conflicts") > 0, 0.5).otherwise(1.0)
    return cascade.route(first if stage1 else materialize(first, "stage1"), second.select("seq", "has_text", "adjusted", F.coalesce("n_conflicts", F.lit(0)).alias("n_conflicts"), c2.alias("confidence2")), cascade.trigger(b, e))


CON = f"con AS (SELECT DISTINCT b.seq FROM batch b JOIN edges e ON e.s_id = b.s_id AND e.pred = b.pred WHERE b.pred IN {inlist(o.CARDINALITY)} AND lower(e.o_name) <> lower(b.o_name))"
VERDICT = """pre AS (SELECT o.seq, o.outcome, o.confidence AS c1, text_ IS NOT NULL AS has_text, adjusted, con.seq IS NOT NULL AS bad, reason, 0.6 * o.confidence + 0.4 * (coalesce(conf, 1.0) * CASE WHEN con.seq IS NOT NULL THEN 0.5 ELSE 1.0 END) AS c12
 FROM outcome o JOIN batch b ON b.seq = o.seq JOIN adj ON adj.seq = o.seq LEFT JOIN con ON con.seq = o.seq LEFT JOIN trig ON trig.seq = o.seq),
 way AS (SELECT *, CASE WHEN outcome = 'FAIL' THEN 'rules' WHEN outcome = 'PASS' AND c1 >= 0.9 AND CASE WHEN has_text THEN adjusted ELSE c1 END >= 0.9 THEN 'fast_path' WHEN reason IS NULL AND NOT bad AND c12 >= 0.7 THEN 'stage2' ELSE 'stage3' END AS decided_by FROM pre),
 verdict AS (SELECT seq, CASE decided_by WHEN 'rules' THEN 'rejected' WHEN 'stage3' THEN 'needs_review' ELSE 'accepted' END AS status, decided_by,
 round(CASE decided_by WHEN 'rules' THEN c1 WHEN 'fast_path' THEN CASE WHEN has_text THEN adjusted ELSE c1 END ELSE c12 END, 6) AS confidence FROM way)"""
ALL = (*OUTCOME, FS, ADJ, INC, TRIG, CON, VERDICT)


@query(recursive(*ALL) + "SELECT * FROM verdict")
def cascade_verdicts(spark, d):
    return verdicts(spark, d)


@query(recursive(*ALL) + """SELECT count(*) AS n, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'needs_review') AS needs_review,
 round(count(*) FILTER (status = 'accepted') / count(*), 6) AS acceptance_rate, round(count(*) FILTER (decided_by = 'stage3') / count(*), 6) AS escalation_rate FROM verdict""")
def cascade_run_statistics(spark, d):
    return cascade.run_statistics(verdicts(spark, d))


@query(recursive(*ALL) + """SELECT decided_by, status, count(*) AS n, round(avg(confidence), 8) AS mean_confidence, round(quantile_cont(confidence, 0.5), 6) AS median_confidence, round(count(*) / (SELECT count(*) FROM verdict), 6) AS share FROM verdict GROUP BY ALL""")
def cascade_stage_statistics(spark, d):
    return cascade.stage_statistics(verdicts(spark, d))


@query(with_(FACTS) + """SELECT b.seq, side, rank, edge_seq FROM batch b JOIN (SELECT 'subject' AS side, s_id AS k, seq AS edge_seq, row_number() OVER (PARTITION BY s_id ORDER BY seq) AS rank FROM edges) e ON e.k = b.s_id AND rank <= 10
 UNION ALL SELECT b.seq, 'object', rank, edge_seq FROM batch b JOIN (SELECT o_id AS k, seq AS edge_seq, row_number() OVER (PARTITION BY o_id ORDER BY seq) AS rank FROM edges) e ON e.k = b.o_id AND rank <= 10
 UNION ALL SELECT b.seq, 'relation', rank, edge_seq FROM batch b JOIN (SELECT pred AS k, seq AS edge_seq, row_number() OVER (PARTITION BY pred ORDER BY seq) AS rank FROM edges) e ON e.k = b.pred AND rank <= 5""")
def cascade_context(spark, d):
    return cascade.context(*parts(spark, d), 10, 10, 5)


@query(with_(FACTS) + """SELECT seq, level, CASE level WHEN 'high' THEN 1.1 WHEN 'low' THEN 0.7 WHEN 'none' THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM (SELECT seq, CASE WHEN length(coalesce(text_, '')) = 0 THEN 'none' WHEN length(text_) < 20 THEN 'low' WHEN conf IS NULL THEN 'unknown'
 WHEN conf >= 0.7 THEN 'high' WHEN conf >= 0.5 THEN 'medium' WHEN conf >= 0.3 THEN 'low' ELSE 'none' END AS level FROM facts)""")
def cascade_support(spark, d):
    """The extraction confidence stands in for a model's similarity."""
    s = cascade.support(F.col("conf"), F.col("text"))
    return kg.facts(spark, d).select("seq", s["level"].alias("level"), s["factor"].alias("factor"))


@query(with_(FACTS, DEC) + """SELECT seq, CASE WHEN a > x AND c >= 0.6 THEN 'PASS' WHEN x > a THEN 'FAIL' ELSE 'UNCERTAIN' END AS outcome, c AS confidence FROM (SELECT seq, (verdict = 'accept')::INT AS a, (verdict = 'reject')::INT AS x, round(p, 6) AS c FROM dec WHERE verdict <> 'review')
 UNION ALL SELECT seq, 'UNCERTAIN', round(p, 6) FROM dec WHERE verdict = 'review'""")
def cascade_vote(spark, d):
    from .metric_queries import decisions

    x = decisions(spark, d).select("seq", F.when(F.col("verdict") == "review", "human_review").otherwise(F.col("verdict")).alias("action"), F.col("p").alias("confidence"))
    return cascade.vote(x)


@query(recursive(*ALL) + f"SELECT {lit('rules_only')} AS classifier, count(*) AS n, count(*) FILTER (outcome = 'PASS') AS accepted FROM outcome UNION ALL SELECT 'stage2_complete', count(*), count(*) FILTER (outcome = 'PASS' AND c12 >= 0.85) FROM pre UNION ALL SELECT 'full', count(*), count(*) FILTER (status = 'accepted') FROM verdict")
def baselines(spark, d):
    b, e, first = outcome(spark, d)
    first = materialize(first, "stage1")
    v = materialize(verdicts(spark, d, (b, e, first)), "verdicts")
    con = resolution.contradictory(b, e, list(o.CARDINALITY)).select("seq", F.lit(0.5).alias("f"))
    c2 = F.coalesce("conf", F.lit(1.0)) * F.coalesce("f", F.lit(1.0))
    s2 = first.join(b.select("seq", "conf"), "seq").join(con, "seq", "left").withColumn("c12", resolution.combine(F.col("confidence"), c2))
    row = lambda df, n, ok: df.agg(F.count("*").alias("n"), F.count_if(ok).alias("accepted")).select(F.lit(n).alias("classifier"), "n", "accepted")
    return row(first, "rules_only", F.col("outcome") == "PASS").union(row(s2, "stage2_complete", (F.col("outcome") == "PASS") & (F.col("c12") >= 0.85))).union(row(v, "full", F.col("status") == "accepted"))
