"""Queries of baselines, phased experiments and what a language model is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kg
from .. import ontology as o
from ..functions import models, prompts
from ..functions import text as tx
from ..functions.draws import PRIME, draw_sql, uniform_sql
from ..operators import baselines as bl
from ..operators import constraints as c
from ..operators import experiments as ex
from ..runtime import materialize, table
from .rule_queries import OUTCOME, outcome, parts
from .sql import DOMAINS, FACTS, LIMITS, inlist, lit, recursive, with_

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _random_sql(source: str) -> str:
    normal = f"sqrt(-2 * ln(({draw_sql(43, 'seq')} + 1) / {PRIME}.0::DOUBLE)) * cos(2 * pi() * {uniform_sql(44, 'seq')})"
    return f"SELECT seq, {uniform_sql(42, 'seq')} < 0.5 AS accepted, round(greatest(0.1, least(0.99, 0.5 + 0.1 * {normal})), 6) AS confidence FROM {source}"


@query(with_(FACTS) + _random_sql("batch"))
def baseline_random(spark, d):
    return bl.at_random(parts(spark, d)[0])


#: How much of a claim's words its source text holds: a similarity that SQL can state.
def _overlap():
    claim = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "s_name", "pred", "o_name")), " "))
    words = F.array_distinct(F.split(F.lower(F.substring("text", 1, 500)), " "))
    return F.when(F.col("text").isNotNull(), F.size(F.array_intersect(claim, words)) / F.size(claim))


_CLAIM = "list_distinct(string_split(lower(concat_ws(' ', s_name, pred, o_name)), ' '))"
_SIM = f"CASE WHEN text_ IS NOT NULL THEN len(list_intersect({_CLAIM}, list_distinct(string_split(lower(text_[1:500]), ' ')))) / len({_CLAIM}) END"


def _staged(spark, d, stage1=None) -> DataFrame:
    b, _, first = stage1 or outcome(spark, d)
    return first.join(b.select("seq", "doc", _overlap().alias("similarity"), F.col("conf").alias("confidence2")), "seq").select("seq", "outcome", "confidence", "doc", "similarity", "confidence2")


_STAGED = f"st AS (SELECT seq, outcome, confidence AS c1, doc, {_SIM} AS sim, conf FROM outcome JOIN batch USING (seq))"


def _emb_sql(penalty: bool, verification: bool) -> str:
    c1 = "c1 * CASE WHEN coalesce(doc, '') = '' THEN 0.5 ELSE 1 END" if penalty else "c1"
    f = "CASE WHEN sim IS NULL THEN 1 WHEN sim > 0.5 THEN 1.1 WHEN sim > 0.3 THEN 1 WHEN sim > 0.15 THEN 0.7 ELSE 0.5 END" if verification else "1"
    return f"""SELECT seq, CASE WHEN outcome = 'FAIL' THEN false WHEN p >= 0.9 THEN true ELSE both_ >= 0.7 END AS accepted, round(CASE WHEN outcome = 'FAIL' OR p >= 0.9 THEN p ELSE both_ END, 6) AS confidence, CASE WHEN outcome = 'FAIL' OR p >= 0.9 THEN 1 ELSE 2 END AS stage
 FROM (SELECT *, (0.5 * p + 0.5 * coalesce(conf, 1.0)) / (0.5 + 0.5) * {f} AS both_ FROM (SELECT *, {c1} AS p FROM st))"""


@query(recursive(*OUTCOME, _STAGED) + _emb_sql(True, True))
def baseline_rules_embedding(spark, d):
    return bl.rules_and_embedding(_staged(spark, d))


_ABLATIONS = {"no_penalty": (False, True), "no_verification": (True, False), "neither": (False, False)}


@query(recursive(*OUTCOME, _STAGED) + " UNION ALL ".join(f"SELECT {lit(n)} AS variant, count(*) AS n, count(*) FILTER (accepted) AS accepted, round(avg(confidence), 6) AS mean_confidence FROM ({_emb_sql(*x)})" for n, x in _ABLATIONS.items()))
def baseline_ablations(spark, d):
    s, out = materialize(_staged(spark, d), "staged"), None
    for name, (p, v) in _ABLATIONS.items():
        one = bl.rules_and_embedding(s, p, v).agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).select(F.lit(name).alias("variant"), "*")
        out = one if out is None else out.union(one)
    return out


@query(with_(FACTS) + f"SELECT seq, CASE WHEN sim IS NULL THEN 'unknown' WHEN sim > 0.5 THEN 'high' WHEN sim > 0.3 THEN 'medium' WHEN sim > 0.15 THEN 'low' ELSE 'none' END AS level, CASE WHEN sim IS NULL THEN 1.0 WHEN sim > 0.5 THEN 1.1 WHEN sim > 0.3 THEN 1.0 WHEN sim > 0.15 THEN 0.7 ELSE 0.5 END::DOUBLE AS factor FROM (SELECT seq, {_SIM} AS sim FROM batch)")
def baseline_source_ladder(spark, d):
    return parts(spark, d)[0].select("seq", bl.ladder(_overlap()).alias("x")).select("seq", "x.*")


def _opinions(spark, d):
    s = F.col("seq") % 5
    return parts(spark, d)[0].select("seq", F.when(s < 3, "PASS").when(s == 3, "FAIL").otherwise("UNCERTAIN").alias("outcome"), F.round(F.coalesce("conf", F.lit(0.5)), 6).alias("confidence"))


@query(with_(FACTS) + "SELECT seq, seq % 5 < 3 AND round(coalesce(conf, 0.5), 6) >= 0.6 AS accepted, round(coalesce(conf, 0.5), 6) AS confidence FROM batch")
def baseline_llm_only(spark, d):
    return bl.judged(_opinions(spark, d))


def _labels(spark, d):
    s = F.col("seq") % 7
    return parts(spark, d)[0].select("seq", F.when(s < 3, "entailment").when(s == 3, "contradiction").when(s < 6, "neutral").alias("label"), F.lit(0.8).alias("score"))


_NLI = "nli AS (SELECT seq, CASE WHEN seq % 7 < 3 THEN 'entailment' WHEN seq % 7 = 3 THEN 'contradiction' WHEN seq % 7 < 6 THEN 'neutral' END AS label FROM batch)"


@query(with_(FACTS, _NLI) + "SELECT seq, coalesce(label, 'neutral') <> 'contradiction' AS accepted, 0.8::DOUBLE AS confidence FROM nli")
def baseline_nli_only(spark, d):
    return bl.inferred(_labels(spark, d))


@query(with_(FACTS, _NLI) + "SELECT count(*) AS total_checks, " + ", ".join(f"count(*) FILTER (label = {lit(k)}) AS {n}, round(count(*) FILTER (label = {lit(k)}) / count(*), 6) AS {k}_rate" for k, n in (("entailment", "entailments"), ("contradiction", "contradictions"), ("neutral", "neutrals"))) + " FROM nli")
def inference_statistics(spark, d):
    return bl.inference_statistics(_labels(spark, d))


@query(with_(FACTS) + "SELECT seq, s_id, pred, o_id FROM edges UNION ALL SELECT seq, s_id, pred, o_id FROM batch WHERE status = 'accepted'")
def baseline_graph(spark, d):
    b, e = parts(spark, d)
    return bl.populated(e.select("seq", "s_id", "pred", "o_id"), b.select("seq", "s_id", "pred", "o_id", (F.col("status") == "accepted").alias("gold")))


@query(with_(FACTS, f"r AS ({_random_sql('batch')})") + "SELECT 'random' AS classifier, count(*) AS n, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS rejected, round(count(*) FILTER (accepted) / count(*), 6) AS acceptance_rate, round(avg(confidence), 6) AS mean_confidence, count(*)::DOUBLE AS ms FROM r")
def baseline_statistics(spark, d):
    return bl.statistics(bl.at_random(parts(spark, d)[0]).select(F.lit("random").alias("classifier"), "accepted", "confidence", F.lit(1.0).alias("ms")))


@query(None)
def baseline_similar_facts(spark, d):
    """New facts against known ones by vectors of their texts; the stand-in embedder hashes letters."""
    b, e = parts(spark, d)
    text = F.concat_ws(" ", "s_name", "pred", "o_name")
    b, e = (models.embed(x.withColumn("claim", text), "claim", models.HashEmbedder) for x in (b, e))
    return bl.similar_facts(b, e)


def _decide(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """Schema, types and self-loops reject; a full cardinality is to be reviewed."""
    bad = c.schema_check(batch).select("seq").union(c.domain_range(batch).select("seq")).union(c.self_loop(batch).select("seq")).distinct().withColumn("bad", F.lit(True))
    full = c.cardinality(batch, edges).select("seq").distinct().withColumn("full", F.lit(True))
    status = F.when(F.col("bad"), "rejected").when(F.col("full"), "needs_review").otherwise("accepted")
    return batch.select("seq").join(bad, "seq", "left").join(full, "seq", "left").select("seq", status.alias("status"))


_OKT, _OKR = inlist([t.lower() for t in o.ENTITY_TYPES]), inlist([*o.RELATION_TYPES, *o.RELATION_MAPPING])


def _decided(name: str, batch: str, edges: str) -> str:
    """The same over tables of facts, as common table expressions."""
    return f"""{name}_bad AS (SELECT seq FROM {batch} WHERE lower(coalesce(s_type, '')) NOT IN {_OKT} OR lower(coalesce(o_type, '')) NOT IN {_OKT} OR pred NOT IN {_OKR} OR (s_id = o_id OR lower(trim(s_name)) = lower(trim(o_name))) AND pred NOT IN {inlist(o.REFLEXIVE)}
 UNION SELECT seq FROM {batch} JOIN domains USING (pred) WHERE NOT list_contains(s_types, s_type) OR NOT list_contains(o_types, o_type)),
 {name}_full AS (SELECT DISTINCT seq FROM {batch} JOIN limits USING (pred) JOIN (SELECT s_id, pred, count(*) AS n FROM {edges} GROUP BY ALL) e USING (s_id, pred) WHERE n >= most),
 {name} AS (SELECT seq, CASE WHEN seq IN (SELECT seq FROM {name}_bad) THEN 'rejected' WHEN seq IN (SELECT seq FROM {name}_full) THEN 'needs_review' ELSE 'accepted' END AS status FROM {batch})"""


_TWO = f"good AS (SELECT * FROM batch WHERE status = 'accepted'), {_decided('v1', 'good', 'edges')}, more AS (SELECT * FROM edges UNION ALL SELECT * FROM good WHERE seq IN (SELECT seq FROM v1 WHERE status = 'accepted')), bad AS (SELECT * FROM batch WHERE status <> 'accepted'), {_decided('v2', 'bad', 'more')}"


@query(with_(FACTS, DOMAINS, LIMITS, _TWO) + "SELECT 'good' AS phase, seq, status FROM v1 UNION ALL SELECT 'bad', seq, status FROM v2")
def experiment_two_phase(spark, d):
    b, e = parts(spark, d)
    return ex.two_phase(b.withColumn("gold", F.col("status") == "accepted"), e, _decide)


_REAL = f"sup AS (SELECT * FROM batch WHERE text_ IS NOT NULL), {_decided('v1', 'sup', 'edges')}, more AS (SELECT * FROM edges UNION ALL SELECT * FROM sup WHERE seq IN (SELECT seq FROM v1 WHERE status = 'accepted')), {_decided('v2', 'batch', 'more')}"


@query(with_(FACTS, DOMAINS, LIMITS, _REAL) + "SELECT 'seed' AS phase, status, count(*) AS n FROM v1 GROUP BY ALL UNION ALL SELECT 'update', status, count(*) FROM v2 GROUP BY ALL")
def experiment_realistic(spark, d):
    b, e = parts(spark, d)
    return ex.realistic(b.where("text is not null"), b, e, _decide).groupBy("phase", "status").agg(F.count("*").alias("n"))


def _check(batch: DataFrame, edges: DataFrame) -> DataFrame:
    return c.stage_one(batch, {"schema": c.schema_check(batch), "domain": c.domain_range(batch), "self_loop": c.self_loop(batch), "cardinality": c.cardinality(batch, edges)})


_SEED = f"""pos AS (SELECT *, row_number() OVER (ORDER BY seq) <= floor((SELECT count(*) FROM facts WHERE pred IS NOT NULL AND s_id IS NOT NULL AND o_id IS NOT NULL) * 0.3) AS seed FROM facts WHERE pred IS NOT NULL AND s_id IS NOT NULL AND o_id IS NOT NULL),
 sd AS (SELECT *, lower(coalesce(s_type, '')) NOT IN {_OKT} OR lower(coalesce(o_type, '')) NOT IN {_OKT} OR pred NOT IN {_OKR} AS bad FROM pos WHERE seed), graph AS (SELECT * FROM sd WHERE NOT bad), up AS (SELECT * FROM pos WHERE NOT seed),
 ck AS (SELECT seq, lower(coalesce(s_type, '')) NOT IN {_OKT} OR lower(coalesce(o_type, '')) NOT IN {_OKT} OR pred NOT IN {_OKR} AS k1, seq IN (SELECT seq FROM up JOIN domains USING (pred) WHERE NOT list_contains(s_types, s_type) OR NOT list_contains(o_types, o_type)) AS k2,
 (s_id = o_id OR lower(trim(s_name)) = lower(trim(o_name))) AND pred NOT IN {inlist(o.REFLEXIVE)} AS k3, seq IN (SELECT seq FROM up JOIN limits USING (pred) JOIN (SELECT s_id, pred, count(*) AS n FROM graph GROUP BY ALL) e USING (s_id, pred) WHERE n >= most) AS k4 FROM up)"""


@query(with_(FACTS, DOMAINS, LIMITS, _SEED) + """SELECT 'seed' AS phase, CASE WHEN bad THEN 'rejected' ELSE 'accepted' END AS status, CASE WHEN bad THEN 'schema' ELSE 'none' END AS reason, count(*) AS n FROM sd GROUP BY ALL
 UNION ALL SELECT 'update', CASE WHEN k1 OR k2 OR k3 THEN 'rejected' WHEN k4 THEN 'needs_review' ELSE 'accepted' END, CASE WHEN k1 THEN 'schema' WHEN k2 THEN 'domain' WHEN k3 THEN 'self_loop' WHEN k4 THEN 'cardinality' ELSE 'none' END, count(*) FROM ck GROUP BY ALL""")
def experiment_seed_update(spark, d):
    f = kg.facts(spark, d).where("pred is not null and s_id is not null and o_id is not null")
    return ex.seed_update(f, 0.3, c.schema_check, _check)


@query(with_(FACTS, "p AS (SELECT batch_id AS phase, avg(conf) AS c, avg((status = 'accepted')::INT) AS f FROM batch GROUP BY 1), x AS (SELECT max(c) FILTER (phase = 2) AS c2, max(c) FILTER (phase = 3) AS c3, max(c) FILTER (phase = 6) AS c6, max(f) FILTER (phase = 4) AS f4, max(f) FILTER (phase = 5) AS f5 FROM p)")
       + "SELECT unnest(['missing_source_penalty_effectiveness', 'contradiction_detection_f1', 'cross_question_detection_f1', 'fake_source_detection_effectiveness']) AS metric, unnest([round((c2 - c3) / c2, 6), round(f4, 6), round(f5, 6), round((c2 - c6) / c2, 6)]) AS value FROM x")
def experiment_effectiveness(spark, d):
    return ex.effectiveness(parts(spark, d)[0].groupBy(F.col("batch_id").alias("phase")).agg(F.avg("conf").alias("confidence"), F.avg((F.col("status") == "accepted").cast("int")).alias("f1")))


_CELLS = "cells AS (SELECT 'run/' || batch_id AS label, count(*) FILTER (status = 'accepted' AND conf >= 0.7) AS tp, count(*) FILTER (status = 'rejected' AND conf >= 0.7) AS fp, count(*) FILTER (status = 'rejected' AND conf < 0.7) AS tn, count(*) FILTER (status = 'accepted' AND conf < 0.7) AS fn FROM batch GROUP BY batch_id)"


def _report(spark, d):
    n = lambda s, hi: F.count_if((F.col("status") == s) & ((F.col("conf") >= 0.7) if hi else (F.col("conf") < 0.7)))
    cell = F.struct(n("accepted", 1).alias("tp"), n("rejected", 1).alias("fp"), n("rejected", 0).alias("tn"), n("accepted", 0).alias("fn")).alias("c")
    p = parts(spark, d)[0].groupBy(F.col("batch_id").cast("string").alias("k")).agg(cell)
    return p.agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("phases"))


@query(with_(FACTS, _CELLS) + "SELECT * FROM cells WHERE tp + fp + tn + fn > 0")
def experiment_phase_records(spark, d):
    return ex.phase_records(_report(spark, d), "run")


@query(with_(FACTS, _CELLS, "one AS (SELECT label, unnest([tp, fp, tn, fn]) AS n, unnest([1, 0, 0, 1]) AS y_true, unnest([1, 1, 0, 0]) AS y_pred FROM cells)") + "SELECT label, y_true, y_pred FROM one, range(n) r")
def experiment_labels(spark, d):
    return ex.labels(ex.phase_records(_report(spark, d), "run"))


@query(with_(FACTS) + "SELECT doc AS example, count(*) AS n, count(*) FILTER (status = 'accepted') AS accepted, count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (status = 'needs_review') AS needs_review FROM batch WHERE doc IS NOT NULL GROUP BY ROLLUP (doc)")
def experiment_extrinsic(spark, d):
    return ex.extrinsic_summary(parts(spark, d)[0].where("doc is not null").select(F.col("doc").alias("example"), "status"))


@query(with_(FACTS, f"s AS (SELECT seq AS id FROM batch WHERE status = 'accepted'), x AS (SELECT id, row_number() OVER (ORDER BY {draw_sql(7, 'id')}, id) AS r FROM s)")
       + "SELECT id, 'supports' AS category, true AS accept FROM s UNION ALL SELECT seq, 'refutes', false FROM batch WHERE status = 'rejected' UNION ALL SELECT seq, 'entity_variant', true FROM batch WHERE status = 'pending' UNION ALL SELECT id, 'cross_doc', false FROM x WHERE r <= least(50, (SELECT count(*) // 2 FROM s))")
def experiment_stream_parts(spark, d):
    from ..functions.draws import draw

    b = parts(spark, d)[0].withColumnRenamed("seq", "id")
    s = b.where("status = 'accepted'")
    return ex.stream_parts(s, b.where("status = 'rejected'"), b.where("status = 'pending'"), s, draw(7, "id"))


@query(with_(FACTS, DOMAINS, LIMITS, _decided("v", "batch", "edges")) + "SELECT seq, s_id, pred, o_id FROM edges UNION ALL SELECT seq, s_id, pred, o_id FROM batch WHERE seq IN (SELECT seq FROM v WHERE status = 'accepted')")
def pipeline_ingest(spark, d):
    b, e = parts(spark, d)
    return ex.ingest(b, e, _decide)[1].select("seq", "s_id", "pred", "o_id")


@query(None)
def pipeline_documents(spark, d):
    """Documents to verdicts: chunked, extracted, checked against the graph."""
    return ex.ingest_documents(table(spark, d, "documents", "doc_id", "text"), parts(spark, d)[1], _decide)[0]


@query("""SELECT x.entity_id AS a, y.entity_id AS b, concat_ws(' | ', '''' || x.entity_name || ''' and ''' || y.entity_name || '''', 'names 90.00%', 'vectors 80.00%', 'both 86.00%', 'limit 85.00%', CASE WHEN x.entity_type = y.entity_type THEN 'duplicate, to be merged' ELSE 'no duplicate: types differ' END) AS reasoning
 FROM entities x JOIN entities y ON x.fingerprint = y.fingerprint AND x.entity_id < y.entity_id""")
def resolution_reasoning(spark, d):
    e = table(spark, d, "entities", "entity_id", "entity_name", "entity_type", "fingerprint")
    x, y = (e.select("fingerprint", F.col("entity_id").alias(s), F.col("entity_name").alias(f"n{s}"), F.col("entity_type").alias(f"t{s}")) for s in "ab")
    p = x.join(y, "fingerprint").where("a < b")
    return p.select("a", "b", ex.reasoning(F.col("na"), F.col("nb"), F.lit(0.9), F.lit(0.8), F.col("ta") == F.col("tb")).alias("reasoning"))


_W = r"w AS (SELECT seq, list_filter(regexp_split_to_array(text_, '[\s\pZ]+'), lambda x: x <> '') AS w FROM batch WHERE text_ IS NOT NULL), v AS (SELECT *, list_position(list_transform(w, lambda x: lower(x) IN " + inlist(tx.CLAIM_VERBS) + r"), true) AS vb FROM w WHERE len(w) > 2)"
_BARE = lambda x: f"regexp_replace({x}, '[.,!?;:]+$', '')"
_ENH = f"""{_W}, a AS (SELECT *, regexp_replace(array_to_string(w[:vb - 1], ' '), '^(?i:The|A|An)\\s+', '') AS s1, {_BARE("array_to_string(w[vb + 1:], ' ')")} AS o1,
 coalesce(list_position(list_transform(w, lambda x, i: NOT (lower(x) IN ('the', 'a', 'an') OR i = 1 OR x[1] <> lower(x[1]))), true), 0) AS low FROM v),
 b AS (SELECT *, list_filter(w[:low - 1], lambda x: lower(x) NOT IN ('the', 'a', 'an')) AS caps, {_BARE("array_to_string(w[low:], ' ')")} AS o2 FROM a)"""


@query(with_(FACTS, _ENH) + f"""SELECT seq, CASE WHEN vb > 1 AND length(s1) > 1 AND length(o1) > 1 THEN s1 WHEN low > 0 AND len(caps) > 0 AND length(o2) > 1 THEN array_to_string(caps, ' ') ELSE array_to_string(w[:len(w) // 2], ' ') END AS subject,
 CASE WHEN vb > 1 AND length(s1) > 1 AND length(o1) > 1 THEN upper(w[vb]) WHEN low > 0 AND len(caps) > 0 AND length(o2) > 1 THEN 'STATES' ELSE 'CLAIMS' END AS predicate,
 CASE WHEN vb > 1 AND length(s1) > 1 AND length(o1) > 1 THEN o1 WHEN low > 0 AND len(caps) > 0 AND length(o2) > 1 THEN o2 ELSE {_BARE("array_to_string(w[len(w) // 2 + 1:], ' ')")} END AS object FROM b""")
def text_claim_enhanced(spark, d):
    return parts(spark, d)[0].select("seq", tx.enhanced_claim(F.col("text")).alias("c")).where("c is not null").select("seq", "c.*")


@query(with_(FACTS) + """SELECT seq, 'Is this fact true? Answer {"is_true": true, false or null, "confidence": 0 to 1}.' || chr(10) || 'Fact: (' || s_name || ', ' || pred || ', ' || o_name || ')' || coalesce(chr(10) || 'Source: ' || text_, '') AS prompt FROM batch""")
def prompt_verify(spark, d):
    return parts(spark, d)[0].select("seq", prompts.verify(F.col("s_name"), F.col("pred"), F.col("o_name"), F.col("text")).alias("prompt"))


@query(with_(FACTS) + """SELECT seq, 'What is to be done? Answer {"action": "accept", "reject", "merge" or "human_review", "confidence": 0 to 1}.' || chr(10) || 'New fact: (' || s_name || ', ' || pred || ', ' || o_name || ')' || chr(10) || 'Conflict: cardinality' || chr(10) || 'Known:' || chr(10) || coalesce(text_, 'nothing') AS prompt FROM batch""")
def prompt_arbitrate(spark, d):
    return parts(spark, d)[0].select("seq", prompts.arbitrate(F.col("s_name"), F.col("pred"), F.col("o_name"), F.lit("cardinality"), F.col("text")).alias("prompt"))


_SHOT = [("Ada Bonn leads the works.", [("Ada Bonn", "LEITET", "works")])]
_HEAD = "List the facts that the text states, as a JSON list of objects with subject, predicate, object and confidence. Relations: LEITET, KENNT. Types: Person, Ort."
_EXAMPLE = 'Text: Ada Bonn leads the works.\nFacts: [{"subject": "Ada Bonn", "predicate": "LEITET", "object": "works"}]'


@query(f"SELECT doc_id, {lit(_HEAD)} || chr(10) || {' || chr(10) || '.join(map(lit, _EXAMPLE.split(chr(10))))} || chr(10) || chr(10) || 'Text: ' || text AS prompt FROM documents WHERE text IS NOT NULL")
def prompt_extract(spark, d):
    """Extraction with a worked example."""
    return table(spark, d, "documents", "doc_id", "text").where("text is not null").select("doc_id", prompts.extract(F.col("text"), ["LEITET", "KENNT"], ["Person", "Ort"], prompts.examples(_SHOT)).alias("prompt"))


@query(with_(FACTS) + "SELECT seq, s_name AS subject, pred AS predicate, o_name AS object, 0.5::DOUBLE AS confidence FROM batch WHERE seq % 2 = 0")
def prompt_extracted(spark, d):
    """Answers with a list of one fact, or with none that can be read."""
    fact = F.to_json(F.array(F.struct(F.col("s_name").alias("subject"), F.col("pred").alias("predicate"), F.col("o_name").alias("object"), F.lit(0.5).alias("confidence"))))
    said = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("Here: "), fact)).otherwise("none, sorry")
    return parts(spark, d)[0].select("seq", F.explode(prompts.extracted(said)).alias("x")).select("seq", "x.*")


_ANSWER = "CASE seq % 4 WHEN 0 THEN 'Sure: {\"is_true\": true, \"confidence\": 0.9}' WHEN 1 THEN '{\"is_true\": false}' WHEN 2 THEN '{\"is_true\": null, \"confidence\": 0.2}' ELSE 'no idea' END"


@query(with_(FACTS) + "SELECT seq, ['accept', 'reject', 'human_review', 'human_review'][(seq % 4 + 1)::INT] AS action, [0.9, 0.5, 0.2, 0.5][(seq % 4 + 1)::INT]::DOUBLE AS confidence FROM batch")
def prompt_verified(spark, d):
    """Answers as a model may give them, read."""
    return parts(spark, d)[0].select("seq", prompts.verified(F.expr(_ANSWER)).alias("x")).select("seq", "x.*")


@query(with_(FACTS) + "SELECT seq, CASE WHEN length(text_) % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS outcome, 0.75::DOUBLE AS confidence FROM batch WHERE text_ IS NOT NULL")
def prompt_consistency(spark, d):
    """A judge asked about each distinct text; the stand-in agrees with texts of even length."""

    def model():
        return lambda texts: [f'{{"consistent": {"true" if len(t) % 2 == 0 else "false"}, "confidence": 0.75}}' for t in texts]

    b = parts(spark, d)[0].where("text is not null").select("seq", F.col("text").alias("prompt"))
    return prompts.ask(b, model).select("seq", prompts.consistent(F.col("response")).alias("x")).select("seq", "x.*")
