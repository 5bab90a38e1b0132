"""Queries of chunking, extraction, generators and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.draws import draw_sql, number_sql, uniform_sql
from .. import kg
from ..functions import chunking, extraction
from ..operators import generators as g
from ..runtime import materialize, table
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


def docs(spark, d):
    return table(spark, d, "documents", "doc_id", "text")


_ZONE = "substr(text, start + 667, greatest(far - start - 666, 0))"
SLIDE = f"""w AS (SELECT doc_id, text, length(text) AS n, unnest(range(0, length(text), 800)) AS start FROM documents WHERE length(trim(text, ' ')) > 0),
 f AS (SELECT *, least(start + 1000, n) AS far FROM w WHERE start = 0 OR start - 800 + 1000 < n),
 c AS (SELECT doc_id, start, CASE WHEN far < n THEN CASE {" ".join(f"WHEN strpos({_ZONE}, {s}) > 0 THEN start + 666 + strpos({_ZONE}, {s}) - 1 + {k}" for s, k in (("'. '", 2), ("'! '", 2), ("'? '", 2), ("chr(10)", 1)))} ELSE far END ELSE far END AS end_char, text FROM f),
 sl AS (SELECT doc_id, start AS start_char, end_char, regexp_replace(substr(text, start + 1, end_char - start), '^[\\s\\pZ\\x85\\x0b\\x1c-\\x1f]+|[\\s\\pZ\\x85\\x0b\\x1c-\\x1f]+$', '', 'g') AS chunk FROM c)"""


@query(with_(SLIDE) + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_char) - 1 AS chunk_index, start_char, end_char, length(chunk) AS n FROM sl WHERE length(chunk) >= 100")
def chunk_sliding(spark, d):
    return chunking.sliding(docs(spark, d)).select("doc_id", "chunk_index", "start_char", "end_char", F.length("chunk").alias("n"))


@query(with_(SLIDE) + "SELECT count(*) AS n_chunks, sum(length(chunk)) AS total, round(avg(length(chunk)), 6) AS mean, min(length(chunk)) AS min, max(length(chunk)) AS max FROM sl WHERE length(chunk) >= 100")
def chunk_statistics(spark, d):
    return chunking.statistics(chunking.sliding(docs(spark, d)))


def _chunks(name):
    def f(spark, d):
        return chunking.chunk(docs(spark, d), name)

    f.__name__ = f"chunk_{name}"
    return f


_BLANK = r"[\s\pZ\x0b\x1c-\x1f\x85]"
_END = lambda s: f"CASE WHEN {s} + 1000 >= n THEN n WHEN strpos(reverse(text[{s} + 102:{s} + 1000]), ' ') > 0 THEN {s} + 1000 - strpos(reverse(text[{s} + 102:{s} + 1000]), ' ') ELSE {s} + 1000 END"
_FIXED = f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE regexp_replace(text, '{_BLANK}+', '', 'g') <> ''), walk AS (SELECT doc_id, 0::BIGINT AS s, ({_END('0')})::BIGINT AS e FROM d
 UNION ALL SELECT doc_id, s, ({_END('s')})::BIGINT FROM (SELECT d.doc_id, text, n, greatest(e - 200, s + 1) AS s FROM walk JOIN d USING (doc_id) WHERE e < n)),
 p AS (SELECT doc_id, s, e, regexp_replace(text[s + 1:e], '^{_BLANK}+|{_BLANK}+$', '', 'g') AS chunk FROM walk JOIN d USING (doc_id))
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index, s AS start_char, e AS end_char, chunk FROM p WHERE chunk <> ''"""
for _s in ("fixed", "sentence", "paragraph"):
    query(_FIXED if _s == "fixed" else None)(_chunks(_s))


@query(None)
def extract_relations(spark, d):
    return extraction.relations(chunking.chunk(docs(spark, d), "sentence"))


@query(None)
def extract_triples(spark, d):
    c = materialize(chunking.chunk(docs(spark, d), "sentence"), "chunks")
    r = materialize(extraction.relations(c), "relations")
    return extraction.build(r, extraction.entities(c, r))


_W = "list_filter(string_split(entity_name, ' '), lambda x: x <> '')"
_SUF = "(" + "|".join(s.replace(".", r"\.") for s in g.ORG_SUFFIXES) + ")$"
_CAPS = lambda w: f"list_filter({w}, lambda x: x[1] <> lower(x[1]))"
_ACR = lambda w: f"array_to_string(list_transform({_CAPS(w)}, lambda x: x[1]), '')"
_ORGW = "list_filter(w, lambda x: lower(x) NOT IN ('the', 'of', 'and'))"
_VAR = lambda n, k, s: f"{{'variant_name': {n}, 'variant_type': '{k}', 'expected_similarity': {s}::DOUBLE}}"
_IF = lambda c, x: f"CASE WHEN {c} THEN {x} END"


@query(f"""WITH e AS (SELECT entity_id, entity_name AS n, entity_type AS t, {_W} AS w FROM entities WHERE length(trim(entity_name, ' ')) > 0),
 v AS (SELECT entity_id, list_filter(CASE WHEN t = 'Person' AND len(w) < 2 THEN [{_VAR("'Dr. ' || n", "title", 0.75)}, {_VAR("'Prof. ' || n", "title", 0.75)}]
 WHEN t = 'Person' THEN [{_VAR("w[1][1] || '. ' || w[-1]", "abbreviation", 0.7)}, {_VAR("w[-1]", "abbreviation", 0.6)}, {_VAR("w[-1] || ', ' || w[1]", "alias", 0.85)},
 {_IF("NOT regexp_matches(n, '^(Dr|Prof)[.]')", _VAR("CASE WHEN length(n) > 10 THEN 'Prof. ' ELSE 'Dr. ' END || n", "title", 0.8))}, {_IF("len(w) > 2", _VAR("w[1] || ' ' || array_to_string(list_transform(w[2:-2], lambda x: x[1] || '.'), ' ') || ' ' || w[-1]", "abbreviation", 0.9))}]
 WHEN t = 'Organisation' THEN [CASE WHEN regexp_matches(n, {lit(_SUF)}) THEN {_VAR(f"trim(regexp_replace(n, {lit(_SUF)}, ''), ' ')", "abbreviation", 0.85)} ELSE {_VAR("n || ' Inc.'", "alias", 0.85)} END,
 {_IF(f"length({_ACR(_ORGW)}) >= 2", _VAR(f"upper({_ACR(_ORGW)})", "acronym", 0.5))}, CASE WHEN starts_with(n, 'The ') THEN {_VAR("substr(n, 5)", "alias", 0.95)} ELSE {_VAR("'The ' || n", "alias", 0.95)} END]
 WHEN t = 'Ort' THEN [{_IF("regexp_matches(n, ' (City|State|Province|County)$')", _VAR("regexp_replace(n, ' (City|State|Province|County)$', '')", "abbreviation", 0.85))}, {_IF(f"len(w) BETWEEN 2 AND 4 AND length({_ACR('w')}) >= 2", _VAR(f"upper({_ACR('w')})", "acronym", 0.55))}]
 ELSE [{_IF("len(w) > 1", _VAR("w[1]", "abbreviation", 0.55))}, {_IF("lower(w[1]) IN ('the', 'a', 'an')", _VAR("array_to_string(w[2:], ' ')", "alias", 0.9))}] END, lambda x: x IS NOT NULL)[1:4] AS vs FROM e)
 SELECT entity_id, x.variant_name AS variant_name, x.variant_type AS variant_type, x.expected_similarity AS expected_similarity FROM (SELECT entity_id, unnest(vs) AS x FROM v)""")
def generate_variants(spark, d):
    return g.variants(table(spark, d, "entities", "entity_id", "entity_name", "entity_type"))


_MUT = f"""m AS (SELECT *, ['duplicate', 'contradiction', 'schema', 'cardinality', 'correct'][floor({uniform_sql(42, 'seq')} * 5)::INT + 1] AS category, coalesce(lead(o_name) OVER w, first(o_name) OVER w) AS other, string_split(s_name, ' ') AS w
 FROM facts WHERE pred IS NOT NULL AND s_name IS NOT NULL AND o_name IS NOT NULL WINDOW w AS (PARTITION BY pred, o_type ORDER BY {draw_sql(44, 'seq')}, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


@query(with_(FACTS, _MUT) + """SELECT seq, category, CASE category WHEN 'correct' THEN 'ACCEPT' ELSE 'REJECT' END AS expected, CASE WHEN category <> 'duplicate' THEN s_name WHEN len(w) > 1 THEN s_name[1] || '. ' || array_to_string(w[2:], ' ') ELSE 'Dr. ' || s_name END AS s_name, pred,
 CASE WHEN category = 'schema' THEN s_name WHEN category IN ('contradiction', 'cardinality') THEN other ELSE o_name END AS o_name, CASE category WHEN 'correct' THEN 'update_' || seq ELSE doc END AS doc FROM m""")
def generate_mutations(spark, d):
    return g.mutate(kg.facts(spark, d))


@query(with_(FACTS) + f"SELECT seq, upper(m[1]) || m[2:] || ': ' || text_ AS claim, c AS confidence FROM facts, (VALUES {', '.join(f'({lit(a)}, {b}::DOUBLE)' for a, b in g.MARKERS)}) v(m, c) WHERE text_ IS NOT NULL")
def generate_modality(spark, d):
    return g.modal(kg.facts(spark, d))


_OPP = "CASE " + " ".join(f"WHEN regexp_matches(text_, '(?i)\\b{a}\\b') THEN regexp_replace(text_, '(?i)\\b{a}\\b', '{b}', 'g')" for a, b in [p for x in g.SWAPS for p in (x, x[::-1])]) + " ELSE array_to_string(list_reverse(string_split(text_, ' ')), ' ') END"


@query(with_(FACTS) + f"SELECT seq, {_OPP} AS conflicting FROM facts WHERE text_ IS NOT NULL")
def generate_opposites(spark, d):
    return kg.facts(spark, d).where("text is not null").select("seq", g.opposite(F.col("text")).alias("conflicting"))


def _events(spark, d):
    f = kg.facts(spark, d)
    cat = F.when(F.col("status") == "accepted", "supports").when(F.col("status") == "rejected", "refutes").when(F.col("batch_id") > 3, "entity_variant").otherwise("cross_doc")
    return f.select(F.col("seq").alias("id"), cat.alias("category"), F.lower("s_name").alias("key"))


def _order(name):
    def f(spark, d):
        s = g.shuffle(_events(spark, d), name)
        return s.select("id", "category", F.col("arrival.a").cast("double").alias("a"), F.col("arrival.b").alias("b"), F.col("arrival.c").alias("c"))

    f.__name__ = f"order_{name}"
    return f


CAT = "cat AS (SELECT seq, s_name, CASE WHEN status = 'accepted' THEN 'supports' WHEN status = 'rejected' THEN 'refutes' WHEN batch_id > 3 THEN 'entity_variant' ELSE 'cross_doc' END AS category FROM facts)"


_U, _D, _K = uniform_sql(42, "seq"), draw_sql(42, "seq"), number_sql("lower(s_name)")
_ORDERS = {
    "random": f"{_U} AS a, {_D} AS b, 0 AS c",
    "interleaved": f"(row_number() OVER (PARTITION BY category ORDER BY {_D}, seq))::DOUBLE AS a, {number_sql('category')} AS b, 0 AS c",
    "temporal": f"CASE category WHEN 'supports' THEN 0.4 * {_U} WHEN 'entity_variant' THEN 0.2 + 0.5 * {_U} WHEN 'refutes' THEN 0.5 + 0.4 * {_U} ELSE 0.7 + 0.3 * {_U} END AS a, {_D} AS b, 0 AS c",
    "clustered": f"{_K}::DOUBLE AS a, {_K} AS b, {_D} AS c",
    "adversarial": f"{_K}::DOUBLE AS a, (category <> 'supports')::BIGINT AS b, {_D} AS c",
}
for _s, _x in _ORDERS.items():
    query(with_(FACTS, CAT) + f"SELECT seq AS id, category, {_x} FROM cat")(_order(_s))


@query(with_(FACTS, CAT) + "SELECT category, count(*) AS n, min(seq) AS first, max(seq) AS last, round(avg(seq), 6) AS mean FROM cat GROUP BY category")
def order_statistics(spark, d):
    return g.order_statistics(_events(spark, d).withColumn("pos", F.col("id")))


@query(with_(FACTS, CAT) + f"SELECT seq AS id, category, lower(s_name) AS key FROM cat QUALIFY row_number() OVER (PARTITION BY category ORDER BY {_D}, seq) <= 25")
def sample_stratified(spark, d):
    return g.stratified(_events(spark, d), "category", 25)


@query(with_(FACTS) + f"SELECT seq, pred FROM batch WHERE pred IN {inlist(('LEITET', 'KENNT'))}")
def facts_of_relations(spark, d):
    return parts(spark, d)[0].where(F.col("pred").isin("LEITET", "KENNT")).select("seq", "pred")
