"""Queries of text scalars: typing, templates, answers, claims, sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from ..functions import text as tx
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


@query("SELECT entity_id, substr(md5(lower(entity_name) || ':' || entity_type), 1, 12) AS fp, substr(md5(lower(entity_name) || ':' || entity_type), 1, 12) IS NOT DISTINCT FROM fingerprint AS same FROM entities")
def text_fingerprint(spark, d):
    e = table(spark, d, "entities", "entity_id", "entity_name", "entity_type", "fingerprint")
    fp = kg.fingerprint(F.col("entity_name"), F.col("entity_type"))
    return e.select("entity_id", fp.alias("fp"), fp.eqNullSafe(F.col("fingerprint")).alias("same"))


def _template_sql(s, p, o, templates, answers):
    whens = " ".join(f"WHEN {lit(k)} THEN printf({lit(t)}, {s}, {o})" for k, t in templates.items()) + " " + " ".join(f"WHEN {lit(k)} THEN printf({lit(t)}, {o})" for k, t in answers.items())
    return f"CASE {p} {whens} ELSE concat_ws(' ', {s}, lower(replace({p}, '_', ' ')), {o}) END"


@query(with_(FACTS) + f"SELECT seq, {_template_sql('s_name', 'pred', 'o_name', tx.CLAIMS_DE, tx.ANSWERS_DE)} AS claim FROM batch")
def text_claim_de(spark, d):
    return parts(spark, d)[0].select("seq", tx.sentence(F.col("s_name"), F.col("pred"), F.col("o_name"), tx.CLAIMS_DE, tx.ANSWERS_DE).alias("claim"))


_EN = "CASE WHEN c.relation_en IS NOT NULL THEN c.relation_en ELSE pred END"


@query(with_(FACTS, "b AS (SELECT seq, s_name, o_name, coalesce(c.relation_en, pred) AS p FROM batch LEFT JOIN relation_catalog c ON c.relation_de = pred)")
    + f"SELECT seq, {_template_sql('s_name', 'p', 'o_name', tx.HYPOTHESES_EN, tx.ANSWERS_EN)} AS hypothesis FROM b")
def text_hypothesis_en(spark, d):
    cat = table(spark, d, "relation_catalog", "relation_de", "relation_en")  # 20 rows, fixed
    b = parts(spark, d)[0].join(F.broadcast(cat), F.col("pred") == F.col("relation_de"), "left")
    return b.select("seq", tx.sentence(F.col("s_name"), F.coalesce("relation_en", "pred"), F.col("o_name"), tx.HYPOTHESES_EN, tx.ANSWERS_EN).alias("hypothesis"))


def _type_sql(name, variant):
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({name}), {lit(w.replace('_', ' '))})" for w in words.split()) + f" THEN {lit(k)}" for k, words in tx.TYPE_WORDS[variant].items())
    if variant == "hybrid":
        return f"CASE {whens} WHEN lower(regexp_extract({name}, '\\(([^)]*)\\)', 1)) IN ('film', 'album', 'book', 'song', 'tv series') THEN 'Konzept' WHEN substr({name}, 1, 1) <> lower(substr({name}, 1, 1)) THEN 'Person' ELSE 'Konzept' END"
    return f"CASE {whens} ELSE 'Person' END"


@query("SELECT entity_id, " + ", ".join(f"{_type_sql('entity_name', v)} AS {v}" for v in tx.TYPE_WORDS) + " FROM entities")
def text_entity_type(spark, d):
    return table(spark, d, "entities", "entity_id", "entity_name").select("entity_id", *[tx.entity_type(F.col("entity_name"), v).alias(v) for v in tx.TYPE_WORDS])


@query(f"SELECT entity_type, k AS guessed, count(*) AS n FROM (SELECT entity_type, {_type_sql('entity_name', 'stream')} AS k FROM entities) GROUP BY ALL")
def text_entity_type_confusion(spark, d):
    e = table(spark, d, "entities", "entity_type", "entity_name")
    return e.groupBy("entity_type", tx.entity_type(F.col("entity_name"), "stream").alias("guessed")).agg(F.count("*").alias("n"))


def _rel_sql(q):
    whens = " ".join("WHEN " + " OR ".join(f"contains(lower({q}), {lit(w)})" for w in words.split()) + f" THEN {lit(r)}" for r, words in tx.QUESTION_WORDS)
    return f"CASE {whens} WHEN s_type = 'Person' AND o_type = 'Organisation' THEN 'ASSOZIIERT_MIT' WHEN s_type = 'Person' AND o_type = 'Ort' THEN 'VERBUNDEN_MIT' WHEN s_type = 'Person' AND o_type = 'Ereignis' THEN 'TEILNAHME_AN' ELSE 'RELATED_TO' END"


@query(with_(FACTS) + f"SELECT seq, {_rel_sql('text_')} AS relation FROM facts")
def text_relation_type(spark, d):
    return kg.facts(spark, d).select("seq", tx.relation_type(F.col("text"), F.col("s_type"), F.col("o_type")).alias("relation"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'compare|difference|both|either') THEN 'comparison' WHEN regexp_matches(lower(text), 'when|where|who|what') THEN 'bridge' ELSE 'unknown' END AS question_type FROM documents")
def text_question_type(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", tx.question_type(F.col("text")).alias("question_type"))


def norm_sql(x, german=True):
    t = f"lower({x})"
    if german:
        t = f"CASE trim({t}) WHEN 'ja' THEN 'yes' WHEN 'nein' THEN 'no' ELSE {t} END"
    art = "a|an|the|der|die|das|ein|eine|einer|eines|einem|einen" if german else "a|an|the"
    # RE2's \b knows ASCII letters only: what bounds a word is stated by hand, twice for neighbours that share a space.
    once = lambda y: f"regexp_replace({y}, '(^|[^\\pL\\pN_])({art})($|[^\\pL\\pN_])', '\\1 \\3', 'g')"
    punct = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
    return f"trim(regexp_replace(regexp_replace({once(once(t))}, '{punct}', '', 'g'), '[\\s\\pZ]+', ' ', 'g'))"


@query(f"SELECT entity_id, {norm_sql('description')} AS normal, {norm_sql('description', False)} AS normal_en FROM entities")
def text_normal_answer(spark, d):
    e = table(spark, d, "entities", "entity_id", "description")
    return e.select("entity_id", tx.normal_answer(F.col("description")).alias("normal"), tx.normal_answer(F.col("description"), False).alias("normal_en"))


TOKENS = """bag AS (SELECT seq, side, w, count(*) AS n FROM (SELECT seq, 'a' AS side, unnest(string_split(a, ' ')) AS w FROM n UNION ALL SELECT seq, 'b', unnest(string_split(b, ' ')) FROM n) WHERE w <> '' GROUP BY ALL),
 tot AS (SELECT seq, sum(n) FILTER (side = 'a') AS na, sum(n) FILTER (side = 'b') AS nb FROM bag GROUP BY seq),
 com AS (SELECT x.seq, sum(least(x.n, y.n)) AS c FROM bag x JOIN bag y ON x.seq = y.seq AND x.w = y.w AND x.side = 'a' AND y.side = 'b' GROUP BY x.seq)"""


@query(with_(FACTS, f"n AS (SELECT seq, {norm_sql('text_')} AS a, {norm_sql('concat_ws(chr(32), s_name, o_name)')} AS b FROM facts)", TOKENS)
    + """SELECT n.seq, a IS NOT DISTINCT FROM b AS same, round(coalesce(2 * (c / na) * (c / nb) / ((c / na) + (c / nb)), 0), 6) AS f1, round(coalesce(c / na, 0), 6) AS prec, round(coalesce(c / nb, 0), 6) AS rec
 FROM n LEFT JOIN tot USING (seq) LEFT JOIN com USING (seq)""")  # fmt: skip
def text_token_f1(spark, d):
    f = kg.facts(spark, d)
    gold = F.concat_ws(" ", "s_name", "o_name")
    s = tx.token_f1(F.col("text"), gold)
    r = lambda c: F.round(f"s.{c}", 6)
    f = f.select("seq", tx.exact_match(F.col("text"), gold).alias("same"), s.alias("s"))
    return f.select("seq", "same", r("f1").alias("f1"), r("precision").alias("prec"), r("recall").alias("rec"))


def _neg_sql(t):
    whens = " ".join(f"WHEN contains({t}, {lit(a)}) THEN left({t}, strpos({t}, {lit(a)}) - 1) || {lit(' cannot ' if a == ' can ' else a + 'not ')} || substr({t}, strpos({t}, {lit(a)}) + {len(a)})" for a in tx.AUXILIARIES)
    w = f"list_filter(regexp_split_to_array({t}, '[\\s\\pZ]+'), lambda x: x <> '')"
    return f"CASE {whens} WHEN len({w}) >= 3 THEN array_to_string(list_concat(list_concat({w}[1:2], ['not']), {w}[3:]), ' ') ELSE array_to_string({w}, ' ') END"


@query(with_(FACTS) + f"SELECT seq, {_neg_sql('text_')} AS negated FROM facts WHERE text_ IS NOT NULL")
def text_negate(spark, d):
    return kg.facts(spark, d).where("text is not null").select("seq", tx.negate(F.col("text")).alias("negated"))


@query(r"""SELECT doc_id, len(s) AS n_sentences, length(array_to_string(s, '')) AS n_letters FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)""")
def text_sentences(spark, d):
    s = tx.sentences(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.when(F.col("text").isNotNull(), F.size(s)).alias("n_sentences"), F.length(F.array_join(s, "")).alias("n_letters"))


CLAIM = (
    """w AS (SELECT seq, list_filter(regexp_split_to_array(coalesce(text_, ''), '[\\s\\pZ]+'), lambda x: x <> '') AS w FROM facts)""",
    "h AS (SELECT seq, w, len(w) AS n, list_position(list_transform(w, lambda x: x[1] = lower(x[1]) AND lower(x) NOT IN ('the', 'a', 'an')), true) AS pos_ FROM w)",
    "r AS (SELECT seq, w, n, CASE WHEN coalesce(pos_, 0) = 0 THEN n WHEN pos_ = 1 THEN least(n, 3) ELSE pos_ - 1 END AS head FROM h)",
    f"q AS (SELECT seq, w, n, head, w[head + 1:] AS rest, coalesce(list_position(list_transform(w[head + 1:], lambda x: lower(x) IN {inlist(('is', 'was', 'are', 'were', 'has', 'had', 'have', 'became', 'becomes'))}), true), 0) AS verb FROM r)",
    "z AS (SELECT *, regexp_replace(array_to_string(rest[(CASE WHEN verb > 0 THEN CASE WHEN verb >= len(rest) THEN greatest(len(rest) - 4, 0) ELSE verb END ELSE 0 END) + 1:], ' '), '[.,!?;:]+$', '') AS obj FROM q)",
)


@query(with_(FACTS, *CLAIM)
    + "SELECT seq, array_to_string(w[1:head], ' ') AS subject, CASE WHEN verb > 0 THEN upper(rest[verb]) ELSE 'STATES' END AS predicate, obj AS object FROM z WHERE n >= 4 AND len(rest) > 0 AND length(obj) >= 2")
def text_claim_parts(spark, d):
    return kg.facts(spark, d).select("seq", tx.claim_parts(F.col("text")).alias("c")).where("c is not null").select("seq", "c.*")


@query(with_(FACTS, """w AS (SELECT seq, list_filter(regexp_split_to_array(coalesce(text_, ''), '[\\s\\pZ]+'), lambda x: x <> '') AS w FROM facts)""")
    + """SELECT seq, CASE WHEN lower(w[1]) IN ('the', 'a', 'an') THEN w[1] || ' ' || w[2] ELSE w[1] END AS subject, 'CLAIMS' AS predicate, regexp_replace(array_to_string(w[greatest(len(w) - 2, 1):], ' '), '[.]+$', '') AS object FROM w WHERE len(w) >= 3""")
def text_simple_claim(spark, d):
    return kg.facts(spark, d).select("seq", tx.simple_claim(F.col("text")).alias("c")).where("c is not null").select("seq", "c.*")
