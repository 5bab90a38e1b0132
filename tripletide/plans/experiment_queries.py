"""Queries of conflict generators, question answering and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from ..functions import models, qa
from ..functions.draws import draw_sql, uniform_sql
from ..functions import text as tx
from ..operators import cascade, conflicts
from ..runtime import table
from .metric_queries import DEC, decisions
from .sql import FACTS, lit, with_
from .text_queries import CLAIM, TOKENS, norm_sql

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in conflicts.TAXONOMY) + ") v(kind, action, difficulty, found_by)")
def conflict_taxonomy(spark, d):
    return conflicts.taxonomy(spark)


_MAP = lambda t: "CASE pred " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in t.items()) + " END"
_OK = "FROM facts WHERE pred IS NOT NULL AND s_name IS NOT NULL AND o_name IS NOT NULL"
_Y = r"regexp_extract(o_name, '\b(1\d{3}|20\d{2})\b', 1)"
_N = len(conflicts.SOURCES)
_I = f"floor({uniform_sql(43, 'seq')} * {_N})::INT"
_J = f"({_I} + 1 + floor({uniform_sql(44, 'seq')} * {_N - 1})::INT) % {_N}"
_R = "[" + ", ".join(str(r) for _, r in conflicts.SOURCES) + "]"
_BLUR = lambda before, after: f"regexp_replace(o_name, '\\b(1\\d{{3}}|20\\d{{2}})\\b', '{before}' || {_Y}[1:3] || '0{after}', 'g')"
GEN = f"""al AS (SELECT *, coalesce(lead(o_name) OVER w, first(o_name) OVER w) AS other, string_split(s_name, ' ') AS w {_OK} WINDOW w AS (PARTITION BY pred, o_type ORDER BY {draw_sql(45, 'seq')}, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 gen AS (SELECT seq, 'factual' AS kind, 'reject' AS action, s_name, pred, coalesce(nullif(other, o_name), 'not-' || o_name) AS o_name, 0.8::DOUBLE AS conf FROM al
 UNION ALL SELECT seq, 'temporal', 'accept', s_name, pred, o_name || t, 0.8 FROM al, (VALUES {', '.join(f'({lit(t)})' for t in conflicts.TIMES)}) v(t)
 UNION ALL SELECT seq, 'granularity', 'merge', s_name, {_MAP(conflicts.LADDER)}, o_name, 0.8 FROM al WHERE {_MAP(conflicts.LADDER)} IS NOT NULL
 UNION ALL SELECT seq, 'entity_variant', 'merge', s_name[1] || '. ' || array_to_string(w[2:], ' '), pred, o_name, 0.8 FROM al WHERE len(w) > 1 UNION ALL SELECT seq, 'entity_variant', 'merge', w[-1] || ', ' || array_to_string(w[:-2], ' '), pred, o_name, 0.8 FROM al WHERE len(w) > 1
 UNION ALL SELECT seq, 'implicit', 'reject', s_name, {_MAP(conflicts.CONTRARY)}, o_name, 0.8 FROM al WHERE {_MAP(conflicts.CONTRARY)} IS NOT NULL UNION ALL SELECT seq, 'negation', 'reject', s_name, 'NOT_' || pred, o_name, 0.8 FROM al
 UNION ALL SELECT seq, 'modality', 'weight', s_name, pred, m || ' ' || o_name, c FROM al, (VALUES {', '.join(f'({lit(m)}, {c}::DOUBLE)' for m, c in conflicts.MARKERS)}) v(m, c)
 UNION ALL SELECT seq, 'source_quality', 'weight', s_name, pred, o_name, {_R}[{_I} + 1] FROM al UNION ALL SELECT seq, 'source_quality', 'weight', s_name, pred, o_name, {_R}[{_J} + 1] FROM al
 UNION ALL SELECT seq, 'schema', 'merge', s_name, coalesce({_MAP(conflicts.EQUIVALENT)}, 'schema:' || lower(pred)), o_name, 0.8 FROM al
 UNION ALL SELECT seq, 'numerical', 'accept', s_name, pred, o_name, 0.95 FROM al WHERE {_Y} <> '' UNION ALL SELECT seq, 'numerical', 'merge', s_name, pred, {_BLUR('the ', 's')}, 0.75 FROM al WHERE {_Y} <> '' UNION ALL SELECT seq, 'numerical', 'merge', s_name, pred, {_BLUR('about ', '')}, 0.75 FROM al WHERE {_Y} <> '')"""


@query(with_(FACTS, GEN) + "SELECT * FROM gen")
def conflict_generate(spark, d):
    return conflicts.generate(kg.facts(spark, d))


@query(with_(FACTS, GEN) + "SELECT kind, action, count(*) AS n FROM gen GROUP BY ALL")
def conflict_statistics(spark, d):
    return conflicts.statistics(conflicts.generate(kg.facts(spark, d)))


_RING = f"ring AS (SELECT seq, s_name, pred, coalesce(lead({{'o': o_name, 's': seq}}) OVER w, first({{'o': o_name, 's': seq}}) OVER w) AS n, o_name FROM facts WHERE pred IS NOT NULL AND s_name IS NOT NULL AND o_name IS NOT NULL WINDOW w AS (ORDER BY {draw_sql(42, 'seq')}, seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"


@query(with_(FACTS, _RING) + "SELECT seq, s_name, pred, n.o AS o_name, n.s AS other_seq FROM ring WHERE n.o <> o_name")
def conflict_swapped_objects(spark, d):
    return conflicts.swapped_objects(kg.facts(spark, d))


@query(with_(FACTS) + f"SELECT seq, t[1:500] AS text FROM (SELECT seq, s_name, o_name, lead(text_) OVER (ORDER BY {draw_sql(42, 'seq')}, seq) AS t FROM facts WHERE s_name IS NOT NULL AND o_name IS NOT NULL) WHERE length(t) >= 50 AND NOT contains(t, s_name) AND NOT contains(t, o_name)")
def conflict_false_sources(spark, d):
    return conflicts.false_sources(kg.facts(spark, d))


QUESTION = "Verlag leitet Institut für Messtechnik"
_LINES = r"""hit AS (SELECT * FROM (SELECT *, len(list_intersect(list_distinct(regexp_split_to_array(lower(concat_ws(' ', subject_name, predicate, object_name)), '\s+')), ['verlag', 'leitet', 'institut', 'für', 'messtechnik'])) AS score
 FROM (SELECT DISTINCT * FROM triples WHERE validation_status = 'accepted')) WHERE score > 0 ORDER BY score DESC, seq LIMIT 20),
 lines AS (SELECT row_number() OVER (ORDER BY score DESC, seq) AS rank, '- ' || concat_ws(' ', subject_name, predicate, object_name) || coalesce(' [' || CASE WHEN length(source_text) > 100 THEN source_text[1:100] || '...' ELSE source_text END || ']', '') AS line FROM hit)"""


def _triples(spark, d):
    return table(spark, d, "triples", "seq", "subject_name", "predicate", "object_name", "source_text", "validation_status")


@query(with_(_LINES) + "SELECT * FROM lines")
def qa_context(spark, d):
    return qa.context_lines(_triples(spark, d), QUESTION)


@query(with_(_LINES) + """SELECT coalesce((SELECT arg_min(trim(regexp_replace(line, '^[^-]*-', ''), ' '), rank) FROM lines WHERE contains(lower(line), 'verlag')::INT + contains(lower(line), 'leitet')::INT + contains(lower(line), 'institut')::INT
 + contains(lower(line), 'für')::INT + contains(lower(line), 'messtechnik')::INT >= 2), '') AS answer, round(least(0.9, 0.5 + sum(length(line)) / 2000), 6) AS confidence, count(*) AS n_facts FROM lines""")
def qa_answer(spark, d):
    return qa.answer(_triples(spark, d), QUESTION)


_ASKED = r"""q AS (SELECT pred AS id, lower(pred || ' ' || min(o_name) || '?') AS question FROM facts WHERE pred IS NOT NULL AND o_name IS NOT NULL GROUP BY pred), qw AS (SELECT id, unnest(list_filter(list_distinct(regexp_split_to_array(question, '\s+')), lambda x: x <> '')) AS w FROM q),
 t AS (SELECT DISTINCT seq, subject_name, predicate, object_name, source_text, validation_status FROM triples), tw AS (SELECT seq, validation_status, unnest(list_filter(list_distinct(regexp_split_to_array(lower(concat_ws(' ', subject_name, predicate, object_name)), '\s+')), lambda x: x <> '')) AS w FROM t)"""
_ONE = r"""{v}h AS (SELECT id, seq, count(*) AS score FROM qw JOIN tw USING (w) WHERE {ok} GROUP BY id, seq QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, seq) <= 20),
 {v}l AS (SELECT id, seq, score, '- ' || concat_ws(' ', subject_name, predicate, object_name) || coalesce(' [' || CASE WHEN length(source_text) > 100 THEN source_text[1:100] || '...' ELSE source_text END || ']', '') AS line, question FROM {v}h JOIN t USING (seq) JOIN q USING (id)),
 {v} AS (SELECT '{v}' AS variant, q.id, coalesce(arg_min(trim(regexp_replace(line, '^[^-]*-', ''), ' '), (-score, seq)) FILTER (len(list_filter(list_distinct(regexp_split_to_array(replace(l.question, '?', ' '), '\s+')), lambda x: x <> '' AND contains(lower(line), x))) >= 2), '') AS answer,
 round(least(0.9, 0.5 + coalesce(sum(length(line)), 0) / 2000), 6) AS confidence, count(line) AS n_facts FROM q LEFT JOIN {v}l l ON l.id = q.id GROUP BY q.id)"""


@query(with_(FACTS, _ASKED, _ONE.format(v="without_", ok="true"), _ONE.format(v="with_", ok="validation_status = 'accepted'")) + "SELECT replace(variant, '_', '') AS variant, id, answer, confidence, n_facts FROM (SELECT * FROM without_ UNION ALL SELECT * FROM with_)")
def qa_end_to_end(spark, d):
    """A question for each relation, with its first object by name."""
    f = kg.facts(spark, d).where("pred is not null and o_name is not null")
    return qa.end_to_end(f.groupBy(F.col("pred").alias("id")).agg(F.concat(F.first("pred"), F.lit(" "), F.min("o_name"), F.lit("?")).alias("question")), _triples(spark, d))


_ANSWERS = f"""pr AS (SELECT f.seq, f.pred, CASE WHEN z.n >= 4 AND len(z.rest) > 0 AND length(z.obj) >= 2 THEN z.obj END AS prediction, f.o_name AS gold FROM facts f JOIN z USING (seq) WHERE f.text_ IS NOT NULL),
 n AS (SELECT seq, pred, prediction, {norm_sql('prediction')} AS a, {norm_sql('gold')} AS b FROM pr)"""


@query(with_(FACTS, *CLAIM, _ANSWERS, TOKENS) + """SELECT pred, count(*) AS n, round(avg((prediction IS NOT NULL AND a IS NOT DISTINCT FROM b)::INT), 6) AS exact, round(avg(f1), 6) AS f1, round(avg((f1 > 0)::INT), 6) AS found, 1.0::DOUBLE AS latency
 FROM (SELECT n.*, coalesce(2 * (c / na) * (c / nb) / ((c / na) + (c / nb)), 0) AS f1 FROM n LEFT JOIN tot USING (seq) LEFT JOIN com USING (seq)) GROUP BY pred""")
def qa_summary(spark, d):
    f = kg.facts(spark, d).where("text is not null")
    a = f.select("pred", tx.claim_parts(F.col("text"))["object"].alias("prediction"), F.col("o_name").alias("gold"), F.lit(1.0).alias("ms"))
    return qa.summary(a, ["pred"])


_G = [(0.9, 0.7), (0.85, 0.65), (0.8, 0.6), (0.75, 0.55)]


@query(with_(FACTS, DEC) + f"""SELECT h AS high, m AS medium, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM (SELECT h, m, count(*) FILTER (y = 0 AND p < m) AS tp, count(*) FILTER (y = 1 AND p < h) AS fp, count(*) FILTER (y = 0 AND p >= m) AS fn
 FROM dec, (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE)" for a, b in _G)}) g(h, m) GROUP BY h, m)""")
def experiment_grid(spark, d):
    return qa.grid(decisions(spark, d), _G)


@query(with_(FACTS, DEC) + """SELECT pred AS variant, round(coalesce(count(*) FILTER (y = 1 AND p >= 0.7) / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS signal_kept, round(coalesce(count(*) FILTER (y = 0 AND p < 0.7) / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS noise_removed,
 round(coalesce(count(*) FILTER (y = 1 AND p >= 0.7) / nullif(count(*) FILTER (p >= 0.7), 0), 0), 6) AS precision FROM dec GROUP BY pred""")
def experiment_information_quality(spark, d):
    x = decisions(spark, d)
    return qa.information_quality(x.select(F.col("pred").alias("variant"), F.when(F.col("y") == 1, "signal").otherwise("noise").alias("part"), (F.col("p") >= 0.7).alias("kept")))


@query(with_(FACTS, DEC, "s AS (SELECT batch_id, count(*) FILTER (truth = 'reject' AND verdict <> 'accept') AS tp, count(*) FILTER (truth = 'accept' AND verdict <> 'accept') AS fp, count(*) FILTER (truth = 'reject' AND verdict = 'accept') AS fn FROM dec GROUP BY 1)",
    "g AS (SELECT batch_id, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s)") + "SELECT batch_id::VARCHAR AS variant, f1 AS value, round((SELECT f1 FROM g WHERE batch_id = 0) - f1, 6) AS delta FROM g")
def experiment_ablation(spark, d):
    from ..functions import metrics as m

    s = m.confusion(decisions(spark, d), "reject_positive_review_reject", ["batch_id"]).select(F.col("batch_id").cast("string").alias("variant"), "f1")
    return qa.ablation(s, "0")


@query(None)
def model_verification(spark, d):
    """Claims against their source texts by the hashed stand-in for a model, as support levels."""
    f = kg.facts(spark, d).where("text is not null").withColumn("claim", tx.sentence(F.col("s_name"), F.coalesce("pred", F.lit("")), F.col("o_name"), tx.CLAIMS_DE, tx.ANSWERS_DE))
    from ..functions.similarity import cosine

    e = models.embed(models.embed(f.select("seq", "claim", "text"), "claim", models.HashEmbedder, "a"), "text", models.HashEmbedder, "b")
    s = cascade.support(cosine(F.col("a"), F.col("b")), F.col("text"))
    return e.select("seq", s["level"].alias("level"), s["factor"].alias("factor"))


@query(None)
def model_inference(spark, d):
    f = kg.facts(spark, d).where("text is not null")
    x = models.infer(F.col("text"), F.concat_ws(" ", "s_name", "o_name"), models.OverlapInference)
    n = f.select("seq", x.alias("x"))
    return n.select("seq", "x.label", F.round("x.score", 6).alias("score"), cascade.inference_factor(F.col("x.label"), F.col("x.score")).alias("factor"))
