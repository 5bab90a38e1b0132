"""Queries of readers and writers: tables are written in the shape that a reader takes, read by it, and stated in SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import table, tables_dir
from ..sources import loaders, sinks

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _path(spark, label: str) -> str:
    return f"{tables_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _json(df: DataFrame, label: str) -> str:
    path = _path(df.sparkSession, label)
    df.write.json(path)
    return path


def _docs(spark, d):
    """Documents with a title and a text, as question sets are made of them."""
    t = table(spark, d, "documents", "doc_id", "title", "text", "source", "lang").where("title is not null and text is not null and length(text) > 0")
    return t.withColumn("n", F.col("doc_id") % 4)


_D = "d AS (SELECT doc_id, title, text, source, lang, doc_id % 4 AS n FROM documents WHERE title IS NOT NULL AND text IS NOT NULL AND length(text) > 0)"
_QUESTION = "CASE n WHEN 0 THEN 'Compare both: ' || title WHEN 1 THEN 'Who wrote ' || title || '?' ELSE 'Name ' || title END"


def _hotpot(spark, d) -> str:
    title = lambda k: F.concat("title", F.lit(f" {k}"))
    return _json(
        _docs(spark, d).select(
            F.col("doc_id").cast("string").alias("id"), F.expr(_QUESTION).alias("question"), F.when(F.col("n") < 3, F.col("source")).otherwise("").alias("answer"), F.when(F.col("n") == 3, "bridge").alias("type"),
            F.when(F.col("n") > 1, "hard").otherwise("easy").alias("level"),
            F.struct(F.array(title(1), title(2), title(1), title(9)).alias("title"), F.array(F.lit(0), F.lit(1), F.lit(7), F.lit(0)).alias("sent_id")).alias("supporting_facts"),
            F.struct(F.array(title(3), title(1), title(2), title(4), title(5)).alias("title"), F.array(F.array(F.lit("no")), F.array(F.substring("text", 1, 30)), F.array(F.lit("a"), F.substring("text", 5, 20)), F.array(F.lit("x")), F.array().cast("array<string>")).alias("sentences")).alias("context"),
        ), "hotpot",
    )


_HOT = f"""{_D}, q AS (SELECT doc_id::VARCHAR AS id, {_QUESTION} AS question, CASE WHEN n < 3 THEN source ELSE '' END AS answer, CASE n WHEN 0 THEN 'comparison' WHEN 2 THEN 'unknown' ELSE 'bridge' END AS base, n, title AS t, text,
 CASE WHEN n > 1 THEN 'hard' ELSE 'easy' END AS level FROM d),
 h AS (SELECT *, CASE WHEN n = 3 THEN 'bridge' WHEN regexp_matches(lower(question), 'compare|difference|both|either') THEN 'comparison' WHEN regexp_matches(lower(question), 'when|where|who|what') THEN 'bridge' ELSE 'unknown' END AS question_type FROM q)"""


@query(f"WITH {_HOT} SELECT id, question, answer, question_type, level, 2 AS hops, t || ' 3|' || t || ' 1|' || t || ' 2|' || t || ' 4|' || t || ' 5' AS titles, text[1:30] || '|' || text[5:24] || '||' AS support, t || ' 1|' || t || ' 2|' || t || ' 9' AS gold FROM h")
def source_hotpotqa(spark, d):
    q = loaders.load(spark, "hotpotqa", _hotpot(spark, d))
    return q.select("id", "question", "answer", "question_type", "level", "hops", F.array_join("titles", "|").alias("titles"), F.array_join(F.transform("supporting", lambda s: s["text"]), "|").alias("support"), F.array_join("gold_titles", "|").alias("gold"))


@query(f"WITH {_HOT} SELECT question_type, level, count(*) AS n, 2.0::DOUBLE AS mean_hops, 5.0::DOUBLE AS mean_paragraphs, 4.0::DOUBLE AS mean_supporting FROM h GROUP BY ALL")
def source_question_statistics(spark, d):
    return loaders.question_statistics(loaders.hotpot(spark, _hotpot(spark, d)))


_PAIR = "SELECT id, t || ' {}' AS subject, '{}' AS predicate, {} AS object, {}::DOUBLE AS confidence FROM h"


@query(f"WITH {_HOT} {_PAIR.format(1, 'RELATED_TO', chr(116) + ' || ' + repr(' 2'), 0.85)} UNION ALL {_PAIR.format(2, 'RELATED_TO', chr(116) + ' || ' + repr(' 9'), 0.85)} UNION ALL {_PAIR.format(1, 'HAS_ANSWER', 'answer', 0.9)} WHERE length(answer) > 0")
def source_gold_triples(spark, d):
    return loaders.gold_triples(loaders.hotpot(spark, _hotpot(spark, d)))


_GOLD = f"{_PAIR.format(1, 'RELATED_TO', chr(116) + ' || ' + repr(' 2'), 0.85)} UNION ALL {_PAIR.format(2, 'RELATED_TO', chr(116) + ' || ' + repr(' 9'), 0.85)} UNION ALL {_PAIR.format(1, 'HAS_ANSWER', 'answer', 0.9)} WHERE length(answer) > 0"


@query(f"WITH {_HOT}, g AS ({_GOLD}) SELECT *, 'hotpotqa_' || id AS source_document_id FROM g UNION ALL SELECT *, NULL FROM g")
def source_sourced_triples(spark, d):
    return loaders.sourced_triples(loaders.hotpot(spark, _hotpot(spark, d)))


@query(f"WITH {_HOT} SELECT id, t || ' 1' AS subject, 'RELATED_TO' AS predicate, t || ' ' || k AS object FROM h, (VALUES (3), (4)) v(k)")
def source_violating_triples(spark, d):
    return loaders.violating_triples(loaders.hotpot(spark, _hotpot(spark, d)))


@query(f"WITH {_HOT} SELECT id, t || ' ' || k AS title, CASE WHEN k IN (1, 2) THEN 'signal' ELSE 'noise' END AS part FROM h, (VALUES (1), (2), (3), (4), (5)) v(k)")
def source_split_by_support(spark, d):
    return loaders.split_by_support(loaders.hotpot(spark, _hotpot(spark, d)))


@query(f"WITH {_D} SELECT doc_id::VARCHAR AS id, title AS answer, CASE n WHEN 3 THEN 3 ELSE 2 END AS hops, CASE n WHEN 3 THEN 'compositional' ELSE 'bridge' END AS question_type, CASE n WHEN 0 THEN '' WHEN 3 THEN source || '|' || text[1:40] || '|' || source ELSE text[1:40] || '|' || source END AS support FROM d WHERE n <> 1")
def source_musique(spark, d):
    step = lambda i: F.struct(F.lit("q").alias("question"), F.lit("a").alias("answer"), F.lit(i).alias("paragraph_support_idx"))
    para = lambda t, x: F.struct(F.lit(t).alias("title"), x.alias("paragraph_text"), F.lit(True).alias("is_supporting"))
    steps = F.when(F.col("n") == 3, F.array(step(1), step(0), step(1))).when(F.col("n") > 0, F.array(step(0), step(1)))
    path = _json(_docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.lit("q").alias("question"), F.col("title").alias("answer"), (F.col("n") != 1).alias("answerable"), F.array(para("a", F.substring("text", 1, 40)), para("b", F.col("source"))).alias("paragraphs"), steps.alias("question_decomposition")), "musique")
    q = loaders.musique(spark, path)
    return q.select("id", "answer", "hops", "question_type", F.array_join(F.transform("supporting", lambda s: s["text"]), "|").alias("support"))


def _claims(spark, d) -> str:
    label = F.when(F.col("n") == 0, "SUPPORTS").when(F.col("n") == 1, "REFUTES").when(F.col("n") == 2, "SUPPORTS").otherwise("NOT ENOUGH INFO")
    evidence = F.when(F.col("n") < 2, F.array(F.array(F.col("title"), F.lit("0"), F.substring("text", 1, 60))))
    return _json(_docs(spark, d).select(F.col("doc_id").cast("string").alias("id"), F.substring("text", 1, 80).alias("claim"), label.alias("label"), evidence.alias("evidence")), "fever")


_CLAIMS = f"{_D}, c AS (SELECT doc_id::VARCHAR AS id, text[1:80] AS claim, CASE n WHEN 1 THEN 'REFUTES' ELSE 'SUPPORTS' END AS label, CASE WHEN n < 2 THEN text[1:60] ELSE '' END AS evidence_text FROM d WHERE n < 3)"


@query(f"WITH {_CLAIMS} SELECT * FROM c")
def source_fever(spark, d):
    return loaders.load(spark, "FEVER", _claims(spark, d))


@query(f"WITH {_CLAIMS} SELECT label, count(*) AS n, round(avg(len(regexp_split_to_array(claim, '[ \\t\\n\\x0B\\f\\r]+'))), 6) AS mean_words, count(*) FILTER (evidence_text <> '') AS with_evidence FROM c GROUP BY label")
def source_claim_statistics(spark, d):
    return loaders.claim_statistics(loaders.fever(spark, _claims(spark, d)))


def _triples(spark, d):
    return table(spark, d, "triples", "seq", "subject_name", "predicate", "object_name", "source_text", "validation_status", "extraction_confidence", "batch_id").dropDuplicates(["seq"])


_T = "t AS (SELECT DISTINCT seq, subject_name, predicate, object_name, source_text, validation_status, extraction_confidence, batch_id FROM triples)"


@query(f"WITH {_T} SELECT seq::VARCHAR AS triple_id, 'history' AS dataset, (validation_status = 'accepted')::INT AS y_true, extraction_confidence AS confidence, subject_name AS subject, object_name AS object FROM t")
def sink_examples(spark, d):
    """Decisions to lines of JSON and back."""
    t = _triples(spark, d).select(F.col("seq").cast("string").alias("triple_id"), F.lit("history").alias("dataset"), (F.col("validation_status") == "accepted").cast("int").alias("y_true"), F.col("extraction_confidence").alias("confidence"), F.col("subject_name").alias("subject"), F.col("predicate"), F.col("object_name").alias("object"))
    path = _path(spark, "lines")
    sinks.write_lines(t.select(F.to_json(F.struct("*")).alias("line")), path)
    return loaders.decisions(spark, path).select("triple_id", "dataset", "y_true", "confidence", "subject", "object")


@query(f"WITH {_T} SELECT seq::VARCHAR AS id, subject_name, predicate, object_name, CASE seq % 3 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' END AS human_label FROM t")
def source_annotations(spark, d):
    """Annotation files, one for each hundredth of the facts, as one reads them back."""
    t = _triples(spark, d).withColumn("label", F.when(F.col("seq") % 3 == 0, "correct").when(F.col("seq") % 3 == 1, "incorrect"))
    one = F.struct(F.col("seq").cast("string").alias("id"), "subject_name", "predicate", "object_name", "source_text", "validation_status", F.col("label").alias("human_label"))
    files = t.groupBy((F.col("seq") % 100).alias("file")).agg(F.collect_list(one).alias("samples"))
    path = _path(spark, "annotations")
    files.withColumn("instructions", F.lit("label each")).write.partitionBy("file").json(path)  # one object a file
    return loaders.annotations(spark, path).select("id", "subject_name", "predicate", "object_name", "human_label")


_LINE = "CASE WHEN seq % 50 = 0 THEN '=== dataset: set' || (seq // 50 % 3) WHEN seq % 7 = 0 THEN 'progress ' || seq ELSE 'stage=' || ['rules', 'embedding', 'llm'][(seq % 3 + 1)::INT] || ' ' || ['ACCEPTED', 'REJECTED', 'NEEDS_REVIEW'][(seq % 5 % 3 + 1)::INT] || ' ms=' || (seq % 1000) || '.5' END"
_LOG = f"""{_T}, x AS (SELECT seq AS line, seq % 50 = 0 AS head, seq, seq % 7 = 0 AS noise FROM t), l AS (SELECT *, last_value(CASE WHEN head THEN 'set' || (seq // 50 % 3) END IGNORE NULLS) OVER (ORDER BY line) AS dataset FROM x),
 dec_ AS (SELECT line, dataset, ['rules', 'embedding', 'llm'][(seq % 3 + 1)::INT] AS stage, ['ACCEPTED', 'REJECTED', 'NEEDS_REVIEW'][(seq % 5 % 3 + 1)::INT] AS verdict, seq % 1000 + 0.5::DOUBLE AS ms FROM l WHERE NOT head AND NOT noise)"""


def _log(spark, d):
    s = F.col("seq")
    pick = lambda xs, i: F.element_at(F.array(*map(F.lit, xs)), (i + 1).cast("int"))
    body = F.concat(F.lit("stage="), pick(("rules", "embedding", "llm"), s % 3), F.lit(" "), pick(("ACCEPTED", "REJECTED", "NEEDS_REVIEW"), s % 5 % 3), F.lit(" ms="), (s % 1000).cast("string"), F.lit(".5"))
    line = F.when(s % 50 == 0, F.concat(F.lit("=== dataset: set"), (F.floor(s / 50) % 3).cast("string"))).when(s % 7 == 0, F.concat(F.lit("progress "), s.cast("string"))).otherwise(body)
    return loaders.log_decisions(_triples(spark, d).select(F.lit("log").alias("file"), s.alias("line"), line.alias("value")))


@query(f"WITH {_LOG} SELECT line, dataset, stage, verdict, ms FROM dec_")
def source_log(spark, d):
    return _log(spark, d)


@query(f"WITH {_LOG} SELECT stage, verdict, line FROM dec_ QUALIFY row_number() OVER (PARTITION BY stage, verdict ORDER BY line) <= 5")
def source_log_samples(spark, d):
    return loaders.log_samples(_log(spark, d), 5).select("stage", "verdict", "line")


@query("SELECT source_id, coalesce(reliability_score, 0.5) AS reliability_score, coalesce(total_triples, 0) AS total_triples, coalesce(conflicts_caused, 0) AS conflicts_caused FROM source_profiles")
def sink_profiles(spark, d):
    path = _path(spark, "profiles")
    sinks.write_profiles(table(spark, d, "source_profiles"), path)
    return sinks.read_profiles(spark, path).select("source_id", "reliability_score", "total_triples", "conflicts_caused")


@query("SELECT relation_id, source_id, target_id, relation_type, confidence FROM relations")
def sink_snapshot(spark, d):
    """Saved twice, the second in place of the first, and loaded."""
    path = _path(spark, "snapshot")
    t = {"entities": table(spark, d, "entities", "entity_id"), "relations": table(spark, d, "relations", "relation_id", "source_id", "target_id", "relation_type", "confidence")}
    sinks.save_snapshot({n: x.limit(0) for n, x in t.items()}, path)
    sinks.save_snapshot(t, path)
    return sinks.load_snapshot(spark, path, list(t))["relations"]


@query("SELECT 'graph' AS category, unnest(['n', 'total', 'types']) AS metric, unnest([count(*), count(confidence), count(DISTINCT relation_type)]::VARCHAR[]) AS value FROM relations")
def sink_metrics(spark, d):
    """One row of metrics, flattened, to a file with a head line and back."""
    path = _path(spark, "metrics")
    row = table(spark, d, "relations").agg(F.count("*").alias("n"), F.count("confidence").alias("total"), F.count_distinct("relation_type").alias("types"))
    sinks.write_metrics(sinks.flatten(row, "graph"), path)
    return spark.read.schema("category string, metric string, value string").option("header", True).csv(path)


@query("WITH r AS (SELECT unnest(['a', 'b']) AS label, unnest(['x', 'y']) AS dataset, unnest([3, 5]) AS tp, unnest([1, 2]) AS fp) SELECT label, dataset, tp, fp FROM r")
def source_results(spark, d):
    """Result files of several shapes under their labels: a list of data sets, and one alone."""
    one = _json(spark.range(1).selectExpr("array(named_struct('dataset', 'x', 'tp', 3, 'fp', 1)) AS datasets"), "result")
    other = _json(spark.range(1).selectExpr("'y' AS dataset", "5 AS tp", "2 AS fp"), "result")
    return loaders.results(spark, {"a": one, "b": other}).select("label", "dataset", "tp", "fp")
