"""Readers with fixed schemas: question sets, claims, documents, snapshots, decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import question_type

HOTPOT = "id string, question string, answer string, type string, level string, supporting_facts struct<title:array<string>,sent_id:array<int>>, context struct<title:array<string>,sentences:array<array<string>>>"
MUSIQUE = (
    "id string, question string, answer string, answer_aliases array<string>, answerable boolean, paragraphs array<struct<title:string,paragraph_text:string,is_supporting:boolean>>, "
    "question_decomposition array<struct<question:string,answer:string,paragraph_support_idx:int>>"
)
FEVER = "id string, claim string, label string, evidence array<array<string>>"
DECISION = "triple_id string, dataset string, y_true int, y_pred int, stage_decided string, confidence double, subject string, predicate string, object string"


def supporting_text(title: Column, sent_id: Column, titles: Column, sentences: Column) -> Column:
    """The sentence of the first context paragraph with that title; empty where there is none."""
    at = F.array_position(titles, title)
    para = F.when(at > 0, F.get(sentences, (at - 1).cast("int")))
    return F.coalesce(F.when(sent_id >= 0, F.get(para, sent_id)), F.lit(""))


def hotpot(spark: SparkSession, path: str, sample: int | None = None, level: str | None = None) -> DataFrame:
    """(id, question, answer, question_type, level, hops, titles, supporting, gold_titles). The level is chosen before the sample is cut."""
    d = spark.read.schema(HOTPOT).json(path)
    if level:
        d = d.where(F.col("level") == level)
    if sample is not None:
        d = d.orderBy("id").limit(sample)
    facts = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sent_id"))
    text = F.transform(facts, lambda f: F.struct(f["title"].alias("title"), f["sent_id"].alias("sent_id"), supporting_text(f["title"], f["sent_id"], F.col("context.title"), F.col("context.sentences")).alias("text")))
    kind = question_type(F.col("question"), F.col("type"))
    return d.select("id", "question", "answer", kind.alias("question_type"), "level", F.lit(2).alias("hops"), F.col("context.title").alias("titles"), text.alias("supporting"), F.array_distinct(F.col("supporting_facts.title")).alias("gold_titles"))


def musique(spark: SparkSession, path: str, sample: int | None = None, hops: tuple[int, int] = (2, 4), only_answerable: bool = True) -> DataFrame:
    """As `hotpot`, from decomposed questions; the sample is cut after the filters. Without a decomposition there are two hops."""
    d = spark.read.schema(MUSIQUE).json(path)
    n = F.coalesce(F.nullif(F.size("question_decomposition"), F.lit(0)), F.lit(2))
    n = F.when(F.col("question_decomposition").isNull(), 2).otherwise(n)
    d = d.withColumn("hops", n).where(F.col("hops").between(*hops))
    if only_answerable:
        d = d.where(F.coalesce("answerable", F.lit(True)))
    if sample is not None:
        d = d.orderBy("id").limit(sample)
    steps = F.coalesce("question_decomposition", F.array().cast("array<struct<question:string,answer:string,paragraph_support_idx:int>>"))
    para = F.transform(steps, lambda s: F.get("paragraphs", s["paragraph_support_idx"]))
    para = F.filter(para, lambda p: p.isNotNull())
    support = F.transform(para, lambda p: F.struct(p["title"].alias("title"), F.lit(0).alias("sent_id"), p["paragraph_text"].alias("text")))
    kind = F.when(F.col("hops") > 2, "compositional").otherwise("bridge")
    return d.select("id", "question", "answer", kind.alias("question_type"), F.lit("").alias("level"), "hops", F.transform("paragraphs", lambda p: p["title"]).alias("titles"), support.alias("supporting"), F.array_distinct(F.transform(para, lambda p: p["title"])).alias("gold_titles"))


def fever(spark: SparkSession, path: str, sample: int | None = None, drop_nei: bool = True) -> DataFrame:
    """(id, claim, label, evidence_text). The sample is cut before claims without enough information are dropped, so fewer may come."""
    d = spark.read.schema(FEVER).json(path)
    if sample is not None:
        d = d.orderBy("id").limit(sample)
    if drop_nei:
        d = d.where(F.col("label") != "NOT ENOUGH INFO")
    return d.select("id", "claim", "label", F.coalesce(F.get(F.get("evidence", F.lit(0)), F.lit(2)), F.lit("")).alias("evidence_text"))


def balanced(claims: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """As many supported as refuted claims, at most n / 2 each, by the hash of their id."""
    from pyspark.sql import Window

    c = claims.where(F.col("label").isin("SUPPORTS", "REFUTES"))
    w = Window.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    r = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n // 2)
    least = r.groupBy("label").agg(F.max("r").alias("m")).agg(F.min("m").alias("most"), F.count("*").alias("k"))
    return r.crossJoin(F.broadcast(least)).where((F.col("r") <= F.col("most")) & (F.col("k") == 2)).drop("r", "most", "k")  # one row


LOADERS: dict[str, Callable[..., DataFrame]] = {"hotpotqa": hotpot, "musique": musique, "fever": fever}


def load(spark: SparkSession, name: str, path: str, **options: object) -> DataFrame:
    """A set by name; ValueError for one that isn't known."""
    if name.lower() not in LOADERS:
        raise ValueError(f"no loader for {name!r}; there are {sorted(LOADERS)}")
    return LOADERS[name.lower()](spark, path, **options)


def question_statistics(q: DataFrame) -> DataFrame:
    """(question_type, level, n, mean_hops, mean_paragraphs, mean_supporting)."""
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return q.groupBy("question_type", "level").agg(F.count("*").alias("n"), r("hops", "mean_hops"), r(F.size("titles"), "mean_paragraphs"), r(F.size("supporting"), "mean_supporting"))


def claim_statistics(c: DataFrame) -> DataFrame:
    """(label, n, mean_words, with_evidence)."""
    return c.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.size(F.split("claim", r"\s+"))), 6).alias("mean_words"), F.count_if(F.col("evidence_text") != "").alias("with_evidence"))


def gold_triples(q: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, confidence): each gold title related to the next, the first one to the answer."""
    pairs = F.filter(F.arrays_zip(F.col("gold_titles").alias("s"), F.slice("gold_titles", F.lit(2), F.greatest(F.size("gold_titles") - 1, F.lit(0))).alias("o")), lambda z: z["o"].isNotNull())
    rel = F.transform(pairs, lambda z: F.struct(z["s"].alias("subject"), F.lit("RELATED_TO").alias("predicate"), z["o"].alias("object"), F.lit(0.85).alias("confidence")))
    ans = F.when((F.size("gold_titles") > 0) & (F.length("answer") > 0), F.array(F.struct(F.get("gold_titles", F.lit(0)).alias("subject"), F.lit("HAS_ANSWER").alias("predicate"), F.col("answer").alias("object"), F.lit(0.9).alias("confidence"))))
    empty = F.array().cast("array<struct<subject:string,predicate:string,object:string,confidence:double>>")
    return q.select("id", F.explode(F.concat(rel, F.coalesce(ans, empty))).alias("x")).select("id", "x.*")


def sourced_triples(q: DataFrame) -> DataFrame:
    """(id, subject, predicate, object, confidence, source_document_id): `gold_triples` twice, with the example as their source and without one."""
    g = gold_triples(q)
    return g.withColumn("source_document_id", F.concat(F.lit("hotpotqa_"), "id")).unionByName(g.withColumn("source_document_id", F.lit(None).cast("string")))


def violating_triples(q: DataFrame) -> DataFrame:
    """(id, subject, predicate, object): the first gold title with the first two titles that are not gold."""
    bad = F.slice(F.array_except("titles", "gold_titles"), 1, 2)
    return q.where(F.size("gold_titles") > 0).select("id", F.get("gold_titles", F.lit(0)).alias("subject"), F.lit("RELATED_TO").alias("predicate"), F.explode(bad).alias("object"))


def split_by_support(q: DataFrame) -> DataFrame:
    """(id, title, part): signal for titles with a supporting fact, else noise."""
    return q.select("id", "gold_titles", F.explode("titles").alias("title")).select("id", "title", F.when(F.array_contains("gold_titles", F.col("title")), "signal").otherwise("noise").alias("part"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files; a PDF is left out, as its reader isn't part of this library."""
    d = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return d.where(~F.lower("path").endswith(".pdf"))


def decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DECISION).json(path)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Samples of an annotation file, one row each; without a label it is null."""
    schema = "instructions string, samples array<struct<id:string,subject_name:string,predicate:string,object_name:string,source_text:string,validation_status:string,human_label:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("samples").alias("x")).select("x.*")


def log_decisions(lines: DataFrame) -> DataFrame:
    """(line, dataset, stage, verdict, ms) of log lines (line, value): a header line sets the data set of the lines after it."""
    from pyspark.sql import Window

    head = F.nullif(F.regexp_extract("value", r"=== dataset: (\w+)", 1), F.lit(""))
    # One log is one ordered stream: its lines are read in order by one window per file.
    w = Window.partitionBy("file").orderBy("line")
    d = lines.withColumn("dataset", F.last(head, ignorenulls=True).over(w))
    verdict = F.regexp_extract("value", r"(ACCEPTED|REJECTED|NEEDS_REVIEW)", 1)
    return d.where(verdict != "").select("line", "dataset", F.nullif(F.regexp_extract("value", r"stage=(\w+)", 1), F.lit("")).alias("stage"), verdict.alias("verdict"), F.regexp_extract("value", r"ms=([\d.]+)", 1).try_cast("double").alias("ms"))


def log_samples(decisions_: DataFrame, n: int = 3) -> DataFrame:
    """Up to ``n`` decisions of a log for each (stage, verdict), in order of their line; rows past them are dropped before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy("stage", "verdict").orderBy("line")
    return decisions_.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


RESULT = "dataset string, tp bigint, fp bigint, tn bigint, fn bigint, precision double, recall double, f1 double, accuracy double"


def results(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(label, RESULT columns) of result files under their labels: a file holds one data set, or a list ``datasets`` of them."""
    out = None
    for label, path in paths.items():
        r = spark.read.schema(f"{RESULT}, datasets array<struct<{', '.join(c.replace(' ', ':') for c in RESULT.split(', '))}>>").json(path, multiLine=True)
        own = F.struct(*[c.split()[0] for c in RESULT.split(", ")])
        x = r.select(F.lit(label).alias("label"), F.explode(F.coalesce("datasets", F.array(own))).alias("x")).select("label", "x.*")
        out = x if out is None else out.unionByName(x)
    if out is None:
        raise ValueError("no result files")
    return out
