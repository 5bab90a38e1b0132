"""Sources: how far they are trusted at first, what their facts taught, who else states a fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .history import running, segment

from .. import ontology as o

FLOOR, CEILING, MISSING = 0.1, 0.99, 0.7


def initial_score(source: Column) -> Column:
    """The first trusted pattern in the source's name decides, then an untrusted one (.3), else .5; null counts as unknown (.5)."""
    s = F.lower(F.coalesce(source, F.lit("unknown")))
    c = None
    for pattern, score in o.TRUSTED.items():
        c = F.when(s.contains(pattern), score) if c is None else c.when(s.contains(pattern), score)
    for pattern in o.UNTRUSTED:
        c = c.when(s.contains(pattern), 0.3)
    return c.otherwise(0.5)


def fact_sources(edges: DataFrame) -> DataFrame:
    """(s_id, pred, o_id, n_sources): distinct sources of each accepted fact."""
    return edges.where("doc is not null").groupBy("s_id", "pred", "o_id").agg(F.count_distinct("doc").alias("n_sources"))


def confidence(batch: DataFrame, edges: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(seq, source_score, n_sources, adjusted): base confidence by the source's score, less without a source, more for each earlier source.

    profiles: (doc, reliability), learned; a source without one has its initial score. A null confidence counts as 1.
    """
    j = batch.join(fact_sources(edges), ["s_id", "pred", "o_id"], "left")
    score = initial_score(F.col("doc"))
    if profiles is not None:
        j = j.join(profiles.select("doc", "reliability"), "doc", "left")
        score = F.coalesce("reliability", score)
    factor = score * F.when(F.col("doc").isNull(), MISSING).otherwise(1.0)
    bonus = F.least(F.coalesce("n_sources", F.lit(0)) * 0.1, F.lit(0.3))
    adjusted = F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.coalesce("conf", F.lit(1.0)) * factor + bonus))
    return j.select("seq", F.round(score, 6).alias("source_score"), F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"), F.round(adjusted, 6).alias("adjusted"))


def decay(age_days: Column, half_life: float = 365.0) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life)


def record(decided: DataFrame) -> DataFrame:
    """(doc, total, accepted, rejected, conflicts) of (doc, accepted boolean or null, conflict): facts of no source share the source ``unknown``."""
    return decided.groupBy(F.coalesce("doc", F.lit("unknown")).alias("doc")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("accepted")).alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("conflict")).alias("conflicts"),
    )


def learn(decided: DataFrame, alpha: float = 0.1, start: int = 5) -> DataFrame:
    """(doc, reliability): from the fifth fact on, each decided one moves a source's score towards its acceptance rate, less half its conflicts.

    decided: (doc, seq, accepted, conflict). The fold needs the order of facts; a moving average forgets by (1 - alpha) a step, so it is the sum
    of its inputs weighted by how many updates follow. Running counts are sums over segments of a source's facts, so that one source, such as the facts of none, may have
    a large part of them. Scores are kept within .1 and .99 by clamping the result.
    """
    d = decided.withColumn("doc", F.coalesce("doc", F.lit("unknown")))
    d = segment(d.select("doc", "seq", "accepted", "conflict"), "doc", "seq", "provenance")
    n = running(d, "doc", "seq", {"n": F.lit(1), "a": F.coalesce("accepted", F.lit(False)).cast("int"), "c": F.col("conflict").cast("int"), "k": F.col("accepted").isNotNull().cast("int")})
    # Updates up to a row: decided ones, less those among the first rows that come too early to count.
    n = n.withColumn("u", (F.col("n") >= start) & F.col("accepted").isNotNull())
    n = n.withColumn("target", F.col("a") / F.col("n") * (1 - 0.5 * F.col("c") / F.col("n")))
    total = n.groupBy("doc").agg(F.max("k").alias("every"))
    n = n.join(total, "doc").withColumn("later", F.col("every") - F.col("k"))
    part = F.sum(F.when(F.col("u"), alpha * F.pow(F.lit(1 - alpha), F.col("later")) * F.col("target")))
    left = F.pow(F.lit(1 - alpha), F.sum(F.col("u").cast("int")))
    g = n.groupBy("doc").agg((F.coalesce(part, F.lit(0.0)) + left * initial_score(F.first("doc"))).alias("r"))
    return g.select("doc", F.round(F.greatest(F.lit(FLOOR), F.least(F.lit(CEILING), F.col("r"))), 6).alias("reliability"))


def statistics(profiles: DataFrame) -> DataFrame:
    """One row over (source_id, reliability_score, totals): mean, least and best reliability, totals and rates."""
    return profiles.agg(
        F.count("*").alias("n_sources"),
        F.round(F.avg("reliability_score"), 6).alias("mean_reliability"),
        F.min("reliability_score").alias("min_reliability"),
        F.max("reliability_score").alias("max_reliability"),
        F.sum("total_triples").alias("total"),
        F.round(F.try_divide(F.sum("accepted_triples"), F.sum("total_triples")), 6).alias("acceptance_rate"),
        F.round(F.try_divide(F.sum("conflicts_caused"), F.sum("total_triples")), 6).alias("conflict_rate"),
    )


def report(profiles: DataFrame, k: int | None = None) -> DataFrame:
    """(source_id, reliability_score, acceptance_rate, conflict_rate, level) of all sources, or of the ``k`` most reliable."""
    rate = lambda c: F.round(F.coalesce(F.try_divide(F.col(c), F.col("total_triples")), F.lit(0.0)), 6)
    level = F.when(F.col("reliability_score") >= 0.8, "high").when(F.col("reliability_score") >= 0.5, "medium").otherwise("low")
    r = profiles.select("source_id", "reliability_score", rate("accepted_triples").alias("acceptance_rate"), rate("conflicts_caused").alias("conflict_rate"), level.alias("level"))
    return r if k is None else r.orderBy(F.col("reliability_score").desc_nulls_last(), "source_id").limit(k)


def explanation(checked: DataFrame) -> DataFrame:
    """(seq, explanation): the adjusted confidence in words, from the columns of `confidence`."""
    c = F.col
    text = F.concat_ws(
        "; ",
        F.format_string("source score %.6f", c("source_score")),
        F.when(c("n_sources") > 0, F.format_string("%d earlier sources", c("n_sources"))),
        F.format_string("adjusted %.6f", c("adjusted")),
    )
    return checked.select("seq", text.alias("explanation"))


def graph_boost(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, n_docs, boost): distinct documents that state the same subject, relation and object name, the new one included: 1.2 from three on, 1.1 for two."""
    old = edges.where("doc is not null").select("s_id", "pred", F.lower("o_name").alias("o"), "doc").distinct()
    n = old.groupBy("s_id", "pred", "o").agg(F.count("*").alias("n"))
    b = batch.withColumn("o", F.lower("o_name"))
    known = old.withColumn("_k", F.lit(1))
    j = b.join(n, ["s_id", "pred", "o"], "left").join(known, ["s_id", "pred", "o", "doc"], "left")
    docs = (F.coalesce("n", F.lit(0)) + F.when(F.col("doc").isNotNull() & F.col("_k").isNull(), 1).otherwise(0)).cast("bigint")
    return j.select("seq", docs.alias("n_docs"), F.when(docs >= 3, 1.2).when(docs == 2, 1.1).otherwise(1.0).alias("boost"))


def multiplier(adjusted: Column, base: Column, boost: Column, compat: bool = False) -> Column:
    """What provenance multiplies a confidence by. ``compat`` lets the boost (never under 1) hide any penalty; else the two are multiplied."""
    ratio = F.coalesce(F.try_divide(adjusted, base), F.lit(1.0))
    return F.greatest(ratio, boost) if compat else ratio * boost
