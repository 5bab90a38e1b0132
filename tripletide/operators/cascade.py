"""The cascade: rules, fast path, second stage, trigger, verdict. Expensive stages see only what is routed to them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ontology as o
from ..runtime import materialize
from .resolution import combine


def trigger(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, reason): an incompatible edge from subject to object, or one of the object's with the subject; else a dangerous relation stated with little confidence.

    Only facts of dangerous relations are looked at.
    """
    pairs = o.frame(batch.sparkSession, o.incompatible_pairs(), "pred string, other string")
    b = batch.where(F.col("pred").isin(*o.DANGEROUS))
    e = edges.select(F.col("s_id").alias("x"), F.col("o_id").alias("y"), F.col("pred").alias("other")).distinct()
    want = b.join(F.broadcast(pairs), "pred").select("seq", "s_id", "o_id", "other")  # fixed table
    ahead = want.join(e.toDF("s_id", "o_id", "other"), ["s_id", "o_id", "other"], "left_semi").select("seq", F.lit("role_conflict").alias("reason"), F.lit(0).alias("k"))
    back = want.join(e.toDF("o_id", "s_id", "other"), ["s_id", "o_id", "other"], "left_semi").select("seq", F.lit("object_conflict"), F.lit(1))
    low = b.where(F.coalesce("conf", F.lit(1.0)) < o.LOW_TRIGGER).select("seq", F.lit("low_confidence"), F.lit(2))
    return ahead.union(back).union(low).groupBy("seq").agg(F.min(F.struct("k", "reason")).alias("m")).select("seq", F.col("m.reason").alias("reason"))


def route(stage1: DataFrame, second: DataFrame, triggers: DataFrame, method: str = "weighted_avg", judge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(seq, status, decided_by, confidence): the verdict on every fact.

    stage1: (seq, outcome, confidence); second: (seq, has_text, adjusted, n_conflicts, confidence2); triggers: (seq, reason). In order: FAIL of the rules rejects; a PASS of
    .9 or more is accepted at once, with a source text only if its adjusted confidence stays there; else the stages' confidences are combined, and a trigger, a conflict
    of the second stage or less than .7 asks the judge. ``judge`` gets (seq, confidence) of those and returns (seq, outcome, confidence); without one they need review.
    """
    j = stage1.select("seq", "outcome", F.col("confidence").alias("c1")).join(second, "seq", "left").join(triggers, "seq", "left")
    c1 = F.col("c1")
    sure = F.when(F.coalesce("has_text", F.lit(False)), F.coalesce("adjusted", c1)).otherwise(c1)
    fast = (F.col("outcome") == "PASS") & (c1 >= o.HIGH) & (sure >= o.HIGH)
    both = combine(c1, F.coalesce("confidence2", F.lit(1.0)), method)
    asks = F.col("reason").isNotNull() | (F.coalesce("n_conflicts", F.lit(0)) > 0) | (both < o.MEDIUM)
    where: Column = F.when(F.col("outcome") == "FAIL", "rules").when(fast, "fast_path").when(~asks, "stage2").otherwise("stage3")
    conf = F.when(F.col("outcome") == "FAIL", c1).when(fast, sure).otherwise(both)
    routed = j.select("seq", where.alias("decided_by"), F.round(conf, 6).alias("confidence"))
    status = F.when(F.col("decided_by") == "rules", "rejected").when(F.col("decided_by") == "stage3", "needs_review").otherwise("accepted")
    if judge is None:
        return routed.select("seq", status.alias("status"), "decided_by", "confidence")
    routed = materialize(routed, "routed")
    done = routed.where("decided_by <> 'stage3'").select("seq", status.alias("status"), "decided_by", "confidence")
    said = judge(routed.where("decided_by = 'stage3'").select("seq", "confidence"))
    verdict = F.when(F.col("outcome") == "PASS", "accepted").when(F.col("outcome") == "FAIL", "rejected").otherwise("needs_review")
    return done.unionByName(said.select("seq", verdict.alias("status"), F.lit("stage3").alias("decided_by"), "confidence"))


def run_statistics(decided: DataFrame) -> DataFrame:
    """One row: counts of each verdict, acceptance rate, share that reached the judge."""
    n = F.count("*")
    c = lambda x: F.count_if(F.col("status") == x)
    return decided.agg(
        n.alias("n"), c("accepted").alias("accepted"), c("rejected").alias("rejected"), c("needs_review").alias("needs_review"),
        F.round(F.coalesce(F.try_divide(c("accepted"), n), F.lit(0.0)), 6).alias("acceptance_rate"), F.round(F.coalesce(F.try_divide(F.count_if(F.col("decided_by") == "stage3"), n), F.lit(0.0)), 6).alias("escalation_rate"),
    )


def stage_statistics(decided: DataFrame) -> DataFrame:
    """(decided_by, status, n, mean_confidence, median_confidence, share): per stage and verdict."""
    g = decided.groupBy("decided_by", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 8).alias("mean_confidence"), F.round(F.percentile("confidence", F.lit(0.5)), 6).alias("median_confidence"))
    total = decided.agg(F.count("*").alias("_t"))
    return g.crossJoin(F.broadcast(total)).withColumn("share", F.round(F.col("n") / F.col("_t"), 6)).drop("_t")  # one row


def context(batch: DataFrame, edges: DataFrame, n_subject: int = 5, n_object: int = 5, n_same: int = 0) -> DataFrame:
    """(seq, side, rank, edge_seq): what a judge is shown: the first edges leaving the subject, reaching the object and, if asked, of the same relation.

    The firsts are taken per node or relation before facts are joined, so nothing grows with a node's degree.
    """
    from .store import first_per

    out = None
    for side, key, mine, n in (("subject", "s_id", "s_id", n_subject), ("object", "o_id", "o_id", n_object), ("relation", "pred", "pred", n_same)):
        if not n:
            continue
        e = first_per(edges.select(key, F.col("seq").alias("edge_seq")), [key], ["edge_seq"], n)
        from pyspark.sql import Window

        e = e.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("edge_seq")))
        one = batch.select("seq", F.col(mine).alias(key)).join(e, key).select("seq", F.lit(side).alias("side"), "rank", "edge_seq")
        out = one if out is None else out.union(one)
    return out


def vote(opinions: DataFrame) -> DataFrame:
    """(seq, outcome, confidence) of (seq, action, confidence): any review leaves it open; a majority to accept needs .6; a majority to reject fails; merge votes don't count."""
    g = opinions.groupBy("seq").agg(
        F.count_if(F.col("action") == "human_review").alias("r"), F.count_if(F.col("action") == "accept").alias("a"), F.count_if(F.col("action") == "reject").alias("x"),
        F.aggregate(F.array_sort(F.collect_list("confidence")), F.lit(1.0), lambda p, c: p * c).alias("confidence"),
    )  # one opinion per conflict of a fact
    c = F.col
    out = F.when(c("r") > 0, "UNCERTAIN").when((c("a") > c("x")) & (c("confidence") >= 0.6), "PASS").when(c("x") > c("a"), "FAIL").otherwise("UNCERTAIN")
    return g.select("seq", out.alias("outcome"), F.round("confidence", 6).alias("confidence"))


def support(similarity: Column, text: Column) -> Column:
    """Struct (level, factor): how well a source text supports a claim, by their similarity; short, empty and missing texts count for less, no similarity for nothing."""
    n = F.length(F.coalesce(text, F.lit("")))
    s = similarity
    level = F.when(n == 0, "none").when(n < 20, "low").when(s.isNull(), "unknown").when(s >= 0.7, "high").when(s >= 0.5, "medium").when(s >= 0.3, "low").otherwise("none")
    factor = F.when(level == "high", 1.1).when(level == "low", 0.7).when(level == "none", 0.5).otherwise(1.0)
    return F.struct(level.alias("level"), factor.alias("factor"))


def inference_factor(label: Column, score: Column) -> Column:
    """Factor for an inference label: 1.1 for entailment and .3 for contradiction of .7 and more, else .9."""
    return F.when((label == "entailment") & (score >= 0.7), 1.1).when((label == "contradiction") & (score >= 0.7), 0.3).otherwise(0.9)


def usage_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1000 * 0.01 + tokens_out / 1000 * 0.03
