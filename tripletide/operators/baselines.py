"""Classifiers to compare the cascade with. Each gives (seq, accepted, confidence) for every fact; models come in as columns or functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw, uniform
from ..functions.draws import PRIME
from ..runtime import materialize
from .resolution import combine

ACCEPT, LLM_LEAST, DUPLICATE, MISSING_SOURCE = 0.7, 0.6, 0.85, 0.5
#: Facts of a key, and of these rows, that are compared at once.
TILE, ROWS = 16384, 256


def at_random(batch: DataFrame, rate: float = 0.5, mean: float = 0.5, deviation: float = 0.1, seed: int = 42) -> DataFrame:
    """Accepted with probability ``rate``; a normal confidence (two draws, Box and Muller), kept within .1 and .99."""
    normal = F.sqrt(-2 * F.log((draw(seed + 1, "seq") + 1) / float(PRIME))) * F.cos(2 * math.pi * uniform(seed + 2, "seq"))
    return batch.select("seq", (uniform(seed, "seq") < rate).alias("accepted"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.99), mean + deviation * normal)), 6).alias("confidence"))


def ladder(similarity: Column) -> Column:
    """Struct (level, factor) of how far a source text supports its fact: limits are exceeded strictly, no similarity counts for nothing."""
    level = F.when(similarity.isNull(), "unknown").when(similarity > 0.5, "high").when(similarity > 0.3, "medium").when(similarity > 0.15, "low").otherwise("none")
    return F.struct(level.alias("level"), F.when(level == "high", 1.1).when(level == "low", 0.7).when(level == "none", 0.5).otherwise(1.0).alias("factor"))


def rules_only(stage1: DataFrame) -> DataFrame:
    return stage1.select("seq", (F.col("outcome") == "PASS").alias("accepted"), "confidence")


def rules_and_embedding(facts: DataFrame, penalty: bool = True, verification: bool = True, missing: float = MISSING_SOURCE) -> DataFrame:
    """(seq, accepted, confidence, stage) of (seq, outcome, confidence, doc, similarity, confidence2).

    A fact without a source loses by ``missing`` unless ``penalty`` is off; FAIL rejects, .9 accepts at once; else the mean of both stages' confidences times the
    `ladder` of the source's similarity (unless ``verification`` is off) is to reach .7.
    """
    c1 = F.col("confidence") * (F.when(F.col("doc").isNull() | (F.col("doc") == ""), missing).otherwise(1.0) if penalty else F.lit(1.0))
    factor = ladder(F.col("similarity"))["factor"] if verification else F.lit(1.0)
    both = combine(c1, F.coalesce("confidence2", F.lit(1.0)), wa=0.5, wb=0.5) * factor
    stage = F.when((F.col("outcome") == "FAIL") | (c1 >= 0.9), 1).otherwise(2)
    accepted = F.when(F.col("outcome") == "FAIL", False).when(c1 >= 0.9, True).otherwise(both >= ACCEPT)
    return facts.select("seq", accepted.alias("accepted"), F.round(F.when(stage == 1, c1).otherwise(both), 6).alias("confidence"), stage.alias("stage"))


def similar_facts(batch: DataFrame, edges: DataFrame, embedding: str = "embedding", limit: float = DUPLICATE) -> DataFrame:
    """(seq, accepted, confidence): rejected where a known edge of the same subject or of the same object and relation has a cosine of ``limit`` or more.

    Both carry a vector of their text. Edges are looked at by subject and by (relation, object), not all of them: two facts that share neither are no repeats of each other.
    All pairs of a key are compared, as products of matrices of at most TILE new facts and TILE edges, so that a subject of a tenth of all facts is many tasks.
    """
    keys = F.array_compact(F.array(F.concat(F.lit("s "), "s_id"), F.concat(F.lit("o "), "pred", F.lit("\0"), "o_id")))
    keyed = lambda x, v, *more: x.where(F.size(v) > 0).select(F.explode(keys).alias("key"), F.col(v).alias("v"), *more)
    b = materialize(batch.select("seq", "s_id", "pred", "o_id", F.col(embedding).alias("v")), "sf-batch")
    e = materialize(edges.select("s_id", "pred", "o_id", F.col(embedding).alias("v")), "sf-edges")
    n = lambda x, c: keyed(x, "v").groupBy("key").agg(F.count("*").alias(c))
    # Keys of both sides; a key with many facts is as many tasks as pairs of its tiles.
    tiles = lambda c: F.ceil(F.col(c) / TILE).cast("int").alias(c)
    met = materialize(n(b, "nb").join(n(e, "ne"), "key").select("key", tiles("nb"), tiles("ne")), "sf-keys")
    parts = max(16, b.count() // 4096)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    tile = lambda x, c: F.pmod(F.xxhash64(x), F.col(c)).cast("int")
    x = keyed(b, "v", "seq").join(met, "key").withColumn("i", tile("seq", "nb")).withColumn("j", every("ne"))
    y = keyed(e, "v").withColumn("seq", F.lit(None).cast("bigint")).join(met, "key").withColumn("j", tile("v", "ne")).withColumn("i", every("nb"))
    both = x.select("key", "i", "j", "v", "seq").unionByName(y.select("key", "i", "j", "v", "seq"))
    both = both.select(F.concat_ws("\0", "key", "i", "j").alias("unit"), "v", "seq", F.pmod(F.xxhash64("key", "i", "j"), F.lit(parts)).alias("part"))
    best = both.groupBy("part").applyInArrow(_nearest, "seq bigint, c double").groupBy("seq").agg(F.max("c").alias("c"))
    c = F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0))
    return b.select("seq").join(best, "seq", "left").select("seq", (c < limit).alias("accepted"), F.round(F.when(c >= limit, 1 - c).otherwise(F.greatest(F.lit(0.7), 1 - c)), 6).alias("confidence"))


def _nearest(t):
    """(seq, c) of (unit, v, seq), seq null for known edges: each new fact's largest cosine with the edges of its unit that have vectors of its size; 0 where a norm is 0."""
    import numpy as np
    import pyarrow as pa

    from ..functions.similarity import matrix

    unit = t["unit"].combine_chunks().dictionary_encode().indices.to_numpy()
    known = t["seq"].is_null().to_numpy()
    v, size = matrix(t["v"])
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
        v = np.where(norm == 0, 0, v / norm)
    order = np.lexsort((known, size, unit))
    group = unit[order] * (int(size.max(initial=0)) + 1) + size[order]
    known, v = known[order], v[order]
    seq = t["seq"].fill_null(0).to_numpy()[order]
    best = np.full(len(seq), np.nan)
    ends = np.flatnonzero(np.diff(group, append=-1)) + 1
    none = np.ones(len(seq), bool)
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        mid = hi - int(known[lo:hi].sum())
        if lo < mid < hi:
            w = np.ascontiguousarray(v[mid:hi].T)
            none[lo:mid] = False
            for at in range(lo, mid, ROWS):
                to = min(at + ROWS, mid)
                with np.errstate(all="ignore"):
                    best[at:to] = np.max([(v[at:to] @ w[:, c : c + TILE]).max(axis=1) for c in range(0, w.shape[1], TILE)], axis=0)
    return pa.table({"seq": pa.array(seq[~none], pa.int64()), "c": pa.array(best[~none], pa.float64())})


def judged(opinions: DataFrame, least: float = LLM_LEAST) -> DataFrame:
    """A judge alone, (seq, outcome, confidence): its PASS of ``least`` or more accepts."""
    return opinions.select("seq", ((F.col("outcome") == "PASS") & (F.col("confidence") >= least)).alias("accepted"), "confidence")


def inferred(labels: DataFrame) -> DataFrame:
    """Inference alone, (seq, label, score): all that is not contradicted is accepted."""
    return labels.select("seq", (F.coalesce("label", F.lit("neutral")) != "contradiction").alias("accepted"), F.col("score").alias("confidence"))


def populated(edges: DataFrame, gold: DataFrame) -> DataFrame:
    """The graph that baselines start from: the edges and all facts that gold calls true (boolean ``gold``)."""
    return edges.unionByName(gold.where("gold").select(*edges.columns))


def statistics(results: DataFrame) -> DataFrame:
    """(classifier, n, accepted, rejected, acceptance_rate, mean_confidence, ms) of (classifier, accepted, confidence, ms)."""
    n = F.count("*")
    return results.groupBy("classifier").agg(
        n.alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.round(F.count_if("accepted") / n, 6).alias("acceptance_rate"),
        F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.sum("ms"), 6).alias("ms"),
    )


def inference_statistics(labels: DataFrame) -> DataFrame:
    """One row: checks, labels and their rates."""
    c = lambda x: F.count_if(F.col("label") == x)
    r = lambda x: F.round(F.coalesce(F.try_divide(c(x), F.count("*")), F.lit(0.0)), 6)
    kinds = {"entailment": "entailments", "contradiction": "contradictions", "neutral": "neutrals"}
    return labels.agg(F.count("*").alias("total_checks"), *[c(k).alias(n) for k, n in kinds.items()], *[r(k).alias(f"{k}_rate") for k in kinds])
