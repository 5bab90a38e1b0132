"""Mixing sources to target weights through a splitting tree.

Documents fall into blocks of their source (by hash, about one block per BLOCKS-th of the source). The largest mixture that no source limits
fixes how many tokens each source gives: whole passes over its blocks, then a prefix of the blocks in permuted order, and of the
last block, cut into BLOCKS parts in turn, a prefix of the parts and of the last part's documents, so that the share is met to one document. The block quotas are split exactly among the
output shards by a binary tree of multivariate hypergeometric draws; each shard then takes its own disjoint blocks of the
permuted order, is brought together and ordered by a random key of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import join_checked, materialize
from .tokenize import RANKS_PATH, count_tokens

#: Blocks per source (bounds what the driver holds: sources x BLOCKS numbers).
BLOCKS = 512


def split(quota: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Rows: shards, columns: sources; exact in every column, sizes of shards equal to one block."""
    if shards == 1:
        return quota[None, :]
    left = shards // 2
    take = int(round(quota.sum() * left / shards))
    a = rng.multivariate_hypergeometric(quota, take) if quota.sum() else quota * 0
    return np.vstack([split(a, left, rng), split(quota - a, shards - left, rng)])


def plan(blocks: list[tuple[str, int, int]], targets: dict[str, tuple[float, int]], shards: int, seed: int) -> tuple[list[tuple], dict[str, float]]:
    """(source, block, pass, shard, tokens wanted or -1 for all) of every block used, and the tokens each source is to give.

    The mixture is as large as the scarcest source allows; sources without documents or weight give nothing and the weights of
    the others are scaled to one.
    """
    rng = np.random.default_rng(seed)
    size: dict[str, int] = {}
    for s, _, n in blocks:
        size[s] = size.get(s, 0) + n
    live = {s: w for s, (w, m) in sorted(targets.items()) if w and w > 0 and m and m > 0 and size.get(s)}
    if not live:
        return [], {}
    whole = sum(live.values())
    total = min(targets[s][1] * size[s] * whole / w for s, w in live.items())
    want = {s: total * w / whole for s, w in live.items()}
    used: dict[str, list[tuple[int, int, float]]] = {}
    for s in live:
        own = [(b, n) for x, b, n in blocks if x == s]
        rest, used[s], turn = want[s], [], 0
        while rest > 1e-6 * size[s] and turn < targets[s][1]:
            for i in rng.permutation(len(own)):
                b, n = own[i]
                if rest <= 0:
                    break
                used[s].append((b, turn, -1.0 if n <= rest + 0.5 else rest))
                rest -= min(n, rest)
            turn += 1
    names = list(live)
    quota = split(np.array([len(used[s]) for s in names]), shards, rng)
    out = []
    for j, s in enumerate(names):
        order, at = rng.permutation(len(used[s])), 0
        for shard in range(shards):
            for i in order[at : at + quota[shard, j]]:
                b, turn, part = used[s][i]
                out.append((s, int(b), int(turn), shard, float(part)))
            at += quota[shard, j]
    return out, want


def mix(docs: DataFrame, targets: DataFrame, shards: int = 16, seed: int = 42, path: str = RANKS_PATH) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture (doc_id, source, pass, shard, shuffle_key, n_tokens): one row per use of a document; ``pass`` counts its uses from 0.
    shares (source, target_weight, max_repeats, tokens_available, tokens_taken, actual_share): a row per target and per source without one
    (weight 0). Null and empty texts have no tokens and are never used, nor are documents of null or untargeted sources. Of targets named twice
    the larger weight counts. Rows that repeat a document count as documents of their own.
    """
    spark = docs.sparkSession
    n = count_tokens(docs.select("doc_id", "source", "text"), path).where("n_tokens > 0 and source is not null")
    n = materialize(n.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(BLOCKS)).cast("int")), "p9-sizes")
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max_by("max_repeats", "target_weight").alias("max_repeats"))
    wanted = {r["source"]: (r["target_weight"], r["max_repeats"]) for r in t.collect()}  # the table of targets: one row per source
    sizes = n.join(F.broadcast(t.select("source")), "source", "left_semi").groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
    # At most sources x BLOCKS rows.
    blocks = sorted((r["source"], r["block"], r["n"]) for r in sizes.collect())
    rows, _ = plan(blocks, wanted, shards, seed)
    uses = materialize(spark.createDataFrame(rows, "source string, block int, pass int, shard int, part double"), "p9-uses")
    whole = join_checked(n, uses, ["source", "block"])
    # Only one block a source is used in part: its parts in order, up to the tokens that are still wanted, and of the last of them documents in random order.
    cut = whole.where("part >= 0").withColumn("_p", F.pmod(F.xxhash64("doc_id", "pass", F.lit(seed + 2)), F.lit(BLOCKS)).cast("int"))
    use = ["source", "block", "pass"]
    sums = cut.groupBy(*use, "_p").agg(F.sum("n_tokens").alias("_s"))
    sums = sums.withColumn("_before", F.sum("_s").over(Window.partitionBy(*use).orderBy("_p")) - F.col("_s"))  # at most BLOCKS rows a use
    cut = cut.join(sums, [*use, "_p"]).where("_before < part")
    run = Window.partitionBy(*use, "_p").orderBy(F.xxhash64("doc_id", "pass", F.lit(seed)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.where("_before + _s > part").withColumn("_c", F.col("_before") + F.sum("n_tokens").over(run)).where("_c - n_tokens / 2 <= part")
    keep = ["doc_id", "source", "pass", "shard", "n_tokens"]
    mixed = whole.where("part < 0").select(*keep).union(cut.where("_before + _s <= part").select(*keep)).union(last.select(*keep))
    mixed = mixed.select("doc_id", "source", "pass", "shard", F.xxhash64("doc_id", "pass", "shard", F.lit(seed + 1)).alias("shuffle_key"), "n_tokens")
    # Each shard is a range of partitions, as many as its size asks for, in the order of its random keys.
    shuffled = mixed.orderBy("shard", "shuffle_key")
    have = n.groupBy("source").agg(F.sum("n_tokens").alias("tokens_available"))
    took = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_taken"))
    shares = t.join(have, "source", "full").join(took, "source", "left").na.fill(0, ["tokens_available", "tokens_taken"]).na.fill(0.0, ["target_weight"])
    total = took.agg(F.sum("tokens_taken").alias("_t"))
    shares = shares.crossJoin(F.broadcast(total)).withColumn("actual_share", F.round(F.coalesce(F.try_divide("tokens_taken", "_t"), F.lit(0.0)), 6)).drop("_t")
    return shuffled, shares
