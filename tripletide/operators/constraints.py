"""Stage 1: constraints on a batch of facts, each a filter or join against ontology and graph.

All checks take the batch as a snapshot: it is compared with the graph before it, unless a function says otherwise. Facts that lack
an end or a relation are never here (`kg.batch`). A check returns (seq, severity, ...) for the facts that violate it, once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import ontology as o
from ..runtime import materialize, release
from .history import running, segment


def relation_tier(batch: DataFrame) -> DataFrame:
    """(seq, tier, mapped, tier_confidence): exact 1.0, mapped 0.9, else fail 0.0 with the predicate as it is."""
    spark = batch.sparkSession
    m = o.frame(spark, list(o.RELATION_MAPPING.items()), "pred string, to string")
    exact = F.col("pred").isin(*o.RELATION_TYPES)
    j = batch.join(F.broadcast(m), "pred", "left")  # 20 fixed rows
    return j.select(
        "seq",
        F.when(exact, "exact").when(F.col("to").isNotNull(), "mapping").otherwise("fail").alias("tier"),
        F.when(exact, F.col("pred")).otherwise(F.coalesce("to", "pred")).alias("mapped"),
        F.when(exact, 1.0).when(F.col("to").isNotNull(), 0.9).otherwise(0.0).alias("tier_confidence"),
    )


def schema_check(batch: DataFrame) -> DataFrame:
    """(seq, severity, factor): unknown type of either end, or a relation of no tier."""
    ok = lambda c: F.lower(F.coalesce(c, F.lit(""))).isin(*[t.lower() for t in o.ENTITY_TYPES])
    known = F.col("pred").isin(*o.RELATION_TYPES) | F.col("pred").isin(*o.RELATION_MAPPING)
    return batch.where(~ok(F.col("s_type")) | ~ok(F.col("o_type")) | ~known).select("seq", F.lit(0.9).alias("severity"), F.lit(0.3).alias("factor"))


def _domains(batch: DataFrame) -> DataFrame:
    return o.frame(batch.sparkSession, o.domain_rows(), "pred string, s_types array<string>, o_types array<string>")


def domain_range(batch: DataFrame) -> DataFrame:
    """(seq, severity, side): the subject's or else the object's type is not among those that the relation takes. A null type is none of them."""
    j = batch.join(F.broadcast(_domains(batch)), "pred")  # 14 fixed rows
    bad_s = ~F.array_contains("s_types", F.coalesce("s_type", F.lit("")))
    bad_o = ~F.array_contains("o_types", F.coalesce("o_type", F.lit("")))
    return j.where(bad_s | bad_o).select("seq", F.lit(0.9).alias("severity"), F.when(bad_s, "subject").otherwise("object").alias("side"))


def self_loop(batch: DataFrame) -> DataFrame:
    """(seq, severity): both ends are one thing, by id or by name, and the relation isn't reflexive."""
    same = (F.col("s_id") == F.col("o_id")) | (F.lower(F.trim("s_name")) == F.lower(F.trim("o_name")))
    return batch.where(same & ~F.col("pred").isin(*o.REFLEXIVE)).select("seq", F.lit(0.9).alias("severity"))


def _limits(df: DataFrame) -> DataFrame:
    return o.frame(df.sparkSession, list(o.CARDINALITY.items()), "pred string, most int")


def cardinality(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, severity, existing): the subject already has as many edges of the relation as allowed; a re-assertion counts too."""
    lim = F.broadcast(_limits(batch))  # 6 fixed rows
    have = edges.join(lim, "pred", "left_semi").groupBy("s_id", "pred").agg(F.count("*").alias("existing"))
    return batch.join(lim, "pred").join(have, ["s_id", "pred"]).where("existing >= most").select("seq", F.lit(0.85).alias("severity"), "existing")


def cardinality_sequential(facts: DataFrame) -> DataFrame:
    """(seq, severity, existing): as if facts arrived one by one in order of seq, every earlier one stored."""
    f = facts.where("pred is not null and s_id is not null").join(F.broadcast(_limits(facts)), "pred").select("seq", "batch_id", "most", F.struct("s_id", "pred").alias("k"))  # 6 fixed rows
    # A subject may have a large part of all facts: they are numbered in segments.
    f = running(segment(f, "k", "seq", "cardinality"), "k", "seq", {"nth": F.lit(1)}).select("seq", "batch_id", "most", (F.col("nth") - 1).cast("bigint").alias("existing"))
    return f.where("batch_id > 0 and existing >= most").select("seq", F.lit(0.85).alias("severity"), "existing")


def asymmetry(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, severity): the reverse edge of an asymmetric relation is there."""
    rev = edges.where(F.col("pred").isin(*o.ASYMMETRIC)).select(F.col("o_id").alias("s_id"), F.col("s_id").alias("o_id"), "pred")
    return batch.join(rev, ["s_id", "o_id", "pred"], "left_semi").select("seq", F.lit(0.8).alias("severity"))


def symmetric_duplicate(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, severity): the reverse edge of a self-inverse relation is there: nothing new is said."""
    own = [k for k, v in o.INVERSE.items() if k == v]
    rev = edges.where(F.col("pred").isin(*own)).select(F.col("o_id").alias("s_id"), F.col("s_id").alias("o_id"), "pred")
    return batch.join(rev, ["s_id", "o_id", "pred"], "left_semi").select("seq", F.lit(0.6).alias("severity"))


def functional_conflict(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, severity): a child is stated of someone who is known as father or mother of another only."""
    par = edges.where(F.col("pred").isin("VATER_VON", "MUTTER_VON", "FATHER_OF", "MOTHER_OF")).select(F.col("s_id").alias("o_id"), F.col("o_id").alias("child")).distinct()
    b = batch.where(F.col("pred").isin("KIND_VON", "CHILD_OF"))
    return b.join(par, "o_id").where("child <> s_id").select("seq", F.lit(0.7).alias("severity")).distinct()


def cross_relation(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, severity): an edge leaving the object implies a type for it that the new relation doesn't take as object."""
    d = _domains(batch)
    implied = edges.join(F.broadcast(d.select("pred", "s_types")), "pred").select(F.col("s_id").alias("o_id"), F.array_join(F.array_sort("s_types"), ",").alias("k"), "s_types").dropDuplicates(["o_id", "k"])
    b = batch.join(F.broadcast(d.select("pred", "o_types")), "pred")
    return b.join(implied, "o_id").where(~F.arrays_overlap("s_types", "o_types")).select("seq", F.lit(0.7).alias("severity")).distinct()


def valid_interval(entities: DataFrame) -> DataFrame:
    """(entity_id, severity): valid_from lies after valid_until."""
    return entities.where("valid_from > valid_until").select("entity_id", F.lit(0.8).alias("severity"))


def implied_types(batch: DataFrame) -> DataFrame:
    """(seq, severity, side): the relation implies a type that is disjoint from the one stated; the subject is looked at first."""
    spark = batch.sparkSession
    imp = o.frame(spark, [(k, *v) for k, v in o.IMPLIED.items()], "pred string, s_imp string, o_imp string")
    dis = o.frame(spark, o.disjoint_pairs(), "t string, other string")
    s = dis.select(F.col("t").alias("st"), F.col("other").alias("s_imp"), F.lit(True).alias("bad_s"))
    t = dis.select(F.col("t").alias("ot"), F.col("other").alias("o_imp"), F.lit(True).alias("bad_o"))
    j = batch.join(F.broadcast(imp), "pred").withColumn("st", F.lower("s_type")).withColumn("ot", F.lower("o_type"))
    j = j.join(F.broadcast(s), ["st", "s_imp"], "left").join(F.broadcast(t), ["ot", "o_imp"], "left")  # fixed tables of the ontology
    return j.where("bad_s or bad_o").select("seq", F.lit(0.8).alias("severity"), F.when(F.col("bad_s"), "subject").otherwise("object").alias("side"))


def inverse_inference(batch: DataFrame) -> DataFrame:
    """(seq, s_id, pred, o_id, conf): the inverse fact of each, a little less sure; none for self-inverse relations."""
    inv = o.frame(batch.sparkSession, [(k, v) for k, v in o.INVERSE.items() if k != v], "pred string, inverse string")
    return batch.join(F.broadcast(inv), "pred").select("seq", F.col("o_id").alias("s_id"), F.col("inverse").alias("pred"), F.col("s_id").alias("o_id"), F.round(F.col("conf") * 0.95, 6).alias("conf"))


def reach(starts: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(pred, start, node, depth): nodes that up to ``depth`` edges of one relation lead to from each start, at their least depth.

    starts: (pred, start). Each round joins the frontier with the edges and drops what was seen; rounds are written tables, and the walk ends
    early when nothing new is met. What is kept grows with the reachable pairs, which is the size of the result.
    """
    e = materialize(edges.select("pred", F.col("s_id").alias("node"), F.col("o_id").alias("next")).distinct(), "reach-edges")
    front = materialize(starts.select("pred", "start").distinct().withColumn("node", F.col("start")), "reach-front")
    seen, parts = front, []
    for step in range(1, depth + 1):
        new = front.join(e, ["pred", "node"]).select("pred", "start", F.col("next").alias("node")).distinct().join(seen, ["pred", "start", "node"], "left_anti")
        new = materialize(new, "reach-front")
        if new.isEmpty():
            release(new)
            break
        parts.append(new.withColumn("depth", F.lit(step)))
        seen = materialize(seen.unionByName(new), "reach-seen") if step % 4 == 0 else seen.unionByName(new)
        front = new
    if not parts:
        return front.limit(0).withColumn("depth", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cycles(batch: DataFrame, edges: DataFrame, relations: tuple[str, ...] = o.ACYCLIC, depth: int = 10, severity: float = 0.9) -> DataFrame:
    """(seq, severity): the subject can be reached from the object over the same relation, so the fact would close a cycle.

    Walked from both ends: as many steps forward from objects as are left over by those backward from subjects, which halves
    the rounds and meets far fewer nodes. Only facts whose object leads on and whose subject is led to are walked from.
    """
    b = batch.where(F.col("pred").isin(*relations)).select("seq", "pred", "s_id", "o_id")
    e = edges.where(F.col("pred").isin(*relations)).select("pred", "s_id", "o_id")
    direct = b.where("s_id = o_id").select("seq")
    open_ = b.where("s_id <> o_id").join(e.select("pred", F.col("s_id").alias("o_id")), ["pred", "o_id"], "left_semi").join(e.select("pred", F.col("o_id").alias("s_id")), ["pred", "s_id"], "left_semi")
    open_ = materialize(open_, "cycles-open")
    ahead = depth - depth // 2
    both = e.withColumn("pred", F.concat(F.lit(">"), "pred")).union(e.select(F.concat(F.lit("<"), "pred"), F.col("o_id"), F.col("s_id")))
    starts = open_.select(F.concat(F.lit(">"), "pred").alias("pred"), F.col("o_id").alias("start")).union(open_.select(F.concat(F.lit("<"), "pred"), F.col("s_id")))
    r = reach(starts, both, ahead)
    # An end itself lies no step away; odd depths leave the walk back one step short of the walk ahead.
    r = materialize(r.union(starts.distinct().select("pred", "start", F.col("start").alias("node"), F.lit(0))), "cycles-reach")
    way = lambda sign, end: r.where(F.col("pred").startswith(sign)).select(F.substring("pred", 2, 1 << 20).alias("pred"), F.col("start").alias(end), "node", F.col("depth").alias(f"d_{end}"))
    met = open_.join(way(">", "o_id"), ["pred", "o_id"]).join(way("<", "s_id"), ["pred", "s_id", "node"]).where(F.col("d_o_id") + F.col("d_s_id") <= depth).select("seq")
    return met.union(direct).distinct().select("seq", F.lit(severity).alias("severity"))


def transitive_cycle(batch: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """`cycles` for the transitive relations, to a smaller depth."""
    return cycles(batch, edges, o.TRANSITIVE, depth)


def ancestors(edges: DataFrame, depth: int = 5, relations: tuple[str, ...] = o.TRANSITIVE) -> DataFrame:
    """(pred, node, ancestor, depth) of the transitive relations, at the least depth."""
    e = edges.where(F.col("pred").isin(*relations))
    return reach(e.select("pred", F.col("s_id").alias("start")), e, depth).select("pred", F.col("start").alias("node"), F.col("node").alias("ancestor"), "depth")


def transitive_inference(edges: DataFrame, depth: int = 5) -> DataFrame:
    """(s_id, pred, o_id, depth, conf): facts that follow over two or more steps, 0.95 for each."""
    a = ancestors(edges, depth).where("depth > 1 and node <> ancestor")
    return a.select(F.col("node").alias("s_id"), "pred", F.col("ancestor").alias("o_id"), "depth", F.round(F.pow(F.lit(0.95), F.col("depth")), 6).alias("conf"))


def hierarchy(batch: DataFrame, edges: DataFrame, depth: int = 5) -> DataFrame:
    """(seq, severity): a further parent that is neither above nor below one the subject has already."""
    t = list(o.TRANSITIVE)
    b = batch.where(F.col("pred").isin(*t))
    e = edges.where(F.col("pred").isin(*t)).select("s_id", "pred", "o_id").distinct()
    pairs = b.join(e.withColumnRenamed("o_id", "old"), ["s_id", "pred"]).where("old <> o_id").select("seq", "pred", "o_id", "old")
    pairs = materialize(pairs, "hierarchy")
    starts = pairs.select("pred", F.col("o_id").alias("start")).union(pairs.select("pred", F.col("old")))
    r = materialize(reach(starts, edges.where(F.col("pred").isin(*t)), depth).select("pred", "start", "node"), "hierarchy-reach")
    up = r.select("pred", F.col("start").alias("old"), F.col("node").alias("o_id"))
    down = r.select("pred", F.col("start").alias("o_id"), F.col("node").alias("old"))
    alone = pairs.join(up, ["pred", "old", "o_id"], "left_anti").join(down, ["pred", "o_id", "old"], "left_anti")
    return alone.select("seq", F.lit(0.5).alias("severity")).distinct()


#: Factor on the confidence for each check, in the order in which they count.
FACTORS = {"schema": 0.3, "domain": 0.3, "self_loop": 0.3, "cardinality": 0.6, "cycle": 0.3, "asymmetry": 0.5, "cross_relation": 0.6, "temporal": 0.3, "advanced": 0.7}


def stage_one(batch: DataFrame, checks: dict[str, DataFrame]) -> DataFrame:
    """(seq, n_conflicts, checks, max_severity, confidence, outcome) of every fact.

    ``checks`` are results of this module by their name in FACTORS. FAIL: any temporal conflict, a schema-like one of severity .8 or more
    or a contradiction of .9 or more; UNCERTAIN: any other; PASS: none. The confidence is the product of the factors.
    """
    hard = {"schema": 0.8, "domain": 0.8, "self_loop": 0.8, "cycle": 0.9, "temporal": 0.0, "advanced": 0.8}
    rows = None
    for i, (name, df) in enumerate(checks.items()):
        one = df.groupBy("seq").agg(F.max("severity").alias("severity")).select("seq", F.lit(i).alias("i"), F.lit(name).alias("name"), "severity", F.lit(FACTORS[name]).alias("factor"))
        one = one.withColumn("hard", F.col("severity") >= hard.get(name, 9.0))
        rows = one if rows is None else rows.unionByName(one)
    per = rows.groupBy("seq").agg(
        F.count("*").alias("n_conflicts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), ",").alias("checks"),
        F.max("severity").alias("max_severity"),
        F.aggregate(F.array_sort(F.collect_list(F.struct("i", "factor"))), F.lit(1.0), lambda a, x: a * x["factor"]).alias("confidence"),
        F.bool_or("hard").alias("fail"),
    )  # at most one row per check in a list
    j = batch.select("seq").join(per, "seq", "left")
    outcome: Column = F.when(F.col("fail"), "FAIL").when(F.col("n_conflicts") > 0, "UNCERTAIN").otherwise("PASS")
    return j.select(
        "seq",
        F.coalesce("n_conflicts", F.lit(0)).cast("bigint").alias("n_conflicts"),
        F.coalesce("checks", F.lit("")).alias("checks"),
        F.coalesce("max_severity", F.lit(0.0)).alias("max_severity"),
        F.round(F.coalesce("confidence", F.lit(1.0)), 6).alias("confidence"),
        outcome.alias("outcome"),
    )
