"""Translations in vector space: relation vectors as mean differences, scores of facts, labels by nearest centroid."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw
from ..functions.similarity import cosine, dot


def _ends(relations: DataFrame, entities: DataFrame, dim: int) -> DataFrame:
    v = entities.where(F.size("embedding") == dim).select("entity_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    s, t = v.toDF("source_id", "h"), v.toDF("target_id", "t")
    return relations.where("invalidated_at is null").select("relation_id", "source_id", "target_id", "relation_type").join(s, "source_id").join(t, "target_id")


def relation_vectors(relations: DataFrame, entities: DataFrame, dim: int = 64, least: int = 3) -> DataFrame:
    """(relation_type, n, vector): unit mean of target minus source over the relations of a type with ``least`` or more; averaged by position, combined before the shuffle."""
    d = _ends(relations, entities, dim).select("relation_type", F.posexplode(F.zip_with("t", "h", lambda a, b: a - b)).alias("pos", "x"))
    m = d.groupBy("relation_type", "pos").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where(F.col("n") >= least)
    g = m.groupBy("relation_type").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))  # dim numbers a list
    norm = F.sqrt(dot(F.col("v"), F.col("v")))
    return g.select("relation_type", "n", F.when(norm > 0, F.transform("v", lambda x: x / norm)).otherwise(F.col("v")).alias("vector"))


def scores(relations: DataFrame, entities: DataFrame, vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(relation_id, distance, score, severity): how far source plus relation lies from target; half the distance, at most 1; .4 from .5 on, else null."""
    j = _ends(relations, entities, dim).join(vectors.select("relation_type", "vector"), "relation_type")
    diff = F.zip_with(F.zip_with("h", "vector", lambda a, b: a + b), F.col("t"), lambda a, b: a - b)
    dist = F.sqrt(dot(diff, diff))
    s = F.least(dist / 2, F.lit(1.0))
    return j.select("relation_id", F.round(dist, 6).alias("distance"), F.round(s, 6).alias("score"), F.when(s >= 0.5, 0.4).alias("severity"))


def examples(relations: DataFrame, n: int = 50) -> DataFrame:
    """(relation_type, relation_id): the first ``n`` relations of each type, by creation and id; the rest is dropped before the shuffle."""
    w = Window.partitionBy("relation_type").orderBy("created_at", "relation_id")
    return relations.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("relation_type", "relation_id")


def centroids(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(label, centroid): mean vector of each label."""
    d = vectors.where(F.size("embedding") == dim).select("label", F.posexplode("embedding").alias("pos", "x"))
    m = d.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def to_centroid(vectors: DataFrame, dim: int = 64) -> DataFrame:
    """(vec_id, label, similarity): cosine of each vector with the centroid of its own label."""
    c = centroids(vectors, dim)
    return vectors.where(F.size("embedding") == dim).join(c, "label").select("vec_id", "label", F.round(cosine(F.col("embedding"), F.col("centroid")), 6).alias("similarity"))


def train(edges: DataFrame, dim: int = 50, rate: float = 0.01, margin: float = 1.0, epochs: int = 100, seed: int = 42, most: int = 100_000) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray], list[float]]:
    """(vectors of nodes, of relations, mean loss of each epoch): translations trained by margin ranking against edges with another end.

    A small model for tests and demonstrations, fitted on the driver: of (seq, s_id, pred, o_id) at most ``most`` edges, those with the least draws, are used, and nodes and
    relations that these do not hold get no vector. Node vectors keep length 1. Edges without an end or relation are left out; no edges give empty models.
    """
    e = edges.where("s_id is not null and pred is not null and o_id is not null").select("seq", "s_id", "pred", "o_id").distinct()
    rows = e.orderBy(draw(seed, "seq"), "seq").limit(most).collect()
    if not rows:
        return {}, {}, []
    nodes, relations = sorted({x for r in rows for x in (r["s_id"], r["o_id"])}), sorted({r["pred"] for r in rows})
    at, rel = {x: i for i, x in enumerate(nodes)}, {x: i for i, x in enumerate(relations)}
    h, r, t = (np.array(x) for x in zip(*((at[x["s_id"]], rel[x["pred"]], at[x["o_id"]]) for x in rows)))
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    v, w, losses = unit(rng.normal(size=(len(nodes), dim))), unit(rng.normal(size=(len(relations), dim))), []
    for _ in range(epochs):
        other = rng.integers(0, len(nodes), len(h))
        good, bad = v[h] + w[r] - v[t], v[h] + w[r] - v[other]
        loss = margin + np.linalg.norm(good, axis=1) - np.linalg.norm(bad, axis=1)
        on = (loss > 0) & (other != t)
        losses.append(float(np.maximum(loss, 0).mean()))
        g, b = rate * unit(good)[on], rate * unit(bad)[on]
        for where, step in ((h[on], b - g), (t[on], g), (other[on], -b)):
            np.add.at(v, where, step)
        np.add.at(w, r[on], b - g)
        v = unit(v)
    return dict(zip(nodes, v)), dict(zip(relations, w)), losses


def plausibility(edge: tuple[str, str, str], nodes: dict[str, np.ndarray], relations: dict[str, np.ndarray]) -> float | None:
    """Of (subject, relation, object), from 0 to 1, by `train`'s vectors; None where one of them has none."""
    s, p, o = edge
    if s not in nodes or o not in nodes or p not in relations:
        return None
    return float(1 / (1 + np.linalg.norm(nodes[s] + relations[p] - nodes[o])))
