"""Graph statistics and what departs from them: degrees, type and pair shares, relation frequencies.

Statistics are counted once per batch over the edges before it; facts are then compared with them by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import join_checked, materialize


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree) of nodes with an edge."""
    ends = edges.select(F.col("s_id").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("o_id", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, and mean and population deviation of out- and in-degree over the nodes that have one; no deviation counts as 1."""
    return _spread(degrees(edges))


def _spread(d: DataFrame) -> DataFrame:
    std = lambda c: F.coalesce(F.nullif(F.stddev_pop(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0)), F.lit(1.0))
    mean = lambda c: F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))
    return d.agg(F.count("*").alias("n_nodes"), mean("out_degree").alias("out_mean"), std("out_degree").alias("out_std"), mean("in_degree").alias("in_mean"), std("in_degree").alias("in_std"))


def type_counts(edges: DataFrame) -> DataFrame:
    """(type, pred, n): how often a type stands at either end of a relation."""
    both = edges.select(F.col("s_type").alias("type"), "pred").union(edges.select("o_type", "pred"))
    return both.where("type is not null").groupBy("type", "pred").agg(F.count("*").alias("n"))


def pair_counts(edges: DataFrame) -> DataFrame:
    """(pred, s_type, o_type, n, n_pred): how often a relation joins two types, and how often it comes at all."""
    p = edges.groupBy("pred", "s_type", "o_type").agg(F.count("*").alias("n"))
    return p.join(p.groupBy("pred").agg(F.sum("n").alias("n_pred")), "pred")


def _common(batch: DataFrame, edges: DataFrame, own: bool = False) -> DataFrame:
    """The batch with everything that the checks compare it with; with ``own`` also the subject's edges of the relation.

    The edges are read once for degrees and once for pairs of types, of which all other counts are made: relations times types squared.
    """
    d = materialize(degrees(edges), "anomaly-degrees")
    p = materialize(pair_counts(edges), "anomaly-pairs")
    pred = materialize(p.select("pred", "n_pred").distinct(), "anomaly-relations")
    ends = p.select(F.col("s_type").alias("type"), "pred", "n").union(p.select("o_type", "pred", "n")).where("type is not null")
    t = materialize(ends.groupBy("type", "pred").agg(F.sum("n").alias("n")), "anomaly-types")
    small = lambda df, on, *cols: (_as(df.select(*cols), df), on, "left")
    j = batch.join(d.select(F.col("node").alias("s_id"), "out_degree"), "s_id", "left").join(d.select(F.col("node").alias("o_id"), "in_degree"), "o_id", "left")
    if own:
        j = j.join(edges.groupBy("s_id", "pred").agg(F.count("*").alias("own")), ["s_id", "pred"], "left").na.fill(0, ["own"])
    j = join_checked(j, *small(pred, "pred", "pred", "n_pred"))
    j = join_checked(j, *small(t, ["s_type", "pred"], F.col("type").alias("s_type"), "pred", F.col("n").alias("n_s")))
    j = join_checked(j, *small(t, ["o_type", "pred"], F.col("type").alias("o_type"), "pred", F.col("n").alias("n_o")))
    j = join_checked(j, *small(p, ["pred", "s_type", "o_type"], "pred", "s_type", "o_type", F.col("n").alias("n_pair")))
    return j.crossJoin(F.broadcast(_spread(d))).na.fill(0, ["out_degree", "in_degree", "n_pred", "n_s", "n_o", "n_pair"])  # one row


def _as(df: DataFrame, stored: DataFrame) -> DataFrame:
    """A projection of a stored table, with its place on disk for the size check."""
    df._tide_path = stored._tide_path
    return df


def _z(deg: str, which: str) -> Column:
    return (F.col(deg) + 1 - F.col(f"{which}_mean")) / F.col(f"{which}_std")


def _far(threshold: float) -> Column:
    """The deviations of the subject's out-degree, or else of the object's in-degree, above ``threshold``; else null."""
    s, t = _z("out_degree", "out"), _z("in_degree", "in")
    return F.when(s > threshold, s).when(t > threshold, t)


def _rare(c: str) -> Column:
    return (F.col(c) / F.col("n_pred") < 0.01) & (F.col(c) < 3)


_RARE_PAIR = "n_pred >= 5 and n_pair / n_pred < 0.01 and n_pair < 2"


def _frequency_z() -> Column:
    """How far the subject's edges of the relation, three or more, lie above what its frequency leads one to expect (Poisson)."""
    rate = F.col("n_pred") / F.col("n_nodes")
    return F.when(F.col("own") >= 3, (F.col("own") + 1 - rate) / F.sqrt(F.greatest(rate, F.lit(1.0))))


def degree(batch: DataFrame, edges: DataFrame, threshold: float = 3.0, least: int = 10) -> DataFrame:
    """(seq, side, z, severity): with the fact the subject's out-degree, or else the object's in-degree, lies more than ``threshold`` deviations up."""
    j = _common(batch, edges).where(F.col("n_nodes") >= least)
    s = _z("out_degree", "out")
    z = _far(threshold)
    return j.select("seq", F.when(s > threshold, "subject").otherwise("object").alias("side"), F.round(z, 6).alias("z"), F.round(F.least(F.lit(0.5) + 0.1 * z, F.lit(0.8)), 6).alias("severity")).where("z is not null")


def rare_type(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, side): the subject's or else the object's type makes up less than one percent of a known relation and was seen less than three times."""
    j = _common(batch, edges).where("n_pred > 0")
    return j.where(_rare("n_s") | _rare("n_o")).select("seq", F.when(_rare("n_s"), "subject").otherwise("object").alias("side"))


def rare_pair(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, usual): a pair of types seen less than twice and in less than one percent of a relation seen five times; ``usual`` names its three most frequent pairs."""
    j = _common(batch, edges).where(_RARE_PAIR)
    ranked = pair_counts(edges).where("s_type is not null and o_type is not null")
    name = F.concat_ws("-", "s_type", "o_type")
    best = ranked.groupBy("pred").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), name.alias("p")))), 1, 3), lambda x: x["p"]), ",").alias("usual"))
    # A relation has as many pairs as there are types, squared: the lists stay short.
    return j.join(best, "pred", "left").select("seq", "usual")


def frequency(batch: DataFrame, edges: DataFrame, threshold: float = 2.5) -> DataFrame:
    """(seq, z): the subject has three edges of the relation or more, far above what its frequency leads one to expect (Poisson)."""
    return _common(batch, edges, own=True).select("seq", F.round(_frequency_z(), 6).alias("z")).where(F.col("z") > threshold)


def _bucket(share: Column) -> Column:
    return F.when(share < 0.01, 0.8).when(share < 0.05, 0.5).when(share < 0.1, 0.3).otherwise(0.0)


def scores(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """(seq, degree_score, type_score, pair_score, score): each from 0 to 1, and their mean. A relation never seen counts as seen once for types, and as .3 for pairs."""
    r = lambda c, n: F.round(c, 6).alias(n)
    deg, typ, pair = _parts()
    return _common(batch, edges).select("seq", r(deg, "degree_score"), r(typ, "type_score"), r(pair, "pair_score"), r((deg + typ + pair) / 3, "score"))


def _parts() -> tuple[Column, Column, Column]:
    deg = F.least(F.abs((F.col("out_degree") + 1 - F.col("out_mean")) / F.greatest(F.col("out_std"), F.lit(1.0))) / 5, F.lit(1.0))
    typ = _bucket(F.col("n_s") / F.greatest(F.col("n_pred"), F.lit(1)))
    pair = F.when(F.col("n_pred") == 0, 0.3).otherwise(_bucket(F.col("n_pair") / F.greatest(F.col("n_pred"), F.lit(1))))
    return deg, typ, pair


def gate(batch: DataFrame, edges: DataFrame, least: int = 20, score_least: int = 50, threshold: float = 3.0) -> DataFrame:
    """(seq, n_anomalies): how many kinds of anomaly a fact shows; none in graphs of fewer than ``least`` nodes, and the score counts from ``score_least`` on."""
    deg, typ, pair = _parts()
    flags = [
        _far(threshold).isNotNull() & (F.col("n_nodes") >= 10),
        (F.col("n_pred") > 0) & (_rare("n_s") | _rare("n_o")),
        F.expr(_RARE_PAIR),
        F.round(_frequency_z(), 6) > 2.5,
        (F.round((deg + typ + pair) / 3, 6) > threshold / 5) & (F.col("n_nodes") >= score_least),
    ]
    n = sum((F.coalesce(f, F.lit(False)).cast("bigint") for f in flags[1:]), F.coalesce(flags[0], F.lit(False)).cast("bigint"))
    return _common(batch, edges, own=True).where(F.col("n_nodes") >= least).select("seq", n.alias("n_anomalies")).where("n_anomalies > 0")


def quality(edges: DataFrame, allowed_types: tuple[str, ...], allowed_relations: tuple[str, ...]) -> DataFrame:
    """One row of graph quality: schema compliance, self-loops, duplicate rate of nodes by name, degrees over all nodes, density."""
    d = degrees(edges).select((F.col("out_degree") + F.col("in_degree")).alias("g"))
    a = edges.agg(
        F.count("*").alias("n_edges"),
        F.round(F.avg((F.col("s_type").isin(*allowed_types) & F.col("o_type").isin(*allowed_types) & F.col("pred").isin(*allowed_relations)).cast("double")), 6).alias("schema_compliance"),
        F.count_if(F.col("s_id") == F.col("o_id")).alias("self_loops"),
        F.round(1 - F.try_divide(F.count_distinct("s_id", "pred", "o_id"), F.count("*")), 6).alias("duplicate_rate"),
    )
    b = d.agg(F.count("*").alias("n_nodes"), F.round(F.avg("g"), 6).alias("degree_mean"), F.max("g").alias("degree_max"), F.round(F.stddev_pop("g"), 6).alias("degree_std"))
    return a.crossJoin(b).withColumn("density", F.round(F.try_divide(F.col("n_edges"), F.col("n_nodes") * (F.col("n_nodes") - 1)), 9))


def compare(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, before, after, delta, percent) of two one-row frames; percent is null where before is 0."""
    cells = lambda df, n: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias(n)) for c in columns])).alias("x")).select("x.*")
    j = cells(before, "before").join(cells(after, "after"), "metric")
    delta = F.col("after") - F.col("before")
    return j.select("metric", "before", "after", F.round(delta, 6).alias("delta"), F.round(F.try_divide(delta * 100, F.col("before")), 6).alias("percent"))
