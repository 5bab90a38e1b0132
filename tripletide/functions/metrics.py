"""Evaluation statistics over decisions: confusion, calibration, curves, paired tests, intervals, corrections.

Inputs are narrow frames; every result is an aggregate of them. Rates divide by zero to 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .draws import uniform

#: Normal quantile of a 95 % interval.
Z95 = 1.959963984540054

#: How a verdict counts, by convention: (positive class, what a review counts as).
CONVENTIONS = {
    "reject_positive_review_excluded": ("reject", None),
    "reject_positive_review_reject": ("reject", "reject"),
    "reject_positive_review_accept": ("reject", "accept"),
    "accept_positive_review_not_accepted": ("accept", "reject"),
    "review_wrong": ("reject", "wrong"),
}


def rate(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def scores(tp: Column, fp: Column, tn: Column, fn: Column) -> list[Column]:
    """precision, recall, f1, accuracy, rounded."""
    p, r = rate(tp, tp + fp), rate(tp, tp + fn)
    return [
        F.round(p, 6).alias("precision"),
        F.round(r, 6).alias("recall"),
        F.round(rate(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        F.round(rate(tp + tn, tp + tn + fp + fn), 6).alias("accuracy"),
    ]


def confusion(decisions: DataFrame, convention: str, by: list[str] = []) -> DataFrame:
    """(by..., n, tp, fp, tn, fn, precision, recall, f1, accuracy) of (truth, verdict): truth ``accept`` or ``reject``, verdict also ``review``.

    ``n`` counts all rows, also those that the convention leaves out; rows with a null truth are left out throughout.
    """
    positive, review = CONVENTIONS[convention]
    v = F.col("verdict")
    if review == "wrong":
        v = F.when(v == "review", F.when(F.col("truth") == "accept", "reject").otherwise("accept")).otherwise(v)
    elif review:
        v = F.when(v == "review", review).otherwise(v)
    d = decisions.where("truth is not null").withColumn("_v", v)
    t, said, counted = F.col("truth") == positive, F.col("_v") == positive, F.col("_v").isin("accept", "reject")
    g = d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(counted & t & said).alias("tp"),
        F.count_if(counted & ~t & said).alias("fp"),
        F.count_if(counted & ~t & ~said).alias("tn"),
        F.count_if(counted & t & ~said).alias("fn"),
    )
    return g.select(*by, "n", "tp", "fp", "tn", "fn", *scores(*[F.col(c) for c in ("tp", "fp", "tn", "fn")]))


def macro(confusions: DataFrame) -> DataFrame:
    """(mean_f1, std_f1, mean_accuracy) over the rows of `confusion`."""
    return confusions.agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.round(F.stddev_pop("f1"), 6).alias("std_f1"), F.round(F.avg("accuracy"), 6).alias("mean_accuracy"))


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of (p, y): bins (lo, hi], so a p of exactly 0 falls into none; bins without rows are missing."""
    b = F.least(F.ceil(F.col("p") * bins), F.lit(bins))
    s = scored.where("p > 0 and p <= 1 and y is not null").withColumn("bin", b.cast("int"))
    return s.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg(F.col("y").cast("double")).alias("accuracy"))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(n, ece, mce, brier, level): expected and largest gap between confidence and accuracy over bins, and mean squared error."""
    total = scored.where("p is not null and y is not null").agg(F.count("*").alias("n"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    g = calibration_bins(scored, bins).agg(F.sum(gap * F.col("n")).alias("g"), F.max(gap).alias("mce"))
    ece = rate(F.col("g"), F.col("n"))
    level = F.when(ece < 0.05, "good").when(ece < 0.1, "fair").otherwise("poor")
    return total.crossJoin(g).select("n", F.round(ece, 6).alias("ece"), F.round("mce", 6).alias("mce"), F.round("brier", 6).alias("brier"), level.alias("level"))  # two single rows


def calibration_curve(scored: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of all bins; empty ones have n 0 and nulls."""
    spine = scored.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    j = spine.join(calibration_bins(scored, bins), "bin", "left")
    return j.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """(bin, n) of equal bins over [0, 1], the last one closed; all bins are there, values outside are not counted."""
    b = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1)).cast("int")
    c = df.where(F.col(column).between(0, 1)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(c, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def curve(scored: DataFrame, steps: int = 100) -> DataFrame:
    """(step, threshold, tp, fp, pos, neg) at ``steps`` thresholds from 0 to 1, both included: rows with p >= threshold, by one histogram and suffix sums."""
    s = scored.where("p is not null and y is not null")
    # The largest step whose threshold does not exceed p; a rounding error at the border is put right by comparing.
    k = F.floor(F.col("p") * (steps - 1)).cast("int")
    k = F.when((k + 1) / F.lit(float(steps - 1)) <= F.col("p"), k + 1).when(k / F.lit(float(steps - 1)) > F.col("p"), k - 1).otherwise(k)
    h = s.groupBy(F.greatest(F.lit(-1), F.least(k, F.lit(steps - 1))).alias("step")).agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") != 1).alias("b"))
    spine = scored.sparkSession.range(steps).select(F.col("id").cast("int").alias("step"))
    tot = h.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("pos"), F.coalesce(F.sum("b"), F.lit(0)).alias("neg"))
    j = spine.join(h, "step", "left").na.fill(0, ["a", "b"])
    w = Window.orderBy(F.col("step").desc())  # `steps` rows
    j = j.select("step", F.sum("a").over(w).alias("tp"), F.sum("b").over(w).alias("fp")).crossJoin(tot)
    return j.select("step", F.round(F.col("step") / float(steps - 1), 6).alias("threshold"), "tp", "fp", "pos", "neg")


def roc(c: DataFrame) -> DataFrame:
    """(step, threshold, tpr, fpr) of `curve`."""
    return c.select("step", "threshold", F.round(rate(F.col("tp"), F.col("pos")), 6).alias("tpr"), F.round(rate(F.col("fp"), F.col("neg")), 6).alias("fpr"))


def pr(c: DataFrame) -> DataFrame:
    """(step, threshold, precision, recall) of `curve`; precision is 1 where nothing is predicted."""
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    return c.select("step", "threshold", F.round(p, 6).alias("precision"), F.round(rate(F.col("tp"), F.col("pos")), 6).alias("recall"))


def _area(points: DataFrame, x: str, y: str) -> Column:
    return F.round(F.sum((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / 2), 6)


def auc(c: DataFrame) -> DataFrame:
    """(roc_auc, pr_auc) by trapezoids over `curve`; points are ordered by x, then y."""
    out = None
    for df, x, y, name in ((roc(c), "fpr", "tpr", "roc_auc"), (pr(c), "recall", "precision", "pr_auc")):
        w = Window.orderBy(x, y, F.col("step").desc())  # as many rows as steps
        one = df.withColumn("_px", F.lag(x).over(w)).withColumn("_py", F.lag(y).over(w)).agg(_area(df, x, y).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def best_threshold(c: DataFrame) -> DataFrame:
    """(criterion, threshold, value): by Youden's J, F1 and balanced accuracy; of equals the smallest threshold."""
    tpr, fpr = rate(F.col("tp"), F.col("pos")), rate(F.col("fp"), F.col("neg"))
    f1 = rate(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("pos"))
    each = F.array(*[F.struct(F.lit(n).alias("criterion"), F.round(v, 6).alias("value")) for n, v in (("youden", tpr - fpr), ("f1", f1), ("balanced", (tpr + 1 - fpr) / 2))])
    x = c.select("threshold", F.explode(each).alias("x")).select("threshold", "x.*")
    return x.groupBy("criterion").agg(F.min(F.struct((-F.col("value")).alias("k"), "threshold")).alias("b")).select("criterion", F.col("b.threshold").alias("threshold"), (-F.col("b.k")).alias("value"))


def mcnemar(paired: DataFrame) -> DataFrame:
    """(b, c, statistic, exact) of (right_a, right_b): discordant pairs, chi-square with continuity correction, and whether an exact test fits better (fewer than 25 discordant)."""
    g = paired.agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("b"), F.count_if(~F.col("right_a") & F.col("right_b")).alias("c"))
    n = F.col("b") + F.col("c")
    return g.select("b", "c", F.round(rate(F.pow(F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0)), 2), n), 6).alias("statistic"), (n < 25).alias("exact"))


def exact_binomial(b: int, c: int) -> float:
    """Two-sided p-value of b against c under equal odds."""
    from math import comb

    n, k = b + c, min(b, c)
    return 1.0 if n == 0 else min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)


def wilson(successes: Column, n: Column, z: float = Z95) -> Column:
    """Struct (low, high) of a proportion; 0, 0 for no trials."""
    p = rate(successes, n)
    mid = rate(p + z * z / (2 * n), 1 + z * z / n)
    half = rate(z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n)
    r = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 6)
    return F.when(n > 0, F.struct(r(mid - half).alias("low"), r(mid + half).alias("high"))).otherwise(F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high")))


def corrections(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(name, p, bonferroni, holm) of (name, p): which of the tests stay significant. Tests are few: one per pair of models."""
    m = F.count("*").over(Window.partitionBy())
    w = Window.orderBy("p", "name")
    t = tests.where("p is not null").withColumn("m", m).withColumn("r", F.row_number().over(w)).withColumn("ok", F.col("p") <= alpha / (F.col("m") - F.col("r") + 1))
    return t.select("name", "p", (F.col("p") <= alpha / F.col("m")).alias("bonferroni"), F.min("ok").over(w).alias("holm"))


def kappa(labelled: DataFrame) -> DataFrame:
    """(n, agreement, kappa) of (a, b): two raters' labels."""
    d = labelled.where("a is not null and b is not null")
    n = d.agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    by = lambda c: d.groupBy(F.col(c).alias("l")).agg(F.count("*").alias(f"n{c}"))
    e = by("a").join(by("b"), "l").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("e"))
    j = n.crossJoin(e)  # two single rows
    po, pe = rate(F.col("same"), F.col("n")), rate(F.col("e"), F.col("n") * F.col("n"))
    return j.select("n", F.round(po, 6).alias("agreement"), F.round(rate(po - pe, 1 - pe), 6).alias("kappa"))


#: How likely a Poisson(1) number is at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def bootstrap(scored: DataFrame, replicates: int = 200, seed: int = 42) -> DataFrame:
    """(mean, low, high) of the accuracy of (id, right) over Poisson bootstrap replicates.

    A row's weight in a replicate is Poisson(1), drawn from a hash of the row and the replicate, so results don't depend on partitions. Every
    replicate is a sum kept while reading: rows are not multiplied in a shuffle.
    """
    weight = F.lit(len(POISSON))
    for i in reversed(range(len(POISSON))):
        weight = F.when(F.col("u") < POISSON[i], i).otherwise(weight)
    reps = scored.select("id", F.col("right").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("r")).withColumn("u", uniform(seed, "id", "r")).withColumn("w", weight)
    parts = reps.groupBy("r").agg((F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("m"))
    q = F.percentile("m", F.array(F.lit(0.025), F.lit(0.975)))
    return parts.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(q[0], 6).alias("low"), F.round(q[1], 6).alias("high"))


def permutation(paired: DataFrame, rounds: int = 200, seed: int = 42) -> DataFrame:
    """(difference, p) of (id, a, b): mean of a - b and the share of rounds with random signs at least as far from 0, (k + 1) / (n + 1)."""
    d = paired.select("id", (F.col("a") - F.col("b")).alias("d"))
    sign = F.when((F.col("r") < 0) | (uniform(seed, "id", "r") < 0.5), 1).otherwise(-1)
    x = d.select("id", "d", F.explode(F.sequence(F.lit(-1), F.lit(rounds - 1))).alias("r"))
    m = x.groupBy("r").agg(F.avg(F.col("d") * sign).alias("m"))
    own = m.where("r = -1").select(F.col("m").alias("difference"))
    j = m.where("r >= 0").crossJoin(F.broadcast(own))  # one row
    return j.groupBy("difference").agg(F.count_if(F.abs("m") >= F.abs("difference") - 1e-12).alias("k"), F.count("*").alias("n")).select(F.round("difference", 6).alias("difference"), F.round((F.col("k") + 1) / (F.col("n") + 1), 6).alias("p"))


def temperature(scored: DataFrame, low: float = 0.25, high: float = 4.0, steps: int = 16) -> DataFrame:
    """(temperature, nll): the temperature of a grid with the least negative log-likelihood of (p, y), after dividing the logit by it."""
    p = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    logit = F.log(p / (1 - p))
    grid = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
    each = F.array(*[F.struct(F.lit(round(t, 6)).alias("t"), (1 / (1 + F.exp(-F.col("l") / t))).alias("q")) for t in grid])
    x = scored.where("p is not null and y is not null").select("y", logit.alias("l")).select("y", F.explode(each).alias("x"))
    g = x.groupBy(F.col("x.t").alias("t")).agg(F.avg(-F.when(F.col("y") == 1, F.log("x.q")).otherwise(F.log(1 - F.col("x.q")))).alias("nll"))
    return g.agg(F.min(F.struct("nll", "t")).alias("b")).select(F.col("b.t").alias("temperature"), F.round("b.nll", 6).alias("nll"))
