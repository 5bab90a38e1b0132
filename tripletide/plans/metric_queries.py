"""Queries of evaluation statistics over decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from ..functions import metrics as m
from ..functions.draws import uniform_sql
from ..runtime import materialize
from .sql import FACTS, lit, with_

QUERIES, SQL = {}, {}


def query(sql):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def decisions(spark, d):
    """What history says of its facts, and what a threshold on the extraction confidence would say: reviewed between .6 and .7."""
    f = kg.facts(spark, d).where("conf is not null")
    verdict = F.when(F.col("conf") >= 0.7, "accept").when(F.col("conf") < 0.6, "reject").otherwise("review")
    truth = F.when(F.col("status") == "accepted", "accept").when(F.col("status") == "rejected", "reject").when(F.col("conf") >= 0.65, "accept").otherwise("reject")
    return f.select("seq", "pred", "batch_id", truth.alias("truth"), verdict.alias("verdict"), F.col("conf").alias("p"), (truth == "accept").cast("int").alias("y"))


DEC = """dec AS (SELECT seq, pred, batch_id, conf AS p, CASE WHEN conf >= 0.7 THEN 'accept' WHEN conf < 0.6 THEN 'reject' ELSE 'review' END AS verdict,
 CASE WHEN status = 'accepted' THEN 'accept' WHEN status = 'rejected' THEN 'reject' WHEN conf >= 0.65 THEN 'accept' ELSE 'reject' END AS truth,
 (CASE WHEN status = 'accepted' THEN 1 WHEN status = 'rejected' THEN 0 WHEN conf >= 0.65 THEN 1 ELSE 0 END) AS y FROM facts WHERE conf IS NOT NULL)"""


def _conf_sql(convention, by=""):
    pos, review = m.CONVENTIONS[convention]
    v = "verdict"
    if review == "wrong":
        v = "CASE WHEN verdict = 'review' THEN CASE WHEN truth = 'accept' THEN 'reject' ELSE 'accept' END ELSE verdict END"
    elif review:
        v = f"CASE WHEN verdict = 'review' THEN {lit(review)} ELSE verdict END"
    c = lambda t, s: f"count(*) FILTER (v <> 'review' AND (truth = {lit(pos)}) = {t} AND (v = {lit(pos)}) = {s})"
    sel = by + ", " if by else ""
    return f"""SELECT {sel}n, tp, fp, tn, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
 round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy FROM (SELECT {sel}count(*) AS n, {c("true", "true")} AS tp, {c("false", "true")} AS fp, {c("false", "false")} AS tn, {c("true", "false")} AS fn
 FROM (SELECT *, {v} AS v FROM dec) {"GROUP BY " + by if by else ""})"""


def _confusion(name):
    def f(spark, d):
        return m.confusion(decisions(spark, d), name)

    f.__name__ = f"metrics_confusion_{name}"
    return f


for _n in m.CONVENTIONS:
    query(with_(FACTS, DEC) + _conf_sql(_n))(_confusion(_n))


@query(with_(FACTS, DEC) + _conf_sql("accept_positive_review_not_accepted", "pred"))
def metrics_confusion_by_relation(spark, d):
    return m.confusion(decisions(spark, d), "accept_positive_review_not_accepted", ["pred"])


@query(with_(FACTS, DEC, f"c AS ({_conf_sql('accept_positive_review_not_accepted', 'batch_id')})") + "SELECT round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1, round(avg(accuracy), 6) AS mean_accuracy FROM c")
def metrics_macro(spark, d):
    return m.macro(m.confusion(decisions(spark, d), "accept_positive_review_not_accepted", ["batch_id"]))


BINS = "bins AS (SELECT least(ceil(p * 10), 10)::INT AS bin, count(*) AS n, avg(p) AS confidence, avg(y) AS accuracy FROM dec WHERE p > 0 AND p <= 1 GROUP BY 1)"


@query(with_(FACTS, DEC, BINS) + """SELECT n, round(e, 6) AS ece, round(x, 6) AS mce, round(b, 6) AS brier, CASE WHEN e < 0.05 THEN 'good' WHEN e < 0.1 THEN 'fair' ELSE 'poor' END AS level
 FROM (SELECT (SELECT count(*) FROM dec) AS n, sum(n * abs(accuracy - confidence)) / (SELECT count(*) FROM dec) AS e, max(abs(accuracy - confidence)) AS x, (SELECT avg(pow(p - y, 2)) FROM dec) AS b FROM bins)""")
def metrics_calibration(spark, d):
    return m.calibration(decisions(spark, d))


@query(with_(FACTS, DEC, BINS) + "SELECT i::INT AS bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM range(1, 11) r(i) LEFT JOIN bins ON bin = i")
def metrics_calibration_curve(spark, d):
    return m.calibration_curve(decisions(spark, d))


@query(with_(FACTS, DEC) + "SELECT i::INT AS bin, count(p) AS n FROM range(0, 10) r(i) LEFT JOIN dec ON p BETWEEN 0 AND 1 AND least(floor(p * 10), 9) = i GROUP BY i")
def metrics_histogram(spark, d):
    return m.histogram(decisions(spark, d), "p")


CURVE = """cur AS (SELECT i::INT AS step, round(i / 99.0::DOUBLE, 6) AS threshold, count(*) FILTER (p >= i / 99.0::DOUBLE AND y = 1) AS tp, count(*) FILTER (p >= i / 99.0::DOUBLE AND y = 0) AS fp, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg
 FROM range(0, 100) r(i), dec GROUP BY i)"""
ROC = "roc AS (SELECT step, threshold, round(tp / pos, 6) AS tpr, round(fp / neg, 6) AS fpr FROM cur)"
PR = "pr AS (SELECT step, threshold, round(CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp / (tp + fp) END, 6) AS precision, round(tp / pos, 6) AS recall FROM cur)"


@query(with_(FACTS, DEC, CURVE, ROC) + "SELECT * FROM roc")
def metrics_roc(spark, d):
    return m.roc(m.curve(decisions(spark, d)))


@query(with_(FACTS, DEC, CURVE, PR) + "SELECT * FROM pr")
def metrics_pr(spark, d):
    return m.pr(m.curve(decisions(spark, d)))


@query(with_(FACTS, DEC, CURVE, ROC, PR) + """SELECT (SELECT round(sum((fpr - px) * (tpr + py) / 2), 6) FROM (SELECT fpr, tpr, lag(fpr) OVER w AS px, lag(tpr) OVER w AS py FROM roc WINDOW w AS (ORDER BY fpr, tpr, step DESC))) AS roc_auc,
 (SELECT round(sum((recall - px) * (precision + py) / 2), 6) FROM (SELECT recall, precision, lag(recall) OVER w AS px, lag(precision) OVER w AS py FROM pr WINDOW w AS (ORDER BY recall, precision, step DESC))) AS pr_auc""")
def metrics_auc(spark, d):
    return m.auc(materialize(m.curve(decisions(spark, d)), "curve"))


@query(with_(FACTS, DEC, CURVE) + """SELECT criterion, arg_min(threshold, (-value, threshold)) AS threshold, max(value) AS value FROM (SELECT threshold, unnest(['youden', 'f1', 'balanced']) AS criterion,
 unnest([round(tp / pos - fp / neg, 6), round(coalesce(2 * tp / nullif(tp + fp + pos, 0), 0), 6), round((tp / pos + 1 - fp / neg) / 2, 6)]) AS value FROM cur) GROUP BY criterion""")
def metrics_best_threshold(spark, d):
    return m.best_threshold(m.curve(decisions(spark, d)))


def paired(spark, d):
    """Two classifiers on the same facts: thresholds .7 and .8."""
    x = decisions(spark, d)
    return x.select(F.col("seq").alias("id"), ((F.col("p") >= 0.7).cast("int") == F.col("y")).alias("right_a"), ((F.col("p") >= 0.8).cast("int") == F.col("y")).alias("right_b"))


PAIRED = "paired AS (SELECT seq, (p >= 0.7) = (y = 1) AS a, (p >= 0.8) = (y = 1) AS b FROM dec)"


@query(with_(FACTS, DEC, PAIRED, "g AS (SELECT count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (NOT a AND b) AS c FROM paired)") + "SELECT b, c, round(coalesce(pow(greatest(abs(b - c) - 1, 0), 2) / nullif(b + c, 0), 0), 6) AS statistic, b + c < 25 AS exact FROM g")
def metrics_mcnemar(spark, d):
    return m.mcnemar(paired(spark, d))


@query(with_(FACTS, DEC) + f"""SELECT pred, n, k, CASE WHEN n > 0 THEN round(greatest((k / n + z2 / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n), 0), 6) END AS low,
 round(least((k / n + z2 / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z2 / (4 * n * n))) / (1 + z2 / n), 1), 6) AS high FROM (SELECT pred, count(*) AS n, sum(y) AS k, {m.Z95} AS z, {m.Z95 * m.Z95} AS z2 FROM dec GROUP BY pred)""")
def metrics_wilson(spark, d):
    g = decisions(spark, d).groupBy("pred").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    w = m.wilson(F.col("k"), F.col("n"))
    return g.select("pred", "n", "k", w["low"].alias("low"), w["high"].alias("high"))


@query(with_(FACTS, DEC, "t AS (SELECT pred AS name, round(1 - avg(y), 6) / 10 AS p FROM dec WHERE pred IS NOT NULL GROUP BY pred HAVING count(*) >= 40)", "r AS (SELECT name, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, name) AS r FROM t)")
    + "SELECT name, p, p <= 0.05 / m AS bonferroni, bool_and(p <= 0.05 / (m - r + 1)) OVER (ORDER BY p, name) AS holm FROM r")
def metrics_corrections(spark, d):
    t = decisions(spark, d).where("pred is not null").groupBy(F.col("pred").alias("name")).agg((F.round(1 - F.avg("y"), 6) / 10).alias("p"), F.count("*").alias("n")).where("n >= 40").select("name", "p")
    return m.corrections(t)


@query(with_(FACTS, DEC) + """SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM (SELECT count(*) AS n, count(*) FILTER (truth = verdict) / count(*) AS po,
 (SELECT sum(a.n * b.n) / pow((SELECT count(*) FROM dec), 2) FROM (SELECT truth AS l, count(*) AS n FROM dec GROUP BY 1) a JOIN (SELECT verdict AS l, count(*) AS n FROM dec GROUP BY 1) b USING (l)) AS pe FROM dec)""")
def metrics_kappa(spark, d):
    return m.kappa(decisions(spark, d).select(F.col("truth").alias("a"), F.col("verdict").alias("b")))


_POISSON = "CASE " + " ".join(f"WHEN u < {x!r} THEN {i}" for i, x in enumerate(m.POISSON)) + f" ELSE {len(m.POISSON)} END"
_REPS = f"reps AS (SELECT r, sum(a::INT * w)::DOUBLE / sum(w) AS m FROM (SELECT r, a, {_POISSON} AS w FROM (SELECT a, r, {uniform_sql(42, 'seq', 'r')} AS u FROM paired, range(200) t(r))) GROUP BY r)"


@query(with_(FACTS, DEC, PAIRED, _REPS) + "SELECT round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM reps")
def metrics_bootstrap(spark, d):
    return m.bootstrap(paired(spark, d).select("id", F.col("right_a").alias("right")))


_SIGNS = f"own AS (SELECT avg(a::INT - b::INT) AS d FROM paired), signed AS (SELECT r, avg((a::INT - b::INT) * CASE WHEN {uniform_sql(42, 'seq', 'r')} < 0.5 THEN 1 ELSE -1 END) AS m FROM paired, range(200) t(r) GROUP BY r)"


@query(with_(FACTS, DEC, PAIRED, _SIGNS) + "SELECT round(any_value(d), 6) AS difference, round((count(*) FILTER (abs(m) >= abs(d) - 1e-12) + 1) / (count(*) + 1), 6) AS p FROM signed, own")
def metrics_permutation(spark, d):
    return m.permutation(paired(spark, d).select("id", F.col("right_a").cast("int").alias("a"), F.col("right_b").cast("int").alias("b")))


_GRID = [round(0.25 * (4.0 / 0.25) ** (i / 15), 6) for i in range(16)]


@query(with_(FACTS, DEC) + f"""SELECT arg_min(t, (nll, t)) AS temperature, min(nll) AS nll FROM (SELECT t, round(avg(CASE WHEN y = 1 THEN -ln(q) ELSE -ln(1 - q) END), 6) AS nll FROM (SELECT t, y, 1 / (1 + exp(-ln(c / (1 - c)) / t)) AS q
 FROM (SELECT y, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM dec), (SELECT unnest({_GRID}) AS t)) GROUP BY t)""")
def metrics_temperature(spark, d):
    return m.temperature(decisions(spark, d))
