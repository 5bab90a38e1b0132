"""Questions over the graph: context, answers, summaries of answers, experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import keyword_search
from ..runtime import join_checked, materialize, release
from .text import exact_match, snippet, token_f1

#: Facts that a word must be in to count as frequent, and facts that a task looks at for the sets of frequent words.
RARE, PART = 256, 262_144


def context_lines(triples: DataFrame, question: str, k: int = 20) -> DataFrame:
    """(rank, line): the best facts for a question, a bullet each, with the start of their source text."""
    hits = keyword_search(triples, question, k)
    t = triples.dropDuplicates(["seq"]).join(F.broadcast(hits), "seq")  # k rows
    from pyspark.sql import Window

    w = Window.orderBy(F.col("score").desc(), "seq")  # k rows
    line = F.concat(F.lit("- "), F.concat_ws(" ", "subject_name", "predicate", "object_name"), F.coalesce(F.concat(F.lit(" ["), snippet(F.col("source_text")), F.lit("]")), F.lit("")))
    return t.select(F.row_number().over(w).alias("rank"), line.alias("line"))


def answer(triples: DataFrame, question: str, k: int = 20) -> DataFrame:
    """One row (answer, confidence, n_facts): the first context line with two of the question's words in it, after its dash; confidence grows with the context, .9 at most."""
    lines = context_lines(triples, question, k)
    words = list(dict.fromkeys(w for w in question.lower().replace("?", " ").split() if w))
    hits = None
    for w in words:
        one = F.lower("line").contains(w).cast("int")
        hits = one if hits is None else hits + one
    text = F.trim(F.regexp_replace("line", r"^[^-]*-", ""))
    g = lines.agg(F.min(F.when((hits if hits is not None else F.lit(0)) >= 2, F.struct("rank", text.alias("a")))).alias("m"), F.sum(F.length("line")).alias("n"), F.count("*").alias("n_facts"))
    return g.select(F.coalesce("m.a", F.lit("")).alias("answer"), F.round(F.least(F.lit(0.9), 0.5 + F.coalesce("n", F.lit(0)) / 2000), 6).alias("confidence"), "n_facts")


def answers(questions: DataFrame, triples: DataFrame, k: int = 20) -> DataFrame:
    """(id, answer, confidence, n_facts) of many questions (id, question) at once: for each what `answer` gives for one; without a fact the answer is empty and the confidence .5.

    Questions and accepted facts meet by words that at most RARE facts have. The words that more have make few sets, many questions to one: their best ``k`` facts are found once a set
    (`_by_sets`). What is among a question's best has one of its rare words or is among the best of its set, as every fact that is before it by the set's words alone is before it by all.
    The best ``k`` facts of a question are kept before their texts are joined. Null questions are answered by nothing.
    """
    from ..operators.store import first_per

    q = materialize(questions.select("id", F.coalesce(F.lower("question"), F.lit("")).alias("question")), "qa-questions")
    words = lambda c: F.filter(F.array_distinct(F.split(c, r"\s+")), lambda w: w != "")
    t = triples.where("validation_status = 'accepted'")
    fact = F.concat_ws(" ", "subject_name", "predicate", "object_name")
    said = materialize(t.select("seq", F.lower(fact).alias("fact")).dropDuplicates(["seq"]).select("seq", F.explode(words(F.col("fact"))).alias("w")), "qa-words")
    asked = materialize(q.select("id", F.explode(words(F.col("question"))).alias("w")), "qa-asked")
    known = materialize(said.groupBy("w").agg(F.count("*").alias("n")).join(asked.select("w").distinct(), "w"), "qa-known")
    often = materialize(known.where(F.col("n") > RARE).select("w"), "qa-often")
    of = lambda x, key: join_checked(x, often, "w").groupBy(key).agg(F.array_sort(F.collect_set("w")).alias("often"))
    facts, sets = materialize(of(said, "seq"), "qa-facts"), materialize(of(asked, "id"), "qa-sets")
    ends = _by_sets(sets.select("often").distinct().withColumn("set", F.to_json("often")), facts, k)
    ends = first_per(ends, ["set"], [F.col("score").desc(), F.col("seq")], k)
    ends = sets.select("id", F.to_json("often").alias("set")).join(ends, "set").select("id", "seq", "score")
    # The rare words that meet, and of the others those that both sides have.
    near = asked.join(known.where(F.col("n") <= RARE).select("w"), "w").join(said, "w").groupBy("id", "seq").agg(F.count("*").alias("score"))
    near = near.join(sets, "id", "left").join(facts.withColumnRenamed("often", "has"), "seq", "left")
    near = near.select("id", "seq", (F.col("score") + F.coalesce(F.size(F.array_intersect("often", "has")), F.lit(0))).alias("score"))
    hits = near.unionByName(ends).groupBy("id", "seq").agg(F.max("score").alias("score"))
    hits = materialize(first_per(hits, ["id"], [F.col("score").desc(), F.col("seq")], k), "qa-hits")
    line = F.concat(F.lit("- "), fact, F.coalesce(F.concat(F.lit(" ["), snippet(F.col("source_text")), F.lit("]")), F.lit("")))
    lines = t.select("seq", line.alias("line")).join(hits.select("seq").distinct(), "seq", "left_semi").dropDuplicates(["seq"])
    j = hits.join(lines, "seq").join(q.withColumn("asked", words(F.replace("question", F.lit("?"), F.lit(" ")))), "id")
    found = F.size(F.filter("asked", lambda w: F.lower("line").contains(w)))
    text = F.trim(F.regexp_replace("line", r"^[^-]*-", ""))
    best = F.min(F.when(found >= 2, F.struct((-F.col("score")).alias("s"), "seq", text.alias("a"))))
    g = j.groupBy("id").agg(best.alias("m"), F.sum(F.length("line")).alias("n"), F.count("*").alias("n_facts"))
    g = q.select("id").join(g, "id", "left")
    for x in (said, asked, known, often, facts, sets):
        release(x)
    return g.select("id", F.coalesce("m.a", F.lit("")).alias("answer"), F.round(F.least(F.lit(0.9), 0.5 + F.coalesce("n", F.lit(0)) / 2000), 6).alias("confidence"), F.coalesce("n_facts", F.lit(0)).alias("n_facts"))


def _by_sets(sets: DataFrame, facts: DataFrame, k: int) -> DataFrame:
    """(set, seq, score) of (set, often) and (seq, often), often being words: of each part of the facts each set's best ``k`` by the words that both have, the earlier of equal ones first."""
    import pyarrow as pa

    parts = max(1, -(-facts.count() // PART))
    x = facts.select(F.pmod(F.xxhash64("seq"), F.lit(parts)).alias("part"), "seq", "often")
    y = sets.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), "set", "often")

    def run(f, s):
        import numpy as np

        order = np.argsort(f["seq"].to_numpy(), kind="stable")
        f = f.take(pa.array(order))
        seq, lists = f["seq"].to_numpy(), f["often"].combine_chunks()
        row = np.repeat(np.arange(len(seq)), lists.value_lengths().to_numpy(zero_copy_only=False))
        d = lists.flatten().dictionary_encode()
        word = d.indices.to_numpy()
        by = np.argsort(word, kind="stable")
        at = np.searchsorted(word[by], np.arange(len(d.dictionary) + 1))
        rows = {w: row[by[at[i] : at[i + 1]]] for i, w in enumerate(d.dictionary.to_pylist())}
        out = [], [], []
        for name, ws in zip(s["set"].to_pylist(), s["often"].to_pylist()):
            n = np.zeros(len(seq), np.uint8 if len(ws) < 256 else np.int32)
            for w in ws:
                if w in rows:
                    n[rows[w]] += 1
            left = k
            for score in range(int(n.max(initial=0)), 0, -1):
                best = np.flatnonzero(n == score)[:left]
                out[0].extend([name] * len(best))
                out[1].extend(seq[best].tolist())
                out[2].extend([score] * len(best))
                left -= len(best)
                if not left:
                    break
        return pa.table({"set": pa.array(out[0], pa.string()), "seq": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    return x.groupBy("part").cogroup(y.groupBy("part")).applyInArrow(run, "set string, seq bigint, score bigint")


def end_to_end(questions: DataFrame, triples: DataFrame, k: int = 20) -> DataFrame:
    """(variant, id, answer, confidence, n_facts): `answers` from all facts (without) and from accepted ones alone (with consistency)."""
    questions = materialize(questions, "qa-asked-for")
    one = lambda name, t: answers(questions, t, k).select(F.lit(name).alias("variant"), "*")
    return one("without", triples.withColumn("validation_status", F.lit("accepted"))).unionByName(one("with", triples))


def summary(answers: DataFrame, by: list[str] = []) -> DataFrame:
    """(by..., n, exact, f1, found, latency) of (prediction, gold, ms); a missing prediction counts as wrong."""
    s = token_f1(F.col("prediction"), F.col("gold"))["f1"]
    a = answers.withColumn("_f", s).withColumn("_e", (F.col("prediction").isNotNull() & exact_match(F.col("prediction"), F.col("gold"))).cast("double"))
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return a.groupBy(*by).agg(F.count("*").alias("n"), r("_e", "exact"), r("_f", "f1"), r((F.col("_f") > 0).cast("double"), "found"), r("ms", "latency"))


def ablation(summaries: DataFrame, baseline: str, metric: str = "f1") -> DataFrame:
    """(variant, value, delta): each variant's metric and what it loses against the baseline."""
    b = summaries.where(F.col("variant") == baseline).select(F.col(metric).alias("_b"))
    return summaries.crossJoin(F.broadcast(b)).select("variant", F.col(metric).alias("value"), F.round(F.col("_b") - F.col(metric), 6).alias("delta"))  # one row


def grid(scored: DataFrame, pairs: list[tuple[float, float]]) -> DataFrame:
    """(high, medium, f1) of (p, y) for pairs of thresholds: accepted from ``high``, rejected below ``medium``; what lies between counts against both classes."""
    g = scored.sparkSession.createDataFrame(pairs, "high double, medium double")
    x = scored.where("p is not null and y is not null").crossJoin(F.broadcast(g))  # a short fixed list of parameters
    acc, rej = F.col("p") >= F.col("high"), F.col("p") < F.col("medium")
    good = F.col("y") == 1
    tp, fp, fn = F.count_if(~good & rej), F.count_if(good & ~acc), F.count_if(~good & ~rej)
    return x.groupBy("high", "medium").agg(F.round(F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0)), 6).alias("f1"))


def information_quality(parts: DataFrame) -> DataFrame:
    """(variant, signal_kept, noise_removed, precision) of (variant, part, kept): part is signal or noise."""
    s, n, k = F.col("part") == "signal", F.col("part") == "noise", F.col("kept")
    d = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    return parts.groupBy("variant").agg(
        d(F.count_if(s & k), F.count_if(s)).alias("signal_kept"), d(F.count_if(n & ~k), F.count_if(n)).alias("noise_removed"), d(F.count_if(s & k), F.count_if(k)).alias("precision"),
    )


def stage_label(reason: Column) -> Column:
    r = F.lower(reason)
    return F.when(r.contains("stufe 1"), "stage1_rules").when(r.contains("stufe 2"), "stage2_embedding").when(r.contains("stufe 3"), "stage3_llm").when(r.contains("nli"), "nli").when(r.contains("fast"), "fast_path").otherwise("unknown")


def parse_vote(response: Column) -> Column:
    """Struct (action, confidence) of a judge's JSON; what can't be read asks for a human."""
    j = F.from_json(response, "action string, confidence double")
    known = F.lower(j["action"]).isin("accept", "reject", "merge", "human_review")
    return F.struct(F.when(known, F.lower(j["action"])).otherwise("human_review").alias("action"), F.coalesce(j["confidence"], F.lit(0.5)).alias("confidence"))
