"""Experiments over the cascade: facts come in phases, what a phase accepts joins the graph of the next, and each phase is scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .history import running, segment

#: (batch, edges) to (seq, status) of every fact of the batch.
Decide = Callable[[DataFrame, DataFrame], DataFrame]


def phases(parts: list[tuple[str, DataFrame]], edges: DataFrame, decide: Decide, keep: tuple[str, ...] = ()) -> DataFrame:
    """(phase, seq, status): the parts in order, each decided against the edges and what the parts named in ``keep`` had accepted before it."""
    graph, out = edges, None
    for name, part in parts:
        v = materialize(decide(part, graph).select(F.lit(name).alias("phase"), "seq", "status"), "phase")
        out = v if out is None else out.unionByName(v)
        if name in keep:
            graph = graph.unionByName(part.join(v.where("status = 'accepted'").select("seq"), "seq", "left_semi").select(*edges.columns))
    return out


def two_phase(facts: DataFrame, edges: DataFrame, decide: Decide) -> DataFrame:
    """`phases` of facts with a boolean ``gold``: the true ones first, whose accepted ones are stored, then the false ones. Facts without gold are left out."""
    return phases([("good", facts.where("gold")), ("bad", facts.where("not gold"))], edges, decide, ("good",))


def realistic(signal: DataFrame, every: DataFrame, edges: DataFrame, decide: Decide) -> DataFrame:
    """`phases`: seeded with the supporting facts, updated with all."""
    return phases([("seed", signal), ("update", every)], edges, decide, ("seed",))


def by_position(facts: DataFrame, ratio: float, order: str = "seq") -> DataFrame:
    """Add ``seed``: the fact is among the first ``ratio`` of all in order, rounded down. All facts are numbered in segments; no task sorts them all."""
    f = running(segment(facts.withColumn("_all", F.lit(0)), "_all", order, "position"), "_all", order, {"_n": F.lit(1)})
    total = facts.agg(F.floor(F.count("*") * ratio).alias("_m"))
    return f.crossJoin(F.broadcast(total)).withColumn("seed", F.col("_n") <= F.col("_m")).drop("_all", "_seg", "_n", "_m")  # one row


#: Kinds of conflict that a reason may be, in the order in which they are looked for; others count as other.
REASONS = ("schema", "domain", "self_loop", "cycle", "temporal", "cardinality")


def reason(checks: Column) -> Column:
    """The first known kind among a fact's checks (joined by commas), else other; empty checks give none."""
    first = F.get(F.filter(F.split(checks, ","), lambda x: x.isin(*REASONS)), F.lit(0))
    return F.when(F.coalesce(checks, F.lit("")) == "", "none").otherwise(F.coalesce(first, F.lit("other")))


def seed_update(facts: DataFrame, ratio: float, schema_ok: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(phase, status, reason, n): the first ``ratio`` of facts in order are stored if their schema is right, the rest is checked against them.

    ``schema_ok`` gives the (seq) that violate the schema; ``check`` takes (batch, edges) and gives (seq, outcome, checks).
    """
    f = materialize(by_position(facts, ratio), "seed")
    seed, update = f.where("seed").drop("seed"), f.where("not seed").drop("seed")
    bad = schema_ok(seed).select("seq").distinct().withColumn("bad", F.lit(True))
    s = materialize(seed.join(bad, "seq", "left"), "seeded")
    graph = s.where("bad is null").drop("bad")
    first = s.select(F.lit("seed").alias("phase"), F.when(F.col("bad"), "rejected").otherwise("accepted").alias("status"), F.when(F.col("bad"), "schema").otherwise("none").alias("reason"))
    u = check(update, graph)
    status = F.when(F.col("outcome") == "FAIL", "rejected").when(F.col("outcome") == "UNCERTAIN", "needs_review").otherwise("accepted")
    then = u.select(F.lit("update").alias("phase"), status.alias("status"), F.when(status == "accepted", "none").otherwise(reason(F.col("checks"))).alias("reason"))
    return first.union(then).groupBy("phase", "status", "reason").agg(F.count("*").alias("n"))


def effectiveness(p: DataFrame) -> DataFrame:
    """(metric, value) of (phase 1 to 6, confidence, f1): what a missing and a false source take off the confidence of phase 2, and F1 of phases 4 and 5; null where a phase is missing."""
    at = lambda n, c: F.max(F.when(F.col("phase") == n, F.col(c)))
    loss = lambda n: F.when(at(2, "confidence") > 0, (at(2, "confidence") - at(n, "confidence")) / at(2, "confidence"))
    m = {"missing_source_penalty_effectiveness": loss(3), "contradiction_detection_f1": at(4, "f1"), "cross_question_detection_f1": at(5, "f1"), "fake_source_detection_effectiveness": loss(6)}
    one = p.agg(*[F.round(x, 6).alias(n) for n, x in m.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in m])).alias("x")).select("x.*")


def phase_records(report: DataFrame, label: str) -> DataFrame:
    """(label, tp, fp, tn, fn) of a report (phases map<string, struct<tp, fp, tn, fn>>): a row for each phase that counted something."""
    x = report.select(F.explode("phases").alias("phase", "c")).select(F.concat(F.lit(f"{label}/"), "phase").alias("label"), *[F.coalesce(f"c.{k}", F.lit(0)).cast("bigint").alias(k) for k in ("tp", "fp", "tn", "fn")])
    return x.where("tp + fp + tn + fn > 0")


def labels(counts: DataFrame) -> DataFrame:
    """(label, y_true, y_pred): a row for each example behind (label, tp, fp, tn, fn)."""
    cell = lambda n, t, p: F.array_repeat(F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred")), F.col(n).cast("int"))
    return counts.select("label", F.explode(F.concat(cell("tp", 1, 1), cell("fp", 0, 1), cell("tn", 0, 0), cell("fn", 1, 0))).alias("x")).select("label", "x.*")


def extrinsic_summary(decided: DataFrame) -> DataFrame:
    """(example, n, accepted, rejected, needs_review): counts of (example, status) for each example and, with example null, for all."""
    c = lambda x: F.count_if(F.col("status") == x).alias(x)
    return decided.rollup("example").agg(F.count("*").alias("n"), c("accepted"), c("rejected"), c("needs_review"))


def stream_parts(supports: DataFrame, refutes: DataFrame, variants: DataFrame, contradictions: DataFrame, order: Column, most: int = 50) -> DataFrame:
    """(id, category, accept) of a labelled stream, frames of (id): supporting and refuting facts, variants, and the first contradictions in ``order``, ``most`` or half as many as supports at most."""
    tag = lambda df, c, ok: df.select("id", F.lit(c).alias("category"), F.lit(ok).alias("accept"))
    first = contradictions.orderBy(order, "id").limit(most)
    half = supports.agg(F.floor(F.count("*") / 2).alias("_h"))
    from pyspark.sql import Window

    cut = first.withColumn("_r", F.row_number().over(Window.orderBy(order, "id"))).crossJoin(F.broadcast(half)).where("_r <= _h")  # ``most`` rows, one row
    return tag(supports, "supports", True).union(tag(refutes, "refutes", False)).union(tag(variants, "entity_variant", True)).union(tag(cut, "cross_doc", False))


def ingest(found: DataFrame, edges: DataFrame, decide: Decide) -> tuple[DataFrame, DataFrame]:
    """(verdicts, graph) of extracted facts: each is decided, and the accepted ones join the edges."""
    v = materialize(decide(found, edges), "ingest")
    return v, edges.unionByName(found.join(v.where("status = 'accepted'").select("seq"), "seq", "left_semi").select(*edges.columns))


def extracted(docs: DataFrame, strategy: str = "sentence") -> DataFrame:
    """Facts in the columns that checks take, from documents (doc_id, text): chunked, extracted by patterns, ends keyed by fingerprint; ``seq`` is a hash of document and fact."""
    from .. import kg
    from ..functions import chunking, extraction

    c = materialize(chunking.chunk(docs.select("doc_id", "text"), strategy), "ingest-chunks")
    r = materialize(extraction.relations(c), "ingest-relations")
    f = extraction.build(r, extraction.entities(c, r))
    s, o = kg.fingerprint(F.col("subject"), F.col("s_type")), kg.fingerprint(F.col("object"), F.col("o_type"))
    return f.select(
        F.xxhash64("doc_id", "subject", "predicate", "object").alias("seq"), F.lit(1).alias("batch_id"), F.col("subject").alias("s_name"), "s_type", s.alias("s_id"), F.col("predicate").alias("pred"), F.col("object").alias("o_name"), "o_type", o.alias("o_id"),
        F.col("confidence").alias("conf"), F.col("doc_id").cast("string").alias("doc"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("status"),
    ).dropDuplicates(["seq"])


def ingest_documents(docs: DataFrame, edges: DataFrame, decide: Decide) -> tuple[DataFrame, DataFrame]:
    """`ingest` of what the documents say; files come as documents through `loaders.documents`."""
    return ingest(materialize(extracted(docs), "ingest-facts"), edges, decide)


def reasoning(a: Column, b: Column, name: Column, embedding: Column, same_type: Column, limit: float = 0.85) -> Column:
    """What was compared and decided for two records, as one line."""
    pct = lambda x: F.format_string("%.2f%%", x * 100)
    both = 0.6 * name + 0.4 * embedding
    verdict = F.when(same_type & (both >= limit), "duplicate, to be merged").when(~same_type, "no duplicate: types differ").otherwise("no duplicate: not alike enough")
    return F.concat_ws(" | ", F.concat(F.lit("'"), a, F.lit("' and '"), b, F.lit("'")), F.concat(F.lit("names "), pct(name)), F.concat(F.lit("vectors "), pct(embedding)), F.concat(F.lit("both "), pct(both)), F.concat(F.lit("limit "), F.lit(f"{limit * 100:.2f}%")), verdict)
