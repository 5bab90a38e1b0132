"""Ten kinds of synthetic conflict over facts, each with the action that a checker should take, and the taxonomy of the kinds.

All tables are fixed and small, choices are hashes of the fact, so a seed fixes the result on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw, uniform
from .generators import MARKERS, opposite
from .history import following

# Kinds with the action expected, how hard they are and what finds them.
TAXONOMY = (
    ("factual", "reject", "medium", "rules,llm"),
    ("temporal", "accept", "hard", "rules"),
    ("granularity", "merge", "medium", "embedding"),
    ("entity_variant", "merge", "medium", "embedding"),
    ("implicit", "reject", "hard", "llm"),
    ("negation", "reject", "easy", "nli"),
    ("modality", "weight", "hard", "nli,llm"),
    ("source_quality", "weight", "medium", "provenance"),
    ("schema", "merge", "easy", "rules"),
    ("numerical", "merge", "medium", "rules"),
)
LADDER = {"TEIL_VON": "HAT_BEZIEHUNG_ZU", "LEITET": "ARBEITET_BEI", "STUDIERT_AN": "HAT_BEZIEHUNG_ZU", "GEBOREN_IN": "WOHNT_IN", "KIND_VON": "KENNT"}
EQUIVALENT = {"GEBOREN_IN": "GEBURTSORT", "ARBEITET_BEI": "ANGESTELLT_BEI", "LEITET": "FUEHRT", "TEIL_VON": "GEHOERT_ZU", "SCHRIEB": "VERFASSTE"}
CONTRARY = {"VERHEIRATET_MIT": "KIND_VON", "LEITET": "ARBEITET_BEI", "KIND_VON": "VATER_VON", "STUDIERT_AN": "LEITET"}
SOURCES = (("peer_reviewed", 0.95), ("encyclopedia", 0.9), ("newspaper", 0.75), ("press_release", 0.6), ("blog", 0.4), ("forum", 0.3), ("anonymous", 0.1))


def taxonomy(spark: SparkSession) -> DataFrame:
    """(kind, action, difficulty, found_by)."""
    return spark.createDataFrame(list(TAXONOMY), "kind string, action string, difficulty string, found_by string")


def _map(table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("pred"))


#: What is said of when a fact held, and how a number is blurred.
TIMES = (" (until 1990)", " (since 1991)")
YEAR = r"\b(1\d{3}|20\d{2})\b"


def generate(facts: DataFrame, seed: int = 42, share: float = 1.0) -> DataFrame:
    """(seq, kind, action, s_name, pred, o_name, conf): for each chosen fact the conflicting ones of every kind that fits it.

    factual: the object of another fact of the relation and object type, the next in a hashed order (where there is none but its own, its opposite); temporal: two times at which both may hold;
    granularity: the coarser relation; entity_variant: the subject's first name as initial, and after its last one; implicit: a relation that excludes this one; negation; modality: four degrees of
    certainty; source_quality: two of the sources; schema: another name of the relation; numerical: a year as it is, as a decade and as about so much.
    Facts without subject, relation or object give none; ``share`` chooses facts by a draw.
    """
    f = facts.where("pred is not null and s_name is not null and o_name is not null").select("seq", "s_name", "pred", "o_name", F.struct("pred", "o_type").alias("_k"), F.struct(draw(seed + 3, "seq").alias("d"), "seq").alias("_o"))
    f = following(f, "_k", "_o", {"other": "o_name"}, True, "conflicts").where(uniform(seed, "seq") < share)
    first = F.floor(uniform(seed + 1, "seq") * len(SOURCES)).cast("int")
    second = (first + 1 + F.floor(uniform(seed + 2, "seq") * (len(SOURCES) - 1)).cast("int")) % len(SOURCES)
    rating = F.array(*[F.lit(r) for _, r in SOURCES])
    year = F.regexp_extract("o_name", YEAR, 1)
    blurred = lambda before, after: F.regexp_replace("o_name", F.lit(YEAR), F.concat(F.lit(before), F.substring(year, 1, 3), F.lit("0" + after)))
    words = F.split("s_name", " ")
    several = F.size(words) > 1

    def one(kind: str, when: Column, s: Column = F.col("s_name"), p: Column = F.col("pred"), o: Column = F.col("o_name"), c: Column = F.lit(0.8), action: str | None = None) -> Column:
        action = action or next(a for k, a, *_ in TAXONOMY if k == kind)
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action"), s.alias("s_name"), p.alias("pred"), o.alias("o_name"), c.cast("double").alias("conf")))

    yes = F.lit(True)
    kinds = F.array_compact(F.array(
        one("factual", yes, o=F.coalesce(F.nullif("other", "o_name"), F.concat(F.lit("not-"), F.col("o_name")))),
        *[one("temporal", yes, o=F.concat(F.col("o_name"), F.lit(t))) for t in TIMES],
        one("granularity", _map(LADDER).isNotNull(), p=_map(LADDER)),
        one("entity_variant", several, s=F.concat(F.substring("s_name", 1, 1), F.lit(". "), F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " "))),
        one("entity_variant", several, s=F.concat(F.element_at(words, -1), F.lit(", "), F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), " "))),
        one("implicit", _map(CONTRARY).isNotNull(), p=_map(CONTRARY)),
        one("negation", yes, p=F.concat(F.lit("NOT_"), F.col("pred"))),
        *[one("modality", yes, o=F.concat(F.lit(f"{m} "), F.col("o_name")), c=F.lit(c)) for m, c in MARKERS],
        *[one("source_quality", yes, c=F.get(rating, i)) for i in (first, second)],
        one("schema", yes, p=F.coalesce(_map(EQUIVALENT), F.concat(F.lit("schema:"), F.lower("pred")))),
        one("numerical", year != "", c=F.lit(0.95), action="accept"),
        one("numerical", year != "", o=blurred("the ", "s"), c=F.lit(0.75)),
        one("numerical", year != "", o=blurred("about ", ""), c=F.lit(0.75)),
    ))
    return f.select("seq", F.explode(kinds).alias("x")).select("seq", "x.*")


def statistics(conflicts: DataFrame) -> DataFrame:
    """(kind, action, n)."""
    return conflicts.groupBy("kind", "action").agg(F.count("*").alias("n"))


def per_kind(conflicts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(kind, n, right, accuracy): whether (seq, kind, status) meets the action expected; facts to weight are right either way."""
    j = conflicts.select("seq", "kind", "action").join(verdicts.select("seq", "kind", "status"), ["seq", "kind"])
    right = (F.col("action") == "weight") | ((F.col("action") == "reject") == (F.col("status") == "rejected"))
    return j.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(right).alias("right"), F.round(F.count_if(right) / F.count("*"), 6).alias("accuracy"))


def _others(facts: DataFrame, seed: int, cols: dict[str, str], ring: bool) -> DataFrame:
    """Facts with columns of the next one in a hashed order of all."""
    f = facts.withColumn("_all", F.lit(0)).withColumn("_o", F.struct(draw(seed, "seq").alias("d"), "seq"))
    return following(f, "_all", "_o", cols, ring, "others").drop("_all", "_o")


def swapped_objects(facts: DataFrame, seed: int = 42) -> DataFrame:
    """(seq, s_name, pred, o_name, other_seq): each fact with the object of another one, the next of a hashed order: answers to other questions. No fact keeps its own object."""
    f = facts.where("s_name is not null and o_name is not null and pred is not null").select("seq", "s_name", "pred", "o_name")
    j = _others(f, seed, {"_n": "o_name", "_s": "seq"}, True)
    return j.where(F.col("_n") != F.col("o_name")).select("seq", "s_name", "pred", F.col("_n").alias("o_name"), F.col("_s").alias("other_seq"))


def false_sources(facts: DataFrame, least: int = 50, most: int = 500, seed: int = 42) -> DataFrame:
    """(seq, text): each fact with another fact's source text of at least ``least`` characters that names neither of its ends, cut to ``most``."""
    f = facts.where("s_name is not null and o_name is not null").select("seq", "s_name", "o_name", "text")
    j = _others(f, seed, {"_t": "text"}, False).where(F.length("_t") >= least)
    return j.where(~F.col("_t").contains(F.col("s_name")) & ~F.col("_t").contains(F.col("o_name"))).select("seq", F.substring("_t", 1, most).alias("text"))


def negated(facts: DataFrame) -> DataFrame:
    """(seq, conflicting): the source text turned into its opposite."""
    return facts.where("text is not null").select("seq", opposite(F.col("text")).alias("conflicting"))
