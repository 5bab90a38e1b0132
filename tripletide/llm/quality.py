"""Per-document statistics of text quality, placed against quantile sketches of their language.

Each text is measured once, in built-in functions, and the narrow table of measures is stored. Per language a mergeable quantile sketch
(Greenwald-Khanna, as `percentile_approx` keeps it) of every measure is built from all documents; a value becomes a robust
z-score, its distance from the median in interquartile units, and the tails are flagged. A language's quantiles are weighed with those of all
texts, so that one of few texts is measured mostly against the whole, at any size by one rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import blank, join_checked, materialize

MEASURES = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "line_end_share", "sentence_density", "common_share", "plain_share")
#: Least spread that counts, so that a language whose texts are all alike flags nothing for a trifle.
FLOOR = {"n_words": 5.0, "mean_word_length": 0.25, "symbol_ratio": 0.01, "digit_ratio": 0.01, "line_end_share": 0.1, "sentence_density": 0.015, "common_share": 0.03, "plain_share": 0.04}
CUTS = (0.05, 0.25, 0.5, 0.75, 0.95)
#: A language's quantiles are drawn towards those of all texts as if so many texts of the whole were among its own: few texts tell little.
PRIOR = 100
#: Words that `measures` takes as common ones at most.
WORDS = 100_000
#: Tails: beyond FAR a single measure tells no prose, beyond LOW it takes two.
FAR, LOW = -5.5, -2.2

# The mark comes first and looks back, so that only marks cost more than a glance.
_SENTENCE = r"[.!?…](?<=(?:\p{Ll}|\p{L}{2}|\d{4}|\)).)(?<!\b(?:Inc|Ltd|Co|Corp|vol|Nr|Bd).)[\"”“»)]*(?=\s|$)"
_LINE_END = r"[.!?…:;][\"”“»)]*\s*$"


def measures(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, lang, MEASURES...): of every text that is not null or blank; others keep null measures.

    lang is lower case, null counts as ``und``. Words are runs of letters and digits; ``common_share`` is the share of words
    in common_words of any language, ``plain_share`` that of other words of three or more letters in lower case,
    ``sentence_density`` sentence ends per word. Texts are measured whole.
    """
    # A fixed table by definition of the data (189 words); every task holds it as one set. A table that is none is refused, not cut.
    rows = common.where("word is not null").select(F.lower("word").alias("w")).distinct().limit(WORDS + 1).collect()
    if len(rows) > WORDS:
        raise ValueError(f"common_words is to be a fixed list of at most {WORDS} words")
    words = [r["w"] for r in rows] or [""]
    t: Column = F.col("text")
    lines = F.filter(F.split(t, r"[\r\n\x0b\x0c\u0085  ]+"), lambda x: ~blank(x))
    d = docs.select("doc_id", F.coalesce(F.lower(F.trim("lang")), F.lit("und")).alias("lang"), F.when(~blank(t), t).alias("text"))
    # The words and lines of a text are cut once and then counted in several ways.
    d = d.select("doc_id", "lang", "text", F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("_w"), lines.alias("_l"))
    plain = lambda x: (F.length(x) > 2) & (x > ":") & (x == F.lower(x)) & ~x.isin(words)  # noqa: E731 (digits sort before the colon)
    d = d.select(
        "doc_id",
        "lang",
        F.length("text").alias("_n"),
        F.size("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).alias("_letters"),
        (F.length(F.regexp_replace("text", r"\s+", "")) - F.length(F.array_join("_w", ""))).alias("_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{N}+", ""))).alias("_digits"),
        F.size("_l").alias("_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(_LINE_END))).alias("_ends"),
        F.regexp_count("text", F.lit(_SENTENCE)).alias("_sentences"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(words))).alias("_common"),
        F.size(F.filter("_w", plain)).alias("_plain"),
        F.col("text").isNotNull().alias("_ok"),
    )
    per = lambda a, b: F.when(F.col("_ok"), F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return d.select(
        "doc_id",
        "lang",
        F.when(F.col("_ok"), F.col("n_words").cast("double")).alias("n_words"),
        per("_letters", "n_words").alias("mean_word_length"),
        per("_symbols", "_n").alias("symbol_ratio"),
        per("_digits", "_n").alias("digit_ratio"),
        per("_ends", "_lines").alias("line_end_share"),
        per("_sentences", "n_words").alias("sentence_density"),
        per("_common", "n_words").alias("common_share"),
        per("_plain", "n_words").alias("plain_share"),
    )


def sketches(m: DataFrame) -> DataFrame:
    """(lang, n, MEASURES as arrays of the quantiles CUTS); lang null holds all texts."""
    cuts = F.array(*map(F.lit, CUTS))
    own = m.where("n_words is not null")
    aggs = [F.count("*").alias("n"), *[F.percentile_approx(c, cuts, F.lit(2000)).alias(c) for c in MEASURES]]
    return own.groupBy("lang").agg(*aggs).unionByName(own.agg(*aggs).withColumn("lang", F.lit(None).cast("string")))


def statistics(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, lang, measures, z_<measure>, is_prose): one row per row of documents.

    A text is no prose where its share of common words or its density of sentences lies far below its language's, or two of common words, sentences and
    plain words lie below. Null, empty and blank texts have null measures and is_prose null.
    """
    m = materialize(measures(docs, common), "p10-measures")
    s = materialize(sketches(m), "p10-sketches")
    everyone = s.where("lang is null").select(*[F.col(c).alias(f"_a_{c}") for c in MEASURES])
    own = s.where(F.col("lang").isNotNull()).select("lang", F.col("n").alias("_n"), *[F.col(c).alias(f"_q_{c}") for c in MEASURES])
    j = join_checked(m, _same(own, s), "lang", "left")
    j = j.crossJoin(F.broadcast(everyone))  # one row
    out = j
    for c in MEASURES:
        n = F.coalesce(F.col("_n"), F.lit(0))
        q = F.zip_with(F.coalesce(f"_q_{c}", f"_a_{c}"), f"_a_{c}", lambda x, y: (n * x + PRIOR * y) / (n + PRIOR))  # noqa: B023
        spread = F.greatest((F.get(q, F.lit(3)) - F.get(q, F.lit(1))) / 1.349, F.lit(FLOOR[c]))
        out = out.withColumn(f"z_{c}", F.round((F.col(c) - F.get(q, F.lit(2))) / spread, 4))
    low = lambda c: (F.col(f"z_{c}") < LOW).cast("int")
    junk = (F.col("z_common_share") < FAR) | (low("common_share") + low("sentence_density") + low("plain_share") >= 2)
    return out.select("doc_id", "lang", *MEASURES, *[f"z_{c}" for c in MEASURES], F.when(F.col("n_words").isNotNull(), ~junk).alias("is_prose"))


def _same(df: DataFrame, stored: DataFrame) -> DataFrame:
    """``df``, a projection of ``stored``, with its place on disk, for the size check of a join."""
    df._tide_path = stored._tide_path
    return df


def found(docs: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id) of the texts that are no running prose."""
    return statistics(docs, common).where("not is_prose").select("doc_id")
