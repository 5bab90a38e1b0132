"""Synthetic conflicts and orders, all drawn from hashes: the same seed gives the same rows on any number of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, number, uniform
from .history import following, running, segment

#: Suffixes of organisations, short names of places.
ORG_SUFFIXES = ("Inc.", "Corp.", "Ltd.", "LLC", "GmbH", "AG", "Company", "Corporation", "Foundation", "Institute")
PLACE_SHORT = {"United States": "US", "United Kingdom": "UK", "New York": "NY", "Los Angeles": "LA", "San Francisco": "SF", "Washington": "DC"}


def _v(name: Column, kind: str, similarity: float, when: Column | None = None) -> Column:
    s = F.struct(name.alias("variant_name"), F.lit(kind).alias("variant_type"), F.lit(similarity).alias("expected_similarity"))
    return s if when is None else F.when(when, s)


def _acronym(w: Column) -> Column:
    cap = F.filter(w, lambda x: F.substring(x, 1, 1) != F.lower(F.substring(x, 1, 1)))
    return F.array_join(F.transform(cap, lambda x: F.substring(x, 1, 1)), "")


def variants(entities: DataFrame, most: int | None = 4) -> DataFrame:
    """(entity_id, variant_name, variant_type, expected_similarity): how a name of its type may be written, the first ``most``."""
    n = F.col("entity_name")
    w = F.filter(F.split(n, " "), lambda x: x != "")
    first, last, size = F.get(w, F.lit(0)), F.element_at(w, -1), F.size(w)
    mid = F.transform(F.slice(w, F.lit(2), F.greatest(size - 2, F.lit(0))), lambda x: F.concat(F.substring(x, 1, 1), F.lit(".")))
    person = F.when(size < 2, F.array(_v(F.concat(F.lit("Dr. "), n), "title", 0.75), _v(F.concat(F.lit("Prof. "), n), "title", 0.75))).otherwise(
        F.array(
            _v(F.concat(F.substring(first, 1, 1), F.lit(". "), last), "abbreviation", 0.7),
            _v(last, "abbreviation", 0.6),
            _v(F.concat(last, F.lit(", "), first), "alias", 0.85),
            _v(F.concat(F.when(F.length(n) > 10, "Prof. ").otherwise("Dr. "), n), "title", 0.8, ~n.rlike(r"^(Dr|Prof)\.")),
            _v(F.concat_ws(" ", first, F.array_join(mid, " "), last), "abbreviation", 0.9, size > 2),
        )
    )
    suffix = "(" + "|".join(s.replace(".", r"\.") for s in ORG_SUFFIXES) + ")$"
    caps = F.filter(w, lambda x: ~F.lower(x).isin("the", "of", "and"))
    org = F.array(
        F.when(n.rlike(suffix), _v(F.trim(F.regexp_replace(n, suffix, "")), "abbreviation", 0.85)).otherwise(_v(F.concat(n, F.lit(" Inc.")), "alias", 0.85)),
        _v(F.upper(_acronym(caps)), "acronym", 0.5, F.length(_acronym(caps)) >= 2),
        F.when(n.startswith("The "), _v(F.substring(n, F.lit(5), F.length(n)), "alias", 0.95)).otherwise(_v(F.concat(F.lit("The "), n), "alias", 0.95)),
    )
    short = F.element_at(F.create_map(*[F.lit(x) for kv in PLACE_SHORT.items() for x in kv]), n)
    tail = r" (City|State|Province|County)$"
    place = F.array(
        _v(short, "acronym", 0.75, short.isNotNull()),
        _v(F.regexp_replace(n, tail, ""), "abbreviation", 0.85, n.rlike(tail)),
        _v(F.upper(_acronym(w)), "acronym", 0.55, size.between(2, 4) & (F.length(_acronym(w)) >= 2)),
    )
    other = F.array(_v(first, "abbreviation", 0.55, size > 1), _v(F.array_join(F.slice(w, F.lit(2), F.greatest(size - 1, F.lit(0))), " "), "alias", 0.9, F.lower(first).isin("the", "a", "an")))
    t = F.col("entity_type")
    some = F.array_compact(F.when(t == "Person", person).when(t == "Organisation", org).when(t == "Ort", place).otherwise(other))
    if most is not None:
        some = F.slice(some, 1, most)
    return entities.where(F.length(F.trim(n)) > 0).select("entity_id", F.explode(some).alias("x")).select("entity_id", "x.*")


#: Categories of `mutate`, a fifth of the facts each.
CATEGORIES = ("duplicate", "contradiction", "schema", "cardinality", "correct")


def mutate(facts: DataFrame, seed: int = 42) -> DataFrame:
    """(seq, category, expected, s_name, pred, o_name, doc): each fact changed by its category.

    duplicate: the subject's first name as initial; contradiction: the object of another fact of the same relation and object type, the next in a hashed order; schema: the object is the
    subject; cardinality: such another object for relations with one value, else a contradiction; correct: the same fact from a new source.
    """
    f = facts.where("pred is not null and s_name is not null and o_name is not null")
    k = F.floor(uniform(seed, "seq") * 5).cast("int")
    cat = F.get(F.array(*map(F.lit, CATEGORIES)), k)
    # The next object of the kind in a hashed order, after the last one the first.
    f = f.select("seq", "s_name", "pred", "o_name", "doc", cat.alias("category"), F.struct("pred", "o_type").alias("_k"), F.struct(draw(seed + 2, "seq").alias("d"), "seq").alias("_o"))
    f = following(f, "_k", "_o", {"other": "o_name"}, True, "mutate")
    words = F.split("s_name", " ")
    initial = F.when(F.size(words) > 1, F.concat(F.substring("s_name", 1, 1), F.lit(". "), F.array_join(F.slice(words, F.lit(2), F.size(words) - 1), " "))).otherwise(F.concat(F.lit("Dr. "), "s_name"))
    c = F.col("category")
    return f.select(
        "seq", "category", F.when(c == "correct", "ACCEPT").otherwise("REJECT").alias("expected"), F.when(c == "duplicate", initial).otherwise(F.col("s_name")).alias("s_name"), "pred",
        F.when(c == "schema", F.col("s_name")).when(c.isin("contradiction", "cardinality"), F.col("other")).otherwise(F.col("o_name")).alias("o_name"),
        F.when(c == "correct", F.concat(F.lit("update_"), F.col("seq").cast("string"))).otherwise(F.col("doc")).alias("doc"),
    )


# Pairs that contradict each other and ladders from fine to coarse.
SWAPS = (("alive", "dead"), ("open", "closed"), ("north", "south"), ("first", "last"), ("before", "after"), ("increased", "decreased"), ("early", "late"), ("large", "small"))
MARKERS = (("certainly", 0.95), ("probably", 0.75), ("possibly", 0.5), ("allegedly", 0.3))


def opposite(text: Column) -> Column:
    """The first listed word that occurs, either way round, is swapped; else the words are turned round."""
    c = None
    for a, b in [p for x in SWAPS for p in (x, x[::-1])]:
        hit = text.rlike(rf"(?i)\b{a}\b")
        c = F.when(hit, F.regexp_replace(text, rf"(?i)\b{a}\b", b)) if c is None else c.when(hit, F.regexp_replace(text, rf"(?i)\b{a}\b", b))
    return c.otherwise(F.array_join(F.reverse(F.split(text, " ")), " "))


def modal(facts: DataFrame) -> DataFrame:
    """(seq, claim, confidence): each stated fact under four markers of certainty."""
    m = F.array(*[F.struct(F.lit(x).alias("m"), F.lit(c).alias("c")) for x, c in MARKERS])
    return facts.where("text is not null").select("seq", "text", F.explode(m).alias("x")).select("seq", F.concat(F.initcap("x.m"), F.lit(": "), "text").alias("claim"), F.col("x.c").alias("confidence"))


def shuffle(events: DataFrame, strategy: str, category: str = "category", key: str = "key", seed: int = 42) -> DataFrame:
    """The rows with an ``arrival`` to sort by: a struct, so that no global rank is needed.

    random; interleaved: round robin over categories; temporal: each category in its own stretch of time; clustered: keys together; adversarial: the first conflict of a key right after its support.
    """
    if strategy == "interleaved":
        # The n-th rows of all categories, each in an order of its own, come together: a category may be most of all rows, so it is numbered in segments.
        e = events.withColumn("_o", F.struct(draw(seed, "id").alias("d"), "id"))
        e = running(segment(e, category, "_o", "interleaved"), category, "_o", {"_n": F.lit(1)}).drop("_o", "_seg")
        return e.withColumn("arrival", F.struct(F.col("_n").cast("double").alias("a"), number(F.col(category)).alias("b"), F.lit(0).cast("bigint").alias("c"))).drop("_n")
    if strategy == "temporal":
        lo = F.when(F.col(category) == "supports", 0.0).when(F.col(category) == "entity_variant", 0.2).when(F.col(category) == "refutes", 0.5).otherwise(0.7)
        hi = F.when(F.col(category) == "supports", 0.4).when(F.col(category) == "entity_variant", 0.7).when(F.col(category) == "refutes", 0.9).otherwise(1.0)
        return events.withColumn("arrival", F.struct((lo + (hi - lo) * uniform(seed, "id")).alias("a"), draw(seed, "id").alias("b"), F.lit(0).cast("bigint").alias("c")))
    by_key = number(F.col(key))
    if strategy == "clustered":
        return events.withColumn("arrival", F.struct(by_key.cast("double").alias("a"), by_key.alias("b"), draw(seed, "id").alias("c")))
    if strategy == "adversarial":
        late = F.when(F.col(category) == "supports", 0).otherwise(1).cast("bigint")
        return events.withColumn("arrival", F.struct(by_key.cast("double").alias("a"), late.alias("b"), draw(seed, "id").alias("c")))
    return events.withColumn("arrival", F.struct(uniform(seed, "id").alias("a"), draw(seed, "id").alias("b"), F.lit(0).cast("bigint").alias("c")))


def order_statistics(ranked: DataFrame, category: str = "category") -> DataFrame:
    """(category, n, first, last, mean) of the position of each category in (category, pos)."""
    return ranked.groupBy(category).agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.round(F.avg("pos"), 6).alias("mean"))


def stratified(df: DataFrame, strata: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows of each stratum, by the hash of their id; rows past them are dropped before the shuffle."""
    w = Window.partitionBy(strata).orderBy(draw(seed, "id"), "id")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")
