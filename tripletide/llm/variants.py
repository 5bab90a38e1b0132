"""Variant spellings of names: canonical rewritings, exploded and joined by equality.

Each name is rewritten to (kind, core, extra): titles, particles, legal forms and word order fall away, nicknames become formal
names, abbreviated sectors whole ones, spellings of one sound become alike. From there its rewritings are exploded: the given name in full, as an initial, or as the known
names that it may be a misspelling of; an organisation under each of its sectors; the core as it is or, as far as typing errors are allowed, its ends without
a letter (`names.forms`). Rewritings meet in an equality join and what met is verified by edits. A rewriting is scored by its rarity, 1 / the number of given names behind it: a full name's is always
1, an initial's only where one person, not several, bears the surname with it, and only links of score 1 count. They are, with those that an entity's aliases state,
consolidated into groups; all work up to there is done once per reading, however many rows carry it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .components import components
from .names import edits, forms, read, same_extra, within


def rewritings(rows: DataFrame) -> DataFrame:
    """(id, main, kind, core, given) of rows (id, main, name, type); names that leave nothing are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [read(n, t) for n, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            at = [i for i, g in enumerate(got) if g]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int32())), b.column(1).take(pa.array(at, pa.int32())), *[pa.array([got[i][j] for i in at], pa.string()) for j in range(3)]],
                names=["id", "main", "kind", "core", "given"],
            )

    return rows.select("id", "main", "name", "type").mapInArrow(run, "id string, main boolean, kind string, core string, given string")


def _forms(keys: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [forms(k, c, g) for k, c, g in zip(*(b.column(i).to_pylist() for i in range(1, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array([x[j] for x in lists], pa.list_(pa.string())) for j in (0, 1)]], names=["key", "core", "own", "sought"])

    return keys.select("key", "kind", "core", "given").mapInArrow(run, "key string, core string, own array<string>, sought array<string>")


def _verified(met: DataFrame) -> DataFrame:
    """Pairs (key_a, key_b), keys as ``kind|core|given``, that are the same, with the edits of their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                (k, c, g), (_, e, h) = x.split("|"), y.split("|")
                d.append(within(c, e, edits(min(len(c), len(e)))) if same_extra(k, g, h) else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d, pa.int32())], names=["key_a", "key_b", "d"])

    return met.select("key_a", "key_b").mapInArrow(run, "key_a string, key_b string, d int").where("d is not null")


def similar(keys: DataFrame) -> DataFrame:
    """(a, b): readings of one name among distinct (key, kind, core, given), key being ``kind|core|given``."""
    f = materialize(_forms(keys), "p5-forms")
    side = lambda forms_, s: f.select(F.explode(F.transform(forms_, lambda x: F.xxhash64(x))).alias("form"), F.col("key").alias(f"key_{s}"), F.col("core").alias(f"core_{s}"))
    # Two edits that are swaps are four to `levenshtein`; it only thins what is verified.
    met = side("own", "a").join(side("sought", "b"), "form").where("key_a <> key_b").where(F.levenshtein("core_a", "core_b", 4) >= 0)
    # Either side may have the shorter core: one order for both.
    met = met.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
    met = materialize(_verified(met), "p5-met")
    given = lambda c: F.element_at(F.split(c, r"\|"), -1)
    initial = lambda c: (F.substring(c, 1, 1) == "P") & (F.length(given(c)) == 1)
    full = met.where(given("key_a").eqNullSafe(given("key_b")) | ~initial("key_a") & ~initial("key_b")).select(F.col("key_a").alias("a"), F.col("key_b").alias("b"))
    # An initial: of the nearest surnames that fit, all must have one given name.
    both = met.select("key_a", "key_b", "d").union(met.select("key_b", "key_a", "d")).where(initial("key_a") & ~initial("key_b"))
    one = both.withColumn("near", F.min("d").over(Window.partitionBy("key_a"))).where("d = near")
    one = one.groupBy("key_a").agg(F.min(given("key_b")).alias("lo"), F.max(given("key_b")).alias("hi"), F.min("key_b").alias("key_b")).where("lo = hi")
    return full.union(one.select("key_a", "key_b"))


def groups(rows: DataFrame) -> DataFrame:
    """(id, group) of rows (id, main, name, type): ids whose names mean one person or organisation share a group.

    Rows with main false are further names of their id. Null and empty names and names without a letter belong nowhere. Repeated rows count once.
    """
    r = materialize(rewritings(rows).withColumn("key", F.concat_ws("|", "kind", "core", "given")), "p5-names")
    keys = materialize(r.select("key", "kind", "core", "given").distinct(), "p5-keys")
    # Other names of one id: linked to its main one. An initial tells too little to link by, and so does a bare word.
    main = r.where("main").select("id", F.col("key").alias("a")).distinct()
    other = r.where("not main and (kind = 'O' or length(given) > 1)").select("id", F.col("key").alias("b")).distinct()
    stated = main.join(other, "id").where("a <> b").select("a", "b").distinct()
    c = components(similar(keys).union(stated))
    c = materialize(c, "p5-groups")
    m = main.join(c, main["a"] == c["item"], "left")
    return m.select("id", F.coalesce("group", "a").alias("group")).distinct()


def records(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id, main, name, type) of the persons and organisations of entities, with their aliases, and of the mentions."""
    e = entities.where(F.lower("entity_type").rlike("^(pers|org)"))
    own = e.select(F.col("entity_id").alias("id"), F.lit(True).alias("main"), F.col("entity_name").alias("name"), F.col("entity_type").alias("type"))
    alias = e.select(F.col("entity_id").alias("id"), F.lit(False).alias("main"), F.explode("aliases").alias("name"), F.col("entity_type").alias("type"))
    men = mentions.select(F.col("variant_id").alias("id"), F.lit(True).alias("main"), F.col("variant_name").alias("name"), F.col("entity_type").alias("type"))
    return own.union(alias).union(men).where("id is not null and name is not null")


def found(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: all pairs of rows that name one person or organisation, equal spellings too."""
    g = materialize(groups(records(entities, mentions)), "p5-members")
    return g.select("group", F.col("id").alias("id_a")).join(g.select("group", F.col("id").alias("id_b")), "group").where("id_a < id_b").select("id_a", "id_b").distinct()
