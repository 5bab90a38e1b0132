"""Mapping free-entered values to a canonical list: a partition-based pigeonhole join, built-in functions only.

References: every entry of the lists, its wording in the other list and in the catalogue, and the ways such an entry is written
(words rotated, a copula before it, first word cut short). A reference of length n within k edits of a value shares one of its
k+1 segments with it, at a position that the difference in length bounds; so values meet references in an equality join on
(length, segment, text of the segment) and `levenshtein` verifies what met. Work is done once per distinct value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import blank, join_checked, materialize

#: Edits allowed; references of up to SHORT letters get one edit (swaps of neighbours count as one there).
EDITS, SHORT = 2, 5
UNMATCHED = "UNMATCHED"


def compact(c: Column) -> Column:
    """Lower-case letters only; digits that stand for letters become those, umlauts and their two-letter spellings plain vowels."""
    letters = F.regexp_replace(F.translate(F.lower(c), "013457äöü", "oieastaou"), r"[^\p{L}]", "")
    return F.regexp_replace(letters, "([aou])e", "$1")


def entries(configs: DataFrame) -> DataFrame:
    """(config_id, kind, pos, entry) of all lists."""
    lists = F.explode(F.array(F.struct(F.lit("relation").alias("kind"), F.col("relation_types").alias("l")), F.struct(F.lit("type").alias("kind"), F.col("entity_types").alias("l"))))
    x = configs.select("config_id", lists.alias("x"))
    return x.select("config_id", "x.kind", F.posexplode("x.l").alias("pos", "entry")).where("entry is not null")


def references(configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, pos, ref, k, cut, plain): ``ref`` in compact letters, with the edits it may differ by.

    ``cut`` marks forms with a shortened first word, which count for values that hold a full stop (types: any value, exactly).
    """
    e = entries(configs)
    worded = catalog.select(F.explode(F.array("relation_de", "relation_en")).alias("entry"), F.array("gloss_de", "gloss_en", "relation_de", "relation_en").alias("also")).where("entry is not null")
    gloss = e.where("kind = 'relation'").join(worded, "entry").select("kind", "pos", F.explode("also").alias("entry"))
    base = e.select("kind", "pos", "entry").union(gloss).where("entry is not null").distinct()
    words = F.filter(F.split(F.lower("entry"), r"[^\p{L}]+"), lambda w: w != "")
    words = F.transform(words, compact)
    b = base.select("kind", "pos", words.alias("w")).where("size(w) > 0").distinct()
    turned = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.concat(F.slice("w", i + 1, F.size("w") - i), F.slice("w", F.lit(1), i)))
    forms = b.select("kind", "pos", "w", F.posexplode(turned).alias("turn", "t")).select("kind", "pos", F.array_join("t", "").alias("r"), (F.col("turn") == 0).alias("plain"))
    verbs = forms.where("kind = 'relation'").select("kind", "pos", F.explode(F.array(F.concat(F.lit("ist"), "r"), F.concat(F.lit("is"), "r"), F.concat("r", F.lit("s")))).alias("r"), F.lit(False).alias("plain"))
    whole = forms.union(verbs).select("kind", "pos", F.col("r").alias("ref"), F.lit(False).alias("cut"), "plain")
    first = F.col("w")[0]
    short = b.where(F.length(first) > 4).select("kind", "pos", F.explode(F.transform(F.sequence(F.lit(3), F.length(first) - 2), lambda n: F.concat(F.substring(first, F.lit(1), n), F.array_join(F.slice("w", F.lit(2), F.size("w")), "")))).alias("ref"))
    short = short.select("kind", "pos", "ref", F.lit(True).alias("cut"), F.lit(False).alias("plain"))
    k = F.when(F.col("cut") | (F.length("ref") <= SHORT), F.when(F.length("ref") < 3, 0).otherwise(1)).otherwise(EDITS)
    return whole.union(short).withColumn("k", k).groupBy("kind", "pos", "ref", "cut").agg(F.max("k").alias("k"), F.max("plain").alias("plain"))


def _swaps(refs: DataFrame) -> DataFrame:
    """Short references with two neighbours swapped, to be met exactly."""
    n = F.length("ref")
    s = refs.where((n <= SHORT) & (n > 2) & ~F.col("cut")).select("kind", "pos", F.col("ref").alias("of"), F.explode(F.sequence(F.lit(1), n - 1)).alias("i"))
    ref = F.concat(F.expr("substring(of, 1, i - 1)"), F.expr("substring(of, i + 1, 1)"), F.expr("substring(of, i, 1)"), F.expr("substring(of, i + 2)"))
    return s.select("kind", "pos", ref.alias("ref")).where("ref <> of")


def _forms(values: DataFrame) -> DataFrame:
    """(kind, value, form, dot): what may stand in a value: the whole, without a closing bracket or number, and its parts."""
    v = F.regexp_replace("value", r"[\p{C}]", "")
    bare = F.regexp_replace(v, r"(_\d+|\s*\([^)]*\)?)[\p{P}\s]*$", "")
    parts = F.filter(F.split(v, r"[/:(]"), lambda p: F.length(compact(p)) > 2)
    forms = F.array_distinct(F.concat(F.array(compact(bare), compact(v)), F.transform(parts, compact)))
    return values.select("kind", "value", F.col("value").rlike(r"\p{L}\.").alias("dot"), F.explode(F.filter(forms, lambda f: F.length(f) > 1)).alias("form"))


def match(values: DataFrame, configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(kind, value, pos) for each distinct (kind, value) that means an entry; of several the nearest, then the first.

    kind is ``relation`` or ``type``, pos the place in the lists. Values that mean none are missing from the result.
    """
    refs = materialize(references(configs, catalog), "p4-refs")
    forms = _forms(values)
    ok = (~F.col("cut")) | F.col("dot") | ((F.col("kind") == "type") & (F.length("form") == F.length("ref")))
    same = join_checked(forms.withColumnRenamed("form", "ref"), refs, ["kind", "ref"]).where((~F.col("cut")) | F.col("dot") | (F.col("kind") == "type"))
    same = same.select("kind", "value", "pos", F.lit(0).alias("d"), (F.col("cut").cast("int") * 2 + (~F.col("plain")).cast("int")).alias("o"))
    swapped = join_checked(forms.withColumnRenamed("form", "ref"), materialize(_swaps(refs), "p4-swaps"), ["kind", "ref"]).select("kind", "value", "pos", F.lit(1).alias("d"), F.lit(1).alias("o"))
    # Segments of the references: cut i of k+1 over n letters runs from floor(n*i/(k+1)) to floor(n*(i+1)/(k+1)).
    n, k = F.length("ref"), F.col("k")
    cut_at = lambda i: F.floor(n * i / (k + 1)).cast("int")
    segs = refs.where("k > 0").select("*", F.explode(F.sequence(F.lit(0), k)).alias("i"))
    segs = segs.select("kind", "pos", "ref", "k", "cut", "plain", n.alias("n"), "i", F.expr("substring(ref, cast(floor(length(ref)*i/(k+1)) as int) + 1, cast(floor(length(ref)*(i+1)/(k+1)) as int) - cast(floor(length(ref)*i/(k+1)) as int))").alias("seg"))
    segs = materialize(segs, "p4-segments")
    # Lengths and edits that references have at all: a value is cut for these only.
    far = F.array(*[F.struct(F.lit(kk).alias("k"), F.lit(dl).alias("dl"), F.lit(i).alias("i"), F.lit(s).alias("s")) for kk in range(1, EDITS + 1) for dl in range(-kk, kk + 1) for i in range(kk + 1) for s in range(-((kk - dl) // 2), (kk + dl) // 2 + 1)])
    # dl: letters that the value has more than the reference; s: shift of the segment in the value.
    probe = forms.where(F.length("form") > 2).select("*", F.explode(far).alias("p")).select("kind", "value", "dot", "form", F.col("p.k").alias("k"), F.col("p.i").alias("i"), (F.length("form") - F.col("p.dl")).alias("n"), F.col("p.s").alias("s")).where("n > 2")
    probe = probe.withColumn("b", F.expr("cast(floor(n*i/(k+1)) as int)")).withColumn("m", F.expr("cast(floor(n*(i+1)/(k+1)) as int) - b"))
    probe = probe.where("b + s >= 0 and b + s + m <= length(form)").withColumn("seg", F.expr("substring(form, b + s + 1, m)")).select("kind", "value", "dot", "form", "k", "n", "i", "seg")
    near = join_checked(probe, segs, ["kind", "k", "n", "i", "seg"]).where(ok | F.col("cut") & F.col("dot"))
    near = near.where("not cut or dot").withColumn("d", F.levenshtein("form", "ref", EDITS)).where("d between 0 and k")
    near = near.select("kind", "value", "pos", "d", (F.col("cut").cast("int") * 2 + (~F.col("plain")).cast("int")).alias("o"))
    best = same.union(swapped).union(near).groupBy("kind", "value").agg(F.min(F.struct("d", "o", "pos")).alias("x"))
    return best.select("kind", "value", F.col("x.pos").alias("pos"))


FIELDS = {"predicate": "relation", "subject_type": "type", "object_type": "type"}


def found(triples: DataFrame, configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(seq, field_name, canonical) of every non-blank value that is not literally in its config's list.

    A value that means no entry, or whose row has no known config, is reported as ``UNMATCHED`` (anti-join). Repeated rows count
    once; null and blank values and rows without seq give nothing; texts are compared whole.
    """
    e = entries(configs)
    lit = e.select("config_id", "kind", F.col("entry").alias("value")).distinct()
    each = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(k).alias("kind"), F.col(f).alias("value")) for f, k in FIELDS.items()])
    rows = triples.where("seq is not null").select("seq", "config_id", F.explode(each).alias("x")).select("seq", "config_id", "x.*").where(~blank(F.col("value")))
    # The lists are those of the configs: bounded by that table, which is read first to check.
    rows = join_checked(rows, materialize(lit, "p4-lists"), ["config_id", "kind", "value"], "left_anti").distinct()
    rows = materialize(rows, "p4-rows")
    hits = materialize(match(rows.select("kind", "value").distinct(), configs, catalog), "p4-hits")
    named = join_checked(rows, hits, ["kind", "value"]).select("seq", "field_name", "config_id", "kind", "pos")
    named = join_checked(named, materialize(e, "p4-entries"), ["config_id", "kind", "pos"], "left").select("seq", "field_name", F.coalesce("entry", F.lit(UNMATCHED)).alias("canonical"))
    none = join_checked(rows, hits, ["kind", "value"], "left_anti").select("seq", "field_name", F.lit(UNMATCHED).alias("canonical"))
    return named.union(none)


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from ..runtime import table

    return (
        table(spark, sf_dir, "triples", "seq", "config_id", *FIELDS),
        table(spark, sf_dir, "pipeline_configs", "config_id", "relation_types", "entity_types"),
        table(spark, sf_dir, "relation_catalog"),
    )
