"""Best record of each duplicate group, field by field, by currency reasoning.

From groups' dated rows `transitions` learns which value of a state attribute comes before which (pending before accepted, ...).
Within a group the records are partially ordered: dated ones by their date, and an undated one comes after all records whose
state precedes its own and before those whose state follows. `placed` reads off, for each record, the latest dated record that it must come after; `survivors`
takes the topologically latest value of each field, combined with what the field asks for (longest text, most reliable source, valid number).

All choices are maxima of ordered structs and a group's order is one maximum per state, so Spark combines them before the shuffle and a group that holds
a third of all rows is no larger for a task than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.history import neighbour, segment
from ..runtime import blank

#: Texts that stand in for a missing description.
STAND_INS = (
    "keine beschreibung", "todo", "no description available at this time", "n/a", "beschreibung folgt in kürze noch", "siehe oben",
    "n.n.", "(leer)", "null", "unbekannt", "unknown", "none", "tbd", "no description", "k. a.", "k.a.", "na", "nan", "nil", "empty", "leer",
)
FIRST_YEAR, LAST_YEAR = 2000, 2029


def trimmed(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.regexp_replace(c, r"^[\p{Z}\p{C}\s]+|[\p{Z}\p{C}\s]+$", "")


def usable_text(c: Column) -> Column:
    """Says something: not blank, has a letter or digit, is no stand-in."""
    return ~blank(c) & c.rlike(r"[\p{L}\p{N}]") & ~F.lower(trimmed(c)).isin(*STAND_INS)


def dated(c: Column) -> Column:
    """``c`` where its year is believable, else null."""
    return F.when(F.year(c).between(FIRST_YEAR, LAST_YEAR), c)


#: States that `transitions` orders at most: the attribute is to be a small domain, else it raises.
STATES = 1000


def transitions(entities: DataFrame, group: str = "fingerprint", state: str = "validation_status") -> DataFrame:
    """(state, depth): how late a state comes, learned from the dated rows of the groups.

    Neighbouring dated rows of one group give value transitions; state a precedes b if a->b is counted more often than
    b->a. The depth is the length of the longest chain of precedences, states of a cycle end at the number of states. A group with a third
    of all rows lies in many segments. Repeated rows count once; rows without date, state, group or id teach nothing.
    """
    rows = entities.select(group, F.struct(dated(F.col("created_at")).alias("t"), "entity_id").alias("o"), F.col(state).alias("s")).where(f"{group} is not null and o.t is not null and o.entity_id is not null and s is not null")
    rows = rows.groupBy(group, "o").agg(F.min("s").alias("s"))
    steps = neighbour(segment(rows, group, "o", "p3-dated"), group, "o", {"p": "s"}).where("p is not null and p <> s").groupBy("p", "s").count()
    back = steps.select(F.col("s").alias("p"), F.col("p").alias("s"), F.col("count").alias("c2"))
    before = [(r["p"], r["s"]) for r in steps.join(back, ["p", "s"], "left").where("count > coalesce(c2, 0)").select("p", "s").limit(STATES**2 + 1).collect()]
    depth = {x: 0 for e in before for x in e}
    if len(depth) > STATES:
        raise ValueError(f"{state} has more than {STATES} values")
    for _ in depth:
        for a, b in before:
            depth[b] = min(len(depth), max(depth[b], depth[a] + 1))
    spark = entities.sparkSession
    return spark.createDataFrame(sorted(depth.items()), "state string, depth int")


def placed(e: DataFrame) -> DataFrame:
    """Add ``_at`` to (fingerprint, created_at, depth, ...): the moment from which a record's place in its group's order is read; null before all.

    A dated record's is its date. An undated one's is the date of the latest dated record whose state precedes its own; without a state, or with none before it, it has none.
    """
    d = dated(F.col("created_at"))
    latest = e.where(d.isNotNull() & F.col("depth").isNotNull()).groupBy("fingerprint", "depth").agg(F.max(d).alias("t"))
    by = latest.groupBy("fingerprint").agg(F.collect_list(F.struct("depth", "t")).alias("_by"))  # one entry per state
    before = F.array_max(F.transform(F.filter("_by", lambda x: x["depth"] < F.col("depth")), lambda x: x["t"]))
    return e.join(by, "fingerprint", "left").withColumn("_at", F.coalesce(d, before)).drop("_by")


def survivors(entities: DataFrame, profiles: DataFrame, undated: str = "oldest") -> DataFrame:
    """(fingerprint, field_name, entity_id, value): who gives description, source_document and confidence.

    Only fingerprints with two or more records; no row where no record has a usable value. description: the longest after
    trimming; source_document: of the most reliable source (0 without profile or score); confidence: of the newest record with
    one from 0 to 1 (NaN is none). Ties: newer created_at, then smaller entity_id. A created_at that is null or outside
    2000..2029 is older than any other (``undated='oldest'``), or comes right after the latest record whose validation_status precedes its own by the
    learned transitions (``undated='learned'``, see `placed`): newer than that record, of several at one place the one with the later state first. Records repeated with one entity_id count once for the group size; null
    fingerprints form no group; extra columns are ignored.
    """
    e = entities.select("entity_id", "fingerprint", "description", "source_document", "confidence", "created_at", "validation_status").where("fingerprint is not null and entity_id is not null")
    p = profiles.groupBy("source_id").agg(F.max("reliability_score").alias("score")).where("source_id is not null")
    # 240 sources by definition of the data, a few bytes each; Spark checks the size before it broadcasts.
    e = e.withColumn("source_id", F.regexp_replace("source_document", r"_\d+$", "")).join(p, "source_id", "left")
    date = dated(F.col("created_at"))
    if undated == "learned":
        prec = transitions(entities).withColumnRenamed("state", "validation_status")
        e = placed(e.join(F.broadcast(prec), "validation_status", "left"))  # one row per state: at most STATES
    else:
        e = e.withColumn("depth", F.lit(0)).withColumn("_at", date)
    age = F.coalesce(-F.unix_micros(F.to_timestamp("_at")), F.lit(1 << 60))
    late = F.when(date.isNull() & F.col("_at").isNotNull(), -1 - F.col("depth")).when(date.isNull(), -F.coalesce("depth", F.lit(0))).otherwise(F.lit(0))
    text, conf, src = F.col("description"), F.col("confidence"), F.col("source_document")
    place = lambda ok, first, value: F.min(F.when(ok, F.struct(first.alias("a"), age.alias("b"), late.alias("c"), F.col("entity_id").alias("d"), value.alias("e"))))
    g = e.groupBy("fingerprint").agg(
        place(usable_text(text), -F.length(trimmed(text)), trimmed(text)).alias("description"),
        place(src.isNotNull(), -F.coalesce("score", F.lit(0.0)), src).alias("source_document"),
        place(conf.between(0.0, 1.0) & ~F.isnan(conf), F.lit(0), conf.cast("string")).alias("confidence"),
        F.min("entity_id").alias("lo"),
        F.max("entity_id").alias("hi"),
    )
    fields = ("description", "source_document", "confidence")
    rows = g.where("lo < hi").select("fingerprint", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"{f}.d").alias("entity_id"), F.col(f"{f}.e").alias("value")) for f in fields])).alias("x"))
    return rows.select("fingerprint", "x.*").where("entity_id is not null")
