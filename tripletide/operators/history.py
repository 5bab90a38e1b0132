"""History of changing attributes: a bitemporal ledger, and versions read from it.

A statement speaks about an item from a moment on (valid time) and arrives at another (recorded time). What is known at a recorded moment is
a row of intervals: each moment spoken about holds until the next one. A late statement about a moment inside an interval splits it;
a statement about a moment already spoken about replaces what was said. Neither overwrites: the row before is closed in recorded time and new ones begin.
The ledger holds all these rectangles, at most two per statement; those not closed are today's history, from which the versions are made.

Which interval a statement splits is found in a sweep over valid time: the nearest moment before it, and the nearest after it, that had arrived
by then. An item may hold a large part of all rows, so rows are cut by range into segments of (item, moment). A sweep with a stack settles what
lies in one segment; for the rest the least arrival of each segment tells in which other one the answer lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, stored_bytes

#: Stored bytes of a segment aimed at.
SEGMENT_BYTES = 32 << 20


def segments(df: DataFrame) -> int:
    """How many segments to cut a table into: as many as the session's shuffles have, more where its stored size (from `materialize`) asks for them."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(n, stored_bytes(df) // SEGMENT_BYTES) if hasattr(df, "_tide_path") else n


def segment(df: DataFrame, key: str, order: str, label: str = "seg", n: int | None = None) -> DataFrame:
    """Range-partition by (key, order), into ``n`` segments or as many as the size asks for, and keep the segment number in ``_seg``; written, so that the numbers stay."""
    return materialize(df.repartitionByRange(n or segments(df), key, order).withColumn("_seg", F.spark_partition_id()), label)


def neighbour(df: DataFrame, key: str, order: str, cols: dict[str, str], back: bool = True) -> DataFrame:
    """Add, from the previous (``back``) or next row of the key in ``order``, columns {new name: old name}.

    ``df`` comes from `segment`; the pair (key, order) is unique. A column ``_has`` tells whether there is such a row.
    """
    w = Window.partitionBy(key, "_seg").orderBy(order)
    shift = F.lag if back else F.lead
    here = df.withColumn("_n", shift(F.struct(*[F.col(c).alias(n) for n, c in cols.items()])).over(w))
    edge = (F.max_by if back else F.min_by)(F.struct(*[F.col(c).alias(n) for n, c in cols.items()]), F.col(order))
    edges = df.groupBy(key, "_seg").agg(edge.alias("_e"))
    edges = edges.withColumn("_b", shift("_e").over(Window.partitionBy(key).orderBy("_seg"))).select(key, "_seg", "_b")
    # Only keys that cross a border have a neighbour there: at most one row per border.
    out = here.join(edges.where("_b is not null"), [key, "_seg"], "left")
    got = F.coalesce("_n", "_b")
    return out.select(*df.columns, got.isNotNull().alias("_has"), *[got[n].alias(n) for n in cols])


def following(df: DataFrame, key: str, order: str, cols: dict[str, str], ring: bool = False, label: str = "ring") -> DataFrame:
    """Add, from the next row of the key in ``order``, columns {new name: old name}; the last row gets null, or with ``ring`` the first one's."""
    s = segment(df, key, order, label)
    out = neighbour(s, key, order, cols, back=False).drop("_seg", "_has") if not ring else neighbour(s, key, order, cols, back=False).drop("_seg")
    if not ring:
        return out
    first = s.groupBy(F.col(key).alias("_fk")).agg(F.min_by(F.struct(*[F.col(c).alias(n) for n, c in cols.items()]), order).alias("_f"))
    out = out.join(first, F.col(key).eqNullSafe(F.col("_fk")))
    return out.select(*df.columns, *[F.when(F.col("_has"), F.col(n)).otherwise(F.col(f"_f.{n}")).alias(n) for n in cols])


def running(df: DataFrame, key: str, order: str, sums: dict[str, Column]) -> DataFrame:
    """Add running sums {new name: of what} over the key's rows up to and with each one, in ``order``. ``df`` comes from `segment`."""
    w = Window.partitionBy(key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = df.withColumns({c: F.sum(x).over(w) for c, x in sums.items()})
    parts = df.groupBy(key, "_seg").agg(*[F.sum(x).alias(f"_s_{c}") for c, x in sums.items()])
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(key).alias("_k"), F.col("_seg").alias("_s"), *[F.sum(f"_s_{c}").over(before).alias(f"_b_{c}") for c in sums], F.min("_seg").over(Window.partitionBy(key)).alias("_f")).where("_s > _f")
    out = here.join(parts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_seg") == F.col("_s")), "left")
    return out.select(*df.columns, *[(F.col(c) + F.coalesce(f"_b_{c}", F.lit(0))).alias(c) for c in sums])


def carried(df: DataFrame, key: str, order: str, cols: tuple[str, ...]) -> DataFrame:
    """Fill nulls of ``cols`` with the last value before them in the key's ``order``. ``df`` comes from `segment`."""
    w = Window.partitionBy(key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    here = df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})
    edges = df.groupBy(key, "_seg").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_e_{c}") for c in cols])
    before = Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(key, "_seg", *[F.last(f"_e_{c}", ignorenulls=True).over(before).alias(f"_b_{c}") for c in cols], F.min("_seg").over(Window.partitionBy(key)).alias("_s")).where("_seg > _s").drop("_s")
    out = here.join(edges, [key, "_seg"], "left")
    return out.select(*[F.coalesce(c, f"_b_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots of one segment, sorted by (item, v): ``before`` and ``after`` are the nearest v on either side that arrived earlier."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    item, v, *came = (t.column(c).to_pylist() if c == "item_id" else t.column(c).cast(pa.int64()).to_pylist() for c in ("item_id", "v", "r", "u", "h"))
    came = [tuple(-(1 << 63) - 1 if y is None else y for y in x) for x in zip(*came, v)]  # nulls first, as Spark orders them
    before, after, stack = [None] * len(v), [None] * len(v), []
    for i, x in enumerate(came):
        if i and item[i] != item[i - 1]:
            stack.clear()
        while stack and came[stack[-1]] > x:
            after[stack.pop()] = v[i]
        before[i] = v[stack[-1]] if stack else None
        stack.append(i)
    moments = [pa.array(x, pa.int64()).cast(t.schema.field("v").type) for x in (before, after)]
    cols = [*t.columns, *moments, pa.array([TaskContext.get().partitionId()] * len(v), pa.int32())]
    yield from pa.table(cols, names=[*t.column_names, "before", "after", "_seg"]).to_batches(20_000)


def places(slots: DataFrame) -> DataFrame:
    """``before`` and ``after`` for (item_id, v, r, u, h): the nearest v of the item below and above that arrived earlier, in the order of (r, u, h)."""
    kind = dict(slots.dtypes)
    place = f"item_id {kind['item_id']}, v {kind['v']}, r {kind['r']}, u {kind['u']}, h bigint, before {kind['v']}, after {kind['v']}, _seg int"
    s = slots.select("item_id", "v", "r", "u", "h").repartitionByRange(segments(slots), "item_id", "v").sortWithinPartitions("item_id", "v")
    s = materialize(s.mapInArrow(_sweep, place), "p7-places")
    came = F.struct("r", "u", "h", "v")
    # Least arrivals by segment, of items that cross a border: as many as there are borders.
    least = s.groupBy("item_id", "_seg").agg(F.min(came).alias("m")).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("_seg", "m"))).alias("ms")).where("size(ms) > 1")
    x = s.where("before is null or after is null").join(least, "item_id")
    x = x.withColumn("came", came)
    left = F.filter("ms", lambda m: (m["_seg"] < F.col("_seg")) & (m["m"] < F.col("came")))
    right = F.filter("ms", lambda m: (m["_seg"] > F.col("_seg")) & (m["m"] < F.col("came")))
    asks = x.select("item_id", "v", "came", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.when(F.col("before").isNull(), F.try_element_at(left, F.lit(-1))["_seg"]).alias("to")), F.struct(F.lit("r").alias("side"), F.when(F.col("after").isNull(), F.try_element_at(right, F.lit(1))["_seg"]).alias("to")))).alias("a"))
    asks = asks.where("a.to is not null").select(F.struct("item_id", F.col("a.to").alias("seg"), F.col("a.side").alias("side")).alias("k"), "came", F.col("v").alias("asks"), F.lit(None).cast(kind["v"]).alias("says"))
    # In that segment only rows that nothing earlier follows (or, to the right, precedes) can answer: the one that came last before the asker.
    says = s.join(least.select("item_id"), "item_id", "left_semi").withColumn("came", came)
    says = says.select("item_id", "_seg", "came", "v", F.explode(F.array(F.when(F.col("after").isNull(), "l"), F.when(F.col("before").isNull(), "r"))).alias("side")).where("side is not null")
    says = says.select(F.struct("item_id", F.col("_seg").alias("seg"), "side").alias("k"), "came", F.lit(None).cast(kind["v"]).alias("asks"), F.col("v").alias("says"))
    got = carried(segment(asks.unionByName(says), "k", "came", "p7-asks"), "k", "came", ("says",)).where("asks is not null")
    got = got.groupBy(F.col("k.item_id").alias("item_id"), F.col("asks").alias("v")).agg(F.max(F.when(F.col("k.side") == "l", F.col("says"))).alias("_l"), F.max(F.when(F.col("k.side") == "r", F.col("says"))).alias("_r"))
    return s.join(got, ["item_id", "v"], "left").select("item_id", "v", "r", "u", "h", F.coalesce("before", "_l").alias("before"), F.coalesce("after", "_r").alias("after"))


def ledger(updates: DataFrame) -> DataFrame:
    """All rows of ``updates`` as rectangles: with valid_until, recorded_from, recorded_until and ``current``; columns so named get ``stated_`` before their name.

    A row says what was known of the item from valid_from to valid_until (null: open) while recorded time went from recorded_from
    to recorded_until (null: still). valid_until is the next moment spoken about, as known then, or an earlier invalidated_at; a late
    statement closes the row whose interval it splits and leaves two. Rows of no recorded duration, of statements recorded at one moment, are left out; of
    those about one moment the larger update_id counts. Rows delivered again (equal in all columns) count once. A row with null item_id or valid_from
    speaks of nothing and is left out; a null recorded_at counts as earliest. An empty table gives no rows.
    """
    u = updates.where("item_id is not null and valid_from is not null").distinct()
    u = u.select("item_id", F.col("valid_from").alias("v"), F.col("recorded_at").alias("r"), F.col("update_id").alias("u"), F.xxhash64(*u.columns).alias("h"), F.struct(*updates.columns).alias("says"))
    u = materialize(u, "p7-statements")
    p = materialize(places(u.groupBy("item_id", "v").agg(F.min(F.struct("r", "u", "h")).alias("a")).select("item_id", "v", "a.*")), "p7-slots")
    # What happens to a moment's row: it begins, is said anew, is split by a later arrival.
    order = lambda nth: F.struct("r", "u", "h", F.lit(nth).alias("nth")).alias("o")
    key, to = F.struct("item_id", "v").alias("k"), lambda c: F.struct(F.col(c).alias("to")).alias("until")
    starts = p.select(key, order(0), F.lit(None).alias("says"), to("after"))
    splits = p.where("before is not null").select(F.struct("item_id", F.col("before").alias("v")).alias("k"), order(2), F.lit(None).alias("says"), to("v"))
    said = u.select(key, order(1), "says", F.lit(None).alias("until"))
    events = segment(said.union(starts).union(splits), "k", "o", "p7-events", 2 * segments(u))
    rows = neighbour(carried(events, "k", "o", ("says", "until")), "k", "o", {"_next": "o"}, back=False)
    rows = rows.where(~F.col("_has") | ~F.col("_next.r").eqNullSafe(F.col("o.r")))
    own = {"valid_until": F.least("until.to", "says.invalidated_at"), "recorded_from": F.col("o.r"), "recorded_until": F.col("_next.r"), "current": ~F.col("_has")}
    return rows.select(*[F.col("says")[c].alias(f"stated_{c}" if c in own else c) for c in updates.columns], *[x.alias(c) for c, x in own.items()])


def versions(updates: DataFrame, attributes: tuple[str, ...] = ("item_name", "description", "validation_status")) -> DataFrame:
    """(item_id, period_from, period_until, attributes): one row per version of each item.

    They are made from the rows of the `ledger` that are not closed: per item and valid_from the statement recorded last. A version begins at an item's first statement, where an
    attribute differs from the statement before (null is a value) and after a statement with invalidated_at; it ends at the
    invalidated_at of its last statement, else where the next begins, else it is open (null). Statements without
    item_id or valid_from are left out; an empty table gives no rows.
    """
    kept = ["invalidated_at", *attributes]
    cur = ledger(updates.select("update_id", "item_id", "recorded_at", "valid_from", *kept)).where("current").select("item_id", "valid_from", *kept)
    cur = segment(cur, "item_id", "valid_from", "p7-current")
    seen = neighbour(cur, "item_id", "valid_from", {f"_p_{c}": c for c in kept})
    changed: Column = ~F.col("_has") | F.col("_p_invalidated_at").isNotNull()
    for c in attributes:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    starts = seen.where(changed).select("item_id", "valid_from", "_seg", *attributes, F.col("_p_invalidated_at").alias("_before"))
    # A row past the end of each item carries what its last statement says.
    end = F.to_timestamp_ntz(F.lit("9999-12-31 23:59:59")) if dict(updates.dtypes)["valid_from"] == "timestamp_ntz" else F.to_timestamp(F.lit("9999-12-31 23:59:59"))
    last = cur.groupBy("item_id").agg(F.max_by("invalidated_at", "valid_from").alias("_before"), F.max("_seg").alias("_seg"))
    last = last.select("item_id", end.alias("valid_from"), "_seg", *[F.lit(None).cast("string").alias(c) for c in attributes], "_before")
    marks = neighbour(starts.unionByName(last), "item_id", "valid_from", {"_next": "valid_from", "_inv": "_before"}, back=False)
    until = F.coalesce("_inv", F.when(F.col("_next") < end, F.col("_next")))
    return marks.where(F.col("_has")).select("item_id", F.col("valid_from").alias("period_from"), until.alias("period_until"), *attributes)


def found(updates: DataFrame) -> DataFrame:
    """`versions` with its times as text cut to seconds; an open end is the empty string."""
    v = versions(updates)
    t = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return v.select("item_id", t("period_from").alias("period_from"), F.coalesce(t("period_until"), F.lit("")).alias("period_until"))
