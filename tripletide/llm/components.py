"""Consolidating pairwise matches into groups: alternating large-star and small-star edge rewrites.

Each round is two distributed joins. Large-star ties every larger neighbour of a node to the smallest of its
neighbourhood; small-star does the same with the smaller neighbours and the node itself. The rounds end when the set
of edges stays as it is; then every node points at the least identifier of its component. Each round's edges are written to the
shared folder and the round before is deleted, so plans stay short and a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, release


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u").alias("n"), F.col("v").alias("o")).union(e.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = both.groupBy("n").agg(F.min("o").alias("m")).withColumn("m", F.least("m", "n"))
    up = e.select(F.col("v").alias("n"), F.col("u").alias("o"))  # the larger neighbours of n
    return up.join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.col("u").alias("n"), F.col("v").alias("o"))  # the smaller neighbours of n
    least = down.groupBy("n").agg(F.min("o").alias("m"))
    rest = down.join(least, "n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u > v").distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(item, group): every item of a pair with two different items, and the least item of its component.

    Null items and pairs of an item with itself link nothing; repeated and reversed pairs count once; no pairs give no rows.
    """
    e = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct()
    e = materialize(e, "cc")
    mark = _mark(e)
    settled = not mark[0]
    while not settled:  # each round lowers what some node points at, so it ends
        new = materialize(small_star(large_star(e)), "cc")
        new_mark = _mark(new)
        release(e)
        e, settled, mark = new, new_mark == mark, new_mark
    return e.select(F.col("u").alias("item"), F.col("v").alias("group")).union(e.select(F.col("v"), F.col("v")).distinct())


def matches(conflicts: DataFrame, kind: str = "duplicateentity") -> DataFrame:
    """(a, b): pairs of entity ids that the conflict sets of one type link.

    Types are compared by their letters only; ids are brought to 32 hex digits with hyphens, what has none is dropped. The
    items of one set hang on its least item. Sets that are null, empty or of one item link nothing.
    """
    hexes = F.transform("conflicting_items", lambda x: F.right(F.regexp_replace(F.lower(x), r"[^0-9a-f]", ""), F.lit(32)))
    # 'urn:uuid:' leaves one hex letter ('d') before the 32 digits, hence the right end.
    ids = F.array_distinct(F.filter(hexes, lambda x: x.isNotNull() & (F.length(x) == 32)))
    ids = F.transform(ids, lambda x: F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.substring(x, 13, 4), F.substring(x, 17, 4), F.substring(x, 21, 12)))
    s = conflicts.where(F.regexp_replace(F.lower("conflict_type"), r"[^a-z]", "") == kind).select(ids.alias("ids")).where("size(ids) > 1")
    return s.select(F.array_min("ids").alias("a"), F.explode("ids").alias("b")).where("a <> b")


def found(conflicts: DataFrame) -> DataFrame:
    """(item_id, group_id) of the entities that duplicate matches link."""
    return components(matches(conflicts)).select(F.col("item").alias("item_id"), F.col("group").alias("group_id"))
