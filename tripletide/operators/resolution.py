"""Entity resolution: blocked candidates, their similarity, canonical records by merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import cologne_udf, weighted
from ..runtime import join_checked, materialize, release

DUPLICATE, SAME, LIKELY = 0.85, 0.95, 0.85


#: Rarest words of a name by which it is looked up, and letters from which a word also meets others one edit apart.
RAREST, LONG = 2, 5
#: Members of a block, and of these rows, that are compared at once; what rounding may take from a bound.
TILE, ROWS, SLACK = 4096, 512, 1e-4


def members(entities: DataFrame) -> DataFrame:
    """(entity_id, id): the record that stands for each valid named one: of equal lower-case names of one type the least entity_id."""
    e = entities.where("entity_name is not null and entity_id is not null and invalidated_at is null").select("entity_id", F.lower(F.trim("entity_name")).alias("name"), "entity_type").distinct()
    first = e.groupBy("name", "entity_type").agg(F.min("entity_id").alias("id"))
    return e.join(first, (e["name"] == first["name"]) & e["entity_type"].eqNullSafe(first["entity_type"])).select("entity_id", "id")


def _links(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, type, w), the RAREST words of each name, and (type, w, into, y): the blocks that the names of a word go to.

    Names of one word meet in its block (``y`` false). Two words that share a form meet in the block of the one with more names, to which those of the other go as well (``y`` true).
    """
    n = entities.where("entity_name is not null and invalidated_at is null").groupBy(F.lower(F.trim("entity_name")).alias("name"), F.coalesce("entity_type", F.lit("")).alias("type")).agg(F.min("entity_id").alias("id"))
    words = F.array_distinct(F.filter(F.split("name", r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3))
    w = n.where("id is not null").select("id", "type", F.explode(F.when(F.size(words) > 0, words).otherwise(F.array("name"))).alias("w"))
    w = materialize(w, "er-words")
    counted = materialize(w.groupBy("type", "w").agg(F.count("*").alias("n")), "er-counts")
    # A name has few words: the list of one is short.
    rare = w.join(counted, ["type", "w"]).groupBy("id", "type").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", (-F.length("w")).alias("l"), "w"))), 1, RAREST).alias("r"))
    rare = materialize(rare.select("id", "type", F.explode(F.transform("r", lambda x: x["w"])).alias("w")).distinct(), "er-rare")
    release(w)
    release(counted)
    own = materialize(rare.groupBy("type", "w").agg(F.count("*").alias("n")), "er-own")
    cut = F.when(F.length("w") >= LONG, F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring(F.col("w"), F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w"))))).otherwise(F.array())
    f = own.select("type", F.struct("n", "w").alias("x"), F.explode(F.array_distinct(F.concat(cut, F.array("w")))).alias("form"))
    met = f.join(f.withColumnRenamed("x", "z"), ["type", "form"]).where("x < z").select("type", F.col("x.w").alias("w"), F.col("z.w").alias("into")).distinct()
    met = materialize(met, "er-links")
    alone = own.join(met.select("type", F.col("into").alias("w")).distinct().withColumn("led", F.lit(True)), ["type", "w"], "left").where("n > 1 or led").select("type", "w", F.col("w").alias("into"), F.lit(False).alias("y"))
    return rare, alone.unionByName(met.withColumn("y", F.lit(True)))


def candidates(entities: DataFrame, named: DataFrame, limit: float) -> DataFrame:
    """(a, b, name_similarity, embedding_similarity): pairs of different names of one type that share a rare word form, where the names are as alike as they need be.

    ``named`` has (id, name, v, k) of the names. Names are compared once each, however many records carry them (`members`). A name is looked up by its RAREST words, counted over
    all names of the type; a name without a word of three letters by the whole of it. Words of LONG letters and more are looked up without one of their letters, too: two words that
    differ by one edit share such a form. A block is as many tasks as pairs of its tiles; in a tile all pairs are looked at and those that `_may` does not rule out
    are scored, so pairs that only a frequent word brings together are never written.
    """
    rare, into = _links(entities)
    m = materialize(rare.join(into, ["type", "w"]).select("id", "type", "into", "y"), "er-members")
    sizes = materialize(m.groupBy("type", "into").agg(F.ceil(F.count("*") / TILE).cast("int").alias("t")).where("t > 1"), "er-sizes")
    i, j = F.pmod(F.xxhash64("id"), F.coalesce("t", F.lit(1))).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce("t", F.lit(1)) - 1))
    m = join_checked(m, sizes, ["type", "into"], "left").withColumn("i", i).withColumn("j", j)
    unit = F.xxhash64("type", "into", F.least("i", "j"), F.greatest("i", "j"))
    m = m.select("id", "y", F.concat_ws("\0", "type", "into", F.least("i", "j"), F.greatest("i", "j")).alias("unit"), F.when(F.col("i") > F.col("j"), 1).otherwise(0).alias("half"), unit.alias("h"))
    m = m.join(named, "id").select("id", "y", "unit", "half", "name", "v", "k", F.pmod("h", F.lit(max(64, named.count() // 1024))).alias("part"))
    return m.groupBy("part").applyInArrow(lambda t: _met(t, limit), "a string, b string, name_similarity double, embedding_similarity double").distinct()


def _met(t, limit: float):
    """(a, b, name_similarity, embedding_similarity), a before b, of a table of block members, unit by unit: pairs of names as alike as their cosine asks for.

    Sums run in the order of the vectors, as Spark's do. Matching blocks cost most and are only sought where their upper bounds leave the question open.
    """
    from difflib import SequenceMatcher

    import numpy as np
    import pyarrow as pa

    from ..functions.similarity import jaro_winklers, letters, matrix

    unit = t["unit"].combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(unit, kind="stable")
    t, unit = t.take(pa.array(order)), unit[order]
    ids, side, half = (t[c].to_numpy(zero_copy_only=False) for c in ("id", "y", "half"))
    rank = np.unique(ids.astype(str), return_inverse=True)[1]
    side = side.astype(bool)
    v, size = matrix(t["v"])
    along = lambda x, y: sum((x[:, d] * y[:, d] for d in range(x.shape[1])), np.zeros(len(x)))
    with np.errstate(all="ignore"):
        norm = np.sqrt(along(v, v))
        unit_v = np.where(norm[:, None] == 0, 0, v / norm[:, None]).astype(np.float32)
    names = t["name"].to_pylist()
    counts, length, start = letters(names)
    k = np.unique(np.array([x or "" for x in t["k"].to_pylist()]), return_inverse=True)[1]
    sounds = np.array([bool(x) for x in t["k"].to_pylist()])
    out = []
    ends = np.flatnonzero(np.diff(unit, append=-1)) + 1
    for lo, hi in zip(np.r_[0, ends[:-1]], ends):
        for at in range(lo, hi, ROWS):
            x, y = np.s_[at : min(at + ROWS, hi)], np.s_[lo:hi]
            with np.errstate(all="ignore"):
                cos = unit_v[x] @ unit_v[y].T
            # Without two vectors of one size the name alone decides; nan, which Spark holds to be above all numbers, rules nothing out.
            need = np.where((size[x, None] == size[None, y]) & (size[x, None] >= 0), np.where(cos < 0.9 - SLACK, (limit - 0.4 * cos) / 0.6, 0), limit) - SLACK
            # Of two tiles pairs lie across; of y and y, in no tile.
            fits = (need <= 1) & (rank[x, None] < rank[None, y]) if not half[lo:hi].any() else (need <= 1) & (half[x, None] < half[None, y])
            i, j = np.nonzero(fits & ~(side[x, None] & side[None, y]))
            need, i, j = need[i, j], i + at, j + lo
            i, j = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
            short, long = np.minimum(length[i], length[j]), np.maximum(length[i], length[j])
            more = np.where((k[i] == k[j]) & sounds[i], 0.15, 0.0)
            ok = np.flatnonzero((_may(short, short, long, 4) + more >= need) & (rank[i] != rank[j]))
            for c in range(0, len(ok), 1 << 16):
                o = ok[c : c + (1 << 16)]
                p, q = i[o], j[o]
                same = np.cumprod((start[p] == start[q]) & (start[p] >= 0), axis=1).sum(axis=1)
                met = np.minimum(counts[p], counts[q]).sum(axis=1)
                left = _may(met, short[o], long[o], same) + more[o] >= need[o]
                o, p, q, met = o[left], p[left], q[left], met[left]
                both = (size[p] == size[q]) & (size[p] >= 0)
                with np.errstate(all="ignore"):
                    exact = along(v[p], v[q]) / (norm[p] * norm[q])
                exact = np.where(both, np.where(norm[p] * norm[q] == 0, 0.0, exact), 0.0)
                wanted = np.where(both, np.where((exact >= 0.9) | np.isnan(exact), 0.0, (limit - 0.4 * exact) / 0.6), limit) - 1e-9
                s, extra = jaro_winklers([names[n] for n in p], [names[n] for n in q]), more[o]
                most = 2 * met / np.maximum(length[p] + length[q], 1) + 1e-9
                for n in np.flatnonzero((s < 1) & (most > s) & (most + extra >= wanted)):
                    blocks = SequenceMatcher(None, names[p[n]], names[q[n]])
                    if blocks.real_quick_ratio() > s[n] and (best := blocks.quick_ratio()) > s[n] and best + extra[n] >= wanted[n]:
                        s[n] = max(s[n], blocks.ratio())
                s = np.minimum(1.0, s + extra)
                kept = (s >= wanted) & (wanted <= 1)
                out.append((ids[p[kept]], ids[q[kept]], s[kept], exact[kept], ~both[kept]))
    a, b, s, exact, bare = (np.concatenate(x) for x in zip(*out)) if out else (np.array([], t) for t in (object, object, float, float, bool))
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "name_similarity": pa.array(s, pa.float64()), "embedding_similarity": pa.array(exact, pa.float64(), mask=bare)})


def _may(met, short, long, same):
    """Most that the names' similarity can be, without their sound, where ``met`` letters at most meet and ``same`` first ones do: the bounds of Jaro-Winkler and of matching blocks."""
    import numpy as np

    met, short, long = (np.asarray(x, float) for x in (met, short, long))
    jaro = (met / np.maximum(short, 1) + met / np.maximum(long, 1) + 1) / 3
    return np.maximum(2 * met / np.maximum(short + long, 1), jaro + 0.1 * same * (1 - jaro))


def resolve(entities: DataFrame, limit: float = DUPLICATE) -> DataFrame:
    """(a, b, name_similarity, embedding_similarity, similarity, strategy): candidate pairs alike enough, of the records that stand for their names (`members`).

    Alike: .6 name + .4 embedding of ``limit`` or more, or a cosine of .9; without both embeddings the name alone decides. A name's embedding is that of its first record
    with one. strategy: ``keep`` from .95, ``merge`` from .85, else ``link``. The cosine is known first and says how alike the names must be, so few names are scored.
    """
    e = entities.where("entity_name is not null and invalidated_at is null").groupBy(F.lower(F.trim("entity_name")).alias("name"), "entity_type")
    e = e.agg(F.min("entity_id").alias("id"), F.min_by("embedding", F.when(F.size("embedding") > 0, F.col("entity_id"))).alias("v"))
    e = materialize(e.select("id", "name", "v", cologne_udf("name").alias("k")), "er-names")
    p = candidates(entities, e, limit)
    sim = F.when(F.col("embedding_similarity").isNull(), F.col("name_similarity")).otherwise(weighted(F.col("name_similarity"), F.col("embedding_similarity")))
    p = p.withColumn("similarity", sim).where((F.col("similarity") >= limit) | (F.col("embedding_similarity") >= 0.9))
    strategy = F.when(F.col("similarity") >= SAME, "keep").when(F.col("similarity") >= LIKELY, "merge").otherwise("link")
    r = lambda c: F.round(c, 6).alias(c)
    return p.select("a", "b", r("name_similarity"), r("embedding_similarity"), r("similarity"), strategy.alias("strategy"))


def top_candidates(resolved: DataFrame, k: int = 3) -> DataFrame:
    """(entity_id, candidate, similarity, rank): the best ``k`` of each entity, from either side of the pairs."""
    from pyspark.sql import Window

    both = resolved.select(F.col("a").alias("entity_id"), F.col("b").alias("candidate"), "similarity").union(resolved.select("b", "a", "similarity"))
    w = Window.partitionBy("entity_id").orderBy(F.col("similarity").desc(), "candidate")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def merge(entities: DataFrame, by: str = "fingerprint") -> DataFrame:
    """One record per group: the longest name (of equals the first), all aliases and other names, properties of the latest record, highest confidence,
    widest validity, earliest creation; the id of the most confident record. All parts but the aliases are maxima, combined before the shuffle."""
    e = entities.where(F.col(by).isNotNull())
    longest = F.min(F.struct((-F.length("entity_name")).alias("l"), F.col("entity_name").alias("n")))
    conf = F.coalesce("confidence", F.lit(-1.0))
    base = F.min(F.struct((-conf).alias("c"), F.col("entity_id").alias("i")))
    names = e.select(by, F.explode(F.concat(F.array("entity_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("n")).where("n is not null").distinct()
    a = names.groupBy(by).agg(F.array_sort(F.collect_list("n")).alias("names"))
    g = e.groupBy(by).agg(longest.alias("l"), base.alias("b"), F.max("confidence").alias("confidence"), F.min("valid_from").alias("valid_from"), F.max("valid_until").alias("valid_until"), F.min("created_at").alias("created_at"), F.count("*").alias("n_records"))
    j = g.join(a, by)
    return j.select(by, F.col("b.i").alias("entity_id"), F.col("l.n").alias("entity_name"), F.array_remove("names", F.col("l.n")).alias("aliases"), "confidence", "valid_from", "valid_until", "created_at", "n_records")


def contradictory(batch: DataFrame, edges: DataFrame, ruled: list[str]) -> DataFrame:
    """(seq, severity): the subject has the relation, one with a cardinality rule, with an object of another name."""
    e = edges.where(F.col("pred").isin(*ruled)).groupBy("s_id", "pred").agg(F.min(F.lower("o_name")).alias("lo"), F.max(F.lower("o_name")).alias("hi"))
    o = F.lower("o_name")
    return batch.join(e, ["s_id", "pred"]).where((F.col("lo") != o) | (F.col("hi") != o)).select("seq", F.lit(0.8).alias("severity"))


def combine(a: Column, b: Column, method: str = "weighted_avg", wa: float = 0.6, wb: float = 0.4) -> Column:
    """Two confidences as one: multiply, min, weighted_avg or bayesian (even prior; certain and impossible together give null); an unknown method is weighted_avg."""
    if method == "multiply":
        return a * b
    if method == "min":
        return F.least(a, b)
    if method == "bayesian":
        return F.try_divide(a * b, a * b + (1 - a) * (1 - b))
    return (wa * a + wb * b) / (wa + wb)
