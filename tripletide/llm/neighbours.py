"""Most similar vectors for every vector: a hierarchical k-means tree, searched best bin first.

A tree of unit centroids is fitted on a bounded sample (SAMPLE vectors, for many leaves up to MOST_SAMPLE) and sent to the executors; every vector is routed through it, none
only through the sample. A search keeps a priority queue of branches, always opens the one whose centroid is most similar, and
collects leaves until it has as many as calibration asks for: for a sample of queries the exact neighbours are found by brute
force over all vectors, and leaf visits are widened until the wanted part of them lies in a leaf that one side of
the pair visits. Since every vector is a query, a pair met from either side counts for both.

Leaves lie in buckets of neighbouring leaves; a query is sent once to each bucket that holds a leaf of its list. Leaves follow the density of the
sample, so a dense region has many small ones; a leaf that still holds more than SPLIT vectors gets a tree of its own where it is met, with visits calibrated on its own queries. More than k + 1 exact copies of one vector are cut to k + 1 representatives in the index and
the other copies get the smallest ids of their class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import join_checked, materialize

#: Bound of the sample that the tree is fitted on, rows aimed at per leaf, children of a node, leaves of a bucket, calibration queries.
SAMPLE, LEAF_ROWS, BRANCH, BUCKET_LEAVES, PROBES = 65_536, 1024, 16, 16, 256
#: Sampled vectors per leaf where there are more leaves than SAMPLE serves, up to MOST_SAMPLE; vectors of a leaf above which it is split, queries that calibrate the split.
PER_LEAF, MOST_SAMPLE, SPLIT, OWN_PROBES = 8, 524_288, 8192, 128


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


class Tree:
    """Nodes in arrays: `kids[node]` holds up to BRANCH children (-1: none), `leaf[node]` the number of the leaf or -1."""

    def __init__(self, x: np.ndarray, leaf_size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centre, self.kids, leaf = [np.zeros(x.shape[1], np.float32)], [np.full(BRANCH, -1, np.int32)], [-1]
        todo, n_leaf = [(0, np.arange(len(x)))], 0
        while todo:  # depth first, so that leaf numbers of one branch follow each other
            node, rows = todo.pop()
            k = min(BRANCH, -(-len(rows) // leaf_size))
            parts = self._split(x[rows], k, rng) if k > 1 else []
            if len(parts) < 2:
                leaf[node] = n_leaf
                n_leaf += 1
                continue
            for j, (c, own) in enumerate(parts):
                self.kids[node][j] = len(self.centre)
                todo.append((len(self.centre), rows[own]))
                self.centre.append(c)
                self.kids.append(np.full(BRANCH, -1, np.int32))
                leaf.append(-1)
        self.centre, self.kids, self.leaf = np.array(self.centre), np.array(self.kids), np.array(leaf, np.int32)
        self.n_leaves = n_leaf

    @staticmethod
    def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        c = x[rng.choice(len(x), k, replace=False)].copy()
        for _ in range(8):
            a = (x @ c.T).argmax(1)
            for j in range(k):
                m = x[a == j].sum(0)
                n = np.linalg.norm(m)
                if n > 1e-9:
                    c[j] = m / n
        a = (x @ c.T).argmax(1)
        return [(c[j], np.flatnonzero(a == j)) for j in range(k) if (a == j).any()]

    def search(self, q: np.ndarray, visits: int) -> np.ndarray:
        """Leaves of each query in the order a best-bin-first search meets them: (len(q), visits), -1 past the last."""
        visits = min(visits, self.n_leaves)
        out = np.full((len(q), visits), -1, np.int32)
        for lo in range(0, len(q), 2048):
            self._search(q[lo : lo + 2048], out[lo : lo + 2048])
        return out

    def _search(self, q: np.ndarray, out: np.ndarray) -> None:
        n, visits = out.shape
        queue, node = np.full((n, 4 * BRANCH), -9, np.float32), np.zeros((n, 4 * BRANCH), np.int32)
        queue[:, 0], used = 0, 1
        got, live = np.zeros(n, np.int64), np.arange(n)
        while len(live):
            at = queue[live, :used].argmax(1)
            top, score = node[live, at], queue[live, at]
            queue[live, at] = -9
            is_leaf = self.leaf[top] >= 0
            hit = live[is_leaf & (score > -9)]
            out[hit, got[hit]] = self.leaf[top[is_leaf & (score > -9)]]
            got[hit] += 1
            open_, opened = live[~is_leaf & (score > -9)], top[~is_leaf & (score > -9)]
            if len(open_):
                kids = self.kids[opened]
                s = np.where(kids >= 0, np.einsum("nbd,nd->nb", self.centre[kids], q[open_], optimize=True), -9)
                if used + BRANCH > queue.shape[1]:
                    # Keep what can still be visited: the best entries, at least as many as leaves are wanted.
                    if visits + BRANCH < used and visits < self.n_leaves:
                        keep = np.argsort(-queue[:, :used], axis=1, kind="stable")[:, : visits + BRANCH]
                        m = keep.shape[1]
                        queue[:, :m], node[:, :m] = np.take_along_axis(queue, keep, 1), np.take_along_axis(node, keep, 1)
                        queue[:, m:], used = -9, m
                    if used + BRANCH > queue.shape[1]:
                        queue = np.hstack([queue, np.full((n, 4 * BRANCH), -9, np.float32)])
                        node = np.hstack([node, np.zeros((n, 4 * BRANCH), np.int32)])
                queue[open_, used : used + BRANCH], node[open_, used : used + BRANCH] = s, kids
                used += BRANCH
            live = live[(got[live] < visits) & (score > -9)]


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """List or binary column without nulls to (rows, dim) float32."""
    if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)


def _cos(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b))


def _best(who: np.ndarray, other: np.ndarray, cos: np.ndarray, k: int) -> np.ndarray:
    """Mask of the k best others of each who (ties: smaller other)."""
    order = np.lexsort((other, -cos, who))
    w = who[order]
    first = np.maximum.accumulate(np.where(np.r_[True, w[1:] != w[:-1]], np.arange(len(w)), 0)) if len(w) else np.zeros(0, int)
    out = np.zeros(len(w), bool)
    out[order] = np.arange(len(w)) - first < k
    return out


def valid(vectors: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v): vectors of ``dim`` finite numbers that are not all zero."""
    v = F.col(vec_col).cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col(id_col).isNotNull() & (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(id_col).cast("string").alias("id"), v.alias("v"))


def _sample(v: DataFrame, total: int, bound: int) -> tuple[list[str], pa.Array]:
    """About ``bound`` rows, chosen by the hash of their id."""
    share = min(1.0, bound / max(1, total))
    s = v if share >= 1 else v.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30)))
    t = s.limit(2 * bound).toArrow()
    order = np.argsort(np.array(t.column("id").to_pylist(), dtype=object))
    t = t.take(pa.array(order))
    return t.column("id").to_pylist(), t.column("v").combine_chunks()


def nearest(vectors: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 10, min_cosine: float | None = None, recall: float = 0.99) -> DataFrame:
    """(id, other, cosine): for every valid vector its k most similar others, as far as their cosine is ``min_cosine`` or more.

    Vectors that are null, of another length, with nulls or NaN, or all zero are no vectors here and appear on neither side. Of equally similar
    ones the smaller id comes first; an id is not its own neighbour; rows repeated under one id count once. ``recall`` is what calibration asks for of
    the sampled queries' exact neighbours. Fewer than two vectors give no rows.
    """
    spark = vectors.sparkSession
    v = valid(vectors, id_col, vec_col, dim)
    classes = v.groupBy(F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).agg(F.count("*").alias("n"))
    total, crowded = classes.agg(F.sum("n"), F.count(F.when(F.col("n") > k + 1, 1))).first()
    out_schema = "id string, other string, cosine double"
    if not total or total < 2:
        return spark.createDataFrame([], out_schema)
    copies = None
    if crowded:
        heavy = materialize(classes.where(F.col("n") > k + 1).select("h1", "h2"), "p1-heavy")
        keyed = v.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.hash("v"))
        rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
        heads = join_checked(keyed.select("id", "h1", "h2").distinct(), heavy, ["h1", "h2"]).withColumn("r", rank).where(F.col("r") <= k + 1)
        heads = materialize(heads.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("heads")), "p1-heads")
        keyed = join_checked(keyed, heads, ["h1", "h2"], "left")
        spare = F.col("heads").isNotNull() & (F.col("id") > F.element_at("heads", -1))
        copies = keyed.where(spare).select("id", F.explode(F.slice("heads", 1, k)).alias("other"), F.lit(1.0).alias("cosine")).distinct()
        v = keyed.where(~spare).select("id", "v")

    leaves = max(1, total // LEAF_ROWS)
    ids, sample = _sample(v, total, max(SAMPLE, min(PER_LEAF * leaves, MOST_SAMPLE)))
    x = unit(_matrix(sample, dim))
    leaves = min(leaves, max(1, len(x) // PER_LEAF))
    tree = Tree(x, max(2, -(-len(x) // leaves)))
    probes = np.unique(np.linspace(0, len(x) - 1, min(PROBES, len(x))).astype(int))
    visits = calibrate(v, tree, [ids[i] for i in probes], _matrix(sample, dim)[probes], k, min_cosine, recall) if tree.n_leaves > 1 else 1
    shared = spark.sparkContext.broadcast(tree)  # at most MOST_SAMPLE / PER_LEAF leaves and their ancestors

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            raw = _matrix(b.column(1), dim)
            way = t.search(unit(raw), visits)
            bucket = np.where(way >= 0, way // BUCKET_LEAVES, -1)
            rows, at = [], []
            for j in range(way.shape[1]):  # the first visit of a row to each bucket
                new = (bucket[:, j] >= 0) & ~(bucket[:, :j] == bucket[:, j : j + 1]).any(1)
                rows.append(np.flatnonzero(new))
                at.append(bucket[new, j])
            rows, at = np.concatenate(rows), np.concatenate(at)
            blob = raw.tobytes()
            vec = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * dim * 4).astype(np.int32).tobytes()), pa.py_buffer(blob)])
            # Of a row's leaves only those of the bucket go along: its own, if it lies there, and those it visits, a bit each.
            there, leaf = bucket[rows] == at[:, None], way[rows] % BUCKET_LEAVES
            home, asks = np.where(there[:, 0], leaf[:, 0], -1), np.where(there, 1 << leaf, 0).sum(1)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), b.column(0).take(take), vec.take(take), pa.array(home.astype(np.int16)), pa.array(asks.astype(np.int32))], names=["bucket", "id", "v", "home", "asks"])

    def meet(key: tuple, t: pa.Table) -> pa.Table:
        names = np.array(t.column("id").to_pylist(), dtype=object)
        names, pick = np.unique(names, return_index=True)  # a repeated id counts once; ids are numbered in their order
        raw = _matrix(t.column("v").combine_chunks(), dim)[pick]
        home, visited = t.column("home").to_numpy()[pick], t.column("asks").to_numpy()[pick]
        u = unit(raw)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for leaf in range(BUCKET_LEAVES):
            data, asks = np.flatnonzero(home == leaf), np.flatnonzero(visited >> leaf & 1)
            for q, data in _blocks(u, asks, data, k, recall):
                s = u[q] @ u[data].T
                s[q[:, None] == data[None, :]] = -9
                floor = -8.0 if min_cosine is None else min_cosine - 1e-5
                if len(data) > k and (min_cosine is None or (s >= floor).sum(1).max() > 4 * k):
                    kth = np.partition(s, len(data) - k, axis=1)[:, len(data) - k]
                    mine = s >= np.maximum(kth - 1e-6, floor)[:, None]
                    if len(q) > k:
                        kth = np.partition(s, len(q) - k, axis=0)[len(q) - k]
                        mine |= s >= np.maximum(kth - 1e-6, floor)[None, :]
                else:
                    mine = s >= floor
                i, j = np.nonzero(mine)
                a, b = q[i], data[j]
                c = _cos(raw[a], raw[b])
                keep = _best(a, b, c, k) | _best(b, a, c, k)
                if min_cosine is not None:
                    keep &= c >= min_cosine
                got.append((a[keep], b[keep], c[keep]))
        if got:
            a, b, c = (np.concatenate(z) for z in zip(*got))
            a, b, c = np.r_[a, b], np.r_[b, a], np.r_[c, c]
            _, one = np.unique(a.astype(np.int64) * len(names) + b, return_index=True)
            a, b, c = a[one], b[one], c[one]
            keep = _best(a, b, c, k)
            a, b, c = a[keep], b[keep], c[keep]
        else:
            a = b = np.zeros(0, int)
            c = np.zeros(0)
        return pa.table({"id": pa.array(names[a].tolist(), pa.string()), "other": pa.array(names[b].tolist(), pa.string()), "cosine": pa.array(c)})

    routed = v.mapInArrow(route, "bucket int, id string, v binary, home smallint, asks int")
    met = routed.groupBy("bucket").applyInArrow(meet, out_schema).repartition("id")  # one shuffle for what follows
    order = Window.partitionBy("id").orderBy(F.col("cosine").desc(), "other")
    best = met.dropDuplicates(["id", "other"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    return best if copies is None else best.unionByName(copies)


def _blocks(u: np.ndarray, asks: np.ndarray, data: np.ndarray, k: int, recall: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, vectors) of one leaf to be compared: all with all in blocks, in a leaf of more than SPLIT vectors by a tree of its own.

    Its visits are widened until the wanted part of the nearest vectors that an exhaustive search of the leaf finds for OWN_PROBES of its queries is met.
    """
    parts = [(asks, data)] if len(data) else []
    if len(data) > SPLIT:
        own = Tree(u[data[:: max(1, len(data) // SAMPLE)]], max(2, LEAF_ROWS * min(len(data), SAMPLE) // len(data)))
        home = own.search(u[data], 1)[:, 0]
        some = asks[:: max(1, len(asks) // OWN_PROBES)][:OWN_PROBES]
        s = u[some] @ u[data].T
        s[some[:, None] == data[None, :]] = -9
        want = home[np.argpartition(s, len(data) - k, axis=1)[:, -k:]]
        visits = 1
        while visits < own.n_leaves and (own.search(u[some], visits)[:, None, :] == want[:, :, None]).any(2).mean() < recall:
            visits = min(own.n_leaves, visits * 2)
        way = own.search(u[asks], visits)
        parts = [(asks[(way == leaf).any(1)], data[home == leaf]) for leaf in range(own.n_leaves)]
    for q, d in parts:
        for lo in range(0, len(q) if len(d) else 0, 1024):
            yield q[lo : lo + 1024], d


def exact(v: DataFrame, names: list[str], q: np.ndarray, k: int, min_cosine: float | None) -> pa.Table:
    """(q, id, cosine, v): the k nearest of a bounded number of queries by comparing them with every vector, in blocks."""
    dim = q.shape[1]
    uq = unit(q)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = _matrix(b.column(1), dim)
            s = uq @ unit(raw).T
            kth = np.partition(s, max(0, len(raw) - k - 1), axis=1)[:, max(0, len(raw) - k - 1)]
            i, j = np.nonzero(s >= np.maximum(kth, -8.0 if min_cosine is None else min_cosine)[:, None])
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), b.column(0).take(pa.array(j)), pa.array(_cos(q[i], raw[j])), b.column(1).take(pa.array(j))], names=["q", "id", "cosine", "v"])

    self_ = v.sparkSession.createDataFrame(list(enumerate(names)), "q int, id string")
    near = v.mapInArrow(scan, "q int, id string, cosine double, v array<float>").join(F.broadcast(self_), ["q", "id"], "left_anti")
    order = Window.partitionBy("q").orderBy(F.col("cosine").desc(), "id")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r").toArrow()


def calibrate(v: DataFrame, tree: Tree, names: list[str], q: np.ndarray, k: int, min_cosine: float | None, recall: float) -> int:
    """Leaf visits at which the wanted part of the probes' exact neighbours is met from one side or the other."""
    t = exact(v, names, q, k, min_cosine)
    if not t.num_rows:  # no probe has a neighbour as near as that: the nearest there are
        t = exact(v, names, q, k, None)
    i = t.column("q").to_numpy()
    other = unit(_matrix(t.column("v").combine_chunks(), q.shape[1]))
    wide = min(tree.n_leaves, 64)
    while True:
        there, back = tree.search(unit(q)[i], wide), tree.search(other, wide)
        rank = np.minimum(*(np.where((way == home[:, :1]).any(1), (way == home[:, :1]).argmax(1), wide) for way, home in ((there, back), (back, there))))
        need = int(np.quantile(rank, recall, method="higher")) + 1
        if need <= wide or wide >= tree.n_leaves:
            return max(1, min(need, tree.n_leaves))
        wide = min(tree.n_leaves, wide * 4)


def found(entities: DataFrame, min_cosine: float = 0.85, k: int = 10, dim: int = 64) -> DataFrame:
    """(id_a, id_b), smaller first: pairs of cosine ``min_cosine`` or more, one of them among the k most similar of the other."""
    n = nearest(entities, "entity_id", "embedding", dim, k, min_cosine)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
