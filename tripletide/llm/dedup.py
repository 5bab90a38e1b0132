"""New batches of facts against all history: navigable small-world graphs in stored shards, exact reranking.

Rows that state one fact in one canonical writing (`names.read_any` for both things, the catalogue's number for the relation) are one
node, with the earliest accepted row behind it. Nodes that can mean one fact agree in the relation and in the kinds of both things: these make
a segment. A segment of more than CELL nodes is cut into blocks by what stands beside the cores (given names, sectors, numbers), which `same` compares too, so a query asks only the blocks where it can mean
something and loses none. A block of more than CELL nodes is cut into cells by a coarse tree (as in `neighbours`), of which a query visits as many as calibration asks for.
However many nodes or queries a cell has, a task holds SHARD of its nodes and ASKED of its queries at once.
A node's vector hashes the letters' triples of both names.

An `Index` keeps, in the shared folder, the shards of each cell: at most SHARD nodes and their small-world graph, in which every node is linked to its nearest ones,
to nodes that have it among theirs, and to a few at random. `append` writes the history's shards once. `add` takes new batches: it walks the stored graphs, which it reads and never
builds again, and lets each batch become a new shard that later batches are held against too; shards of batches are merged as in a binary counter, so a query meets the history and at
most a logarithm of the number of batches. What is left of them is stored, and `compact` merges stored shards when there are many.
A graph's beam is widened until walks agree with an exhaustive search of the shard for sampled facts with typing errors; where none does, the shard is compared whole. Exact repeats meet by equality. What a walk meets is reranked exactly:
by comparing relation, names and numbers, not vectors.
"""

from __future__ import annotations

import ctypes
import json
import random
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import blank, join_checked, materialize, tables_dir
from .canonical import match
from .names import GIVEN, THING_WORDS, edits, forget, read_any, same
from .neighbours import Tree, unit

#: Numbers per name in a vector.
NAME_DIM = 48
DIM = 2 * NAME_DIM
#: Nodes per cell aimed at and per shard at most; nodes of a leaf in which a node's links are looked for; links per node; entry points.
CELL, SHARD, LEAF, LINKS, RANDOM_LINKS, ENTRIES = 65_536, 65_536, 512, 16, 4, 64
#: One node in so many is a place to enter a graph; shards up to WHOLE nodes need none and are compared whole.
UPPER, WHOLE = 4, 4096
#: Similarity of all nodes kept from which a walk may have lost some and the shard is compared whole, similarity from which a walk opens a node in any case, and nodes that a walk keeps.
LEAST, NEAR, KEEP = 0.62, 0.76, 32
#: Pairs of facts compared at once where all are.
BLOCK = 1 << 20
#: Cells that calibration looks at first, and more where they do not hold enough; facts of a shard that its beam is tuned on.
MOST, TUNED = 8, 256
#: Nodes that the trees of all segments are fitted on, and probes for the cells to visit.
SAMPLE, PROBES = 262_144, 1500
#: Stored tables of batches' shards from which `add` compacts.
MERGE_AT = 8
#: Queries of a cell that are held at once; parts, for each side, that a segment is cut into at most; facts that are routed at once.
ASKED, PARTS, ROUTED = 16_384, 32, 2048
#: Rows with a whole shard or its queries are large: the writer looks at the size after each, a reader takes one row group of them.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

_code: dict[str, int] = {}


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _trim = None


def _tidy() -> None:
    """Give freed memory back: Python workers stay, and what one keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _hash(g: str) -> int:
    c = _code.get(g)
    if c is None:
        if len(_code) > 100_000:
            _code.clear()
        c = _code[g] = zlib.crc32(g.encode())
    return c


@lru_cache(20_000)
def _features(kind: str, core: str, extra: str) -> list[int]:
    if kind == "X":
        w = core.split(" ")
        own = [x for x in w if x not in THING_WORDS] or w
        codes = [_hash(f"#{extra}")] * 3 if extra else []
        text = "^" + "^".join(own) + "$"
    else:
        codes, text = [], f"^{core}$"
    codes.extend(_hash(text[i : i + 3]) for i in range(len(text) - 2))
    return codes


def vectors(facts: list[tuple]) -> np.ndarray:
    """Unit vectors of facts (s kind, s core, s given, relation, o kind, o core, o given); the relation is no part of them."""
    out = np.zeros((len(facts), DIM), np.float32)
    for lo in range(0, len(facts), 4096):  # what lies between is many times as large
        out[lo : lo + 4096] = _vectors(facts[lo : lo + 4096])
    return out


def _vectors(facts: list[tuple]) -> np.ndarray:
    out = np.zeros((len(facts), DIM), np.float32)
    for part in (0, 4):
        rows, codes = [], []
        for f in facts:
            c = _features(f[part], f[part + 1], f[part + 2])
            rows.append(len(c))
            codes.extend(c)
        code = np.array(codes, dtype=np.int64)
        at = np.repeat(np.arange(len(facts)), rows) * NAME_DIM + code % NAME_DIM
        v = np.bincount(at, weights=np.where(code >> 20 & 1, 1.0, -1.0), minlength=len(facts) * NAME_DIM).reshape(-1, NAME_DIM)
        lo = 0 if part == 0 else NAME_DIM
        out[:, lo : lo + NAME_DIM] = unit(v) / np.sqrt(2)
    return unit(out)


class Graph:
    """A navigable small-world graph over the unit vectors of one shard."""

    def __init__(self, x: np.ndarray, rng: np.random.Generator | None, stored: bytes | None = None):
        """Built with ``rng``, or from what `dump` gave."""
        self.x, n = x, len(x)
        self.links, self.beam = None, None
        if rng is None:
            if stored:
                self.beam, k = np.frombuffer(stored, np.int32, 2).tolist()
                self.entries, self.links = np.frombuffer(stored, np.int32, k, 8), np.frombuffer(stored, np.uint16 if n <= 1 << 16 else np.int32, offset=4 * (k + 2)).reshape(n, -1).astype(np.int32)
                self.upper = np.ascontiguousarray(x[self.entries])
            return
        if n <= WHOLE:  # a walk would see much of it at a higher price
            return
        near = self._near(x, rng)
        # Links back: the first LINKS nodes that chose a node, so that none is out of reach.
        to, frm = near.ravel(), np.repeat(np.arange(n, dtype=np.int32), LINKS)
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        pos = np.arange(len(to)) - np.searchsorted(to, to)
        back = rng.integers(0, n, (n, LINKS), dtype=np.int32)
        few = pos < LINKS
        back[to[few], pos[few]] = frm[few]
        links = np.sort(np.hstack([near, back, rng.integers(0, n, (n, RANDOM_LINKS), dtype=np.int32)]), axis=1)
        links[:, 1:][links[:, 1:] == links[:, :-1]] = -1
        self.links = np.where(links < 0, np.arange(n, dtype=np.int32)[:, None], links)  # a link to itself is seen already
        self.entries = np.sort(rng.choice(n, max(ENTRIES, n // UPPER), replace=False)).astype(np.int32)
        self.upper = np.ascontiguousarray(x[self.entries])

    def dump(self) -> bytes | None:
        """The beam, entry points and links, for storage."""
        if self.links is None:
            return None
        head = np.r_[self.beam or len(self.x), len(self.entries), self.entries].astype(np.int32)
        return head.tobytes() + self.links.astype(np.uint16 if len(self.x) <= 1 << 16 else np.int32).tobytes()

    @staticmethod
    def _near(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """LINKS similar nodes of each node: the most similar ones of all, in large shards of the three leaves next to it."""
        n = len(x)
        if n <= 2 * LEAF:
            near = np.empty((n, LINKS), np.int32)
            for lo in range(0, n, 1024):
                s = x[lo : lo + 1024] @ x.T
                s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -9
                near[lo : lo + 1024] = np.argpartition(s, n - LINKS, axis=1)[:, n - LINKS :]
            return near
        tree = Tree(x, LEAF, int(rng.integers(1 << 30)))
        way = tree.search(x, 3)
        node, sim = np.zeros((n, 3 * LINKS), np.int32), np.full((n, 3 * LINKS), -9, np.float32)
        order = np.argsort(way[:, 0], kind="stable")
        starts = np.searchsorted(way[order, 0], np.arange(tree.n_leaves + 1))
        for j in range(way.shape[1]):
            at = np.argsort(way[:, j], kind="stable")
            cut = np.searchsorted(way[at, j], np.arange(tree.n_leaves + 1))
            for leaf in range(tree.n_leaves):
                own, asks = order[starts[leaf] : starts[leaf + 1]], at[cut[leaf] : cut[leaf + 1]]
                k = min(LINKS, len(own))
                if not k:
                    continue
                for lo in range(0, len(asks), 2048):
                    rows = asks[lo : lo + 2048]
                    s = x[rows] @ x[own].T
                    if j == 0:
                        s[rows[:, None] == own[None, :]] = -9
                    top = np.argpartition(s, len(own) - k, axis=1)[:, len(own) - k :]
                    node[rows, j * LINKS : j * LINKS + k] = own[top]
                    sim[rows, j * LINKS : j * LINKS + k] = np.take_along_axis(s, top, 1)
        best = np.argpartition(sim, 2 * LINKS, axis=1)[:, 2 * LINKS :]
        out = np.take_along_axis(node, best, 1)
        return np.where(np.take_along_axis(sim, best, 1) > -9, out, rng.integers(0, n, out.shape, dtype=np.int32))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities) of up to KEEP nodes met for each query; -1 pads.

        ``beam``: a walk goes on while one of the ``beam`` best nodes, or any of NEAR or more, is not yet opened.
        """
        k, n = min(KEEP, len(self.x)), len(self.x)
        node, sim = np.full((len(q), k), -1, np.int32), np.full((len(q), k), -9, np.float32)
        for lo in range(0, len(q), 512):
            part = q[lo : lo + 512]
            if self.links is None or beam >= n:
                s = part @ self.x.T
                top = np.argpartition(s, n - k, axis=1)[:, n - k :]
                node[lo : lo + 512], sim[lo : lo + 512] = top, np.take_along_axis(s, top, 1)
            else:
                self._walk(part, beam, node[lo : lo + 512], sim[lo : lo + 512])
        return node, sim

    def _walk(self, q: np.ndarray, beam: int, node: np.ndarray, sim: np.ndarray) -> None:
        m, k = node.shape
        seen = np.zeros((m, len(self.x)), bool)
        s = q @ self.upper.T
        first = min(k, max(8, beam))
        top = np.argpartition(s, s.shape[1] - first, axis=1)[:, -first:]
        node[:, :first], sim[:, :first] = self.entries[top], np.take_along_axis(s, top, 1)
        np.put_along_axis(seen, self.entries[top], True, 1)
        open_ = np.zeros((m, k), bool)
        open_[:, :first] = True
        # The walks that still go on, with their state side by side.
        live, ls, ln, lo_, lq, lseen = np.arange(m), sim.copy(), node.copy(), open_, q, seen
        while len(live):
            at = np.where(lo_, ls, -9).argmax(1)
            row = np.arange(len(live))
            best = ls[row, at]
            go = lo_[row, at] & ((best >= NEAR) | ((ls > best[:, None]).sum(1) < beam))
            if not go.all():
                done = live[~go]
                node[done], sim[done] = ln[~go], ls[~go]
                live, ls, ln, lo_, lq, at = live[go], ls[go], ln[go], lo_[go], lq[go], at[go]
                if not len(live):
                    return
                row = np.arange(len(live))
            lo_[row, at] = False
            out = self.links[ln[row, at]]
            fresh = ~lseen[live[:, None], out]
            lseen[live[:, None], out] = True
            v = np.einsum("nld,nd->nl", self.x[out], lq)
            v[~fresh] = -9
            all_s, all_n, all_o = np.hstack([ls, v]), np.hstack([ln, out]), np.hstack([lo_, fresh])
            keep = np.argpartition(all_s, all_s.shape[1] - k, axis=1)[:, -k:]
            flat = keep + row[:, None] * all_s.shape[1]
            ls, ln, lo_ = all_s.ravel()[flat], all_n.ravel()[flat], all_o.ravel()[flat]

    def meet(self, q: np.ndarray, beam: int, whole=None) -> tuple[np.ndarray, np.ndarray]:
        """(i, node): nodes met for query i; all that ``whole(queries)`` gives where the shard is compared whole or the nodes that a walk keeps do not hold them.

        Without ``whole`` nodes of LEAST or more are wanted, else whatever a walk keeps is met.
        """
        n, rest = len(self.x), np.arange(len(q))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if self.links is not None and beam < n:
            node, sim = self.search(q, beam)
            crowded = (sim >= LEAST).all(1)
            i, j = np.nonzero((sim >= (-8 if whole else LEAST)) & ~crowded[:, None])
            out.append((i, node[i, j].astype(np.int64)))
            rest = np.flatnonzero(crowded)
        if whole and len(rest):
            i, j = whole(rest)
            out.append((rest[i], j))
        elif not whole:
            for lo in range(0, len(rest), 512):
                i, j = np.nonzero(q[rest[lo : lo + 512]] @ self.x.T >= LEAST)
                out.append((rest[lo + i], j))
        return tuple(np.concatenate(z) for z in zip(*out))

    def tune(self, q: np.ndarray, want: np.ndarray, recall: float) -> int:
        """The beam, widened until walks from ``q`` find the wanted part of ``want``, one node each that an exhaustive search finds.

        Where no beam of a walk finds it, the shard is compared whole.
        """
        self.beam = 8
        while self.links is not None and len(q) and self.beam < len(self.x):
            if (self.search(q, self.beam)[0] == want[:, None]).any(1).mean() >= recall:
                break
            self.beam = self.beam + self.beam // 2 if self.beam < KEEP else len(self.x)
        return self.beam


def facts(triples: DataFrame, configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(seq, batch_id, ok, sk, sc, sg, rel, ok_, oc, og): rows that state a fact, read canonically.

    Rows without seq, with a blank predicate or one that means no listed relation, or with a name that leaves nothing state none.
    """
    t = triples.where("seq is not null").select("seq", "batch_id", "subject_name", "subject_type", "predicate", "object_name", "object_type", "validation_status")
    t = t.where(~blank(F.col("predicate")) & F.col("subject_name").isNotNull() & F.col("object_name").isNotNull())
    values = t.select(F.lit("relation").alias("kind"), F.col("predicate").alias("value")).distinct()
    rel = materialize(match(values, configs, catalog).select(F.col("value").alias("predicate"), F.col("pos").alias("rel")), "p2-relations")
    t = join_checked(t, rel, "predicate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sn, st, on, ot = (b.column(i).to_pylist() for i in range(4, 8))
            got = [(read_any(a, x), read_any(c, y)) for a, x, c, y in zip(sn, st, on, ot)]
            at = [i for i, g in enumerate(got) if g[0] and g[1]]
            rows = pa.array(at, pa.int32())
            cols = [pa.array([got[i][side][j] for i in at], pa.string()) for side in (0, 1) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(4)], *cols], names=["seq", "batch_id", "ok", "rel", "sk", "sc", "sg", "ok_", "oc", "og"])
        forget()
        _tidy()

    t = t.select("seq", F.coalesce(F.col("batch_id").cast("int"), F.lit(0)).alias("batch_id"), (~F.col("validation_status").eqNullSafe("rejected")).alias("ok"), F.col("rel").cast("int"), "subject_name", "subject_type", "object_name", "object_type")
    return t.mapInArrow(run, "seq bigint, batch_id int, ok boolean, rel int, sk string, sc string, sg string, ok_ string, oc string, og string")


KEY = ("sk", "sc", "sg", "rel", "ok_", "oc", "og")


def _keys(t: pa.Table | pa.RecordBatch) -> list[tuple]:
    return list(zip(*(t.column(c).to_pylist() for c in KEY)))


def visible(batch: int) -> list[tuple[int, int]]:
    """Ranges of batches whose merged shards are there when ``batch`` has been added: a binary counter, history apart."""
    out, lo = [], 1
    for bit in reversed(range(batch.bit_length())):
        if batch >> bit & 1:
            out.append((lo, lo + (1 << bit) - 1))
            lo += 1 << bit
    return out


@lru_cache(20_000)
def _side(kind: str, core: str, extra: str) -> tuple[int, int, int, int, int]:
    """Of one name: code of the kind and what stands beside the core, of the kind and its first letter, pairs of neighbouring letters as 64 bits, how many of them may differ (an edit changes six bits at most, a swap of neighbours so many), flags."""
    text, bits = f"^{core}$", 0
    for i in range(len(text) - 1):
        bits |= 1 << (_hash(text[i : i + 2]) & 63)
    initial = kind == "P" and len(extra) == 1
    # Long ones may differ where one of them is loose: a given name that is no known one, several sectors.
    long_ = len(extra) > 4 if kind == "P" else kind == "O"
    loose = long_ and (extra not in GIVEN if kind == "P" else "+" in extra)
    return _hash(f"{kind}|{extra}"), _hash(f"{kind}|{extra[:1]}"), bits, 6 * edits(len(core)), initial | long_ << 1 | loose << 2 | ord(kind) << 8


SIDE = np.dtype([("whole", "<u4"), ("first", "<u4"), ("bits", "<u8"), ("most", "<u2"), ("flags", "<u2")])
TRAITS = np.dtype([("relation", "<i4"), ("s", SIDE), ("o", SIDE)])


def traits(keys: list[tuple]) -> np.ndarray:
    out = np.zeros(len(keys), TRAITS)
    out["relation"] = [k[3] for k in keys]
    for side, lo in (("s", 0), ("o", 4)):
        out[side] = np.array([_side(*k[lo : lo + 3]) for k in keys], SIDE)
    return out


class Traits:
    """What the names of two facts must share to be the `same`, as numbers; no pair that `same` accepts is lost.

    The relation; of each name the kind, what stands beside the core, as far as `names.same_extra` asks for it, and letters as far as the edits allow.
    """

    def __init__(self, own: np.ndarray):
        self.relation = own["relation"]
        self.sides = [{c: np.ascontiguousarray(own[side][c]) for c in SIDE.names} for side in ("s", "o")]

    def plausible(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Mask of the pairs of rows a and c."""
        out = self.relation[a] == self.relation[c]
        for x in self.sides:
            at = np.flatnonzero(out)
            i, k = a[at], c[at]
            at_i, at_k = x["flags"][i], x["flags"][k]
            any_ = (at_i >> 2) & (at_k >> 1) | (at_k >> 2) & (at_i >> 1)
            beside = (x["whole"][i] == x["whole"][k]) | (x["first"][i] == x["first"][k]) & ((at_i | at_k) & 1 > 0) | (at_i >> 8 == at_k >> 8) & (any_ & 1 > 0)
            out[at] = beside & (np.bitwise_count(x["bits"][i] ^ x["bits"][k]) <= np.minimum(x["most"][i], x["most"][k]))
        return out

    def pairs(self, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): all plausible pairs of q[i] and rows[j]."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        bits, most = self.sides[1]["bits"], self.sides[1]["most"]

        def compare(mine: np.ndarray, there: np.ndarray) -> None:
            step = max(1, BLOCK // max(1, len(there)))
            for lo in range(0, len(mine) if len(there) else 0, step):
                a, c = q[mine[lo : lo + step]], rows[there]
                i, j = np.nonzero(np.bitwise_count(bits[a][:, None] ^ bits[c]) <= np.minimum(most[a][:, None], most[c]))
                keep = self.plausible(a[i], c[j])
                out.append((mine[lo + i[keep]], there[j[keep]]))

        # What is not loose agrees in what stands beside the names, or in its first letter: only such rows are compared.
        group = self.relation.astype(np.int64)
        for x in self.sides:
            group = group * 1_000_003 + np.where(x["flags"] >> 8 == ord("P"), x["first"], x["whole"])
        loose = (self.sides[0]["flags"] | self.sides[1]["flags"]) >> 2 & 1 > 0
        strict = [np.flatnonzero(~loose[x]) for x in (q, rows)]
        by = [x[np.argsort(group[y[x]], kind="stable")] for x, y in zip(strict, (q, rows))]
        codes = [group[y[x]] for x, y in zip(by, (q, rows))]
        for g in np.intersect1d(*codes):
            compare(*(x[slice(*np.searchsorted(z, [g, g + 1]))] for x, z in zip(by, codes)))
        compare(np.flatnonzero(loose[q]), np.arange(len(rows)))
        compare(strict[0], np.flatnonzero(loose[rows]))
        return tuple(np.concatenate(z) for z in zip(*out))


NODE = "node bigint, first_ok bigint, first_batch int, last_batch int, sk string, sc string, sg string, rel int, ok_ string, oc string, og string"
COLUMNS = ("node", "first_ok", "first_batch", "last_batch", *KEY)


class Nodes:
    """Facts of one cell with their vectors: a table of COLUMNS, kept as one value in storage."""

    def __init__(self, t: pa.Table, v: np.ndarray | None = None, traits_: np.ndarray | None = None, keys: list[tuple] | None = None):
        self.t, self.keys = t, _keys(t) if keys is None else keys
        self.v = vectors(self.keys) if v is None else v
        self.traits = traits(self.keys) if traits_ is None else traits_
        self.node = t.column("node").to_numpy()
        self.ok = t.column("first_ok").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        self.first, self.last = (t.column(c).to_numpy(zero_copy_only=False) for c in ("first_batch", "last_batch"))

    def take(self, rows: np.ndarray) -> Nodes:
        return Nodes(self.t.take(pa.array(rows)), self.v[rows], self.traits[rows], [self.keys[i] for i in rows.tolist()])

    def dump(self) -> bytes:
        fixed = lambda width, raw: pa.Array.from_buffers(pa.binary(width), len(self.v), [None, pa.py_buffer(raw)])
        sink = pa.BufferOutputStream()
        t = self.t.append_column("v", fixed(DIM, np.rint(self.v * 127).astype(np.int8).tobytes())).append_column("traits", fixed(TRAITS.itemsize, self.traits.tobytes()))
        with pa.ipc.new_stream(sink, t.schema) as w:
            w.write_table(t)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def load(data: bytes) -> Nodes:
        t = pa.ipc.open_stream(data).read_all().combine_chunks()
        raw = lambda name, width: b"".join(c.buffers()[1].to_pybytes()[c.offset * width : (c.offset + len(c)) * width] for c in t.column(name).chunks)
        v = np.frombuffer(raw("v", DIM), np.int8).reshape(-1, DIM).astype(np.float32)
        return Nodes(t.drop_columns(["v", "traits"]), unit(v), np.frombuffer(raw("traits", TRAITS.itemsize), TRAITS))


def build(nodes: Nodes, rng: np.random.Generator, recall: float) -> list[tuple[Nodes, Graph]]:
    """Shards of nodes with an accepted row, in order of it. Beams are tuned on TUNED of a shard's facts, misspelt: each is to find what it was."""
    rows = np.flatnonzero(~np.isnan(nodes.ok))
    rows = rows[np.lexsort((nodes.node[rows], nodes.ok[rows]))]
    out = []
    for part in np.array_split(rows, max(1, -(-len(rows) // SHARD))):
        if len(part):
            own = nodes.take(part)
            graph = Graph(own.v, rng)
            if graph.links is not None:
                probes = np.sort(rng.choice(len(part), min(TUNED, len(part)), replace=False))
                letters = random.Random(int(part[0]))
                graph.tune(vectors([_misspelt(own.keys[i], letters) for i in probes.tolist()]), probes, recall)
            out.append((own, graph))
    return out


def meet(shards: list[tuple[Nodes, Graph]], q: Nodes, rows: np.ndarray, best: dict[int, float], later: bool = True) -> None:
    """Lower ``best[row]``, the least accepted seq known of a query's fact, for ``rows`` of ``q`` by what the shards hold; without ``later`` not by nodes of batches after the query's."""

    def means(f: tuple, g: tuple) -> bool:
        return same(f[:3], g[:3]) and same(f[4:], g[4:])

    for there, graph in shards if len(rows) else []:
        asked = [q.keys[i] for i in rows]
        both = Traits(np.concatenate([q.traits[rows], there.traits]))
        all_q, held, n = np.arange(len(rows)), np.arange(len(there.keys)) + len(rows), len(rows)
        whole = lambda i: both.pairs(all_q[i], held)  # noqa: B023, E731
        i, j = graph.meet(q.v[rows], graph.beam or len(graph.x), whole)
        known = np.array([best.get(r, np.inf) for r in rows.tolist()])
        early = there.ok[j] < known[i]  # a later match changes nothing
        if not later:
            early &= there.first[j] <= q.last[rows[i]]
        i, j = i[early], j[early]
        hit = np.flatnonzero(both.plausible(i, n + j))
        hit = hit[np.argsort(there.ok[j[hit]], kind="stable")]  # the first match of a row is its earliest
        for a, c in zip(i[hit].tolist(), j[hit].tolist()):
            r = int(rows[a])
            if there.ok[c] < best.get(r, np.inf) and means(asked[a], there.keys[c]):
                best[r] = float(there.ok[c])


def meet_batches(q: Nodes, home: np.ndarray, recall: float, rng: np.random.Generator) -> tuple[dict[int, float], dict[tuple[int, int], list[tuple[Nodes, Graph]]]]:
    """(least accepted seq by row, shards left by range of batches) of one cell's new batches, each held against those before it and itself."""
    best: dict[int, float] = {}
    shards: dict[tuple[int, int], list[tuple[Nodes, Graph]]] = {}
    held = home & ~np.isnan(q.ok)  # rejected rows alone hold nothing
    numbers = {int(b): k + 1 for k, b in enumerate(np.unique(np.r_[q.first[held], q.last]).astype(int))}
    first, last = (np.array([numbers.get(int(b), 0) if b == b else 0 for b in x.tolist()]) for x in (np.where(held, q.first, -1), q.last))
    for batch in range(1, len(numbers) + 1):
        spans = visible(batch)
        for lo, hi in spans:
            if (lo, hi) not in shards:
                shards[lo, hi] = build(q.take(np.flatnonzero(held & (first >= lo) & (first <= hi))), rng, recall)
        for span in [x for x in shards if x not in spans]:
            del shards[span]  # merged into a larger shard
        for span in spans:
            meet(shards[span], q, np.flatnonzero(last == batch), best)
    named = {k: b for b, k in numbers.items()}
    return best, {(named[lo], named[hi]): x for (lo, hi), x in shards.items()}


@lru_cache(20_000)
def _parts(kind: str, extra: str, n: int) -> tuple[str, tuple[str, ...]]:
    """Of one name, by what stands beside its core: its part, of ``n`` for names that go by equality, and all parts with names that `same` may accept, its own among them."""
    whole, first, _, _, flags = _side(kind, "", extra)
    every, initials = tuple(str(i) for i in range(n)), f"i{first % n}"
    if flags >> 2 & 1:  # loose
        return "~", ("~", initials, *every)
    if flags & 1:
        return initials, ("~", initials, *every)
    own = str(whole % n)
    return own, ("~", initials, own)


class Cells:
    """How segments of more than CELL nodes are cut: ``cut``, into how many parts on each side, ``there``, the blocks with nodes that are held; of blocks with more than CELL nodes the trees, and how far from its own cell a query looks."""

    def __init__(self, trees: dict[str, Tree], recall: float, samples: dict[str, list[tuple]], cut: dict[str, int], there: list[str]):
        self.trees, self.most, self.margin = trees, 1, 0.0
        self.cut, self.there = cut, frozenset(there)
        rng = random.Random(3)
        for block, tree in sorted(trees.items()):
            # Probes: sampled facts, misspelt as far as `same` allows; their match lies in the cell of what they were.
            keys = samples[block]
            keys = keys[:: max(1, len(keys) * len(trees) // PROBES)]
            most, margin = _widen(tree, vectors([_misspelt(k, rng) for k in keys]), np.arange(len(keys)), tree.search(vectors(keys), 1)[:, 0], recall)
            self.most, self.margin = max(self.most, most), max(self.margin, margin)

    def blocks(self, key: tuple, asks: bool) -> list[str]:
        """Blocks of a fact, its own first; ``asks``: others that hold what it may mean."""
        segment = f"{key[3]}|{key[0]}|{key[4]}"
        n = self.cut.get(segment)
        if not n:
            return [segment]
        (s, s_all), (o, o_all) = _parts(key[0], key[2], n), _parts(key[4], key[6], n)
        own = f"{segment}|{s}.{o}"
        return [own, *sorted({f"{segment}|{x}.{y}" for x in s_all for y in o_all} & self.there - {own})] if asks else [own]

    def route(self, block: str, keys: list[tuple], asks: bool) -> np.ndarray:
        """Leaves of each fact, its own first; -1 pads. ``asks``: as far as matches are to be looked for."""
        tree, v = self.trees[block], vectors(keys)
        return _cells(tree, v, min(self.most, tree.n_leaves), self.margin) if asks else tree.search(v, 1)

    def routed(self, keys: list[tuple], asks: bool) -> tuple[list[int], list[str], list[bool]]:
        """(row, cell, home): the cell of each fact, and with ``asks`` others where it is to be looked for."""
        by: dict[tuple[str, bool], list[int]] = {}
        for i, k in enumerate(keys):
            for j, block in enumerate(self.blocks(k, asks)):
                by.setdefault((block, j == 0), []).append(i)
        row, cell, home = [], [], []
        for (block, own), at in by.items():
            if block not in self.trees:
                row, cell, home = row + at, cell + [block] * len(at), home + [own] * len(at)
                continue
            way = self.route(block, [keys[i] for i in at], asks)
            i, j = np.nonzero(way >= 0)
            row, cell, home = row + np.array(at)[i].tolist(), cell + [f"{block}|{z}" for z in way[i, j].tolist()], home + [own and x for x in (j == 0).tolist()]
        return row, cell, home


def _misspelt(key: tuple, rng: random.Random) -> tuple:
    """A fact with as many letters of its names changed as are allowed, in at least one of them."""
    out, both = list(key), rng.random()
    for at, one in ((1, both < 0.6), (5, both > 0.4)):
        for _ in range(rng.randint(1, 2) if one else 0):
            w = out[at]
            if edits(len(w)) > (w != key[at]):
                p = rng.randrange(len(w))
                out[at] = w[:p] + rng.choice(["", "x", w[p] + "e", w[p + 1 : p + 2] + w[p]]) + w[p + 1 + (rng.random() < 0.3) :]
    return tuple(out)


def _segment():
    return F.concat_ws("|", F.col("rel").cast("string"), "sk", "ok_")


class Index:
    """Shards of all facts accepted so far, in the shared folder.

    ``shards`` are tables (cell, lo, hi, data, links), one row per shard of the batches lo to hi; ``keys`` tables (node, first_ok) of all nodes. A manifest
    names the tables that count, so that a job that is lost leaves the index as it was. ``recall`` is what calibration asks of beams and of cells.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, recall: float = 0.98):
        self.spark, self.recall = spark, recall
        self.path = path or f"{tables_dir(spark)}/p2-index-{uuid.uuid4().hex}"
        self.cells: Cells | None = None
        self.state: dict = {"version": 0, "history": [], "batches": [], "keys": [], "sample": None, "cut": {}, "blocks": []}
        fs = self._fs()
        at = fs[0].globStatus(fs[1](f"{self.path}/manifest-*"))
        if at:
            newest = max((x.getPath().getName() for x in at), key=lambda n: int(n.split("-")[1]))
            self.state |= json.loads(spark.read.text(f"{self.path}/{newest}").first()[0])
            self._fit()

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _write(self, df: DataFrame, label: str) -> str:
        name = f"{label}-{uuid.uuid4().hex}"
        df.write.options(**LARGE_ROWS if label in ("history", "batches") else {}).parquet(f"{self.path}/{name}")
        return name

    def _read(self, label: str, name: str) -> DataFrame:
        out = self.spark.read.parquet(f"{self.path}/{name}")
        if label == "shards":
            out = out.where("cell is not null").select(*_SHARD_NAMES)
        out._tide_path = f"{self.path}/{name}"
        return out

    def _commit(self) -> None:
        self.state["version"] += 1
        self.spark.createDataFrame([(json.dumps(self.state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.state['version']}")

    def _fit(self) -> None:
        """Cells, with trees from the stored sample (at most 2 x SAMPLE facts)."""
        by: dict[str, list[tuple]] = {}
        if self.state["sample"]:
            rows = self._read("sample", self.state["sample"]).toArrow().sort_by("node")
            for segment, n, key in zip(rows.column("segment").to_pylist(), rows.column("n").to_pylist(), _keys(rows)):
                by.setdefault(segment, []).append((n, key))
        keys = {x: [k for _, k in z] for x, z in by.items()}
        trees = {x: Tree(vectors(keys[x]), max(2, -(-len(z) * CELL // z[0][0]))) for x, z in by.items()}
        self.cells = Cells(trees, self.recall, keys, self.state["cut"], self.state["blocks"]) if trees or self.state["cut"] else None

    def _routed(self, nodes: DataFrame, asks: bool) -> DataFrame:
        """Nodes with (cell, home); those of cut segments go to their block, and its leaf, as queries also to others."""
        x = nodes.select(_segment().alias("cell"), F.lit(True).alias("home"), *COLUMNS)
        if self.cells is None:
            return x
        # The trees of at most 2 x SAMPLE facts, cut to CELL, and the names of blocks: bounded.
        shared = self.spark.sparkContext.broadcast(self.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for whole in batches:
                for lo in range(0, whole.num_rows, ROUTED):
                    b = whole.slice(lo, ROUTED)
                    row, cell, home = c.routed(_keys(b), asks)
                    rest = b.select(list(COLUMNS)).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.string()), pa.array(home, pa.bool_()), *rest.columns], names=["cell", "home", *COLUMNS])

        return x.mapInArrow(run, "cell string, home boolean, " + NODE)

    def _blocks(self, nodes: DataFrame) -> dict[str, int]:
        """Nodes by block of the segments that are cut: at most (2 x PARTS + 1) ** 2 of each."""
        shared = self.spark.sparkContext.broadcast(self.cells)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([shared.value.blocks(k, False)[0] for k in _keys(b)], pa.string())], names=["block"])

        cut = nodes.where(_segment().isin(list(self.state["cut"]))).select(*KEY).mapInArrow(run, "block string")
        return {r["block"]: r["n"] for r in cut.groupBy("block").agg(F.count("*").alias("n")).collect()}

    def append(self, nodes: DataFrame) -> None:
        """Index the history: nodes (COLUMNS) with an accepted row, unique by KEY. Segments above CELL nodes are cut into blocks, blocks above CELL nodes by trees fitted on a sample of at most 2 x SAMPLE of them."""
        size = nodes.groupBy(_segment().alias("segment")).agg(F.count("*").alias("n"))
        cut = {r["segment"]: min(PARTS, -(-r["n"] // CELL)) for r in size.where(F.col("n") > CELL).collect()}  # a segment is a relation and two kinds
        if cut and not self.state["cut"] and not self.state["sample"]:
            nodes = materialize(nodes.select(*COLUMNS), "p2-history")
            self.state["cut"] = cut
            self._fit()
            blocks = self._blocks(nodes)
            self.state["blocks"] = sorted(blocks)
            large = {x: n for x, n in blocks.items() if n > CELL}
            if large:
                share = int(min(1.0, SAMPLE / sum(large.values())) * (1 << 30))
                n = F.element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("cell"))
                s = self._routed(nodes.where(F.pmod(F.col("node"), F.lit(1 << 30)) < share), False).withColumn("n", n).where("n is not null")
                self.state["sample"] = self._write(s.select(F.col("cell").alias("segment"), "n", "node", *KEY).limit(2 * SAMPLE), "sample")
            self._fit()
        elif self.state["cut"]:
            self._more(nodes)

        recall = self.recall

        def shard(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = key[0].as_py()
            rng = np.random.default_rng(_hash(cell))
            for t, _ in _pieces(batches, SHARD):
                yield from _shard_rows(cell, 0, 0, build(Nodes(t.select(list(COLUMNS)).combine_chunks()), rng, recall)).to_batches()
                del t
                _tidy()

        routed = self._routed(nodes, False).repartition(self._spread(), "cell").sortWithinPartitions("cell", "first_ok", "node")
        self.state["history"].append(self._write(routed.groupBy("cell").applyInArrow(shard, SHARDS), "history"))
        self.state["keys"].append(self._write(nodes.select("node", "first_ok"), "keys"))
        self._commit()

    def _more(self, nodes: DataFrame) -> None:
        """Note the blocks of further nodes."""
        self.state["blocks"] = sorted({*self.state["blocks"], *self._blocks(nodes.where("first_ok is not null"))})
        self.cells.there = frozenset(self.state["blocks"])

    def _spread(self) -> int:
        """Tasks for cells: two for each core or as many as shuffles have, each of which writes a file."""
        return max(2 * self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def add(self, nodes: DataFrame) -> DataFrame:
        """(node, first): for nodes (COLUMNS, unique by KEY) of new batches the least accepted seq of all nodes of the same fact, stored or among them.

        first_ok is the least seq of a node's rows that are not rejected (null: none), first_batch the batch of that row, last_batch that of its last.
        A node means itself. The new nodes are stored too.
        """
        recall = self.recall
        nodes = materialize(nodes.select(*COLUMNS), "p2-new")
        exact = None
        for name in self.state["keys"]:
            k = nodes.select("node").join(self._read("keys", name), "node").select("node", F.col("first_ok").alias("first"))
            exact = k if exact is None else exact.union(k)
        old = nodes.select("node", F.col("first_ok").alias("first")).where("first is not null")
        known = materialize((old if exact is None else old.union(exact)).groupBy("node").agg(F.min("first").alias("first")), "p2-known")
        if self.state["cut"]:
            self._more(nodes)

        def pack(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, alone in _pieces(batches, ASKED):
                t = t.combine_chunks()
                own = t.column("known").to_numpy(zero_copy_only=False).astype(np.float64).tobytes()
                home = t.column("home").to_numpy(zero_copy_only=False).tobytes()
                data = [[key[0].as_py()], [alone], [Nodes(t.select(list(COLUMNS))).dump()], [own], [home]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, _PACKED_TYPES)], names=_PACKED_NAMES)
                del t, data
                _tidy()

        # Those at home first, by batch: shards of few batches, and none where others only ask.
        routed = self._routed(nodes, True).join(known.withColumnRenamed("first", "known"), "node", "left").select("cell", "home", *COLUMNS, "known")
        routed = routed.repartition(self._spread(), "cell").sortWithinPartitions("cell", F.desc("home"), "last_batch", "node")
        packed = materialize(routed.groupBy("cell").applyInArrow(pack, PACKED), "p2-asked", **LARGE_ROWS)
        asked = lambda b, i: (Nodes.load(b.column("asked")[i].as_py()), np.frombuffer(b.column("own")[i].as_py(), np.float64), np.frombuffer(b.column("at_home")[i].as_py(), bool))

        def walk(batches: Iterator[pa.RecordBatch], later: bool = True) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    q, own, home = asked(b, i)
                    there = Nodes.load(b.column("data")[i].as_py())
                    best = {r: x for r, x in enumerate(own.tolist()) if x == x}
                    rows = np.arange(len(q.keys)) if later else np.flatnonzero(q.last >= b.column("lo")[i].as_py())
                    meet([(there, Graph(there.v, None, b.column("links")[i].as_py()))], q, rows, best, later)
                    yield _found_rows(q, best, own)
                    del there, q
                    _tidy()

        def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from walk(batches, False)

        def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    q, own, home = asked(b, i)
                    cell = b.column("cell")[i].as_py()
                    best, left = meet_batches(q, home, recall, np.random.default_rng(_hash(cell) + 1))
                    f = _found_rows(q, best, own)
                    yield pa.RecordBatch.from_arrays([*f.columns, *(pa.nulls(f.num_rows, x) for x in _SHARD_TYPES)], names=[*f.schema.names, *_SHARD_NAMES])
                    for (lo, hi), made in left.items():
                        for x in _shard_rows(cell, lo, hi, made).combine_chunks().to_batches():
                            yield pa.RecordBatch.from_arrays([pa.nulls(x.num_rows, pa.int64())] * 2 + x.columns, names=["node", "first", *_SHARD_NAMES])
                    del q, left
                    _tidy()

        with self._one_by_one():
            return self._meet(packed, known, nodes, walk, among, across)

    @contextmanager
    def _one_by_one(self) -> Iterator[None]:
        """A row is a shard: neither batches nor a join's buffer are to hold many at once."""
        conf = self.spark.conf
        few = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1", "spark.sql.sortMergeJoinExec.buffer.in.memory.threshold": "4"}
        before = {k: conf.get(k) for k in few}
        try:
            for k, x in few.items():
                conf.set(k, x)
            yield
        finally:
            for k, x in before.items():
                conf.set(k, x)

    def _meet(self, packed: DataFrame, known: DataFrame, nodes: DataFrame, walk: Callable, among: Callable, across: Callable) -> DataFrame:
        out = [known]
        for name in [*self.state["history"], *self.state["batches"]]:
            met = join_checked(self._read("shards", name), packed, "cell").mapInArrow(walk, "node bigint, first bigint")
            out.append(materialize(met, "p2-met"))
        # One table holds what was found, rows with a node, and the shards that are left, rows with a cell.
        name = self._write(packed.mapInArrow(among, "node bigint, first bigint, " + SHARDS), "batches")
        out.append(self._read("found", name).where("node is not null").select("node", "first"))
        # Queries of one cell that were not held at once: each part against what the others left.
        split = packed.where("not alone")
        if not split.isEmpty():
            met = self._read("shards", name).join(split, "cell").mapInArrow(across, "node bigint, first bigint")
            out.append(materialize(met, "p2-across"))
        self.state["batches"].append(name)
        self.state["keys"].append(self._write(nodes.where("first_ok is not null").select("node", "first_ok"), "keys"))
        self._commit()
        found_ = out[0]
        for x in out[1:]:
            found_ = found_.union(x)
        found_ = found_.groupBy("node").agg(F.min("first").alias("first"))
        if len(self.state["batches"]) > MERGE_AT:
            found_ = materialize(found_, "p2-found")  # compaction deletes tables that it is read from
            self.compact()
        return found_

    def compact(self) -> None:
        """Merge the stored shards of batches, cell by cell, into one table; the history's stay. The tables before are deleted when the manifest names the new one."""
        before, recall = list(self.state["batches"]), self.recall
        if len(before) < 2:
            return
        rows = self._read("shards", before[0])
        for name in before[1:]:
            rows = rows.union(self._read("shards", name))

        def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = key[0].as_py()
            rng = np.random.default_rng(_hash(cell) + 2)

            def made(parts: list[Nodes], lo: int, hi: int) -> list[pa.RecordBatch]:
                every = pa.concat_tables([p.t for p in parts])
                v = np.vstack([p.v for p in parts])
                # A node that came in several batches stays once, with its earliest row.
                order = np.lexsort((every.column("first_ok").to_numpy(), every.column("node").to_numpy()))
                node = every.column("node").to_numpy()[order]
                keep = order[np.r_[True, node[1:] != node[:-1]]]
                return _shard_rows(cell, lo, hi, build(Nodes(every.take(pa.array(keep)).combine_chunks(), v[keep], np.concatenate([p.traits for p in parts])[keep]), rng, recall)).to_batches()

            parts, los, his = [], [], []
            for b in batches:
                for lo, hi, data in zip(*(b.column(c).to_pylist() for c in ("lo", "hi", "data"))):
                    part = Nodes.load(data)
                    if parts and sum(len(p.keys) for p in parts) + len(part.keys) > SHARD:
                        yield from made(parts, min(los), max(his))
                        parts, los, his = [], [], []
                        _tidy()
                    parts, los, his = [*parts, part], [*los, lo], [*his, hi]
            if parts:
                yield from made(parts, min(los), max(his))

        with self._one_by_one():
            self.state["batches"] = [self._write(rows.repartition(self._spread(), "cell").groupBy("cell").applyInArrow(merge, SHARDS), "batches")]
        self._commit()
        fs, path = self._fs()
        for name in before:
            fs.delete(path(f"{self.path}/{name}"), True)


SHARDS = "cell string, lo int, hi int, data binary, links binary"
_SHARD_NAMES = ["cell", "lo", "hi", "data", "links"]
_SHARD_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


PACKED = "cell string, alone boolean, asked binary, own binary, at_home binary"
_PACKED_NAMES = ["cell", "alone", "asked", "own", "at_home"]
_PACKED_TYPES = [pa.string(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """(rows, alone): the rows of one group in tables of at most ``most``, none without rows; alone: it is the only one."""
    held, n, alone = [], 0, True
    for b in batches:
        while b.num_rows:
            if n == most:
                alone = False
                yield pa.Table.from_batches(held), alone
                held, n = [], 0
            held.append(b.slice(0, most - n))
            b = b.slice(held[-1].num_rows)
            n += held[-1].num_rows
    if held:
        yield pa.Table.from_batches(held), alone


def _shard_rows(cell: str, lo: int, hi: int, made: list[tuple[Nodes, Graph]]) -> pa.Table:
    cols = [[cell] * len(made), [lo] * len(made), [hi] * len(made), [n.dump() for n, _ in made], [g.dump() for _, g in made]]
    return pa.table([pa.array(c, t) for c, t in zip(cols, _SHARD_TYPES)], names=_SHARD_NAMES)


def _found_rows(q: Nodes, best: dict[int, float], own: np.ndarray) -> pa.RecordBatch:
    """(node, first) of the rows for which something earlier than ``own`` was met."""
    at = [r for r, x in best.items() if not x >= own[r]]
    return pa.RecordBatch.from_arrays([pa.array(q.node[at], pa.int64()), pa.array([int(best[r]) for r in at], pa.int64())], names=["node", "first"])


def _widen(tree: Tree, q: np.ndarray, i: np.ndarray, cell: np.ndarray, recall: float) -> tuple[int, float]:
    """(most cells to visit, margin) with which the wanted part of the matches, q[i] in cell, is met; all cells are looked at where fewer do not hold it."""
    wide = min(tree.n_leaves, MOST)
    while True:
        way = tree.search(q, wide)
        hit = way[i] == cell[:, None]
        sim = _leaf_similarity(tree, q, way)
        rank = hit.argmax(1)
        gap = np.where(hit.any(1), np.maximum(sim[i, 0] - sim[i, rank], 0), 9.0)
        margin = float(np.quantile(gap, recall, method="higher"))
        if margin < 9 or wide >= tree.n_leaves:
            # No further in the list than the matches within the margin lie.
            return int(rank[gap <= margin].max()) + 1 if margin < 9 else wide, margin
        wide = min(tree.n_leaves, wide * 4)


def _leaf_similarity(tree: Tree, q: np.ndarray, way: np.ndarray) -> np.ndarray:
    leaf_node = np.flatnonzero(tree.leaf >= 0)
    of = np.empty(tree.n_leaves, np.int64)
    of[tree.leaf[leaf_node]] = leaf_node
    s = np.einsum("nkd,nd->nk", tree.centre[of[np.maximum(way, 0)]], q)
    return np.where(way >= 0, s, -9)


def _cells(tree: Tree, q: np.ndarray, most: int, margin: float) -> np.ndarray:
    """Cells of each query, best first, as far as they are within ``margin`` of the first; -1 pads."""
    way = np.full((len(q), most), -1, np.int32)
    w = tree.search(q, most)
    s = _leaf_similarity(tree, q, w)
    way[:, : w.shape[1]] = np.where(s >= s[:, :1] - margin, w, -1)
    return way


def found(triples: DataFrame, configs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(seq_first, seq_dup): rows of batches whose fact is held by an earlier row that is not rejected, with the earliest such row.

    Rows delivered again (one seq) count once. Direction matters; types, ids and texts do not. Rows that state no fact (see `facts`)
    are no cases and hold nothing. A null batch_id counts as history, a null status as not rejected. No rows give no rows.
    """
    f = facts(triples, configs, catalog)
    f = materialize(f.withColumn("node", F.xxhash64(*KEY)), "p2-facts")
    ok = F.when(F.col("ok"), F.col("seq"))
    nodes = lambda x: x.groupBy("node").agg(*[F.any_value(c).alias(c) for c in KEY], F.min(ok).alias("first_ok"), F.min(F.when(F.col("ok"), F.col("batch_id"))).alias("first_batch"), F.max("batch_id").alias("last_batch"))
    index = Index(triples.sparkSession)
    index.append(nodes(f.where("batch_id <= 0 and ok")))
    d = materialize(index.add(nodes(f.where("batch_id > 0"))), "p2-found")
    rows = f.where("batch_id > 0").select("node", "seq").distinct()
    return rows.join(d, "node").where("first < seq").select(F.col("first").alias("seq_first"), F.col("seq").alias("seq_dup"))
