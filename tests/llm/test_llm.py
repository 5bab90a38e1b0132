"""Operators on corpora: against brute force, exact round trips, and the defined results of odd input."""

import base64
import datetime as dt
import inspect
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripletide.llm import canonical, components, dedup, mixture, names, neighbours, quality, queries, survivor, tokenize, variants

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    with open(tokenize.RANKS_PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenize.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokenizer_equals_the_public_one(spark, tiktoken_encoding):
    rng = random.Random(1)
    alphabet = "aaab  éüß日本🙂\n\r\t'.,-0123456789tshe'll"
    texts = [None, "", " ", "\n\n", "aaaaaaaaaaa", "a" * 3000, "don't we'll", "🙂" * 50, " x​"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(400)]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(d).collect()}
    assert got == {i: tiktoken_encoding.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    n = {r["doc_id"]: r["n_tokens"] for r in tokenize.count_tokens(d.select("doc_id", "text")).collect()}
    assert n == {i: len(x) for i, x in got.items()}
    assert tokenize.encode(d.limit(0)).count() == 0


def test_tokenizer_forgets_and_remembers(monkeypatch, tiktoken_encoding):
    monkeypatch.setattr(tokenize, "MEMORY", 5)
    with open(tokenize.RANKS_PATH, "rb") as f:
        e = tokenize.Encoder(f.read())
    for t in ("one two three four five six seven", "eight one two", "three three"):
        ids, n = e.batch([t, None])
        assert list(ids) == tiktoken_encoding.encode_ordinary(t) and list(n) == [len(ids), 0]


def union_find(pairs):
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        par[y] = x
    return {x: find(x) for x in par}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(3)
    if shape == "random":
        pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)]
    elif shape == "chain":
        ids = [f"n{i:03}" for i in range(120)]
        rng.shuffle(ids)
        pairs = list(zip(ids, ids[1:]))
    else:
        pairs = [("hub", f"n{i:04}") for i in range(1500)] * 2
    want = union_find([p for p in pairs if p[0] != p[1]])
    d = spark.createDataFrame([*pairs, (None, "x"), ("x", None), ("self", "self")], "a string, b string")
    assert {r["item"]: r["group"] for r in components.components(d).collect()} == want
    assert components.components(d.limit(0)).count() == 0


def test_conflict_sets(spark):
    u = lambda c: f"{c * 8}-{c * 4}-{c * 4}-{c * 4}-{c * 12}"
    rows = [
        ("DUPLICATE-entity ", [u("A"), "{" + u("b") + "}", None, ""]), ("duplicate_entity", ["urn:uuid:" + u("b"), u("c")]), ("schema_violation", [u("d"), u("e")]),
        ("duplicate_entity", None), ("duplicate_entity", []), ("duplicate_entity", [u("d")]), ("duplicate_entity", [u("e"), u("e"), "?"]), (None, [u("d"), u("e")]),
    ]
    d = spark.createDataFrame(rows, "conflict_type string, conflicting_items array<string>")
    assert {(r["item_id"], r["group_id"]) for r in components.found(d).collect()} == {(u(c), u("a")) for c in "abc"}


def brute(ids, x, k, least):
    n = np.linalg.norm(x, axis=1)
    s = (x @ x.T) / np.outer(n, n)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if ids[j] != ids[i] and s[i, j] >= least), key=lambda j: (-round(s[i, j], 12), ids[j]))[:k]
        out |= {(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in order}
    return out


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 64)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(500, 64))
    x = np.vstack([base, base[:300] + rng.normal(size=(300, 64)) * 0.35, base[:100] * 7 + rng.normal(size=(100, 64))]).astype(np.float32)
    ids = [f"e{i:05}" for i in rng.permutation(len(x))]
    rows = [(i, [float(z) for z in v]) for i, v in zip(ids, x)]
    odd = [("n1", None), ("n2", [0.0] * 64), ("n3", [1.0] * 48), ("n4", [None] + [1.0] * 63), ("n5", [float("nan")] + [1.0] * 63), (None, [1.0] * 64), ("n6", [])]
    d = spark.createDataFrame(rows + odd, "entity_id string, embedding array<float>")
    want = brute(ids, x.astype(np.float64), 10, 0.85)
    got = {(r["id_a"], r["id_b"]) for r in neighbours.found(d).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert neighbours.found(spark.createDataFrame(odd, d.schema)).count() == 0
    free = neighbours.nearest(d, "entity_id", "embedding", 64, k=3, recall=0.999)
    assert free.groupBy("id").count().where("count <> 3").count() == 0 and free.select("id").distinct().count() == len(ids)


def test_neighbours_in_a_crowded_leaf(spark, monkeypatch):
    """A leaf above SPLIT is split where it is met; few near pairs calibrate nothing and still the nearest are found."""
    monkeypatch.setattr(neighbours, "SPLIT", 300)
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 100)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(60, 64))
    x = (base[rng.integers(0, 60, 900)] + rng.normal(size=(900, 64)) * 0.3).astype(np.float32)
    u = neighbours.unit(x)
    at = np.arange(len(x))
    s = u @ u.T
    np.fill_diagonal(s, -9)
    met = np.zeros((len(x), len(x)), bool)
    for q, d in neighbours._blocks(u, at, at, 5, 0.99):
        met[np.ix_(q, d)] = True
    assert met.mean() < 0.9 and np.take_along_axis(met, np.argsort(-s, axis=1)[:, :5], 1).mean() >= 0.97
    ids = [f"e{i:05}" for i in at]
    d = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in zip(ids, x)], "entity_id string, embedding array<float>")
    want = brute(ids, x.astype(np.float64), 10, 0.999)
    assert {(r["id_a"], r["id_b"]) for r in neighbours.found(d, min_cosine=0.999).collect()} == want


def test_neighbours_with_a_third_of_exact_copies(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64)).astype(np.float32)
    x[100:240] = x[100]
    ids = [f"e{i:05}" for i in range(len(x))]
    d = spark.createDataFrame([(i, [float(z) for z in v]) for i, v in zip(ids, x)] + [(ids[0], [float(z) for z in x[0]])], "entity_id string, embedding array<float>")
    assert {(r["id_a"], r["id_b"]) for r in neighbours.found(d).collect()} == brute(ids, x.astype(np.float64), 10, 0.85)


TRIPLE = "seq bigint, batch_id int, subject_name string, subject_type string, predicate string, object_name string, object_type string, validation_status string"


def test_dedup_cases(spark, small):
    _, conf, cat = canonical.tables(spark, small)
    rows = [
        (1, 0, "Albrecht Sausteinrugil", "Person", "LEITET", "Verlag Munebral", "Organisation", "accepted"),
        (2, 0, "Nora Sausteinrugil", "Person", "LEITET", "Verlag Munebral", "Organisation", "accepted"),
        (3, 0, "Ort Eins", "Ort", "TEIL_VON", "Bericht 5 über Wolunkarge", "Dokument", "rejected"),
        (10, 1, "SAUSTEINRUGIL, Albrecht", "person", "leads", "The Verlag Munebrall", "Org", "pending"),
        (10, 1, "SAUSTEINRUGIL, Albrecht", "person", "leads", "The Verlag Munebrall", "Org", "pending"),
        (11, 1, "Verlag Munebral", "Organisation", "LEITET", "Albrecht Sausteinrugil", "Person", "pending"),  # the other direction
        (12, 1, "Albrecht Sausteinrugil", "Person", None, "Verlag Munebral", "Organisation", "pending"),
        (13, 1, "Albrecht Sausteinrugil", "Person", "xxx", "Verlag Munebral", "Organisation", "pending"),
        (14, 2, "A. Sausteinrugil", None, "leitet", "Verlag Munebral", None, "pending"),
        (15, 2, "Ort Eins", "Ort", "TEIL_VON", "Bericht 5 über Wolunkarge", "Dokument", "pending"),  # only a rejected row before it
        (16, 3, "ort eins", None, "teil von", "bericht 5 über wolunkarge", None, "rejected"),
        (17, 3, "ort eins", None, "teil von", "bericht 6 über wolunkarge", None, "pending"),
        (18, 3, None, None, "teil von", "", None, "pending"),
        (None, 3, "a", None, "teil von", "b", None, "pending"),
    ]
    d = spark.createDataFrame(rows, TRIPLE)
    assert {(r["seq_first"], r["seq_dup"]) for r in dedup.found(d, conf, cat).collect()} == {(1, 10), (1, 14), (15, 16)}
    assert dedup.found(d.limit(0), conf, cat).count() == 0


def test_graph_shards_against_exhaustive_search():
    rng = np.random.default_rng(2)
    x = neighbours.unit(rng.normal(size=(6000, dedup.DIM)))
    q = neighbours.unit(x[:400] + rng.normal(size=(400, dedup.DIM)) * 0.05)
    g = dedup.Graph(x, rng)
    assert g.links is not None
    g.tune(q[:100], np.arange(100), 0.95)
    node, _ = g.search(q, g.beam)
    assert (node == np.arange(400)[:, None]).any(1).mean() >= 0.9
    assert dedup.visible(6) == [(1, 4), (5, 6)] and dedup.visible(1) == [(1, 1)] and dedup.visible(0) == []


def test_dedup_recall_on_small_tables(spark, small):
    """Against all pairs, compared name by name."""
    t, conf, cat = canonical.tables(spark, small)
    full = spark.read.parquet(f"{small}/triples.parquet")
    f = dedup.facts(full, conf, cat).distinct().collect()
    by = {}
    for r in f:
        if r["ok"]:
            by.setdefault(r["rel"], []).append(r)
    want = set()
    for r in f:
        if r["batch_id"]:
            a = ((r["sk"], r["sc"], r["sg"]), (r["ok_"], r["oc"], r["og"]))
            first = min((o["seq"] for o in by.get(r["rel"], []) if o["seq"] < r["seq"] and names.same(a[0], (o["sk"], o["sc"], o["sg"])) and names.same(a[1], (o["ok_"], o["oc"], o["og"]))), default=None)
            if first is not None:
                want.add((first, r["seq"]))
    got = {(r["seq_first"], r["seq_dup"]) for r in dedup.found(full, conf, cat).collect()}
    assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(got)


def test_graph_meets_all_of_a_crowd():
    """More alike nodes than a walk keeps, and a target that no walk reaches."""
    rng = np.random.default_rng(3)
    x = neighbours.unit(rng.normal(size=(5000, dedup.DIM)))
    x[:300] = neighbours.unit(x[0] + rng.normal(size=(300, dedup.DIM)) * 0.02)
    g = dedup.Graph(x, rng)
    i, j = g.meet(x[:3], 8)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(z.tolist() for z in np.nonzero(x[:3] @ x.T >= dedup.LEAST))))
    g.search = lambda q, beam: (np.full((len(q), dedup.KEEP), -1, np.int32), np.full((len(q), dedup.KEEP), -9, np.float32))
    assert g.tune(x[:50], np.arange(50), 0.98) == len(x)


def nodes_of(keys, ok, first, last):
    """`dedup.Nodes` of keys, numbered from 0."""
    n = len(keys)
    cols = [range(n), [None if x is None else int(x) for x in ok], [None if x is None else int(x) for x in first], [int(x) for x in last], *zip(*keys)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int32() if c == "rel" else pa.string() for c in dedup.KEY]]
    return dedup.Nodes(pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=list(dedup.COLUMNS)))


def test_dedup_finds_what_vectors_do_not():
    """Typing errors in both names, and two in one, leave few letters' triples; `same` accepts them."""
    far = [
        ("P", "munebral", "nora", 1, "O", "wolunkar", ""), ("P", "munexral", "nora", 1, "O", "wolukkar", ""), ("P", "muxebyal", "nora", 1, "O", "wolunkar", ""),
        ("P", "munibrol", "anna", 1, "O", "wolunkar", ""), ("P", "muxibyol", "anna", 1, "O", "woxunyar", ""),
    ]
    v = dedup.vectors(far)
    assert v[3] @ v[4] < dedup.LEAST
    q = nodes_of(far, range(5), [1] * 5, [1] * 5)
    again = dedup.Nodes.load(q.dump())
    assert again.keys == q.keys and np.abs(again.v - q.v).max() < 0.02 and (again.ok == q.ok).all()
    rng = np.random.default_rng(1)
    best, left = dedup.meet_batches(again, np.ones(5, bool), 0.98, rng)
    assert best == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3} and list(left) == [(1, 1)]
    # Held against stored history, a batch meets it and is not met by it.
    history = dedup.build(nodes_of(far[:1], [7], [0], [0]), rng, 0.98)
    best = {}
    dedup.meet(history, q, np.arange(5), best)
    assert best == {0: 7, 1: 7, 2: 7}


def test_traits_lose_no_pair():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdefgiklmnoprstuw") for _ in range(rng.randint(4, 12)))
    keys = []
    for _ in range(300):
        a, b = word(), word()
        for _ in range(4):
            c, d = (w[:p] + rng.choice(["", "x", "xy", "x" + w[p : p + 1]]) + w[p + 1 :] for w in (a, b) for p in [rng.randrange(len(w))])
            keys.append((rng.choice("PO"), c, rng.choice(["", "a", "anna", "antonia", "antonja", "bntonia"]), 1, "X", d, ""))
    want = {(i, j) for i, f in enumerate(keys) for j, g in enumerate(keys) if names.same(f[:3], g[:3]) and names.same(f[4:], g[4:])}
    at = np.arange(len(keys))
    assert want <= set(zip(*(z.tolist() for z in dedup.Traits(dedup.traits(keys)).pairs(at, at))))


def test_cells_widen_until_matches_are_met():
    rng = np.random.default_rng(4)
    x = neighbours.unit(rng.normal(size=(2000, dedup.DIM)))
    tree = neighbours.Tree(x, 40)
    assert tree.n_leaves > 4 * dedup.MOST
    far = tree.search(x[:50], tree.n_leaves)[:, -5]  # matches beyond the first cells looked at
    most, margin = dedup._widen(tree, x[:50], np.arange(50), far, 0.98)
    assert most > dedup.MOST and margin < 2
    met = dedup._cells(tree, x[:50], most, margin)
    assert (met == far[:, None]).any(1).mean() >= 0.98


def test_stored_graph_walks_alike():
    rng = np.random.default_rng(8)
    x = neighbours.unit(rng.normal(size=(3000, dedup.DIM)))
    g = dedup.Graph(x, rng)
    again = dedup.Graph(x, None, g.dump())
    for a, b in zip(g.search(x[:50], 8), again.search(x[:50], 8)):
        assert (np.sort(a, 1) == np.sort(b, 1)).all()
    assert dedup.Graph(x[:10], rng).dump() is None and dedup.Graph(x[:10], None, None).links is None


def test_dedup_asks_full_recall():
    assert inspect.signature(dedup.Index.__init__).parameters["recall"].default >= 0.98


def words_for(n, rng):
    return ["".join(rng.choice("abdefgiklmnoprstuw") for _ in range(rng.randint(8, 12))) for _ in range(n)]


FACTS = "node bigint, first_ok bigint, first_batch int, last_batch int, sk string, sc string, sg string, rel int, ok_ string, oc string, og string"


@pytest.mark.parametrize("cell", [65_536, 250])
def test_index_takes_batches_without_its_history(spark, monkeypatch, cell):
    """Batches in several calls, the index opened anew each time: as against all facts by brute force; the history's shards stay the files they were. Cells of 250 need trees."""
    monkeypatch.setattr(dedup, "CELL", cell)
    by_itself = cell == 250  # compacts in `add`
    if by_itself:
        monkeypatch.setattr(dedup, "MERGE_AT", 1)
    rng = random.Random(11)
    base = [(rng.choice("P"), a, "anna", rng.randrange(2), "X", b, "7") for a, b in zip(words_for(900, rng), words_for(900, rng))]
    worse = lambda w: (lambda p: w[:p] + "x" + w[p + 1 :])(rng.randrange(len(w)))
    bent = [(f[0], worse(f[1]), f[2], f[3], f[4], worse(f[5]) if rng.random() < 0.5 else f[5], f[6]) for f in base for _ in range(rng.choice([0, 0, 1, 2]))]
    facts_ = list(dict.fromkeys(base + bent))
    rng.shuffle(facts_)
    when = [rng.choice([0, 0, 0, 1, 2, 3, 4]) for _ in facts_]
    order = sorted(range(len(facts_)), key=lambda i: when[i])
    rows = {i: (i, seq if seq % 9 else None, when[i] if seq % 9 else None, when[i], *facts_[i]) for seq, i in enumerate(order) if when[i] or seq % 9}
    part = lambda *bs: spark.createDataFrame([r for r in rows.values() if r[3] in bs], FACTS)
    index = dedup.Index(spark)
    index.append(part(0))
    assert (index.cells is not None) == (cell == 250)
    fs, path = index._fs()
    files = lambda: sorted((x.getPath().getName(), x.getModificationTime()) for n in index.state["history"] for x in fs.listStatus(path(f"{index.path}/{n}")))
    written, got = files(), {}
    for bs in ((1, 2), (3,), (4,)):
        index = dedup.Index(spark, index.path)  # only what is stored
        got |= {r["node"]: r["first"] for r in index.add(part(*bs)).collect()}
        if bs == (3,):
            index.compact()
            assert len(index.state["batches"]) == 1
    assert files() == written and len(dedup.Index(spark, index.path).state["batches"]) == (1 if by_itself else 2)
    ok = lambda f, g: f[3] == g[3] and names.same(f[:3], g[:3]) and names.same(f[4:], g[4:])
    want = {}
    for i, r in rows.items():
        if r[3]:
            hits = [o[1] for o in rows.values() if o[1] is not None and o[3] <= r[3] and ok(r[4:], o[4:])]
            if hits:
                want[i] = min(hits)
    assert sum(got.get(i) == x for i, x in want.items()) >= (0.99 if cell > 1000 else 0.95) * len(want) and set(got) <= set(want)
    assert index.add(part(99)).count() == 0


def test_survivors(spark):
    e = "entity_id string, fingerprint string, description string, source_document string, confidence double, created_at timestamp_ntz, validation_status string, clash int"
    old, new, bad = DAY, DAY + dt.timedelta(days=9), dt.datetime(1900, 1, 1)
    rows = [
        ("a", "f", "  n/a ", "s1_1", 1.5, new, "accepted", 1), ("b", "f", "kurz", "s2_1", 0.4, old, "pending", 1), ("c", "f", "laenger ", None, 0.9, bad, "pending", 1), ("d", "f", " laenger", "s2_9", float("nan"), None, None, 1),
        ("x", "g", None, None, None, None, None, 1), ("y", "g", "\t", None, -1.0, None, None, 1), ("z", "h", "alone", "s1_1", 0.5, old, None, 1), (None, "h", "q", "s1_1", 0.5, old, None, 1), ("n", None, "q", None, 0.5, old, None, 1),
    ]
    d = spark.createDataFrame(rows, e)
    p = spark.createDataFrame([("s1", 0.3), ("s2", 0.8), (None, 1.0)], "source_id string, reliability_score double")
    got = {(r["fingerprint"], r["field_name"]): r["entity_id"] for r in survivor.survivors(d, p).collect()}
    assert got == {("f", "description"): "c", ("f", "source_document"): "b", ("f", "confidence"): "b"}
    assert survivor.survivors(d.limit(0), p.limit(0)).count() == 0


def test_currency_learns_transitions(spark):
    rows = [(f"{g}{i}", g, None, None, 0.5, DAY + dt.timedelta(days=i), s) for g in "abc" for i, s in enumerate(("pending", "accepted", "archived"))]
    rows += [("u1", "u", "x", None, 0.1, None, "pending"), ("u2", "u", "y", None, 0.2, None, "archived")]
    d = spark.createDataFrame(rows, "entity_id string, fingerprint string, description string, source_document string, confidence double, created_at timestamp_ntz, validation_status string")
    t = {r["state"]: r["depth"] for r in survivor.transitions(d).collect()}
    assert t == {"pending": 0, "accepted": 1, "archived": 2}
    p = spark.createDataFrame([], "source_id string, reliability_score double")
    pick = lambda u: {r["entity_id"] for r in survivor.survivors(d, p, u).where("fingerprint = 'u' and field_name = 'confidence'").collect()}
    assert pick("oldest") == {"u1"} and pick("learned") == {"u2"}


def test_currency_places_undated_among_dated(spark):
    """An undated record is newer than all whose state precedes its own and older than those that follow; without state it is oldest."""
    rows = [(f"{g}{i}", g, None, None, 0.5, DAY + dt.timedelta(days=i), s) for g in "abc" for i, s in enumerate(("pending", "accepted", "archived"))]
    groups = {
        "v": [("v1", DAY, "pending"), ("v2", None, "accepted"), ("v3", DAY + dt.timedelta(days=5), "archived")],  # the last dated one follows it
        "w": [("w1", DAY, "pending"), ("w2", DAY + dt.timedelta(days=3), "accepted"), ("w3", None, "archived"), ("w4", None, None)],
        "x": [("x1", DAY, "archived"), ("x2", None, "pending")],
        "y": [("y1", None, "accepted"), ("y2", None, "archived"), ("y3", DAY, "pending"), ("y4", dt.datetime(1900, 1, 1), "archived")],
    }
    rows += [(i, g, f"text {i}", None, 0.5, t, s) for g, xs in groups.items() for i, t, s in xs]
    d = spark.createDataFrame(rows * 2, "entity_id string, fingerprint string, description string, source_document string, confidence double, created_at timestamp_ntz, validation_status string")
    p = spark.createDataFrame([], "source_id string, reliability_score double")
    got = {(r["fingerprint"], r["field_name"]): r["entity_id"] for r in survivor.survivors(d, p, "learned").where("fingerprint in ('v', 'w', 'x', 'y')").collect()}
    assert got == {(g, f): i for g, i in {"v": "v3", "w": "w3", "x": "x1", "y": "y2"}.items() for f in ("description", "confidence")}


def test_canonical(spark, small):
    _, conf, cat = canonical.tables(spark, small)
    cases = {
        "geborenIn": "GEBOREN_IN", "G3B0R3N_1N": "GEBOREN_IN", "IN_GEBOREN": "GEBOREN_IN", "rel:BORN_IN": "GEBOREN_IN", "ist geboren in": "GEBOREN_IN", "GEBO. IN": "GEBOREN_IN", "place of birth": "GEBOREN_IN",
        "kenmt": "KENNT", "knetn": "UNMATCHED", "Besitzts": "BESITZT", "kg/TEIL_VON": "TEIL_VON", "TEIL_VON (Relation)": "TEIL_VON", "gehoert als abteilung zu": "TEIL_VON", "n/a": "UNMATCHED", "kochte": "UNMATCHED", "x" * 5000: "UNMATCHED",
    }
    rows = [(i, 1, k, "Pesron", None) for i, k in enumerate(cases)] * 2 + [(100, 1, " ", "Org", "Ortt"), (101, 2, "BORN_IN", "Tier", "human/person"), (102, 9, "BORN_IN", None, "​"), (None, 1, "x", "y", "z")]
    d = spark.createDataFrame(rows, "seq bigint, config_id int, predicate string, subject_type string, object_type string")
    got = {(r["seq"], r["field_name"]): r["canonical"] for r in canonical.found(d, conf, cat).collect()}
    assert {k: got[i, "predicate"] for i, k in enumerate(cases)} == cases
    assert got[0, "subject_type"] == "Person" and got[100, "subject_type"] == "Organisation" and got[100, "object_type"] == "Ort"
    assert (100, "predicate") not in got and (101, "predicate") not in got and got[101, "subject_type"] == "UNMATCHED" and got[101, "object_type"] == "Person"
    assert got[102, "predicate"] == "UNMATCHED" and (102, "object_type") not in got and not any(k[0] is None for k in got)
    assert canonical.found(d.limit(0), conf, cat).count() == 0


def test_name_readings():
    r = names.read
    same = [("Rosalie Ulrike Lizaultozis", "rOSLIE lIZAULTOZIS"), ("Nadine van der Kobutrohü", "Kobutrohü N."), ("Lorenz Emilia Lütrizaper", "LÜTRIZAPER, Lorenz"), ("Sebastian Greinoshüsar", "Basti Greinoshuesar"), ("Cordula Turelraukor", "Prof. Dr. C. Turelraukor."), ("Helene Wibrünritrer", "HeleneWibrünritrer")]
    for a, b in same:
        assert names.same(r(a, "Person"), r(b, "Person")), (a, b)
    assert not names.same(r("Nora Kobutrohü", "Person"), r("Gregor Kobutrohü", "Person"))
    assert r("Institut Togresfeiklen für Messtechnik", None) == r("Togresfeiklen, Inst. f. Messtechnik", "ORG")
    assert r(None, None) is None and r("", "Person") is None and r("...", "Person") is None and r("Dr.", "Person") is None
    assert names.read_any("Bericht 5 über X", "Dokument") != names.read_any("Bericht 6 über X", "Dokument")
    assert names.within("kitten", "sitting", 3) == 3 and names.within("kitten", "sitting", 2) is None
    assert names.within("abcd", "bacd", 1) == 1 and names.within("abcd", "badc", 2) == 2 and names.within("abcd", "badc", 1) is None and names.within("", "ab", 2) == 2
    assert not names.same(r("Verlag Munebral", "Org"), r("Stiftung Munebral", "Org")) and names.same(r("Stftg. Munebral", "Org"), r("Stiftung Munebrla", "Org"))
    # A misspelt word of the sector is not taken for the name, a name like such a word is.
    assert r("Gesellscthaft Pasuspustel fur Klangforscgung", "Org") == ("O", "pasuspustel", "geselschaft") and r("Velag Munebral", "ORG") == r("Munebral Verlag", "Org")
    assert r("Gesellscahft Mnobüsstomes für Klangfroschung", "Org")[1] == "mnobustomes" and r("Verlag Verlak", "Org") == ("O", "verlak", "verlag") and r("Verlag GmbH", "Org") is None
    assert r("wernernarisgugrun", "Person") == r("Werner Narisgugrun", "Person")


def test_variants(spark):
    ent = [
        ("e1", "Georg Mubeinseikein", "Person", ["Ulrike Distisbridau", "G. Mubeinseikein"]), ("e2", "Mubeinseikein, Georg", "Person", None), ("e3", "Rosalie Lizaultozis", "Person", []), ("e4", "Rudolf Lizaultozis", "Person", [None]),
        ("e5", "Verlag Temunstupas", "Organisation", None), ("e6", "Temunstupas", "Ort", None), ("e7", "Georg Mubeinseikein", "Person", None), ("e7", "Georg Mubeinseikein", "Person", None),
    ]
    men = [("v1", "ulrike distisbridau", None), ("v2", "R. Lizaultozis", "Person"), ("v3", "Vlg. Temunsstupas", "ORG"), ("v4", None, None), ("v5", " ", "Person"), ("v6", "Rosalie Lizaultosis", "Unknown"), ("v7", "x" * 3000, None)]
    e = spark.createDataFrame(ent, "entity_id string, entity_name string, entity_type string, aliases array<string>")
    m = spark.createDataFrame(men, "variant_id string, variant_name string, entity_type string")
    got = {(r["id_a"], r["id_b"]) for r in variants.found(e, m).collect()}
    one = ["e1", "e2", "e7", "v1"]
    assert got == {(a, b) for a in one for b in one if a < b} | {("e3", "v6"), ("e5", "v3")}  # v2 could be either
    assert variants.found(e.limit(0), m.limit(0)).count() == 0


def test_forms_let_all_edits_meet(spark):
    """Against every pair of spellings: edits anywhere in the core, swaps across its middle, edits in given names that are no known ones, several sectors."""
    rng = random.Random(6)
    keys = set()
    for _ in range(60):
        core = "".join(rng.choice("abdefgiklmnoprstuw") for _ in range(rng.randint(3, 15)))
        kind = rng.choice("PPO")
        extra = rng.choice(["", "anna", "antonia", "katharina", "hildegunde"] if kind == "P" else ["", "verlag", "archiv+verlag", "archiv"])
        keys.add((kind, core, extra))
        for _ in range(8):
            c, g = core, extra
            for _ in range(rng.randint(1, 2)):
                p = rng.randrange(len(c))
                c = c[:p] + rng.choice(["", "x", "x" + c[p], c[p + 1 : p + 2] + c[p]]) + c[p + 1 + (rng.random() < 0.3) :]
            if kind == "P" and len(g) > 4 and rng.random() < 0.4:
                p = rng.randrange(len(g))
                g = g[:p] + rng.choice(["", "y", "yz"]) + g[p + 1 :]
            keys.add((kind, c or "x", g))
    keys = sorted(keys)
    for g, h in (("a", "anna"), ("a", "a"), ("a", "alarich")):
        assert set(names.forms("P", "munebral", h)[0]) & set(names.forms("P", "muxebyal", g)[1])
    want = {tuple(sorted(("|".join(a), "|".join(b)))) for a in keys for b in keys if a < b and names.same(a, b)}
    d = spark.createDataFrame([("|".join(k), *k) for k in keys], "key string, kind string, core string, given string")
    got = {tuple(sorted((r["a"], r["b"]))) for r in variants.similar(d).collect()}
    assert got == want and len(want) > 500


def test_mixture(spark):
    rng = random.Random(4)
    rows = [(i, s, " ".join("word" for _ in range(rng.randrange(1, 60)))) for i, s in enumerate(rng.choices(["big", "small", "other", None], [70, 8, 12, 10], k=1500))] + [(9001, "big", None), (9002, "big", "")]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    t = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("none", 0.1, 4), ("zero", None, 1)], "source string, target_weight double, max_repeats int")
    mixed, shares = mixture.mix(d, t, shards=5)
    m = mixed.toPandas()
    assert not m.duplicated(["doc_id", "pass"]).any() and set(m.source) == {"big", "small"} and not set(m.doc_id) & {9001, 9002}
    assert (m.groupby("doc_id").size() <= m.groupby("doc_id").source.first().map({"big": 2, "small": 3})).all()
    s = {r["source"]: r for r in shares.collect()}
    assert abs(s["big"]["actual_share"] - 2 / 3) < 0.01 and abs(s["small"]["actual_share"] - 1 / 3) < 0.01
    assert s["none"]["tokens_taken"] == 0 and s["other"]["target_weight"] == 0.0 and set(m.shard) == set(range(5))
    order = [(r["shard"], r["shuffle_key"]) for r in mixed.collect()]
    assert order == sorted(order)
    again, _ = mixture.mix(d.repartition(7), t, shards=5)
    assert again.subtract(mixed).count() == 0
    empty, rest = mixture.mix(d.limit(0), t)
    assert empty.count() == 0 and rest.count() == 4


def test_split_is_exact():
    rng = np.random.default_rng(1)
    q = mixture.split(np.array([100, 7, 0, 33]), 6, rng)
    assert q.shape == (6, 4) and (q.sum(0) == [100, 7, 0, 33]).all() and q.sum(1).max() - q.sum(1).min() <= 2


PROSE = "Der Vertrag von 1870 regelte, wer die Werft bezahlen sollte. Er galt bis in das Jahr 1901 und wurde dann erneuert. Die Karte war damals in einem sehr schlechten Zustand. "


def test_quality(spark):
    rows = [(i, PROSE * (1 + i % 5), "de") for i in range(300)]
    odd = [
        (1000, "\n".join(f"- Verlag Nummer{i}" for i in range(30)), "DE"), (1001, "a1b2c3d4e5f6" * 40, "de"), (1002, "id;name;jahr\n" + "\n".join(f"{i};Xaver;19{i}" for i in range(10, 60)), None), (1003, "_ " * 200, "de"),
        (1004, None, "de"), (1005, "", "de"), (1006, " \n ", "de"), (1007, "# Titel\n\n" + PROSE.replace(". ", ".\r\n"), "de"), (1008, PROSE * 4000, "de"),
    ]
    d = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string")
    w = spark.createDataFrame([(x,) for x in "der von die er bis in das und wurde dann war einem sehr wer".split()], "word string")
    assert {r["doc_id"] for r in quality.found(d, w).collect()} == {1000, 1001, 1002, 1003}
    s = {r["doc_id"]: r for r in quality.statistics(d, w).where("doc_id >= 1000").collect()}
    assert s[1004]["is_prose"] is None and s[1005]["n_words"] is None and s[1006]["is_prose"] is None and s[1008]["is_prose"]
    assert quality.found(d.limit(0), w).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, small, name):
    from tests.test_oracle import compare

    compare(spark, queries.queries()[name], queries.oracle_sql()[name])


def test_blocks_lose_no_pair():
    """What `same` accepts lies in a block that is asked: initials, given names that are no known ones, several sectors."""
    extras = {"P": ["", "a", "anna", "antonia", "antonja", "bntonia", "ulrike", "ulrika"], "O": ["", "werke", "verein", "verein+werke"], "X": ["", "7", "27"]}
    sides = [(k, "munebral", e) for k in extras for e in extras[k]]
    keys = [(*a, 1, *b) for a in sides for b in sides]
    cut = {f"1|{a}|{b}": 5 for a in extras for b in extras}
    own = {k: dedup.Cells({}, 0.98, {}, cut, []).blocks(k, True)[0] for k in keys}
    cells = dedup.Cells({}, 0.98, {}, cut, sorted(set(own.values())))
    for f in keys:
        asked = cells.blocks(f, True)
        assert asked[0] == own[f] and len(set(asked)) == len(asked)
        assert {own[g] for g in keys if names.same(f[:3], g[:3]) and names.same(f[4:], g[4:])} <= set(asked)
    assert cells.blocks(("P", "munebral", "anna", 2, "X", "b", ""), True) == ["2|P|X"]


def test_index_holds_few_at_once(spark, monkeypatch):
    """However many nodes and queries share a cell, a task holds a part of either; what comes out is as by brute force."""
    for name, most in (("CELL", 150), ("SHARD", 60), ("ASKED", 40)):
        monkeypatch.setattr(dedup, name, most, raising=False)
    written, write = {}, dedup.materialize

    def keep(df, label="t", **options):
        written[label] = write(df, label, **options)
        return written[label]

    monkeypatch.setattr(dedup, "materialize", keep)
    rng = random.Random(3)
    base = [("P", a, rng.choice(["anna", "anna", "anna", "ulrike", "u"]), 1, "X", b, "") for a, b in zip(words_for(250, rng), words_for(250, rng))]
    bent = [(*f[:5], (lambda w, p: w[:p] + "x" + w[p + 1 :])(f[5], rng.randrange(len(f[5]))), "") for f in base for _ in range(2)]
    facts_ = list(dict.fromkeys(base + bent))
    rng.shuffle(facts_)
    when = sorted(rng.choice([0, 0, 1, 2, 3]) for _ in facts_)
    rows = [(i, i, when[i], when[i], *f) for i, f in enumerate(facts_)]
    index = dedup.Index(spark)
    index.append(spark.createDataFrame([r for r in rows if not r[3]], FACTS))
    got = {r["node"]: r["first"] for r in index.add(spark.createDataFrame([r for r in rows if r[3]], FACTS)).collect()}
    ok = lambda f, g: f[3] == g[3] and names.same(f[:3], g[:3]) and names.same(f[4:], g[4:])
    want = {r[0]: min(o[1] for o in rows if o[3] <= r[3] and ok(r[4:], o[4:])) for r in rows if r[3]}
    assert set(got) == set(want) and sum(got[i] == x for i, x in want.items()) >= 0.98 * len(want)
    held = lambda df, column: [len(dedup.Nodes.load(r[column]).keys) for r in df.collect()]
    assert max(held(written["p2-asked"], "asked")) <= 40
    for name in index.state["history"] + index.state["batches"]:
        assert max(held(index._read("shards", name), "data")) <= 60
    merged = dedup.Index(spark, index.path)
    assert merged.cells.there == index.cells.there
    assert {r["node"]: r["first"] for r in merged.add(spark.createDataFrame([(10_000, 10_000, 9, 9, *base[0])], FACTS)).collect()}[10_000] < 10_000
    merged.compact()
    assert max(held(merged._read("shards", merged.state["batches"][0]), "data")) <= 60
