"""Store, text, similarity, statistics, history, streams and sources on small tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tripletide.functions import chunking, extraction, metrics, similarity
from tripletide.functions import text as tx
from tripletide.operators import anomaly, cascade, generators, history, provenance, resolution, store
from tripletide.sources import loaders, sinks
from tripletide.streaming import stream

ENT = "entity_id string, entity_name string, entity_type string, description string, aliases array<string>, embedding array<float>, created_at timestamp_ntz, invalidated_at timestamp_ntz, valid_from timestamp_ntz, valid_until timestamp_ntz, confidence double, validation_status string, source_document string, fingerprint string"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def entity(i, name, kind="Person", **kw):
    row = dict(entity_id=i, entity_name=name, entity_type=kind, description=None, aliases=None, embedding=None, created_at=day(0), invalidated_at=None, valid_from=None, valid_until=None, confidence=0.5, validation_status="accepted", source_document=None, fingerprint="f" + name.lower())
    return tuple((row | kw).values())


def test_store(spark):
    e = spark.createDataFrame([entity("1", "Ada Bonn", confidence=0.9), entity("2", "ada bonn"), entity("3", "Bonn", "Ort", invalidated_at=day(5)), entity("4", "Carl")], ENT)
    r = spark.createDataFrame([("r1", "1", "4", "KENNT", None), ("r2", "1", "3", "KENNT", None), ("r3", "4", "9", "KENNT", None), ("r4", "1", "1", "KENNT", None)], "relation_id string, source_id string, target_id string, relation_type string, invalidated_at timestamp_ntz").withColumn("confidence", F.lit(1.0))
    assert [x["entity_id"] for x in store.find_by_name(e, "BONN").collect()] == ["1", "2"]
    assert store.get_entity(e, "3").count() == 0 and store.get_entity(e, "3", True).count() == 1
    assert sorted(x["entity_id"] for x in store.duplicates(e).collect()) == ["1", "2"]
    assert sorted(x["relation_id"] for x in store.creatable(r, e).collect()) == ["r1", "r4"]
    assert [x["entity_id"] for x in store.neighbours(e, r, "1").collect()] == ["4"]
    assert store.both_directions(r).where("relation_id = 'r4'").count() == 2
    at = lambda n: {x["entity_id"] for x in store.state_at(e, F.lit(day(n))).collect()}
    assert at(-1) == set() and at(4) == {"1", "2", "3", "4"} and at(5) == {"1", "2", "4"}
    gone = {x["entity_id"]: x["description"] for x in store.invalidate(e, F.col("entity_id").isin("3", "4"), F.lit(day(9)), "why").collect()}
    assert gone["4"] == " [why]" and gone["3"] is None


def test_merge_and_resolve(spark):
    e = spark.createDataFrame(
        [entity("1", "Einstein", confidence=0.9, aliases=["E."], fingerprint="x"), entity("2", "Albert Einstein", confidence=0.95, aliases=[None, "E."], fingerprint="x"), entity("3", "Albert Einstien", fingerprint="y"), entity("4", "Niels Bohr", fingerprint="z")], ENT
    )
    m = {r["fingerprint"]: r for r in resolution.merge(e).collect()}
    assert (m["x"]["entity_name"], m["x"]["entity_id"], m["x"]["confidence"], m["x"]["aliases"]) == ("Albert Einstein", "2", 0.95, ["E.", "Einstein"])
    got = {(r["a"], r["b"]) for r in resolution.resolve(e).collect()}
    assert ("2", "3") in got and not any("4" in p for p in got)


def test_names():
    assert similarity.jaro_winkler("meyer", "meier") == pytest.approx(0.8933, abs=1e-4)
    assert similarity.jaro_winkler("albert einstein", "a. einstein") == pytest.approx(0.767727, abs=1e-6)
    assert similarity.jaro_winkler("abcdefgh", "abzzzzzzzz") == pytest.approx(0.586667, abs=1e-6)
    assert similarity.jaro_winkler("", "") == 1.0 and similarity.jaro_winkler("a", "") == 0.0
    assert similarity.cologne("Meyer") == similarity.cologne("Meier") and similarity.cologne("Müller") and similarity.cologne("") == ""
    assert similarity.cologne("ab p") and similarity.cologne("Lob") == "51" and similarity.cologne("Top") == "23"
    assert similarity.name_similarity(" Ada ", "ada") == 1.0


def test_text(spark):
    d = spark.createDataFrame([("The cat!", "cat"), ("", ""), ("dog", "cat"), ("Ja", "yes"), (None, "x")], "a string, b string")
    s = tx.token_f1(F.col("a"), F.col("b"))
    got = [(r["f"], r["g"]) for r in d.select(s["f1"].alias("f"), tx.token_f1(F.col("a"), F.col("b"), True)["f1"].alias("g")).collect()]
    assert got == [(1.0, 1.0), (0.0, 1.0), (0.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    n = spark.createDataFrame([("He is here",), ("one two three",), ("",), (None,)], "t string").select(tx.negate(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in n] == ["He is not here", "one two not three", "", None]
    c = spark.createDataFrame([("Albert Einstein was born in Ulm.",), ("too short",), (None,)], "t string").select(tx.claim_parts(F.col("t")).alias("c")).collect()
    assert tuple(c[0]["c"]) == ("Albert Einstein", "WAS", "born in Ulm") and c[1]["c"] is None and c[2]["c"] is None


def test_statistics(spark):
    s = spark.createDataFrame([(1, 0.0, 1), (2, 0.1, 0), (3, 1.0, 1), (4, 0.95, 1), (5, None, 1)], "id bigint, p double, y int")
    assert {r["bin"]: r["n"] for r in metrics.calibration_bins(s).collect()} == {1: 1, 10: 2}  # 0 falls into no bin
    assert {r["bin"]: r["n"] for r in metrics.histogram(s, "p").collect() if r["n"]} == {0: 1, 1: 1, 9: 2}  # 1 falls into the last
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "name string, p double")
    assert {r["name"] for r in metrics.corrections(t).where("holm").collect()} == {"a"}
    w = spark.createDataFrame([(0, 0), (5, 8)], "k int, n int").select(metrics.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert tuple(w[0]["w"]) == (0.0, 0.0) and tuple(w[1]["w"]) == pytest.approx((0.306, 0.863), abs=1e-3)
    assert metrics.exact_binomial(0, 0) == 1.0 and metrics.exact_binomial(1, 9) == pytest.approx(0.021484, abs=1e-6)
    c = spark.createDataFrame([(1.0, 0.5), (0.9, 0.9), (0.0, 1.0)], "a double, b double")
    got = c.select(*[F.round(resolution.combine(F.col("a"), F.col("b"), m), 6).alias(m) for m in ("multiply", "min", "weighted_avg", "bayesian", "other")]).collect()
    assert tuple(got[0]) == (0.5, 0.5, 0.8, 1.0, 0.8) and got[1]["bayesian"] == pytest.approx(0.81 / 0.82, abs=1e-6) and got[2]["bayesian"] is None
    d = spark.createDataFrame([(i, "accept" if i % 3 else "reject", ("accept", "reject", "review")[i % 3]) for i in range(30)], "id int, truth string, verdict string")
    for name in metrics.CONVENTIONS:
        r = metrics.confusion(d, name).first()
        assert r["n"] == 30 and 0 <= r["f1"] <= 1
    b = metrics.bootstrap(spark.createDataFrame([(i, i % 4 > 0) for i in range(200)], "id bigint, right boolean"), 100).first()
    assert b["low"] < 0.75 < b["high"] and b["mean"] == pytest.approx(0.75, abs=0.02)
    assert metrics.auc(metrics.curve(s)).first()["roc_auc"] == pytest.approx(2 / 3, abs=0.01)


def test_history(spark):
    schema = "update_id bigint, item_id string, recorded_at timestamp, valid_from timestamp, invalidated_at timestamp, item_name string, description string, validation_status string"
    row = lambda u, i, rec, v, n, inv=None: (u, i, day(rec), day(v) if v is not None else None, day(inv) if inv is not None else None, n, None, "ok")
    u = spark.createDataFrame(
        [row(1, "a", 1, 0, "x"), row(1, "a", 1, 0, "x"), row(2, "a", 11, 10, "x"), row(3, "a", 21, 20, "wrong"), row(4, "a", 30, 20, "y"), row(5, "a", 41, 40, "y", 45), row(6, "a", 51, 50, "y"), row(7, "b", 1, 5, None), row(8, "b", 1, None, "q"), row(9, None, 1, 1, "q")], schema
    )
    got = {(r["item_id"], (r["period_from"] - dt.datetime(2024, 1, 1)).days, (r["period_until"] - dt.datetime(2024, 1, 1)).days if r["period_until"] else None) for r in history.versions(u).collect()}
    assert got == {("a", 0, 20), ("a", 20, 45), ("a", 50, None), ("b", 5, None)}
    assert history.versions(u.limit(0)).count() == 0
    led = history.ledger(u.withColumn("extra", F.lit(1)).withColumn("valid_until", F.lit("clash"))).where("item_id = 'a'")
    assert led.where("current").count() == 5 and led.where("not current and update_id = 3").count() == 1 and led.where("stated_valid_until = 'clash'").count() == led.count()


def test_ledger_splits_intervals_at_late_updates(spark):
    schema = "update_id bigint, item_id string, recorded_at timestamp_ntz, valid_from timestamp_ntz, invalidated_at timestamp_ntz"
    u = spark.createDataFrame([(1, "a", day(1), day(0), None), (2, "a", day(2), day(30), None), (3, "a", day(3), day(10), None), (4, "a", day(4), day(10), day(20)), (5, "b", None, day(1), None)], schema)
    n = lambda x: (x - day(0)).days if x else None
    got = {(r["update_id"], *(n(r[c]) for c in ("valid_from", "valid_until", "recorded_from", "recorded_until")), r["current"]) for r in history.ledger(u).collect()}
    assert got == {
        (1, 0, None, 1, 2, False), (1, 0, 30, 2, 3, False), (1, 0, 10, 3, None, True), (2, 30, None, 2, None, True),
        (3, 10, 30, 3, 4, False), (4, 10, 20, 4, None, True), (5, 1, None, None, None, True),
    }
    assert history.ledger(u.limit(0)).count() == 0


@pytest.mark.parametrize("order", ["late", "reverse", "mixed"])
def test_ledger_against_every_state_of_knowledge(spark, order):
    """What the ledger says of each recorded moment is what the statements up to it say; one item lies in several segments."""
    rng = random.Random(order)
    rows = []
    for i in range(400):
        item = "hot" if i % 4 else f"i{i % 12}"
        v = {"late": i if rng.random() < 0.7 else rng.randrange(i + 1), "reverse": 500 - i, "mixed": rng.randrange(150)}[order]
        rows.append((i, item, None if i < 3 else day(i // 2), day(v), day(v + rng.randrange(9)) if rng.random() < 0.1 else None))
    rng.shuffle(rows)
    u = spark.createDataFrame(rows + rows[:9], "update_id bigint, item_id string, recorded_at timestamp_ntz, valid_from timestamp_ntz, invalidated_at timestamp_ntz")
    led = [r.asDict() for r in history.ledger(u).collect()]
    first = dt.datetime.min
    at = lambda x: x or first
    for item in ("hot", "i0", "i8"):
        for moment in [first, *(day(x) for x in range(0, 200, 23))]:
            known = {}
            for r in sorted((r for r in rows if r[1] == item and at(r[2]) <= moment), key=lambda r: (at(r[2]), r[0])):
                known[r[3]] = r
            order_ = sorted(known)
            want = {(known[v][0], v, min([x for x in (known[v][4], nxt) if x], default=None)) for v, nxt in zip(order_, [*order_[1:], None])}
            got = [(r["update_id"], r["valid_from"], r["valid_until"]) for r in led if r["item_id"] == item and at(r["recorded_from"]) <= moment and (r["recorded_until"] is None or moment < r["recorded_until"])]
            assert len(got) == len(set(got)) and set(got) == want


def test_history_hot_item_crosses_segments(spark):
    rows = spark.range(4000).selectExpr("id update_id", "if(id % 3 = 0, concat('i', id % 50), 'hot') item_id", "timestamp'2020-01-01' + make_interval(0,0,0,0,id) recorded_at", "timestamp'2020-01-01' + make_interval(0,0,0,0,id) valid_from", "cast(null as timestamp) invalidated_at", "concat('v', floor(id / 7)) item_name", "'d' description", "'ok' validation_status")
    got = {tuple(r) for r in history.found(rows).collect()}
    pdf = rows.toPandas().sort_values(["item_id", "valid_from"])
    want = set()
    for i, g in pdf.groupby("item_id"):
        g = g[g.item_name != g.item_name.shift()]
        f = list(g.valid_from.dt.strftime("%Y-%m-%d %H:%M:%S"))
        want |= {(i, a, b) for a, b in zip(f, f[1:] + [""])}
    assert got == want


def test_provenance(spark, make_facts):
    s = spark.createDataFrame([("wikipedia_x",), ("blog1",), (None,), ("zeitung",)], "x string").select(provenance.initial_score(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in s] == [0.9, 0.3, 0.5, 0.5]
    e = make_facts(*[(i, "a", "Person", "KENNT", "b", "Person", 1.0, f"d{i}") for i in range(4)], batch=0)
    b = make_facts((11, "a", "Person", "KENNT", "b", "Person", 1.0, "blog"), (12, "a", "Person", "KENNT", "c", "Person", 1.0, None))
    assert {r["seq"]: r["adjusted"] for r in provenance.confidence(b, e).collect()} == {11: 0.6, 12: 0.35}
    d = spark.createDataFrame([("s", i, True, False) for i in range(5)] + [("t", i, True, False) for i in range(4)], "doc string, seq bigint, accepted boolean, conflict boolean")
    assert {r["doc"]: r["reliability"] for r in provenance.learn(d).collect()} == {"s": 0.55, "t": 0.5}


def test_anomaly_and_trigger(make_facts):
    e = make_facts(*[(i, f"p{i}", "Person", "KENNT", f"q{i}", "Person") for i in range(20)], *[(100 + i, "hub", "Person", "KENNT", f"q{i}", "Person") for i in range(30)], batch=0)
    b = make_facts((500, "hub", "Person", "KENNT", "new", "Person"), (501, "p1", "Person", "KENNT", "new", "Person"))
    assert [r["seq"] for r in anomaly.degree(b, e).collect()] == [500]
    m = make_facts((1, "s", "Person", "VERHEIRATET_MIT", "o", "Person"), batch=0)
    t = make_facts((11, "s", "Person", "MUTTER_VON", "o", "Person", 0.9), (12, "s", "Person", "KENNT", "o", "Person", 0.1), (13, "x", "Person", "LEITET", "y", "Organisation", 0.5))
    assert {r["seq"]: r["reason"] for r in cascade.trigger(t, m).collect()} == {11: "role_conflict", 13: "low_confidence"}


def test_router(spark):
    one = spark.createDataFrame([(1, "FAIL", 0.3), (2, "PASS", 1.0), (3, "PASS", 1.0), (4, "PASS", 1.0)], "seq bigint, outcome string, confidence double")
    two = spark.createDataFrame([(2, False, 0.1, 0, 1.0), (3, True, 0.5, 1, 0.5), (4, True, 0.5, 0, 0.9)], "seq bigint, has_text boolean, adjusted double, n_conflicts int, confidence2 double")
    tri = spark.createDataFrame([], "seq bigint, reason string")
    got = {r["seq"]: (r["status"], r["decided_by"]) for r in cascade.route(one, two, tri).collect()}
    assert got == {1: ("rejected", "rules"), 2: ("accepted", "fast_path"), 3: ("needs_review", "stage3"), 4: ("accepted", "stage2")}
    yes = lambda df: df.select("seq", F.lit("PASS").alias("outcome"), F.lit(0.8).alias("confidence"))
    assert {r["seq"]: r["status"] for r in cascade.route(one, two, tri, judge=yes).collect()}[3] == "accepted"
    v = spark.createDataFrame([(1, "accept", 0.9), (1, "accept", 0.8), (2, "reject", 0.9), (3, "human_review", 1.0), (4, "accept", 0.5)], "seq bigint, action string, confidence double")
    assert {r["seq"]: r["outcome"] for r in cascade.vote(v).collect()} == {1: "PASS", 2: "FAIL", 3: "UNCERTAIN", 4: "UNCERTAIN"}


@pytest.mark.parametrize("strategy", ["fixed", "sentence", "paragraph", "semantic", "sliding"])
def test_chunks(spark, strategy):
    text = "\n\n".join(" ".join(f"Satz {i}.{j} steht hier ohne Ende." for j in range(12)) for i in range(8)) + "\n\n" + "x" * 5000
    d = spark.createDataFrame([(1, text), (2, None), (3, "  "), (4, "kurz"), (5, "a" * 100_000)], "doc_id bigint, text string")
    c = chunking.chunk(d, strategy).toPandas()
    one = c[c.doc_id == 1]
    assert len(one) > 2 and set(c.doc_id) <= {1, 4, 5} and (one.start_char < one.end_char).all() and one.end_char.max() <= len(text)
    assert list(one.chunk_index) == list(range(len(one)))


def test_extraction(spark):
    d = spark.createDataFrame([(1, 0, "Marie Curie was born in Warsaw. Marie Curie received the Nobel Prize."), (2, 0, None)], "doc_id bigint, chunk_index int, chunk string")
    r = extraction.relations(d)
    assert ("Marie Curie", "GEBOREN_IN", "Warsaw") in {(x["subject"], x["predicate"], x["object"]) for x in r.collect()}
    t = extraction.build(r, extraction.entities(d, r))
    assert t.where("predicate = 'GEBOREN_IN'").count() == 1
    m = extraction.with_model(d.where("chunk is not null"), lambda ts: [[("a", "p", "b", 0.9)] for _ in ts])
    assert m.count() == 1

    def broken(ts):
        raise ValueError

    assert extraction.with_model(d, broken).count() == 0


def test_generators(spark, small):
    from tripletide import kg

    f = kg.facts(spark, small)
    a, b = (generators.mutate(f.repartition(n)).orderBy("seq").collect() for n in (2, 7))
    assert a == b and {r["category"] for r in a} == set(generators.CATEGORIES)
    ev = f.selectExpr("seq id", "'supports' category", "s_name key")
    for s in ("random", "interleaved", "temporal", "clustered", "adversarial"):
        assert generators.shuffle(ev, s).count() == ev.count()


def test_stream_equals_batch(spark, tmp_path, make_facts):
    src, graph, out = (str(tmp_path / n) for n in ("in", "graph", "out"))
    make_facts((0, "seed", "Person", "KENNT", "x", "Person"), batch=0).withColumn("batch_no", F.lit(-1)).write.partitionBy("batch_no").parquet(graph)
    facts = make_facts(*[(i, f"s{i % 5}", "Person", "KENNT", f"o{i}", "Person") for i in range(1, 21)])
    facts.repartition(2).write.parquet(src)
    decide = lambda b, e: b.select("seq", F.when(F.col("seq") % 2 == 0, "accepted").otherwise("rejected").alias("status"))
    q = stream.cascade(stream.read_parquet(spark, src, facts.schema, 1), graph, decide, str(tmp_path / "cp"), out)
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 20 and spark.read.parquet(graph).where("batch_no >= 0").count() == 10
    ev = spark.createDataFrame([(1, day(0), 1, "a", 1.0, None), (2, day(0), 1, "a", 2.0, None), (3, None, 1, "a", 2.0, None)], stream.EVENTS)
    assert [tuple(r)[1:] for r in stream.windows(ev).collect()] == [("a", 2, 3.0)]
    assert sorted(r["batch_no"] for r in stream.micro_batches(facts.select("seq"), 8).collect()) == [0] * 8 + [1] * 8 + [2] * 4


def test_sources(spark, tmp_path):
    h = {"id": "h1", "question": "Who is compared?", "answer": "Ulm", "type": "bridge", "level": "hard", "supporting_facts": {"title": ["A", "B", "Z"], "sent_id": [0, 9, 0]}, "context": {"title": ["A", "B", "C"], "sentences": [["a0", "a1"], ["b0"], ["c0"]]}}
    m = {"id": "m1", "question": "q", "answer": "x", "answer_aliases": [], "answerable": True, "paragraphs": [{"title": "A", "paragraph_text": "t", "is_supporting": True}], "question_decomposition": [{"question": "q", "answer": "a", "paragraph_support_idx": 0}] * 3}
    v = [{"id": str(i), "claim": "c d", "label": l, "evidence": [["doc", "0", "text"]]} for i, l in enumerate(["NOT ENOUGH INFO", "SUPPORTS", "REFUTES", "SUPPORTS"])]
    for n, rows in (("h", [h]), ("m", [m]), ("f", v)):
        (tmp_path / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    q = loaders.load(spark, "hotpotqa", str(tmp_path / "h.json"))
    r = q.first()
    assert [x["text"] for x in r["supporting"]] == ["a0", "", ""] and r["gold_titles"] == ["A", "B", "Z"] and r["question_type"] == "bridge"
    assert [(x["subject"], x["object"]) for x in loaders.gold_triples(q).collect()] == [("A", "B"), ("B", "Z"), ("A", "Ulm")]
    assert [x["object"] for x in loaders.violating_triples(q).collect()] == ["C"]
    assert loaders.musique(spark, str(tmp_path / "m.json")).first()["question_type"] == "compositional"
    assert loaders.fever(spark, str(tmp_path / "f.json"), sample=2).count() == 1  # cut first, then dropped
    assert loaders.balanced(loaders.fever(spark, str(tmp_path / "f.json")), 10).count() == 2
    with pytest.raises(ValueError):
        loaders.load(spark, "none", "")
    t = {"entities": spark.range(3), "relations": spark.range(4)}
    p = str(tmp_path / "snap")
    assert sinks.load_snapshot(spark, p, list(t)) is None
    for _ in range(2):
        sinks.save_snapshot(t, p)
    assert sinks.load_snapshot(spark, p, list(t))["relations"].count() == 4
    sinks.write_metrics(sinks.flatten(spark.range(5).selectExpr("count(*) n"), "graph"), str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first()["value"] == "5"
    lines = spark.createDataFrame([("f", 1, "=== dataset: fever"), ("f", 2, "stage=nli REJECTED ms=2.5"), ("f", 3, "noise")], "file string, line int, value string")
    assert [tuple(x) for x in loaders.log_decisions(lines).collect()] == [(2, "fever", "nli", "REJECTED", 2.5)]
