"""Baselines, experiments, prompts, draws and segments on small tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tripletide import config
from tripletide.functions import draws, prompts
from tripletide.functions import text as tx
from tripletide.operators import baselines, conflicts, embeddings, experiments, generators, history, provenance, resolution, store
from tripletide.sources import loaders, sinks


def test_draws_are_even_and_repeatable(spark):
    d = spark.range(20000).select("id", draws.uniform(7, "id").alias("u"), draws.uniform(8, "id").alias("v"))
    r = d.agg(F.avg("u").alias("m"), F.stddev("u").alias("s"), F.corr("u", "v").alias("c"), F.min("u").alias("lo"), F.max("u").alias("hi")).first()
    assert abs(r.m - 0.5) < 0.01 and abs(r.s - 0.2887) < 0.01 and abs(r.c) < 0.03 and r.lo >= 0 and r.hi < 1
    nxt = d.select("u", F.lead("u").over(Window.orderBy("id")).alias("n")).agg(F.corr("u", "n")).first()[0]
    assert abs(nxt) < 0.03
    assert spark.sql("select cast(null as bigint) id").select(draws.draw(1, "id")).first()[0] is None
    assert draws.draw_sql(7, "id").count("id") == 2 ** 2


def test_running_and_following_cross_segments(spark):
    rows = [("hot" if i % 5 else f"k{i % 3}", i, i % 7) for i in range(900)] + [(None, i, 1) for i in range(5)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "k string, o bigint, x bigint")
    got = {(r["k"], r["o"]): (r["n"], r["s"]) for r in history.running(history.segment(d, "k", "o"), "k", "o", {"n": F.lit(1), "s": F.col("x")}).collect()}
    nxt = {(r["k"], r["o"]): r["y"] for r in history.following(d, "k", "o", {"y": "o"}, ring=True).collect()}
    for k in ("hot", "k0", "k1", "k2", None):
        own = sorted(r[1:] for r in rows if r[0] == k)
        s = 0
        for n, (o, x) in enumerate(own):
            s += x
            assert got[k, o] == (n + 1, s) and nxt[k, o] == own[(n + 1) % len(own)][0]


def test_interleaved_order_is_round_robin(spark):
    d = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 100 else "c", "k") for i in range(105)], "id bigint, category string, key string")
    order = [r["category"] for r in generators.shuffle(d, "interleaved").orderBy("arrival").collect()]
    assert all(set(order[i : i + 3]) == {"a", "b", "c"} for i in range(0, 15, 3)) and set(order[25:]) == {"a"}
    other = [r["id"] for r in generators.shuffle(d, "random").orderBy("arrival").collect()]
    assert sorted(other) == list(range(105)) and other != list(range(105))


def test_learning_a_hot_source(spark):
    rows = [("unknown" if i % 3 else None, i, (i * 7) % 11 < 6 if i % 13 else None, i % 5 == 0) for i in range(700)]
    got = provenance.learn(spark.createDataFrame(rows, "doc string, seq bigint, accepted boolean, conflict boolean")).collect()
    score, n, a, c = 0.5, 0, 0, 0
    for _, _, ok, con in rows:
        n, a, c = n + 1, a + bool(ok), c + con
        if n >= 5 and ok is not None:
            score = 0.9 * score + 0.1 * (a / n * (1 - 0.5 * c / n))
    assert [r["doc"] for r in got] == ["unknown"] and got[0]["reliability"] == pytest.approx(score, abs=2e-6)


def test_rules_and_embedding(spark):
    rows = [(1, "FAIL", 0.9, "d", 0.9, 1.0), (2, "PASS", 1.0, "d", None, None), (3, "PASS", 1.0, None, 0.6, 1.0), (4, "PASS", 1.0, "", 0.1, 1.0), (5, "UNCERTAIN", 0.6, "d", 0.5, 0.8), (6, "UNCERTAIN", 0.6, "d", 0.15, 0.8)]
    d = spark.createDataFrame(rows, "seq bigint, outcome string, confidence double, doc string, similarity double, confidence2 double")
    got = {r["seq"]: (r["accepted"], r["confidence"], r["stage"]) for r in baselines.rules_and_embedding(d).collect()}
    assert got == {1: (False, 0.9, 1), 2: (True, 1.0, 1), 3: (True, 0.825, 2), 4: (False, 0.375, 2), 5: (True, 0.7, 2), 6: (False, 0.35, 2)}
    free = {r["seq"]: r["accepted"] for r in baselines.rules_and_embedding(d, penalty=False, verification=False).collect()}
    assert free == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True}
    assert baselines.rules_and_embedding(d.limit(0)).count() == 0


def test_similar_facts(spark):
    kind = "seq bigint, s_id string, pred string, o_id string, embedding array<float>"
    e = spark.createDataFrame([(1, "a", "P", "b", [1.0, 0.0]), (2, "a", "P", "c", None)], kind)
    b = spark.createDataFrame([(11, "a", "Q", "z", [1.0, 0.1]), (12, "x", "P", "b", [0.0, 1.0]), (13, "x", "Q", "y", [1.0, 0.0]), (14, "x", "P", "b", None)], kind)
    assert {r["seq"]: r["accepted"] for r in baselines.similar_facts(b, e).collect()} == {11: False, 12: True, 13: True, 14: True}


def test_phases_store_what_was_accepted(spark, make_facts):
    e = make_facts((1, "a", "Person", "KENNT", "b", "Person"), batch=0)
    f = make_facts((2, "b", "Person", "KENNT", "c", "Person"), (3, "c", "Person", "KENNT", "d", "Person"), (4, "q", "Person", "KENNT", "r", "Person")).withColumn("gold", F.expr("case when seq < 3 then true when seq = 3 then false end"))

    def reachable(batch, edges):
        known = edges.select(F.col("o_id").alias("s_id")).distinct().withColumn("ok", F.lit(True))
        return batch.join(known, "s_id", "left").select("seq", F.when(F.col("ok"), "accepted").otherwise("rejected").alias("status"))

    assert {(r["phase"], r["seq"]): r["status"] for r in experiments.two_phase(f, e, reachable).collect()} == {("good", 2): "accepted", ("bad", 3): "accepted"}
    alone = experiments.phases([("bad", f.where("seq = 3"))], e, reachable)
    assert [r["status"] for r in alone.collect()] == ["rejected"]
    verdicts, graph = experiments.ingest(f.drop("gold"), e, reachable)
    assert graph.count() == 2 and verdicts.where("status = 'rejected'").count() == 2
    pos = experiments.by_position(f.drop("gold"), 0.4)
    assert [r["seq"] for r in pos.where("seed").collect()] == [2] and pos.count() == 3


def test_counts_labels_and_effects(spark):
    p = spark.createDataFrame([(2, 0.8, None), (3, 0.6, None), (4, 0.5, 0.9)], "phase int, confidence double, f1 double")
    assert {r["metric"]: r["value"] for r in experiments.effectiveness(p).collect()} == {"missing_source_penalty_effectiveness": 0.25, "contradiction_detection_f1": 0.9, "cross_question_detection_f1": None, "fake_source_detection_effectiveness": None}
    c = spark.createDataFrame([("x", 2, 1, 0, 3)], "label string, tp int, fp int, tn int, fn int")
    assert sorted((r["y_true"], r["y_pred"]) for r in experiments.labels(c).collect()) == [(0, 1), (1, 0), (1, 0), (1, 0), (1, 1), (1, 1)]
    s = experiments.extrinsic_summary(spark.createDataFrame([("a", "accepted"), ("a", "rejected"), ("b", "accepted")], "example string, status string"))
    assert {(r["example"], r["n"], r["accepted"]) for r in s.collect()} == {("a", 2, 1), ("b", 1, 1), (None, 3, 2)}


def test_models_are_asked_once_and_may_fail(spark):
    d = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "id int, prompt string")

    def model():
        tries = []

        def talk(texts):
            tries.append(1)
            if len(tries) == 1:
                raise RuntimeError("busy")
            return [f'well: {{"is_true": true, "confidence": 0.{len(texts)}}}' if t else "?" for t in texts]

        return talk

    got = {r["id"]: r["response"] for r in prompts.ask(d.repartition(1), model).collect()}
    assert got[1] == got[2] is not None and got[3] is None and got[4] == "?"
    broken = prompts.ask(d, lambda: lambda texts: 1 / 0)
    assert broken.where("response is not null").count() == 0 and broken.count() == 4
    x = spark.createDataFrame([('a {"consistent": false}',), ("no",), (None,)], "r string").select(prompts.consistent(F.col("r")).alias("x"), prompts.verified(F.col("r")).alias("y"))
    assert [(r["x"]["outcome"], r["y"]["action"]) for r in x.collect()] == [("FAIL", "human_review"), ("UNCERTAIN", "human_review"), ("UNCERTAIN", "human_review")]
    e = spark.createDataFrame([('facts: [{"subject": "a", "predicate": "P", "object": "b", "confidence": 0.5}]',), ("[",)], "r string").select(prompts.extracted(F.col("r")).alias("x")).collect()
    assert e[0]["x"][0]["object"] == "b" and e[1]["x"] == []
    assert '"subject": "a"' in prompts.examples([("t", [("a", "P", "b")])])


def test_enhanced_claims(spark):
    cases = {"The Ada Bonn was born in Ulm.": ("Ada Bonn", "WAS", "born in Ulm"), "Ada Bonn likes very old maps!": ("Ada Bonn", "STATES", "likes very old maps"), "Ada Bonn Ulm": ("Ada", "CLAIMS", "Bonn Ulm"), "two words": None, None: None, "  ": None}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.enhanced_claim(F.col("t")).alias("c"))
    assert {r["t"]: tuple(r["c"]) if r["c"] else None for r in d.collect()} == cases


def test_conflicts_take_real_alternatives(spark, make_facts):
    f = make_facts((1, "Ada Bonn", "Person", "GEBOREN_IN", "Ulm", "Ort"), (2, "Bo", "Person", "GEBOREN_IN", "Bonn 1870", "Ort"), (3, "C", "Person", "LEITET", "Werk", "Organisation"), (4, None, "Person", "LEITET", "Werk", "Organisation"))
    g = conflicts.generate(f).collect()
    of = lambda kind: {(r["seq"], r["o_name"]) for r in g if r["kind"] == kind}
    assert of("factual") == {(1, "Bonn 1870"), (2, "Ulm"), (3, "not-Werk")} and len(of("modality")) == 12 and of("numerical") == {(2, "Bonn 1870"), (2, "Bonn the 1870s"), (2, "Bonn about 1870")}
    assert {r["s_name"] for r in g if r["kind"] == "entity_variant"} == {"A. Bonn", "Bonn, Ada"}
    assert conflicts.generate(f.limit(0)).count() == 0


def test_resolution_looks_up_rare_words(spark):
    rows = [("1", "Ada Bonnhaus", "Person", [1.0, 0.0]), ("2", "Bonnhaus Ada", "Person", None), ("3", "Ada Bonnhauss", "Person", [1.0, 0.0]), ("4", "Ada Bonnhaus", "Person", [0.0, 1.0]), ("5", "ox", "Person", None), ("6", "ox", "Ort", None), ("7", None, "Ort", None), ("8", "Ada Kern", "Person", None)]
    e = spark.createDataFrame([(i, n, t, v, None) for i, n, t, v in rows], "entity_id string, entity_name string, entity_type string, embedding array<float>, invalidated_at timestamp_ntz")
    got = {(r["a"], r["b"]) for r in resolution.resolve(e).collect()}
    assert ("1", "3") in got and all("8" not in p and "6" not in p for p in got)
    m = {r["entity_id"]: r["id"] for r in resolution.members(e).collect()}
    assert m["4"] == "1" and m["5"] == "5" and m["6"] == "6" and "7" not in m
    assert resolution.resolve(e.limit(0)).count() == 0


def test_results_of_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"datasets": [{"dataset": "x", "tp": 1}, {"dataset": "y", "tp": 2}]}')
    (tmp_path / "b.json").write_text('{"dataset": "z", "tp": 3}')
    got = {(r["label"], r["dataset"], r["tp"]) for r in loaders.results(spark, {"a": str(tmp_path / "a.json"), "b": str(tmp_path / "b.json")}).collect()}
    assert got == {("a", "x", 1), ("a", "y", 2), ("b", "z", 3)}
    with pytest.raises(ValueError):
        loaders.results(spark, {})


def test_translations_learn_what_goes_together(spark, make_facts):
    rows = [(i * 10 + j, f"p{i}{j}", "Person", "WOHNT_IN", f"city{i}", "Ort") for i in range(4) for j in range(8)]
    nodes, relations, losses = embeddings.train(make_facts(*rows, (999, None, "Person", "X", "q", "Ort")), dim=16, rate=0.05, epochs=200)
    assert sum(losses[-10:]) < 0.5 * sum(losses[:10]) and set(relations) == {"WOHNT_IN"}
    right = [embeddings.plausibility((f"p{i}{j}", "WOHNT_IN", f"city{i}"), nodes, relations) for i in range(4) for j in range(8)]
    wrong = [embeddings.plausibility((f"p{i}{j}", "WOHNT_IN", f"city{(i + 1) % 4}"), nodes, relations) for i in range(4) for j in range(8)]
    assert sum(a > b for a, b in zip(right, wrong)) >= 30
    assert embeddings.plausibility(("nobody", "WOHNT_IN", "city1"), nodes, relations) is None and embeddings.train(make_facts(*rows).limit(0)) == ({}, {}, [])


def test_stores_open_empty_or_from_a_folder(spark, tmp_path):
    e, r = store.open_store(spark)
    assert e.count() == r.count() == 0 and store.open_store(spark, str(tmp_path / "none"))[0].columns == e.columns
    full = spark.createDataFrame([("x", "X")], "entity_id string, entity_name string")
    sinks.save_snapshot({"entities": full, "relations": r}, str(tmp_path / "s"))
    assert store.open_store(spark, str(tmp_path / "s"))[0].count() == 1


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"consistency": {"high": 0.9}, "graph": null, "other": {"x": 1}}')
    c = config.load(str(tmp_path / "c.json"), {"TRIPLETIDE_CONSISTENCY_HIGH": "0.8", "TRIPLETIDE_LLM_MODEL": "small", "TRIPLETIDE_OTHER_X": "2"})
    assert c.threshold("high", 0.5) == 0.8 and c.threshold("medium", 0.7) == 0.7 and c.llm == {"model": "small"} and c.graph == {}
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "c.json"), {"TRIPLETIDE_CONSISTENCY_HIGH": "7"}).threshold("high", 0.5)
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("consistency:\n  high: 0.75\n")
    assert config.load(str(tmp_path / "c.yaml"), {}).threshold("high", 0.5) == 0.75


def test_documents_are_ingested(spark, make_facts):
    e = make_facts((1, "a", "Person", "KENNT", "b", "Person"), batch=0)
    docs = spark.createDataFrame([(1, "Marie Curie was born in Warsaw. Marie Curie was born in Warsaw."), (2, None), (3, "")], "doc_id bigint, text string")
    yes = lambda b, _: b.select("seq", F.lit("accepted").alias("status"))
    v, graph = experiments.ingest_documents(docs, e, yes)
    assert v.count() == v.select("seq").distinct().count() and graph.count() == 1 + v.count()
    assert experiments.ingest_documents(docs.limit(0), e, yes)[1].count() == 1


def test_many_questions_at_once(spark):
    from tripletide.functions import qa

    t = spark.createDataFrame([(1, "Ada", "LEITET", "Werk", None, "accepted"), (2, "Bo", "LEITET", "Haus", "x" * 200, "accepted"), (3, "Cy", "LEITET", "Werk", None, "rejected"), (1, "Ada", "LEITET", "Werk", None, "accepted")], "seq bigint, subject_name string, predicate string, object_name string, source_text string, validation_status string")
    q = spark.createDataFrame([(1, "leitet Haus?"), (2, "nothing"), (3, None), (4, "LEITET werk")], "id int, question string")
    got = {r["id"]: (r["answer"].split(" [")[0], r["n_facts"]) for r in qa.answers(q, t).collect()}
    # By whole words "haus?" is none, so the earlier of two equal facts comes first; an answer needs two of the question's words in its line.
    assert got == {1: ("Bo LEITET Haus", 2), 2: ("", 0), 3: ("", 0), 4: ("Ada LEITET Werk", 2)}
    assert {(r["variant"], r["id"]): r["n_facts"] for r in qa.end_to_end(q, t).collect()}["without", 4] == 3


def test_resolution_meets_in_tiles(spark, monkeypatch):
    """As many pairs from small tiles as pair by pair; what a frequent word brings together is not written."""
    import random

    from tripletide.functions import similarity as sim

    rnd = random.Random(3)
    stems = ["Gravi", "Gravit", "Relat", "Relativ", "Farben", "Zahlen", "Rekla", "Rekal"]
    rows = [(f"{i:03}", f"{rnd.choice(stems)}{rnd.choice('aeiou')}{rnd.choice('bdgkl')}-{rnd.choice(['Theorie', 'Theorei', 'Ansatz'])}", "Konzept", [None, [], [1.0, rnd.random()], [rnd.random(), 1.0], [0.0, 0.0], [1.0]][rnd.randrange(6)]) for i in range(160)]
    e = spark.createDataFrame([(i, n, t, v, None) for i, n, t, v in rows], "entity_id string, entity_name string, entity_type string, embedding array<float>, invalidated_at timestamp_ntz")
    whole = sorted(map(tuple, resolution.resolve(e).collect()), key=str)
    monkeypatch.setattr(resolution, "TILE", 20)
    monkeypatch.setattr(resolution, "ROWS", 7)
    assert whole and sorted(map(tuple, resolution.resolve(e).collect()), key=str) == whole
    name = {i: n for i, n, _, _ in rows}
    assert all(abs(sim.name_similarity(name[r[0]], name[r[1]]) - r[2]) < 1e-6 for r in whole)
    x, y = zip(*[(rnd.choice(rows)[1].lower(), rnd.choice(rows)[1].lower()) for _ in range(300)], ("", "a"), ("ab", "ba"), ("x" * 300, "y" + "x" * 290))
    assert list(sim.jaro_winklers(x, y)) == [sim.jaro_winkler(a, b) for a, b in zip(x, y)]


def test_similar_facts_of_a_hot_subject(spark, monkeypatch):
    import numpy as np

    rnd = np.random.default_rng(5)
    v = np.round(rnd.normal(size=(120, 5)), 3)
    v[7], v[40] = 0, v[91]
    kind = "seq bigint, s_id string, pred string, o_id string, embedding array<float>"
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", "P", f"o{i % 9}", v[i].tolist()) for i in range(120)] + [(200, "hot", None, None, [1.0]), (201, None, None, None, [1.0] * 5)]
    b, e = spark.createDataFrame(rows[:80] + rows[120:], kind), spark.createDataFrame(rows[80:120], kind)
    monkeypatch.setattr(baselines, "TILE", 8)
    got = {r["seq"]: (r["accepted"], r["confidence"]) for r in baselines.similar_facts(b, e).collect()}

    def cos(x, y):
        x, y = (np.array(z, np.float32).astype(float) for z in (x, y))
        n = np.linalg.norm(x) * np.linalg.norm(y) if x.shape == y.shape else 0
        return x @ y / n if n else 0.0

    for i, s, p, o, x in rows[:80] + rows[120:]:
        c = max([0.0, *(cos(x, w) for _, t, q, u, w in rows[80:120] if s == t or (p, o) == (q, u))])
        assert got[i] == (c < 0.85, pytest.approx(1 - c if c >= 0.85 else max(0.7, 1 - c), abs=2e-6))
    assert got[40] == (False, 0.0) and got[201] == (True, 1.0)


def test_answers_of_frequent_words(spark, small, monkeypatch):
    """The same rows as SQL where nearly all words count as frequent and facts are many parts."""
    from tripletide.functions import qa
    from tripletide.plans import experiment_queries as q

    from .test_oracle import compare

    monkeypatch.setattr(qa, "RARE", 2)
    monkeypatch.setattr(qa, "PART", 200)
    compare(spark, q.qa_end_to_end, q.SQL["qa_end_to_end"])


def test_top_candidates_of_tiles(spark, monkeypatch):
    rows = [(f"{i:02}", f"Gravi{c}{d}-Theorie", "Konzept") for i, (c, d) in enumerate((c, d) for c in "aeiou" for d in "bdgk")]
    e = spark.createDataFrame([(*r, None, None) for r in rows], "entity_id string, entity_name string, entity_type string, embedding array<float>, invalidated_at timestamp_ntz")
    monkeypatch.setattr(resolution, "TILE", 6)
    top = resolution.top_candidates(resolution.resolve(e)).collect()
    assert {r["entity_id"] for r in top} == {r[0] for r in rows} and len(top) == 3 * len(rows)
    assert all(r["entity_id"] != r["candidate"] and 1 <= r["rank"] <= 3 for r in top)
