"""Rule stage: one positive and one negative case per rule, and empty input."""

import pytest

from tripletide.operators import constraints as c
from tripletide.operators import temporal as t

P, O, G, E = "Person", "Ort", "Organisation", "Ereignis"


def seqs(df):
    return sorted(r["seq"] for r in df.collect())


def test_relation_tiers(make_facts):
    b = make_facts((1, "a", P, "REGIERTE", "b", G), (2, "a", P, "FLIEGT_NACH", "b", O), (3, "a", P, "KENNT", "b", P))
    got = {r["seq"]: (r["tier"], r["mapped"], r["tier_confidence"]) for r in c.relation_tier(b).collect()}
    assert got == {1: ("mapping", "LEITET", 0.9), 2: ("fail", "FLIEGT_NACH", 0.0), 3: ("exact", "KENNT", 1.0)}


def test_schema_and_domain(make_facts):
    b = make_facts((1, "a", "UNKNOWN", "KENNT", "b", P), (2, "a", P, "KENNT", "b", P), (3, "x", O, "GEBOREN_IN", "b", P), (4, "x", P, "GEBOREN_IN", "b", O), (5, "x", None, "KENNT", "b", P))
    assert seqs(c.schema_check(b)) == [1, 5]
    got = {r["seq"]: r["side"] for r in c.domain_range(b).collect()}
    assert got == {1: "subject", 3: "subject", 5: "subject"}


def test_self_loop(make_facts):
    b = make_facts((1, "Einstein", P, "KENNT", "Einstein", P), (2, "Einstein", P, "HAT_BEZIEHUNG_ZU", "Einstein", P), (3, "a", P, "KENNT", "b", P))
    assert seqs(c.self_loop(b)) == [1]


def test_cardinality(make_facts):
    e = make_facts((1, "a", P, "GESTORBEN_IN", "x", O), (2, "k", P, "KIND_VON", "m", P), (3, "k", P, "KIND_VON", "v", P), batch=0)
    b = make_facts((11, "a", P, "GESTORBEN_IN", "y", O), (12, "k", P, "KIND_VON", "z", P), (13, "b", P, "GESTORBEN_IN", "x", O))
    assert seqs(c.cardinality(b, e)) == [11, 12]
    assert seqs(c.cardinality_sequential(e.union(b).union(make_facts((14, "b", P, "GESTORBEN_IN", "z", O))))) == [11, 12, 14]


def test_cycles_and_depth(make_facts):
    chain = [(i, f"n{i}", O, "TEIL_VON", f"n{i + 1}", O) for i in range(12)]
    e = make_facts(*chain, batch=0)
    b = make_facts((100, "n3", O, "TEIL_VON", "n0", O), (101, "n0", O, "TEIL_VON", "zz", O), (102, "n12", O, "TEIL_VON", "n0", O), (103, "n10", O, "TEIL_VON", "n0", O))
    assert seqs(c.cycles(b, e)) == [100, 103]  # deeper than ten edges isn't looked for
    assert seqs(c.transitive_cycle(b, e)) == [100]


def test_directions(make_facts):
    e = make_facts((1, "b", P, "LEITET", "a", G), (2, "b", P, "KENNT", "a", P), (3, "v", P, "VATER_VON", "x", P), batch=0)
    b = make_facts((11, "a", P, "LEITET", "b", G), (12, "a", P, "KENNT", "b", P), (13, "k", P, "KIND_VON", "v", P), (14, "x", P, "KIND_VON", "v", P))
    assert seqs(c.asymmetry(b, e)) == [11]
    assert seqs(c.symmetric_duplicate(b, e)) == [12]
    assert seqs(c.functional_conflict(b, e)) == [13]


def test_cross_relation(make_facts):
    e = make_facts((1, "Merkel", P, "LEITET", "CDU", G), batch=0)
    b = make_facts((11, "X", P, "GEBOREN_IN", "Merkel", O), (12, "X", P, "GEBOREN_IN", "Ulm", O))
    assert seqs(c.cross_relation(b, e)) == [11]


def test_implied_types(make_facts):
    b = make_facts((1, "x", O, "GEBOREN_IN", "u", O), (2, "x", P, "GEBOREN_IN", "u", P), (3, "x", P, "GEBOREN_IN", "u", O), (4, "x", P, "BORN_IN", "u", O))
    assert {r["seq"]: r["side"] for r in c.implied_types(b).collect()} == {1: "subject", 2: "object"}


def test_hierarchy_and_inference(make_facts):
    e = make_facts((1, "a", O, "TEIL_VON", "b", O), (2, "b", O, "TEIL_VON", "c", O), batch=0)
    b = make_facts((11, "a", O, "TEIL_VON", "q", O), (12, "a", O, "TEIL_VON", "c", O))
    assert seqs(c.hierarchy(b, e)) == [11]
    got = {(r["s_id"], r["o_id"]): r["conf"] for r in c.transitive_inference(e).collect()}
    assert got == {("a", "c"): pytest.approx(0.9025)}
    assert seqs(c.inverse_inference(make_facts((5, "a", P, "LEITET", "b", G), (6, "a", P, "KENNT", "b", P)))) == [5]


def test_stage_one(make_facts):
    b = make_facts((1, "a", P, "KENNT", "a", P), (2, "a", P, "KENNT", "b", P), (3, "a", P, "KENNT", "c", P))
    got = {r["seq"]: (r["outcome"], r["confidence"]) for r in c.stage_one(b, {"self_loop": c.self_loop(b), "cardinality": b.where("seq = 3").selectExpr("seq", "0.85 severity")}).collect()}
    assert got == {1: ("FAIL", 0.3), 2: ("PASS", 1.0), 3: ("UNCERTAIN", 0.6)}


def test_years(spark):
    from pyspark.sql import functions as F

    rows = [("(1879-1955)", "1879,1955", 1955), ("x3000", "", None), ("", "", None), (None, "", None), ("Nobelpreis 1921", "1921", 1921), ("14. März 1879 und 1955-03-02", "1879,1955", 1955)]
    d = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, x string")
    got = {r["i"]: (r["y"], r["one"]) for r in d.select("i", F.array_join(t.years(F.col("x"), 2026), ",").alias("y"), t.one_year(F.col("x"), 2026).alias("one")).collect()}
    assert got == {i: r[1:] for i, r in enumerate(rows)}


def test_temporal(make_facts):
    e = make_facts((1, "p", P, "GEBOREN_AM", "1879", E), (2, "p", P, "GESTORBEN_AM", "1955", E), batch=0)
    b = make_facts(
        (11, "p", P, "GEBOREN_AM", "1880", E), (12, "p", P, "ERHIELT", "Preis 1960", E), (13, "p", P, "ERHIELT", "Preis 1921", E), (14, "p", P, "ARBEITET_BEI", "X", G),
        (15, "q", P, "GEBOREN_AM", "2200", E), (16, "q", P, "GEWANN", "Preis 1700", E), (17, "p", P, "SCHRIEB", "Buch 1870", E),
    )
    got = {r["seq"]: (r["rule"], r["severity"]) for r in t.check(b, e, 2026).collect()}
    assert got == {11: ("other_birth", 0.9), 12: ("after_death", 0.95), 14: ("active_after_death", 0.9), 16: ("early_award", 0.8), 17: ("before_birth", 0.9)}


def test_empty(make_facts, spark):
    from tests.conftest import FACT

    none = spark.createDataFrame([], FACT)
    for f in (c.cardinality, c.asymmetry, c.cross_relation, c.cycles, c.hierarchy, c.symmetric_duplicate):
        assert f(none, none).count() == 0
    assert t.check(none, none, 2026).count() == 0 and c.ancestors(none).count() == 0
