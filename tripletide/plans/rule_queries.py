"""Queries of the rule stage and of attribute histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import kg
from .. import ontology as o
from ..operators import constraints as c
from ..operators import history, temporal
from ..runtime import materialize, table
from .sql import DISJOINT, DOMAINS, FACTS, IMPLIED, INVERSE, LIMITS, MAPPING, inlist, lit, one_year, recursive, with_, years

#: Year that counts as the present.
YEAR = 2026
QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def parts(spark, d):
    """(batch, edges) over the facts, read once."""
    f = kg.facts(spark, d)
    return kg.batch(f), kg.edges(f)


@query
def kg_facts(spark, d):
    return kg.facts(spark, d).select("seq", "batch_id", "s_id", "pred", "o_id", "s_type", "o_type")


SQL["kg_facts"] = with_(FACTS) + "SELECT seq, batch_id, s_id, pred, o_id, s_type, o_type FROM facts"


@query
def rules_relation_tier(spark, d):
    return c.relation_tier(parts(spark, d)[0])


SQL["rules_relation_tier"] = with_(FACTS, MAPPING) + f"""SELECT seq, CASE WHEN b.pred IN {inlist(o.RELATION_TYPES)} THEN 'exact' WHEN to_ IS NOT NULL THEN 'mapping' ELSE 'fail' END AS tier,
 CASE WHEN b.pred IN {inlist(o.RELATION_TYPES)} THEN b.pred ELSE coalesce(to_, b.pred) END AS mapped,
 CASE WHEN b.pred IN {inlist(o.RELATION_TYPES)} THEN 1.0 WHEN to_ IS NOT NULL THEN 0.9 ELSE 0.0 END::DOUBLE AS tier_confidence FROM batch b LEFT JOIN mapping m ON b.pred = m.pred"""


@query
def rules_schema(spark, d):
    return c.schema_check(parts(spark, d)[0])


_OKT = inlist([t.lower() for t in o.ENTITY_TYPES])
_OKR = inlist([*o.RELATION_TYPES, *o.RELATION_MAPPING])
SQL["rules_schema"] = with_(FACTS) + f"SELECT seq, 0.9::DOUBLE severity, 0.3::DOUBLE factor FROM batch WHERE lower(s_type) NOT IN {_OKT} OR lower(o_type) NOT IN {_OKT} OR pred NOT IN {_OKR}"


@query
def rules_domain_range(spark, d):
    return c.domain_range(parts(spark, d)[0])


_DOMAIN = "SELECT seq, 0.9::DOUBLE severity, CASE WHEN NOT list_contains(s_types, s_type) THEN 'subject' ELSE 'object' END side FROM batch JOIN domains USING (pred) WHERE NOT list_contains(s_types, s_type) OR NOT list_contains(o_types, o_type)"
SQL["rules_domain_range"] = with_(FACTS, DOMAINS) + _DOMAIN


@query
def rules_self_loop(spark, d):
    f = kg.facts(spark, d).where("pred is not null and s_id is not null and o_id is not null")
    return c.self_loop(f)


_SELF = f"WHERE (s_id = o_id OR lower(trim(s_name)) = lower(trim(o_name))) AND pred NOT IN {inlist(o.REFLEXIVE)}"
SQL["rules_self_loop"] = with_(FACTS) + f"SELECT seq, 0.9::DOUBLE severity FROM facts {_SELF} AND pred IS NOT NULL AND s_id IS NOT NULL AND o_id IS NOT NULL"


@query
def rules_cardinality(spark, d):
    return c.cardinality(*parts(spark, d))


SQL["rules_cardinality"] = with_(FACTS, LIMITS) + """SELECT seq, 0.85::DOUBLE severity, existing FROM batch JOIN limits USING (pred)
 JOIN (SELECT s_id, pred, count(*) existing FROM edges GROUP BY ALL) e USING (s_id, pred) WHERE existing >= most"""


@query
def rules_cardinality_sequential(spark, d):
    return c.cardinality_sequential(kg.facts(spark, d))


SQL["rules_cardinality_sequential"] = with_(FACTS, LIMITS) + """SELECT seq, 0.85::DOUBLE severity, existing FROM (SELECT seq, batch_id, most, row_number() OVER (PARTITION BY s_id, pred ORDER BY seq) - 1 AS existing
 FROM facts JOIN limits USING (pred) WHERE s_id IS NOT NULL) WHERE batch_id > 0 AND existing >= most"""


@query
def rules_asymmetry(spark, d):
    return c.asymmetry(*parts(spark, d))


_REV = "EXISTS (SELECT 1 FROM edges e WHERE e.s_id = b.o_id AND e.o_id = b.s_id AND e.pred = b.pred)"
SQL["rules_asymmetry"] = with_(FACTS) + f"SELECT seq, 0.8::DOUBLE severity FROM batch b WHERE pred IN {inlist(o.ASYMMETRIC)} AND {_REV}"


@query
def rules_symmetric_duplicate(spark, d):
    return c.symmetric_duplicate(*parts(spark, d))


SQL["rules_symmetric_duplicate"] = with_(FACTS) + f"SELECT seq, 0.6::DOUBLE severity FROM batch b WHERE pred IN {inlist([k for k, v in o.INVERSE.items() if k == v])} AND {_REV}"


@query
def rules_functional_conflict(spark, d):
    """KIND_VON edges of history stand in, reversed, as parents' edges, for which the data have no relation of their own."""
    b, e = parts(spark, d)
    parents = e.where("pred = 'KIND_VON'").select("seq", F.col("o_id").alias("s_id"), F.lit("VATER_VON").alias("pred"), F.col("s_id").alias("o_id"))
    return c.functional_conflict(b, parents)


SQL["rules_functional_conflict"] = with_(FACTS) + """SELECT DISTINCT b.seq, 0.7::DOUBLE severity FROM batch b JOIN edges e ON e.pred = 'KIND_VON' AND e.o_id = b.o_id
 WHERE b.pred = 'KIND_VON' AND e.s_id <> b.s_id"""


@query
def rules_cross_relation(spark, d):
    return c.cross_relation(*parts(spark, d))


_CROSS = """SELECT DISTINCT b.seq, 0.7::DOUBLE severity FROM batch b JOIN domains d ON d.pred = b.pred JOIN edges e ON e.s_id = b.o_id JOIN domains x ON x.pred = e.pred WHERE len(list_intersect(d.o_types, x.s_types)) = 0"""
SQL["rules_cross_relation"] = with_(FACTS, DOMAINS) + _CROSS


@query
def rules_valid_interval(spark, d):
    return c.valid_interval(table(spark, d, "entities", "entity_id", "valid_from", "valid_until"))


SQL["rules_valid_interval"] = "SELECT entity_id, 0.8::DOUBLE severity FROM entities WHERE valid_from > valid_until"


@query
def rules_implied_types(spark, d):
    return c.implied_types(parts(spark, d)[0])


_IMPL = """SELECT seq, 0.8::DOUBLE severity, CASE WHEN EXISTS (SELECT 1 FROM disjoint_ x WHERE x.t = lower(s_type) AND x.other = s_imp) THEN 'subject' ELSE 'object' END side
 FROM batch JOIN implied USING (pred) WHERE EXISTS (SELECT 1 FROM disjoint_ x WHERE (x.t = lower(s_type) AND x.other = s_imp) OR (x.t = lower(o_type) AND x.other = o_imp))"""
SQL["rules_implied_types"] = with_(FACTS, IMPLIED, DISJOINT) + _IMPL


@query
def rules_inverse_inference(spark, d):
    return c.inverse_inference(parts(spark, d)[0])


SQL["rules_inverse_inference"] = with_(FACTS, INVERSE) + "SELECT seq, o_id AS s_id, inv AS pred, s_id AS o_id, round(conf * 0.95, 6) AS conf FROM batch JOIN inverse_ USING (pred) WHERE inv <> batch.pred"


@query
def rules_cycles(spark, d):
    return c.cycles(*parts(spark, d))


def _reach(relations, depth, start="SELECT DISTINCT pred, o_id AS start FROM batch"):
    return (
        f"re AS (SELECT DISTINCT pred, s_id, o_id FROM edges WHERE pred IN {inlist(relations)})",
        f"rs AS (SELECT * FROM ({start}) WHERE pred IN {inlist(relations)})",
        f"reach AS (SELECT pred, start, start AS node, 0 AS depth FROM rs UNION SELECT r.pred, r.start, e.o_id, r.depth + 1 FROM reach r JOIN re e ON e.pred = r.pred AND e.s_id = r.node WHERE r.depth < {depth})",
    )


_CYC = "SELECT DISTINCT b.seq, 0.9::DOUBLE severity FROM batch b JOIN reach r ON r.pred = b.pred AND r.start = b.o_id AND r.node = b.s_id"
SQL["rules_cycles"] = recursive(FACTS, *_reach(o.ACYCLIC, 10)) + _CYC


@query
def rules_transitive_cycle(spark, d):
    return c.transitive_cycle(*parts(spark, d))


SQL["rules_transitive_cycle"] = recursive(FACTS, *_reach(o.TRANSITIVE, 5)) + _CYC


@query
def rules_ancestors(spark, d):
    return c.ancestors(parts(spark, d)[1])


_ALL_STARTS = "SELECT DISTINCT pred, s_id AS start FROM edges"
SQL["rules_ancestors"] = recursive(FACTS, *_reach(o.TRANSITIVE, 5, _ALL_STARTS)) + "SELECT pred, start AS node, node AS ancestor, min(depth) AS depth FROM reach WHERE depth > 0 AND node <> start GROUP BY ALL"


@query
def rules_transitive_inference(spark, d):
    return c.transitive_inference(parts(spark, d)[1])


SQL["rules_transitive_inference"] = recursive(FACTS, *_reach(o.TRANSITIVE, 5, _ALL_STARTS)) + """SELECT s_id, pred, o_id, depth, round(pow(0.95, depth), 6) conf
 FROM (SELECT pred, start AS s_id, node AS o_id, min(depth) AS depth FROM reach WHERE depth > 0 AND node <> start GROUP BY ALL) WHERE depth > 1"""


@query
def rules_hierarchy(spark, d):
    return c.hierarchy(*parts(spark, d))


_PAIRS = f"pairs AS (SELECT DISTINCT b.seq, b.pred, b.o_id, e.o_id AS old FROM batch b JOIN edges e ON e.s_id = b.s_id AND e.pred = b.pred WHERE b.pred IN {inlist(o.TRANSITIVE)} AND e.o_id <> b.o_id)"
SQL["rules_hierarchy"] = recursive(FACTS, _PAIRS, *_reach(o.TRANSITIVE, 5, "SELECT DISTINCT pred, o_id AS start FROM pairs UNION SELECT pred, old FROM pairs")) + """SELECT DISTINCT seq, 0.5::DOUBLE severity FROM pairs p
 WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.pred = p.pred AND r.depth > 0 AND ((r.start = p.old AND r.node = p.o_id) OR (r.start = p.o_id AND r.node = p.old)))"""


@query
def temporal_years(spark, d):
    f = kg.facts(spark, d)
    y = temporal.years(F.col("o_name"), YEAR)
    return f.select("seq", F.array_join(y, ",").alias("years"), temporal.one_year(F.col("o_name"), YEAR).alias("year"))


SQL["temporal_years"] = with_(FACTS) + f"""SELECT seq, coalesce(array_to_string(list_filter({years("o_name")}, lambda x, i: list_position({years("o_name")}, x) = i), ','), '') AS years,
 {one_year("o_name")} AS year FROM facts"""


@query
def temporal_year_range(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text")
    r = temporal.year_range(F.col("text"), YEAR)
    return docs.select("doc_id", r["from"].alias("year_from"), r["to"].alias("year_to")).where("year_from is not null")


SQL["temporal_year_range"] = r"""SELECT doc_id, a AS year_from, b AS year_to FROM (SELECT doc_id, try_cast(regexp_extract(text, '(\d{4})\s*[-–—]\s*(\d{4})', 1) AS INT) a, try_cast(regexp_extract(text, '(\d{4})\s*[-–—]\s*(\d{4})', 2) AS INT) b FROM documents)
 WHERE a BETWEEN 1000 AND 2036 AND b BETWEEN 1000 AND 2036"""


@query
def temporal_context(spark, d):
    """Birth and death years as the awards and events of a subject state them: the earliest relation in the data with years in its objects."""
    e = parts(spark, d)[1]
    renamed = e.withColumn("pred", F.when(F.col("pred") == "BETEILIGT_AN", "GEBOREN_AM").when(F.col("pred") == "ERHIELT", "GESTORBEN_AM").otherwise(F.col("pred")))
    return temporal.context(renamed, YEAR)


_LIFE = f"""life AS (SELECT s_id, arg_max(y, seq) FILTER (k = 'b') AS birth_year, arg_max(y, seq) FILTER (k = 'd') AS death_year FROM (
 SELECT s_id, seq, {one_year("o_name")} y, CASE WHEN pred IN ('BETEILIGT_AN', 'GEBOREN_IN') THEN 'b' WHEN pred IN ('ERHIELT', 'GESTORBEN_IN') THEN 'd' END k FROM edges) WHERE y IS NOT NULL AND k IS NOT NULL GROUP BY s_id)"""
SQL["temporal_context"] = with_(FACTS, _LIFE) + "SELECT * FROM life"


@query
def temporal_check(spark, d):
    """As `temporal_context`, with the batch's relations read the same way, so that every rule has cases."""
    b, e = parts(spark, d)
    new = F.when(F.col("pred") == "BETEILIGT_AN", "GEBOREN_AM").when(F.col("pred") == "ERHIELT", "GESTORBEN_AM").when(F.col("pred") == "HAT_BEZIEHUNG_ZU", "GEWANN").otherwise(F.col("pred"))
    return temporal.check(b.withColumn("pred", new), e.withColumn("pred", new), YEAR)


_RULES = [
    ("future", f"y > {YEAR + 1}", 0.9),
    ("early_award", f"p IN {inlist(o.AWARDS)} AND y < 1800", 0.8),
    ("other_birth", f"p IN {inlist(o.BIRTH)} AND birth_year <> y", 0.9),
    ("birth_after_death", f"p IN {inlist(o.BIRTH)} AND y > death_year", 0.95),
    ("long_life", f"p IN {inlist(o.BIRTH)} AND death_year - y > 130", 0.8),
    ("other_death", f"p IN {inlist(o.DEATH)} AND death_year <> y", 0.9),
    ("death_before_birth", f"p IN {inlist(o.DEATH)} AND y < birth_year", 0.95),
    ("long_life", f"p IN {inlist(o.DEATH)} AND y - birth_year > 130", 0.8),
    ("active_after_death", f"p IN {inlist(set(o.LIFETIME) & set(o.PRESENT))} AND y IS NULL AND death_year IS NOT NULL", 0.9),
    ("before_birth", f"p IN {inlist(o.LIFETIME)} AND y < birth_year", 0.9),
    ("after_death", f"p IN {inlist(o.LIFETIME)} AND y > death_year", 0.95),
]
_CASE = lambda i: "CASE " + " ".join(f"WHEN {r[1]} THEN {lit(r[i])}" for r in _RULES) + " END"
SQL["temporal_check"] = with_(FACTS, _LIFE) + f"""SELECT seq, ({_CASE(2)})::DOUBLE severity, {_CASE(0)} AS rule FROM (SELECT seq, birth_year, death_year, {one_year("o_name")} y,
 CASE pred WHEN 'BETEILIGT_AN' THEN 'GEBOREN_AM' WHEN 'ERHIELT' THEN 'GESTORBEN_AM' WHEN 'HAT_BEZIEHUNG_ZU' THEN 'GEWANN' ELSE pred END p FROM batch LEFT JOIN life USING (s_id)) WHERE rule IS NOT NULL"""


def outcome(spark, d):
    b, e = parts(spark, d)
    b, e = materialize(b, "batch"), materialize(e, "edges")
    return b, e, c.stage_one(
        b,
        {
            "schema": c.schema_check(b),
            "domain": c.domain_range(b),
            "self_loop": c.self_loop(b),
            "cardinality": c.cardinality(b, e),
            "cycle": c.cycles(b, e),
            "asymmetry": c.asymmetry(b, e),
            "cross_relation": c.cross_relation(b, e),
            "temporal": temporal.check(b, e, YEAR),
            "advanced": c.implied_types(b),
        },
    )


@query
def rules_outcome(spark, d):
    """Stage 1 over every new fact."""
    return outcome(spark, d)[2]


_LIFE2 = _LIFE.replace("pred IN ('BETEILIGT_AN', 'GEBOREN_IN')", f"pred IN {inlist(o.BIRTH)}").replace("pred IN ('ERHIELT', 'GESTORBEN_IN')", f"pred IN {inlist(o.DEATH)}")
OUTCOME = (
    FACTS, DOMAINS, LIMITS, IMPLIED, DISJOINT, *_reach(o.ACYCLIC, 10), _LIFE2,
    f"""hits AS (SELECT seq, 0 i, 'schema' c, 0.9 s, 0.3 f, 0.8 h FROM ({SQL["rules_schema"].split("SELECT seq", 1)[0] and ""}SELECT seq FROM batch WHERE lower(s_type) NOT IN {_OKT} OR lower(o_type) NOT IN {_OKT} OR pred NOT IN {_OKR})
 UNION ALL SELECT seq, 1, 'domain', 0.9, 0.3, 0.8 FROM ({_DOMAIN})
 UNION ALL SELECT seq, 2, 'self_loop', 0.9, 0.3, 0.8 FROM batch {_SELF}
 UNION ALL SELECT seq, 3, 'cardinality', 0.85, 0.6, 9 FROM batch JOIN limits USING (pred) JOIN (SELECT s_id, pred, count(*) n FROM edges GROUP BY ALL) e USING (s_id, pred) WHERE n >= most
 UNION ALL SELECT seq, 4, 'cycle', 0.9, 0.3, 0.9 FROM ({_CYC})
 UNION ALL SELECT seq, 5, 'asymmetry', 0.8, 0.5, 9 FROM batch b WHERE pred IN {inlist(o.ASYMMETRIC)} AND {_REV}
 UNION ALL SELECT seq, 6, 'cross_relation', 0.7, 0.6, 9 FROM ({_CROSS})
 UNION ALL SELECT seq, 7, 'temporal', s, 0.3, 0 FROM (SELECT seq, {_CASE(2)} s FROM (SELECT seq, birth_year, death_year, {one_year("o_name")} y, pred p FROM batch LEFT JOIN life USING (s_id))) WHERE s IS NOT NULL
 UNION ALL SELECT seq, 8, 'advanced', 0.8, 0.7, 0.8 FROM ({_IMPL}))""",
    """outcome AS (SELECT b.seq, count(c) AS n_conflicts, coalesce(string_agg(c, ',' ORDER BY i), '') AS checks, coalesce(max(s), 0.0)::DOUBLE AS max_severity, round(coalesce(product(f::DOUBLE), 1.0), 6) AS confidence,
 CASE WHEN bool_or(s >= h) THEN 'FAIL' WHEN count(c) > 0 THEN 'UNCERTAIN' ELSE 'PASS' END AS outcome FROM batch b LEFT JOIN hits USING (seq) GROUP BY b.seq)""",
)
SQL["rules_outcome"] = recursive(*OUTCOME) + "SELECT * FROM outcome"


@query
def p7_found(spark, d):
    return history.found(table(spark, d, "graph_updates"))


SQL["p7_found"] = """WITH cur AS (SELECT item_id, valid_from, invalidated_at, item_name, description, validation_status FROM (SELECT DISTINCT * FROM graph_updates)
 QUALIFY row_number() OVER (PARTITION BY item_id, valid_from ORDER BY recorded_at DESC, update_id DESC) = 1),
seen AS (SELECT *, lag(valid_from) OVER w IS NULL OR lag(invalidated_at) OVER w IS NOT NULL OR lag(item_name) OVER w IS DISTINCT FROM item_name OR lag(description) OVER w IS DISTINCT FROM description
 OR lag(validation_status) OVER w IS DISTINCT FROM validation_status AS begins FROM cur WINDOW w AS (PARTITION BY item_id ORDER BY valid_from)),
num AS (SELECT *, sum(begins::INT) OVER (PARTITION BY item_id ORDER BY valid_from) AS v FROM seen),
ver AS (SELECT item_id, v, min(valid_from) AS f, arg_max({'x': invalidated_at}, valid_from).x AS inv FROM num GROUP BY item_id, v)
SELECT item_id, strftime(f, '%Y-%m-%d %H:%M:%S') AS period_from, coalesce(strftime(coalesce(inv, lead(f) OVER (PARTITION BY item_id ORDER BY f)), '%Y-%m-%d %H:%M:%S'), '') AS period_until FROM ver"""


@query
def p7_ledger(spark, d):
    u = history.ledger(table(spark, d, "graph_updates", "update_id", "item_id", "valid_from", "recorded_at", "invalidated_at"))
    t = lambda x: F.coalesce(F.date_format(x, "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias(x)
    return u.select("update_id", "item_id", *map(t, ("valid_from", "valid_until", "recorded_from", "recorded_until")), "current")


# What was known of each item at each of its recorded moments, then rows that say the same at moments in turn made one.
SQL["p7_ledger"] = """WITH u AS (SELECT DISTINCT update_id, item_id, valid_from, recorded_at, invalidated_at, coalesce(epoch_us(recorded_at), -1 << 62) AS k FROM graph_updates WHERE item_id IS NOT NULL AND valid_from IS NOT NULL),
m AS (SELECT DISTINCT item_id, k, recorded_at FROM u),
known AS (SELECT m.item_id, m.k, any_value(m.recorded_at) AS came, u.valid_from, arg_max({'id': u.update_id, 'inv': u.invalidated_at}, (u.k, u.update_id)) AS s FROM m JOIN u ON u.item_id = m.item_id AND u.k <= m.k GROUP BY m.item_id, m.k, u.valid_from),
upto AS (SELECT *, lead(valid_from) OVER (PARTITION BY item_id, k ORDER BY valid_from) AS nxt FROM known),
news AS (SELECT * FROM upto WINDOW w AS (PARTITION BY item_id, valid_from ORDER BY k) QUALIFY lag(k) OVER w IS NULL OR lag(s.id) OVER w IS DISTINCT FROM s.id OR lag(nxt) OVER w IS DISTINCT FROM nxt)
SELECT s.id AS update_id, item_id, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(least(nxt, s.inv), '%Y-%m-%d %H:%M:%S'), '') AS valid_until, coalesce(strftime(came, '%Y-%m-%d %H:%M:%S'), '') AS recorded_from,
 coalesce(strftime(lead(came) OVER w, '%Y-%m-%d %H:%M:%S'), '') AS recorded_until, lead(k) OVER w IS NULL AS current FROM news WINDOW w AS (PARTITION BY item_id, valid_from ORDER BY k)"""
