"""Pieces of SQL that several statements share; they state the same views as `kg` does."""

from __future__ import annotations

from .. import ontology as o


def lit(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, str):
        return "'" + x.replace("'", "''") + "'"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(lit, x)) + "]"
    return repr(x)


def inlist(xs) -> str:
    return "(" + ", ".join(map(lit, xs)) + ")"


def values(name: str, columns: str, rows: list) -> str:
    """A common table expression of fixed rows."""
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"{name}({columns}) AS (SELECT * FROM (VALUES {body}) v)"


def kind(c: str) -> str:
    whens = " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in o.TYPE_ALIASES.items())
    return f"CASE {c} {whens} ELSE {c} END"


FACTS = f"""
t0 AS (SELECT DISTINCT seq, batch_id, subject_name s_name, {kind("subject_type")} s_type, nullif(upper(replace(replace(regexp_replace(predicate, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), ' ', '_'), 'ß', 'ss')), '') p,
    object_name o_name, {kind("object_type")} o_type, extraction_confidence conf, source_document_id doc, source_text text_, validation_status status FROM triples),
facts AS (SELECT seq, batch_id, s_name, s_type, substr(md5(lower(s_name) || ':' || s_type), 1, 12) s_id, coalesce(c.relation_de, p) pred,
    o_name, o_type, substr(md5(lower(o_name) || ':' || o_type), 1, 12) o_id, conf, doc, text_, status FROM t0 LEFT JOIN relation_catalog c ON p = c.relation_en),
edges AS (SELECT * FROM facts WHERE batch_id = 0 AND coalesce(status, '') <> 'rejected' AND pred IS NOT NULL AND s_id IS NOT NULL AND o_id IS NOT NULL),
batch AS (SELECT * FROM facts WHERE batch_id > 0 AND pred IS NOT NULL AND s_id IS NOT NULL AND o_id IS NOT NULL)
"""

DOMAINS = values("domains", "pred, s_types, o_types", o.domain_rows())
LIMITS = values("limits", "pred, most", list(o.CARDINALITY.items()))
MAPPING = values("mapping", "pred, to_", list(o.RELATION_MAPPING.items()))
INVERSE = values("inverse_", "pred, inv", list(o.INVERSE.items()))
IMPLIED = values("implied", "pred, s_imp, o_imp", [(k, *v) for k, v in o.IMPLIED.items()])
DISJOINT = values("disjoint_", "t, other", o.disjoint_pairs())


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(c.strip() for c in ctes) + " "


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join(c.strip() for c in ctes) + " "


def years(text: str, this_year: int = 2026) -> str:
    """List of plausible years of a text, by pattern and place."""
    en, de = "January|February|March|April|May|June|July|August|September|October|November|December", "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"
    ex = lambda p, g=1: f"regexp_extract_all({text}, '(?i){p}', {g})"
    pair = rf"regexp_extract_all({text}, '\((\d{{4}})[-–](\d{{4}})\)', 1)"
    pair2 = rf"regexp_extract_all({text}, '\((\d{{4}})[-–](\d{{4}})\)', 2)"
    both = f"flatten(list_transform(list_zip({pair}, {pair2}), lambda z: [z[1], z[2]]))"
    parts = [ex(r"\b(1[0-9]{3}|20[0-9]{2})\b"), both, ex(r"\((\d{4})\)"), ex(r"(\d{4})$"), ex(rf"(?:{en})\s+\d{{1,2}},?\s+(\d{{4}})"), ex(rf"\d{{1,2}}\.\s*(?:{de})\s+(\d{{4}})"), ex(r"^(\d{4})-\d{2}-\d{2}")]
    cat = parts[0]
    for p in parts[1:]:
        cat = f"list_concat({cat}, {p})"
    return f"list_filter(list_transform({cat}, lambda x: x::INT), lambda x: x BETWEEN 1000 AND {this_year + 10})"


def one_year(text: str, this_year: int = 2026) -> str:
    """Last of the distinct years in order of first appearance."""
    y = years(text, this_year)
    return f"list_last(list_filter({y}, lambda x, i: list_position({y}, x) = i))"
