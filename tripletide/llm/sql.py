"""SQL that states queries of this subpackage by plain means, for tables small enough to compare all with all."""

from __future__ import annotations

from .canonical import EDITS, SHORT, UNMATCHED
from .survivor import STAND_INS


def _list(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"


P1 = """WITH v AS (SELECT entity_id AS id, embedding::DOUBLE[] AS e FROM entities WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 c AS (SELECT a.id AS q, b.id AS d, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) AS s FROM v a JOIN v b ON a.id <> b.id),
 t AS (SELECT q, d FROM c WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, d) <= 10)
 SELECT DISTINCT least(q, d) AS id_a, greatest(q, d) AS id_b FROM t"""

_AGE = "CASE WHEN year(created_at) BETWEEN 2000 AND 2029 THEN created_at END DESC NULLS LAST, entity_id"
_TRIM = r"regexp_replace(description, '^[\s\pZ\pC]+|[\s\pZ\pC]+$', '', 'g')"
P3 = f"""WITH e AS (SELECT e.*, coalesce(p.score, 0) AS score, {_TRIM} AS d, count(DISTINCT e.entity_id) OVER (PARTITION BY fingerprint) AS n FROM entities e
 LEFT JOIN (SELECT source_id, max(reliability_score) AS score FROM source_profiles GROUP BY 1) p ON p.source_id = regexp_replace(source_document, '_\\d+$', '')),
 r AS (SELECT fingerprint, 'description' AS field_name, entity_id FROM e WHERE n > 1 AND regexp_matches(d, '[\\pL\\pN]') AND lower(d) NOT IN {_list(STAND_INS)} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY length(d) DESC, {_AGE}) = 1
 UNION ALL SELECT fingerprint, 'source_document', entity_id FROM e WHERE n > 1 AND source_document IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, {_AGE}) = 1
 UNION ALL SELECT fingerprint, 'confidence', entity_id FROM e WHERE n > 1 AND confidence BETWEEN 0 AND 1 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY {_AGE}) = 1) SELECT * FROM r"""

P6 = """WITH RECURSIVE s AS (SELECT conflict_id, list_distinct(list_filter(list_transform(conflicting_items, lambda x: right(regexp_replace(lower(x), '[^0-9a-f]', '', 'g'), 32)), lambda x: length(x) = 32)) AS ids
 FROM conflict_sets WHERE regexp_replace(lower(conflict_type), '[^a-z]', '', 'g') = 'duplicateentity'),
 e AS (SELECT DISTINCT a, b FROM (SELECT list_min(ids) AS a, unnest(ids) AS b FROM s WHERE len(ids) > 1) WHERE a <> b), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS item, a AS other FROM u UNION SELECT r.item, u.b FROM r JOIN u ON u.a = r.other),
 h AS (SELECT item, min(other) AS g FROM r GROUP BY item)
 SELECT concat_ws('-', item[1:8], item[9:12], item[13:16], item[17:20], item[21:32]) AS item_id, concat_ws('-', g[1:8], g[9:12], g[13:16], g[17:20], g[21:32]) AS group_id FROM h"""


def _compact(c: str) -> str:
    return f"regexp_replace(regexp_replace(translate(lower({c}), '013457äöü', 'oieastaou'), '[^\\pL]', '', 'g'), '([aou])e', '\\1', 'g')"


P4 = f"""WITH ent AS (SELECT config_id, 'relation' AS kind, unnest(relation_types) AS entry, generate_subscripts(relation_types, 1) - 1 AS pos FROM pipeline_configs
 UNION ALL SELECT config_id, 'type', unnest(entity_types), generate_subscripts(entity_types, 1) - 1 FROM pipeline_configs),
 base AS (SELECT DISTINCT kind, pos, entry FROM ent UNION SELECT e.kind, e.pos, unnest([gloss_de, gloss_en, relation_de, relation_en]) FROM ent e JOIN relation_catalog c ON e.kind = 'relation' AND (e.entry = relation_de OR e.entry = relation_en)),
 b AS (SELECT DISTINCT kind, pos, list_transform(list_filter(regexp_split_to_array(lower(entry), '[^\\pL]+'), lambda x: x <> ''), lambda x: {_compact("x")}) AS w FROM base WHERE entry IS NOT NULL),
 turned AS (SELECT kind, pos, i, array_to_string(list_concat(w[i + 1:], w[1:i]), '') AS r FROM (SELECT *, unnest(range(0, len(w))) AS i FROM b)),
 whole AS (SELECT kind, pos, r AS ref, i = 0 AS plain FROM turned UNION ALL SELECT kind, pos, unnest(['ist' || r, 'is' || r, r || 's']), false FROM turned WHERE kind = 'relation'),
 short AS (SELECT kind, pos, w[1][1:n] || array_to_string(w[2:], '') AS ref FROM (SELECT *, unnest(range(3, length(w[1]) - 1)) AS n FROM b WHERE length(w[1]) > 4)),
 refs AS (SELECT kind, pos, ref, cut, bool_or(plain) AS plain, CASE WHEN cut OR length(ref) <= {SHORT} THEN CASE WHEN length(ref) < 3 THEN 0 ELSE 1 END ELSE {EDITS} END AS k
 FROM (SELECT kind, pos, ref, false AS cut, plain FROM whole UNION ALL SELECT kind, pos, ref, true, false FROM short) GROUP BY kind, pos, ref, cut),
 rows_ AS (SELECT DISTINCT seq, config_id, f.field_name, f.kind, f.value FROM (SELECT seq, config_id, unnest([{{'field_name': 'predicate', 'kind': 'relation', 'value': predicate}}, {{'field_name': 'subject_type', 'kind': 'type', 'value': subject_type}},
 {{'field_name': 'object_type', 'kind': 'type', 'value': object_type}}]) AS f FROM triples) WHERE regexp_matches(f.value, '[^\\pZ\\pC\\s]')),
 open_ AS (SELECT * FROM rows_ r WHERE NOT EXISTS (SELECT 1 FROM ent e WHERE e.config_id = r.config_id AND e.kind = r.kind AND e.entry = r.value)),
 val AS (SELECT DISTINCT kind, value, regexp_replace(value, '\\pC', '', 'g') AS v FROM open_),
 form AS (SELECT kind, value, regexp_matches(value, '\\pL\\.') AS dot, unnest(list_distinct(list_filter(list_concat([{_compact("regexp_replace(v, '(_[0-9]+|[ ]*[(][^)]*[)]?)[\\pP\\s]*$', '')")}, {_compact("v")}],
 list_transform(list_filter(regexp_split_to_array(v, '[/:(]'), lambda x: length({_compact("x")}) > 2), lambda x: {_compact("x")})), lambda x: length(x) > 1))) AS f FROM val),
 near AS (SELECT f.kind, f.value, r.pos, levenshtein(f.f, r.ref) AS d, r.cut::INT * 2 + (NOT r.plain)::INT AS o FROM form f JOIN refs r ON r.kind = f.kind AND abs(length(r.ref) - length(f.f)) <= r.k AND (NOT r.cut OR f.dot OR (f.kind = 'type' AND f.f = r.ref))
 WHERE levenshtein(f.f, r.ref) <= CASE WHEN length(f.f) > 2 THEN r.k ELSE 0 END
 UNION ALL SELECT f.kind, f.value, s.pos, 1, 1 FROM form f JOIN (SELECT kind, pos, ref[1:i - 1] || ref[i + 1] || ref[i] || ref[i + 2:] AS ref FROM (SELECT *, unnest(range(1, length(ref))) AS i FROM refs WHERE NOT cut AND length(ref) BETWEEN 3 AND {SHORT})) s ON s.kind = f.kind AND s.ref = f.f),
 hit AS (SELECT kind, value, arg_min(pos, (d, o, pos)) AS pos FROM near GROUP BY kind, value)
 SELECT o.seq, o.field_name, coalesce(e.entry, '{UNMATCHED}') AS canonical FROM open_ o LEFT JOIN hit h ON h.kind = o.kind AND h.value = o.value LEFT JOIN ent e ON e.config_id = o.config_id AND e.kind = o.kind AND e.pos = h.pos"""

_LATE = "p DESC NULLS LAST, CASE WHEN t IS NOT NULL THEN 0 WHEN p IS NOT NULL THEN 1 + depth ELSE coalesce(depth, 0) END DESC, entity_id"
P3_CURRENCY = f"""WITH RECURSIVE x AS (SELECT *, CASE WHEN year(created_at) BETWEEN 2000 AND 2029 THEN created_at END AS t FROM entities WHERE fingerprint IS NOT NULL AND entity_id IS NOT NULL),
 st AS (SELECT lag(validation_status) OVER (PARTITION BY fingerprint ORDER BY t, entity_id) AS p, validation_status AS s FROM x WHERE t IS NOT NULL AND validation_status IS NOT NULL),
 cnt AS (SELECT p, s, count(*) AS c FROM st WHERE p <> s GROUP BY 1, 2),
 edge AS (SELECT a.p, a.s FROM cnt a LEFT JOIN cnt b ON b.p = a.s AND b.s = a.p WHERE a.c > coalesce(b.c, 0)),
 n AS (SELECT count(*) AS n FROM (SELECT p FROM edge UNION SELECT s FROM edge)),
 walk AS (SELECT p AS state, 0 AS d FROM edge UNION SELECT e.s, w.d + 1 FROM walk w JOIN edge e ON e.p = w.state, n WHERE w.d < n.n),
 dep AS (SELECT state, max(d) AS depth FROM walk GROUP BY 1),
 y AS (SELECT x.*, dep.depth FROM x LEFT JOIN dep ON dep.state = x.validation_status),
 z AS (SELECT y.*, coalesce(y.t, (SELECT max(o.t) FROM y o WHERE o.fingerprint = y.fingerprint AND o.depth < y.depth)) AS p FROM y),
 e AS (SELECT z.*, coalesce(q.score, 0) AS score, {_TRIM} AS d, count(DISTINCT z.entity_id) OVER (PARTITION BY fingerprint) AS n FROM z
 LEFT JOIN (SELECT source_id, max(reliability_score) AS score FROM source_profiles GROUP BY 1) q ON q.source_id = regexp_replace(source_document, '_\\d+$', ''))
 SELECT fingerprint, 'description' AS field_name, entity_id FROM e WHERE n > 1 AND regexp_matches(d, '[\\pL\\pN]') AND lower(d) NOT IN {_list(STAND_INS)} QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY length(d) DESC, {_LATE}) = 1
 UNION ALL SELECT fingerprint, 'source_document', entity_id FROM e WHERE n > 1 AND source_document IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY score DESC, {_LATE}) = 1
 UNION ALL SELECT fingerprint, 'confidence', entity_id FROM e WHERE n > 1 AND confidence BETWEEN 0 AND 1 QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY {_LATE}) = 1"""

SQL = {"p3_currency": P3_CURRENCY, "p1_found": P1, "p3_found": P3, "p4_found": P4, "p6_found": P6}
