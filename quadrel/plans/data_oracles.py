"""SQL that gives the results of ``data_queries`` from the same tables by other means."""

VOC = "http://voc.example/ns#"

_LINKS = f"""lk AS (SELECT DISTINCT CASE WHEN predicate = '{VOC}narrower' THEN object ELSE subject END AS c,
    CASE WHEN predicate = '{VOC}narrower' THEN subject ELSE object END AS p
  FROM rdf WHERE died IS NULL AND o_kind IN (0, 1) AND predicate IN ('{VOC}broader', '{VOC}partOf', '{VOC}narrower')),
edge AS (SELECT c, min(p) AS p FROM lk WHERE c IS NOT NULL AND p IS NOT NULL GROUP BY c),
node AS (SELECT c AS n FROM edge UNION SELECT p FROM lk WHERE p IS NOT NULL AND c IS NOT NULL)"""

_TREE = f"""WITH RECURSIVE {_LINKS},
down AS (SELECT n AS node, n AS root, 0 AS depth, n AS path FROM node WHERE n NOT IN (SELECT c FROM edge)
  UNION ALL SELECT e.c, d.root, d.depth + 1, d.path || ' ' || e.c FROM down d JOIN edge e ON e.p = d.node)"""

_CLOSURE = """up AS (SELECT c AS node, p AS anc, 1 AS distance FROM edge UNION ALL SELECT u.node, e.p, u.distance + 1 FROM up u JOIN edge e ON e.c = u.anc)"""

_HELD = """e AS (SELECT graph, seq, lower(trim(action)) AS action, line, subject, predicate, object, lower(trim(upd_field)) AS f, upd_value AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY graph, seq ORDER BY attempt DESC) AS rn FROM journal WHERE graph IS NOT NULL AND seq IS NOT NULL) WHERE rn = 1)"""

_STATE = """k AS (SELECT * FROM e WHERE action IN ('assert', 'retract', 'update') AND seq > coalesce((SELECT max(seq) FROM e u WHERE u.graph = e.graph AND u.action = 'unload'), -1e18)),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph, line ORDER BY seq DESC) AS rn FROM k WHERE action IN ('assert', 'retract')) WHERE rn = 1 AND action = 'assert')"""


def _field(name: str) -> str:
    return f"""CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.graph = b.graph AND k.line IS NOT DISTINCT FROM b.line AND k.seq > b.seq AND k.action = 'update' AND k.f = '{name}')
    THEN (SELECT arg_max(coalesce(k.v, chr(1)), k.seq) FROM k WHERE k.graph = b.graph AND k.line IS NOT DISTINCT FROM b.line AND k.seq > b.seq AND k.action = 'update' AND k.f = '{name}') ELSE b.{name} END AS {name}"""


_FINAL = f"SELECT graph, line, nullif(subject, chr(1)) AS subject, nullif(predicate, chr(1)) AS predicate, nullif(object, chr(1)) AS object FROM (SELECT graph, line, {_field('subject')}, {_field('predicate')}, {_field('object')} FROM b)"

#: Committed entries: from seq 1 to the first gap, and of these up to the last place where no transaction is open. The depth after a mark is
#: the sum of begins less ends since the sum was lowest, as an end without a begin changes nothing.
_WHOLE = """whole AS (SELECT graph, min(seq) AS m FROM (SELECT graph, seq, lead(seq) OVER (PARTITION BY graph ORDER BY seq) AS nx
    FROM (SELECT graph, seq FROM e0 WHERE seq >= 1 UNION ALL SELECT DISTINCT graph, 0 FROM e0)) WHERE nx IS DISTINCT FROM seq + 1 GROUP BY graph),
run AS (SELECT e0.graph, seq, action, w.m, sum(CASE action WHEN 'begin' THEN 1 WHEN 'end' THEN -1 ELSE 0 END) OVER (PARTITION BY e0.graph ORDER BY seq) AS s FROM e0 JOIN whole w ON w.graph = e0.graph AND seq <= w.m),
depth AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY graph ORDER BY seq)) AS d FROM run),
shown AS (SELECT graph, max(seq) AS m FROM depth WHERE d = 0 GROUP BY graph),
e AS (SELECT e0.* FROM e0 JOIN shown s ON s.graph = e0.graph AND e0.seq <= s.m)"""

_KINDS = {"double": "heightM areaHa lat lon", "integer": "storeys ward rating", "date": "built closed", "boolean": "listed open", "string": "code"}
_T = {"double": "DOUBLE", "integer": "DECIMAL(38,0)", "date": "DATE", "boolean": "BOOLEAN", "string": "VARCHAR"}
_OF = {n: k for k, ns in _KINDS.items() for n in ns.split()}
_IN = ", ".join(f"'{VOC}{n}'" for n in _OF)


def _kind(k: str) -> str:
    return "predicate IN (" + ", ".join(f"'{VOC}{n}'" for n in _KINDS[k].split()) + ")"


_CELL = f"""v AS (SELECT subject, predicate, stmt_id, born, regexp_replace(object, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS t FROM rdf
  WHERE died IS NULL AND o_kind = 2 AND subject IS NOT NULL AND object IS NOT NULL AND predicate IN ({_IN})),
ok AS (SELECT * FROM v WHERE CASE WHEN {_kind('integer')} THEN regexp_full_match(t, '[+-]?[0-9]+')
  WHEN {_kind('double')} THEN regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
  WHEN {_kind('date')} THEN regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}Z?') AND try_cast(rtrim(t, 'Z') AS DATE) IS NOT NULL
  WHEN {_kind('boolean')} THEN lower(t) IN ('true', 'false', '1', '0') ELSE t <> '' END),
cell AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY born DESC NULLS LAST, stmt_id DESC) AS rn FROM ok) WHERE rn = 1)"""


def _wide_column(name: str, kind: str) -> str:
    t = {"date": "rtrim(t, 'Z')", "boolean": "CASE WHEN lower(t) IN ('true', '1') THEN 'true' ELSE 'false' END"}.get(kind, "t")
    return f"max(CASE WHEN predicate = '{VOC}{name}' THEN try_cast({t} AS {_T[kind]}) END) AS \"{name}\""


def _long_column(name: str) -> str:
    digits = "CASE WHEN t LIKE '-%' THEN '-' ELSE '' END || ltrim(ltrim(t, '+-'), '0')"
    return f"max(CASE WHEN predicate = '{VOC}{name}' AND length(ltrim(ltrim(t, '+-'), '0')) > 38 THEN {digits} END) AS \"{name}__long\""


#: Lines judged by whole-line expressions. A line is well quoted if it is a sequence of well-formed literals, IRIs and runs without quotes; it has its columns
#: if it is a sequence of the right number of terms of any content, and a dot.
_ESC = r"""(?:\\[tbnrf"''\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})"""
_LIT = rf"""(?:"(?:[^"\\]|{_ESC})*"(?:@[^ \t"<>]*|\^\^<[^"> ]*>)?)"""
_ANY_IRI = r"""(?:<[^>]*(?:>[^ \t.>][^>]*)*>)"""
_NODE = r"""(?:_:[^ \t<>"]*[^ \t<>".])"""
_TAIL = r"[ \t]*\.[ \t\r]*(?:#.*)?"
_TERM = rf"(?:{_LIT}|{_ANY_IRI}|{_NODE})"


def _sql(rx: str) -> str:
    return "'(?s)" + rx + "'"


_QUOTED = _sql(rf"""[ \t]*(?:{_LIT}(?:[ \t]+|[ \t]*\.[ \t]*|$)|(?:{_ANY_IRI}|[^ \t"<.][^ \t"]*|\.)[ \t]*)*(?:#.*)?""")
_THREE = _sql(rf"[ \t]*{_TERM}(?:[ \t]+{_TERM}){{2}}{_TAIL}")
_FOUR = _sql(rf"[ \t]*{_TERM}(?:[ \t]+{_TERM}){{3}}{_TAIL}")
_CUT = _sql(rf"^[ \t]*({_TERM})[ \t]+({_TERM})[ \t]+({_TERM})(?:[ \t]+({_TERM}))?{_TAIL}$")
_BAD_IRI = r"'[\x00-\x20\x7f-\x9f<>\"{}|^`\\\\]'"


def _bad_iri(t: str) -> str:
    return f"(starts_with({t}, '<') AND regexp_matches(substr({t}, 2, length({t}) - 2), {_BAD_IRI}))"


_BODY_OF = "regexp_extract(o, " + _sql(r"""^"(.*)"(@[^"]*|\^\^<[^"]*>)?$""") + ", 1)"
_TYPE_OF = "regexp_extract(o, " + _sql(r"""\^\^<([^"]*)>$""") + ", 1)"
_LANG_OF = "regexp_extract(o, " + _sql(r""""@([^"]*)$""") + ", 1)"
_TAGGED = "regexp_matches(o, " + _sql(r""""@[^"]*$""") + ")"
_X = "http://www.w3.org/2001/XMLSchema#"
_LINES = f"""st AS (SELECT load_id, lower(trim(nt_format)) = 'nquads' AS quads, coalesce(lower(trim(on_error)) = 'error', false) AS strict, graph AS load_graph, error_count FROM nt_state),
r AS (SELECT l.load_id, line_no, regexp_replace(raw_line, '[\\r\\n]+$', '') AS raw, coalesce(quads, false) AS quads, coalesce(strict, false) AS strict, load_graph FROM nt_lines l LEFT JOIN st USING (load_id)
  WHERE raw_line IS NOT NULL AND NOT regexp_matches(raw_line, '^[ \\t\\r\\n]*(#|$)')),
c AS (SELECT *, regexp_full_match(raw, {_QUOTED}) AS quoted, regexp_full_match(raw, {_THREE}) OR (quads AND regexp_full_match(raw, {_FOUR})) AS whole FROM r),
d AS (SELECT *, regexp_extract(raw, {_CUT}, 1) AS s, regexp_extract(raw, {_CUT}, 2) AS p, regexp_extract(raw, {_CUT}, 3) AS o, regexp_extract(raw, {_CUT}, 4) AS g FROM c),
v AS (SELECT *, CASE WHEN starts_with(o, '"') THEN {_BODY_OF} END AS body, CASE WHEN starts_with(o, '"') THEN {_TYPE_OF} END AS dt FROM d),
f AS (SELECT *, CASE WHEN NOT quoted THEN 'quoting' WHEN NOT whole THEN 'columns' WHEN {_bad_iri('s')} OR {_bad_iri('p')} OR {_bad_iri('o')} OR {_bad_iri('g')} OR starts_with(s, '"') OR NOT starts_with(p, '<') OR starts_with(g, '"')
    OR (starts_with(o, '"') AND ({_TAGGED} AND NOT regexp_full_match({_LANG_OF}, '[A-Za-z]{{1,8}}(-[A-Za-z0-9]{{1,8}})*') OR regexp_matches(dt, {_BAD_IRI})
      OR CASE dt WHEN '{_X}integer' THEN NOT regexp_full_match(body, '[+-]?[0-9]+') WHEN '{_X}double' THEN NOT regexp_full_match(body, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
        WHEN '{_X}date' THEN NOT regexp_full_match(body, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_cast(body AS DATE) IS NULL WHEN '{_X}boolean' THEN body NOT IN ('true', 'false', '1', '0') ELSE false END)) THEN 'value' END AS reason FROM v),
stops AS (SELECT load_id, min(line_no) AS stop FROM f WHERE strict AND reason IS NOT NULL GROUP BY load_id),
got AS (SELECT f.* FROM f LEFT JOIN stops USING (load_id) WHERE stop IS NULL OR line_no <= stop)"""

ORACLES = {
    "p7_found": f"WITH {_LINES} SELECT load_id, line_no, reason FROM got WHERE reason IS NOT NULL",
    "p7_statements": f"WITH {_LINES} SELECT load_id, line_no, s, p, o, coalesce(nullif(g, ''), load_graph) AS g FROM got WHERE reason IS NULL",
    "p7_error_counts": f"WITH {_LINES} SELECT st.load_id, error_count AS recorded, count(reason) AS n_errors, count(got.load_id) - count(reason) AS n_statements FROM st LEFT JOIN got ON got.load_id = st.load_id GROUP BY 1, 2",
    "p2_found": " UNION ALL ".join(f"SELECT '{f}' AS field_name, {f} AS key_value FROM rdf GROUP BY {f} HAVING {f} IS NOT NULL AND count(*) >= 0.05 * (SELECT count(*) FROM rdf)" for f in ("predicate", "graph")),
    "p2_statistics": " UNION ALL ".join(f"SELECT '{f}' AS field_name, {f} AS key_value, count(*) AS n_rows, count(DISTINCT subject) AS n_subjects, count(DISTINCT object) AS n_objects FROM rdf GROUP BY {f}" for f in ("predicate", "graph")),
    "p3_found": f"""WITH RECURSIVE {_LINKS},
up AS (SELECT c AS node, p AS anc FROM edge UNION SELECT u.node, e.p FROM up u JOIN edge e ON e.c = u.anc),
onloop AS (SELECT a.node, min(a.anc) AS root FROM up a WHERE a.node IN (SELECT node FROM up WHERE node = anc) GROUP BY a.node),
top AS (SELECT node, anc AS root FROM up WHERE anc NOT IN (SELECT c FROM edge)),
deep AS (SELECT node, count(*) AS depth FROM up GROUP BY node)
SELECT n AS node, n AS root, CAST(0 AS INTEGER) AS depth FROM node WHERE n NOT IN (SELECT c FROM edge)
UNION ALL SELECT t.node, t.root, CAST(d.depth AS INTEGER) FROM top t JOIN deep d ON d.node = t.node
UNION ALL SELECT node, root, CAST(-1 AS INTEGER) FROM onloop
UNION ALL SELECT u.node, min(o.root), CAST(-2 AS INTEGER) FROM up u JOIN onloop o ON o.node = u.anc WHERE u.node NOT IN (SELECT node FROM onloop) GROUP BY u.node""",
    "p3_paths": f"{_TREE} SELECT node, path FROM down",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS}, tree AS (SELECT n FROM node WHERE n NOT IN (SELECT c FROM edge) UNION ALL SELECT e.c FROM tree t JOIN edge e ON e.p = t.n),
up AS (SELECT c AS node, p AS anc, 1 AS distance FROM edge WHERE c IN (SELECT n FROM tree) UNION ALL SELECT u.node, e.p, u.distance + 1 FROM up u JOIN edge e ON e.c = u.anc)
SELECT anc AS node, node AS descendant, distance FROM up""",
    "p4_found": f"WITH {_HELD}, {_STATE} {_FINAL}",
    "p4_committed": f"WITH {_HELD.replace('e AS', 'e0 AS', 1)}, {_WHOLE}, {_STATE} {_FINAL}",
    "p6_found": f"WITH {_CELL} SELECT subject, predicate, stmt_id FROM cell",
    "p6_wide": f"WITH {_CELL} SELECT s.subject, {', '.join(_wide_column(n, k) for n, k in _OF.items())}, {', '.join(_long_column(n) for n, k in _OF.items() if k == 'integer')} FROM (SELECT DISTINCT subject FROM v) s LEFT JOIN cell c ON c.subject = s.subject GROUP BY s.subject",
}
