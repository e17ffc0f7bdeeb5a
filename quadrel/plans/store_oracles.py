"""SQL for ``store_queries``, written on the base tables and on an independent view of the statements."""

VOC, EX = "http://voc.example/ns#", "http://example.org/"
RDF, RDFS, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2001/XMLSchema#"
LABEL, TYPE = RDFS + "label", RDF + "type"

_Q = """q AS (SELECT subject AS s, predicate AS p, object AS o, o_kind, CASE WHEN nullif(r.lang, '') IS NULL THEN o_dt END AS o_dt, nullif(lower(r.lang), '') AS o_lang,
  coalesce(graph, 'default') AS g, line, born, died FROM rdf LEFT JOIN rdf11 r USING (lit_id) WHERE object IS NOT NULL AND subject IS NOT NULL AND predicate IS NOT NULL),
live AS (SELECT * FROM q WHERE died IS NULL), t AS (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang FROM live)"""
_W = f"WITH RECURSIVE {_Q}"
_T = "SELECT s, p, o, o_kind, o_dt, o_lang FROM t WHERE "
_S = "SELECT s, p, o, o_kind, o_dt, o_lang, g, line FROM live WHERE "
_NUM = r"'[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?'"
_NUMERIC = "o_dt IN (" + ", ".join(f"'{XSD}{n}'" for n in "integer long int short byte nonNegativeInteger positiveInteger nonPositiveInteger negativeInteger unsignedLong unsignedInt unsignedShort unsignedByte decimal double float".split()) + ")"
_V = f"CASE WHEN o_kind = 2 AND {_NUMERIC} AND regexp_full_match(o, {_NUM}) THEN try_cast(o AS DOUBLE) END"
_F = "strip_accents(lower(o))"
_ANNOTATED = "o_kind = 2"

_SUBS = {"broader": "within", "partOf": "within", "within": "related", "linksTo": "related"}
_SCHEMA = [(VOC + a, RDFS + "subPropertyOf", VOC + b) for a, b in _SUBS.items()] + [
    (VOC + "altLabel", RDFS + "subPropertyOf", LABEL), (VOC + "Bridge", RDFS + "subClassOf", VOC + "Structure"), (VOC + "Mill", RDFS + "subClassOf", VOC + "Structure"), (VOC + "Structure", RDFS + "subClassOf", VOC + "Thing"),
    (VOC + "heightM", RDFS + "domain", VOC + "Structure"), (VOC + "heightM", TYPE, RDF + "Property"), (VOC + "code", RDFS + "domain", VOC + "Thing"), (VOC + "code", TYPE, RDF + "Property")]
_VALUES = ", ".join(f"('{s}', '{p}', '{o}')" for s, p, o in _SCHEMA)
_X = f"{_W}, x AS (SELECT s, p, o, o_kind, o_dt, o_lang FROM t UNION SELECT v.s, v.p, v.o, 0::TINYINT, NULL, NULL FROM (VALUES {_VALUES}) v(s, p, o))"
_WITHIN = f"('{VOC}within', '{VOC}broader', '{VOC}partOf')"
_EDGE = f"e AS (SELECT DISTINCT s AS a, o AS b, o_kind FROM x WHERE p IN {_WITHIN})"
_LEAST = f"(SELECT min({{}}) FROM live WHERE p = '{VOC}broader' AND o_kind = 0)"
_CLS = f"""sc AS (SELECT DISTINCT s AS sub, o AS super FROM x WHERE p = '{RDFS}subClassOf'), cls AS (SELECT sub AS c FROM sc UNION SELECT super FROM sc UNION SELECT o FROM x WHERE p = '{TYPE}'),
cl AS (SELECT sub, super FROM sc UNION SELECT cl.sub, sc.super FROM cl JOIN sc ON sc.sub = cl.super),
sub AS (SELECT sub, super FROM cl UNION SELECT c, c FROM cls UNION SELECT c, '{RDFS}Resource' FROM cls UNION SELECT s, '{RDFS}Literal' FROM x WHERE p = '{TYPE}' AND o = '{RDFS}Datatype')"""
_LAB = f"""lab AS (SELECT s AS r, o AS label, CASE WHEN p = '{LABEL}' THEN 0 ELSE 1 END AS rank FROM x WHERE p IN ('{LABEL}', '{VOC}altLabel') AND o_kind = 2
 UNION SELECT s, CASE WHEN regexp_extract(s, '#([^#]*)$', 1) <> '' THEN regexp_extract(s, '#([^#]*)$', 1) WHEN regexp_extract(s, '/([^/]*)$', 1) <> '' THEN regexp_extract(s, '/([^/]*)$', 1) ELSE s END, 2
 FROM x WHERE s NOT IN (SELECT s FROM x WHERE p IN ('{LABEL}', '{VOC}altLabel') AND o_kind = 2))"""
_BNODE = "CASE WHEN {0} LIKE '\\_:%' ESCAPE '\\' OR {0} LIKE '\\_\\_%' ESCAPE '\\' THEN 1 ELSE 0 END"


def _terms(places: str, test: str = "TRUE") -> str:
    parts = [f"SELECT o AS term, o_kind AS kind, o_dt AS dt, o_lang AS lang FROM live" if c == "o" else f"SELECT {c}, {_BNODE.format(c)}, NULL, NULL FROM live" for c in sorted(places)]
    head = parts[0] if parts[0].startswith("SELECT o") else parts[0].replace(f"SELECT {sorted(places)[0]}, ", f"SELECT {sorted(places)[0]} AS term, ").replace(" END, NULL, NULL", " END AS kind, NULL::VARCHAR AS dt, NULL::VARCHAR AS lang")
    return f"{_W} SELECT DISTINCT term, kind, dt, lang FROM ({' UNION ALL '.join([head, *parts[1:]])}) WHERE {test}"


_LITS = f"lits AS (SELECT DISTINCT o FROM live WHERE o_kind = 2)"
_TOK = r"""tok AS (SELECT DISTINCT o AS literal, w AS token FROM (SELECT o, unnest(regexp_extract_all(regexp_replace(o, '([\p{L}\p{N}])-', '\1 ', 'g'), '-?[0-9]+[\p{L}\p{N}]*|[\p{L}\p{N}]+')) AS w0 FROM lits) z,
  LATERAL (SELECT CASE WHEN regexp_full_match(w0, '-[0-9]*[\p{L}].*') THEN substr(w0, 2) ELSE w0 END AS w) y
  WHERE CASE WHEN regexp_full_match(w, '-?[0-9]+') THEN try_cast(w AS BIGINT) BETWEEN -1073741824 AND 1073741824 ELSE length(w) > 1 AND lower(w) NOT IN ('and', 'an', 'or', 'of', 'on', 'in', 'this', 'the') END)"""
_FT = "strip_accents(lower(token))"
_NT = "CASE WHEN regexp_full_match(token, '-?[0-9]+') THEN try_cast(token AS BIGINT) END"
_TX = f"{_W}, {_LITS}, {_TOK}"


def _find(*conds: str, without: str | None = None) -> str:
    sql = " INTERSECT ".join(f"SELECT literal FROM tok WHERE {c}" for c in conds)
    return f"{_TX} SELECT DISTINCT literal FROM ({sql}{f' EXCEPT SELECT literal FROM tok WHERE {without}' if without else ''})"


_NATION = f"SELECT '{EX}nation/' || n_nationkey AS s, '{EX}{{}}' AS p"
_STAR = f"""st AS (SELECT '{EX}region/' || r_regionkey AS s, '{EX}name' AS p, r_name AS o, 2 AS o_kind FROM region
 UNION SELECT '{EX}nation/' || n_nationkey, '{EX}name', n_name, 2 FROM nation UNION SELECT '{EX}nation/' || n_nationkey, '{EX}inRegion', '{EX}region/' || n_regionkey, 0 FROM nation
 UNION SELECT '{EX}customer/' || c_custkey, '{EX}name', c_name, 2 FROM customer UNION SELECT '{EX}customer/' || c_custkey, '{EX}segment', c_mktsegment, 2 FROM customer
 UNION SELECT '{EX}customer/' || c_custkey, '{EX}inNation', '{EX}nation/' || c_nationkey, 0 FROM customer UNION SELECT '{EX}customer/' || c_custkey, '{EX}balance', cast(cast(round(c_acctbal * 100) AS BIGINT) AS VARCHAR), 2 FROM customer
 UNION SELECT '{EX}supplier/' || s_suppkey, '{EX}name', s_name, 2 FROM supplier UNION SELECT '{EX}supplier/' || s_suppkey, '{EX}inNation', '{EX}nation/' || s_nationkey, 0 FROM supplier
 UNION SELECT '{EX}supplier/' || s_suppkey, '{EX}balance', cast(cast(round(s_acctbal * 100) AS BIGINT) AS VARCHAR), 2 FROM supplier
 UNION SELECT '{EX}part/' || p_partkey, '{EX}name', p_name, 2 FROM part UNION SELECT '{EX}part/' || p_partkey, '{EX}brand', p_brand, 2 FROM part
 UNION SELECT '{EX}part/' || p_partkey, '{EX}kind', p_type, 2 FROM part UNION SELECT '{EX}part/' || p_partkey, '{EX}size', cast(p_size AS VARCHAR), 2 FROM part
 UNION SELECT '{EX}order/' || o_orderkey, '{EX}status', o_orderstatus, 2 FROM orders UNION SELECT '{EX}order/' || o_orderkey, '{EX}priority', o_orderpriority, 2 FROM orders
 UNION SELECT '{EX}order/' || o_orderkey, '{EX}placedBy', '{EX}customer/' || o_custkey, 0 FROM orders
 UNION SELECT '{EX}order/' || o_orderkey, '{EX}total', cast(cast(round(o_totalprice * 100) AS BIGINT) AS VARCHAR), 2 FROM orders)"""
_LINE = f"ln AS (SELECT l_orderkey AS k, '{EX}part/' || l_partkey AS member, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"
_B = " || ".join(f"lpad(printf('%02x', sum(('0x' || substr(h, {2 * i + 1}, 2))::INT) % 256), 2, '0')" for i in range(16))
_PX = {"voc": VOC, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}


def _ns(c: str, what: str) -> str:
    cases = " ".join(f"WHEN starts_with({c}, '{ns}') THEN '{p if what == 'prefix' else ns}'" for p, ns in sorted(_PX.items(), key=lambda x: -len(x[1])))
    return f"CASE {cases}{'' if what == 'prefix' else f" ELSE regexp_replace({c}, '[^#/]*$', '')"} END"


ORACLES = {
    "rdf_p": f"{_W} {_T} p = '{LABEL}'", "rdf_po": f"{_W} {_T} p = '{TYPE}' AND o = '{VOC}Bridge' AND o_kind <> 2", "rdf_o": f"{_W} {_T} o = '{VOC}Mill' AND o_kind <> 2",
    "rdf_spo_literal": f"{_W} {_T} p = '{VOC}storeys' AND o = '5' AND o_kind = 2 AND o_dt = '{XSD}integer' AND o_lang IS NULL", "rdf_same_var": f"{_W} {_T} s = o AND o_kind <> 2", "rdf3_dedup": f"{_W} {_T} p = '{VOC}broader'",
    "lit_plain_string": f"{_W} {_T} o = 'true' AND o_kind = 2 AND o_dt = '{XSD}boolean' AND o_lang IS NULL", "lit_icase": f"{_W} {_T} o_kind = 2 AND {_F} = 'n/a'", "lit_substring": f"{_W} {_T} o_kind = 2 AND contains({_F}, 'mor')",
    "lit_word": f"{_W} {_T} o_kind = 2 AND regexp_matches({_F}, '(^|[^\\p{{L}}\\p{{N}}])near($|[^\\p{{L}}\\p{{N}}])')", "lit_prefix": f"{_W} {_T} o_kind = 2 AND starts_with({_F}, 'bo')", "lit_like": f"{_W} {_T} o_kind = 2 AND {_F} LIKE 'ward:%kind%'",
    "lit_lt": f"{_W} {_T} {_V} < 3", "lit_le": f"{_W} {_T} {_V} <= 3", "lit_eq": f"{_W} {_T} {_V} = 7", "lit_ge": f"{_W} {_T} {_V} >= 100", "lit_gt": f"{_W} {_T} {_V} > 100.5", "lit_between": f"{_W} {_T} {_V} BETWEEN 5 AND 6.5",
    "lit_text_ge": f"{_W} {_T} o_kind = 2 AND o_lang = 'nl' AND (upper(strip_accents(o)) > 'ZU' OR (upper(strip_accents(o)) = 'ZU' AND o >= 'zu'))",
    "lang_matches_basic": f"{_W} {_T} o_kind = 2 AND (o_lang = 'en' OR starts_with(o_lang, 'en-'))", "lang_matches_wild": f"{_W} {_T} o_kind = 2 AND regexp_full_match(o_lang, '([^-]+-)*gb(-.*)?')", "lit_typed": f"{_W} {_T} p = '{VOC}lat' AND o_kind = 2 AND o_dt = '{XSD}double'",
    "rdf4_nodedup": f"{_W} {_S} p = '{VOC}broader'", "rdf_g": f"{_W} {_S} g = 'http://data.example/graph/catalog'", "rdf_pg": f"{_W} {_S} p = '{LABEL}' AND g = 'http://data.example/graph/registry'",
    "rdf_sp": f"{_W} {_T} s = 'http://data.example/site/1' AND p = '{TYPE}'", "rdf_sg": f"{_W} {_S} s = 'http://data.example/site/1' AND g = 'http://data.example/graph/catalog'",
    "source_location": f"{_W} SELECT DISTINCT s, g, line FROM live", "estimate_complexity": f"{_W} SELECT count(*) AS n FROM live WHERE p = '{TYPE}'",
    "constraint_conjunction": f"{_W} {_T} p = '{LABEL}' AND o_kind = 2 AND (o_lang = 'en' OR starts_with(o_lang, 'en-')) AND starts_with(lower(o), 'b')", "constraint_typed_number": f"{_W} {_T} {_V} = 2 AND o_dt = '{XSD}integer'",
    "bgp_customers_in_region": f"SELECT '{EX}customer/' || c_custkey AS customer, '{EX}nation/' || n_nationkey AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "bgp_star_order": f"SELECT '{EX}order/' || o_orderkey AS \"order\", '{EX}customer/' || o_custkey AS customer, o_orderstatus AS status, o_orderpriority AS priority FROM orders",
    "bgp_theta_siblings": f"SELECT '{EX}nation/' || a.n_nationkey AS a, '{EX}nation/' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    "bgp_optional": f"SELECT '{EX}customer/' || c_custkey AS customer, c_mktsegment AS segment, '{EX}order/' || o_orderkey AS \"order\" FROM customer LEFT JOIN orders ON o_custkey = c_custkey",
    "bgp_not_exists": f"SELECT '{EX}customer/' || c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", "bgp_exists": f"SELECT '{EX}customer/' || c_custkey AS customer FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "bgp_union": f"SELECT '{EX}order/' || o_orderkey AS \"order\" FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'F'",
    "has_subproperty": f"{_X} SELECT DISTINCT s, o, o_kind, o_dt, o_lang FROM x WHERE p IN {_WITHIN}",
    "has_realpred": f"{_X} SELECT DISTINCT s, o, o_kind, o_dt, o_lang, p AS real_p, false AS is_inverse FROM x WHERE p IN {_WITHIN} UNION SELECT o, s, {_BNODE.format('s')}, NULL, NULL, p, true FROM x WHERE p = '{VOC}narrower' AND o_kind <> 2",
    "has_inverse": f"{_X} SELECT s, o FROM x WHERE p = '{VOC}narrower' UNION SELECT o, s FROM x WHERE p = '{VOC}broader' AND o_kind <> 2",
    "has_symmetric": f"{_X} SELECT s, o FROM x WHERE p = '{VOC}linksTo' UNION SELECT o, s FROM x WHERE p = '{VOC}linksTo' AND o_kind <> 2",
    "subproperty_closure": f"{_X}, e AS (SELECT DISTINCT s AS sub, o AS super FROM x WHERE p = '{RDFS}subPropertyOf'), c AS (SELECT sub, super FROM e UNION SELECT c.sub, e.super FROM c JOIN e ON e.sub = c.super) SELECT sub, super FROM c UNION SELECT sub, sub FROM e UNION SELECT super, super FROM e",
    "reach_forward": f"{_X}, {_EDGE}, w AS (SELECT {_LEAST.format('s')} AS n, 0 AS d UNION SELECT e.b, w.d + 1 FROM w JOIN e ON e.a = w.n WHERE w.d < 200) SELECT {_LEAST.format('s')} AS s, n AS o, min(d) AS d FROM w GROUP BY n",
    "reach_backward": f"{_X}, {_EDGE}, w AS (SELECT {_LEAST.format('o')} AS n, 0 AS d UNION SELECT e.a, w.d + 1 FROM w JOIN e ON e.b = w.n AND e.o_kind <> 2 WHERE w.d < 200) SELECT n AS s, {_LEAST.format('o')} AS o, min(d) AS d FROM w GROUP BY n",
    "reach_maxd": f"{_X}, {_EDGE}, w AS (SELECT {_LEAST.format('o')} AS n, 0 AS d UNION SELECT e.a, w.d + 1 FROM w JOIN e ON e.b = w.n AND e.o_kind <> 2 WHERE w.d < 2) SELECT n AS s, {_LEAST.format('o')} AS o, min(d) AS d FROM w GROUP BY n",
    "subclass_of": f"{_X}, {_CLS} SELECT sub, super FROM sub", "individual_of": f"{_X}, {_CLS} SELECT DISTINCT x.s AS r, '{VOC}Thing' AS c FROM x JOIN sub ON sub.sub = x.o WHERE x.p = '{TYPE}' AND sub.super = '{VOC}Thing'",
    "class_property": f"{_X}, {_CLS} SELECT DISTINCT sub.sub AS c, d.s AS property FROM x d JOIN x pr ON pr.s = d.s AND pr.p = '{TYPE}' AND pr.o = '{RDF}Property' JOIN sub ON sub.super = d.o WHERE d.p = '{RDFS}domain'",
    "label_fallback": f"{_X}, {_LAB} SELECT DISTINCT r, label, rank FROM lab",
    "ns_label": f"{_X}, {_LAB} SELECT DISTINCT r, CASE WHEN starts_with(r, 'http://data.example/site/') THEN 'site:' WHEN starts_with(r, '{VOC}') THEN 'voc:' WHEN starts_with(r, 'http://data.example/') THEN 'data:' ELSE '' END || label AS ns_label FROM lab",
    "rdfs_find_word": f"{_X}, {_CLS} SELECT DISTINCT s AS r FROM x WHERE p IN ('{LABEL}', '{VOC}altLabel') AND o_kind = 2 AND regexp_matches({_F}, '(^|[^\\p{{L}}\\p{{N}}])near($|[^\\p{{L}}\\p{{N}}])') AND s IN (SELECT y.s FROM x y JOIN sub ON sub.sub = y.o WHERE y.p = '{TYPE}' AND sub.super = '{VOC}Structure')",
    "order_literals": f"""{_W}, l AS (SELECT DISTINCT o, o_kind, o_dt, o_lang FROM live WHERE o_kind = 2), k AS (SELECT *, {_V} AS v FROM l)
SELECT o, o_dt, o_lang, row_number() OVER (ORDER BY v IS NULL, v,
  CASE WHEN v IS NULL THEN 0 WHEN o_dt IN ('{XSD}double', '{XSD}float') THEN -3 WHEN o_dt = '{XSD}decimal' THEN -2 ELSE -1 END,
  CASE WHEN v IS NULL OR o_dt IN ('{XSD}double', '{XSD}float', '{XSD}decimal') THEN 0 ELSE coalesce(try_cast(o AS DECIMAL(38,0)), 0) END, upper(strip_accents(lower(o))), o, o_lang IS NOT NULL, coalesce(o_dt, ''), coalesce(o_lang, '')) AS rank FROM k""",
    "enum_subject": _terms("s"), "enum_predicate": _terms("p"), "enum_object": _terms("o"), "enum_node": _terms("so"), "enum_term": _terms("spo"), "enum_iri": _terms("spo", "kind = 0"), "enum_bnode": _terms("so", "kind = 1"), "enum_literal": _terms("o", "kind = 2"), "enum_name": _terms("spo", "kind IN (0, 2)"), "enum_resource": _terms("so", "kind < 2"),
    "stats_graph_counts": f"{_W} SELECT g, count(*) AS triples FROM live GROUP BY g", "stats_pred_counts": f"{_W} SELECT p, count(*) AS triples FROM live GROUP BY p",
    "stats_totals": f"""{_W} SELECT (SELECT count(*) FROM live) AS triples, (SELECT count(DISTINCT s) FROM live) AS subjects, (SELECT count(DISTINCT p) FROM live) AS properties, (SELECT count(*) FROM (SELECT DISTINCT o, o_kind, o_dt, o_lang FROM live)) AS objects,
 (SELECT count(*) FROM (SELECT DISTINCT o, o_dt, o_lang FROM live WHERE o_kind = 2)) AS literals, (SELECT count(*) FROM (SELECT s FROM live UNION SELECT o FROM live WHERE o_kind <> 2)) AS resources, (SELECT count(DISTINCT g) FROM live) AS graphs, (SELECT count(*) FROM live) - (SELECT count(*) FROM t) AS duplicates""",
    "branch_factors": f"{_W} SELECT p, count(*) / count(DISTINCT s) AS subject_branch_factor, count(*) / count(DISTINCT (o, o_kind, o_dt, o_lang)) AS object_branch_factor FROM t GROUP BY p",
    "branch_factors_sub": f"{_X}, h AS (SELECT DISTINCT s, o, o_kind, o_dt, o_lang FROM x WHERE p IN {_WITHIN}) SELECT '{VOC}within' AS p, count(*) / count(DISTINCT s) AS subject_branch_factor, count(*) / count(DISTINCT (o, o_kind, o_dt, o_lang)) AS object_branch_factor FROM h",
    "graph_md5": f"{_W} SELECT g, {_B} AS md5 FROM (SELECT g, md5(concat_ws(chr(1), s, p, o_kind::VARCHAR, o, coalesce(o_dt, ''), coalesce(o_lang, ''), g)) AS h FROM live) GROUP BY g",
    "prefix_usage": f"""{_W}, u AS (SELECT 'subject' AS w, s AS iri, s AS c FROM t WHERE NOT starts_with(s, '_:') UNION SELECT 'predicate', p, concat_ws(chr(1), s, p) FROM t UNION SELECT 'object', o, concat_ws(chr(1), s, p, o) FROM t WHERE o_kind = 0 UNION SELECT 'type', o_dt, concat_ws(chr(1), s, p, o, o_dt) FROM t WHERE o_dt IS NOT NULL)
SELECT {_ns('iri', 'prefix')} AS prefix, {_ns('iri', 'ns')} AS ns, count(*) AS contexts FROM u GROUP BY 1, 2 HAVING {_ns('any_value(iri)', 'prefix')} IS NOT NULL OR count(*) >= 2""",
    "name_functions": f"""{_W} SELECT DISTINCT p, CASE WHEN starts_with(p, '{VOC}') THEN 'voc:' || substr(p, {len(VOC) + 1}) WHEN starts_with(p, '{RDF}') THEN 'rdf:' || substr(p, {len(RDF) + 1}) WHEN starts_with(p, '{RDFS}') THEN 'rdfs:' || substr(p, {len(RDFS) + 1}) ELSE p END AS short,
 p AS long, regexp_replace(p, '[^#/]*$', '') AS base, regexp_extract(p, '[^#/]*$') AS local, md5(md5(p)) AS md5_twice FROM live""",
    "typed_values": f"""{_W} SELECT DISTINCT s, p, o, o_dt, CASE WHEN {_NUMERIC} AND o_dt NOT IN ('{XSD}double', '{XSD}float', '{XSD}decimal') AND regexp_full_match(o, '[+-]?[0-9]+') THEN try_cast(o AS DECIMAL(38,0)) END AS v_int, {_V} AS v_double, CASE WHEN o_dt = '{XSD}date' AND regexp_full_match(o, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})?') THEN try_cast(left(o, 10) AS DATE) END AS v_date FROM t WHERE o_kind = 2 AND o_dt IS NOT NULL""",
    "list_members": f"WITH {_LINE} SELECT pos, member, count(*) AS n FROM ln GROUP BY pos, member", "list_length": f"WITH {_LINE} SELECT n AS length, count(DISTINCT k) AS n FROM ln GROUP BY n", "list_nth1": f"WITH {_LINE} SELECT member, count(*) AS n FROM ln WHERE pos = 0 GROUP BY member",
    "list_nth": f"WITH {_LINE} SELECT pos AS n, member, count(*) AS lists FROM ln GROUP BY pos, member",
    "list_last": f"WITH {_LINE} SELECT member, count(*) AS n FROM ln WHERE pos = n - 1 GROUP BY member", "list_nextto": f"WITH {_LINE} SELECT DISTINCT a.member AS x, b.member AS y FROM ln a JOIN ln b ON a.k = b.k AND b.pos = a.pos + 1",
    "bag_members": f"SELECT '{EX}region/' || n_regionkey AS container, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n, '{EX}nation/' || n_nationkey AS member FROM nation",
    "alt_default": f"SELECT '{EX}region/' || n_regionkey AS container, '{EX}nation/' || min(n_nationkey) AS \"default\", count(*) - 1 AS n_others FROM nation GROUP BY n_regionkey",
    "text_token": _find(f"{_FT} = 'near'"), "text_and": _find(f"{_FT} = 'ward'", f"{_FT} = 'keeper'"), "text_or": f"{_TX} SELECT DISTINCT literal FROM tok WHERE {_FT} IN ('ward', 'near')", "text_not": _find(f"{_FT} = 'ward'", without=f"{_FT} = 'name'"),
    "text_prefix": _find(f"starts_with({_FT}, 'bo')"), "text_between": _find(f"{_NT} BETWEEN 10 AND 20"), "text_ge": _find(f"{_NT} >= 300"), "text_case": _find("token = 'NEAR'"), "text_stop_word": "SELECT '' AS literal WHERE false",
    "stopgap_tokens": f"{_TX} SELECT token, count(*) AS n FROM tok GROUP BY token HAVING count(*) > 100",
    "token_expansions": f"{_TX} SELECT DISTINCT 'prefix(kea)' AS key, token FROM tok WHERE starts_with({_FT}, 'kea') UNION SELECT DISTINCT 'token(ward)', token FROM tok WHERE {_FT} = 'ward'",
    "snapshot_asof": f"{_W}, m AS (SELECT floor(max(born) / 2) AS x FROM q) SELECT DISTINCT s, o FROM q, m WHERE p = '{VOC}linksTo' AND born <= m.x AND (died IS NULL OR died > m.x)",
    "update_object": f"""{_W}, b AS (SELECT * FROM live WHERE p = '{TYPE}' AND o = '{VOC}Bridge' AND o_kind <> 2), m AS (SELECT DISTINCT s, g, line FROM live WHERE p = '{TYPE}' AND o = '{VOC}Mill' AND o_kind <> 2)
SELECT s, g, line FROM b UNION ALL SELECT s, g, line FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.s = m.s AND b.g = m.g AND b.line IS NOT DISTINCT FROM m.line)""",
    "retract_pattern": f"{_W} SELECT p, count(*) AS triples FROM live WHERE NOT (p = '{LABEL}' AND g = 'http://data.example/graph/catalog') AND NOT coalesce({_V} > 100, false) GROUP BY p",
    "assert_again": f"{_W}, h AS (SELECT DISTINCT g, s, p, o, o_kind, o_dt, o_lang, line FROM live WHERE p = '{VOC}partOf') SELECT g, count(*) AS n FROM h GROUP BY g UNION ALL SELECT '{EX}again', count(*) FROM (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang, line FROM h)",
    "net_changes": f"{_W} SELECT 'retract' AS event, '{VOC}partOf' AS p, count(DISTINCT (s, o, g, line)) AS n FROM live WHERE p = '{VOC}partOf' UNION ALL SELECT 'assert', '{VOC}seen', 1",
    "monitor_counts_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "nt_roundtrip": f"{_W} SELECT DISTINCT s, p, o, o_kind FROM t WHERE NOT regexp_matches(s || p, '[\\x00-\\x20<>\"{{}}|^`\\\\]') AND (o_kind = 2 OR NOT regexp_matches(o, '[\\x00-\\x20<>\"{{}}|^`\\\\]')) AND (o_lang IS NULL OR regexp_full_match(o_lang, '[a-z]{{1,8}}(-[a-z0-9]{{1,8}})*'))",
    "turtle_roundtrip": f"WITH {_STAR} SELECT DISTINCT s, p, o, o_kind FROM st", "rdfxml_roundtrip": f"WITH {_STAR} SELECT DISTINCT s, p, o, o_kind FROM st",
    "json_result_rows": f"SELECT '{EX}nation/' || n_nationkey AS n, 0 AS n_kind, n_name AS name, 2 AS name_kind, NULL AS missing FROM nation", "graph_isomorphic": "SELECT 0 AS n_different",
    "lang_tags": f"{_W} SELECT o_lang, count(*) AS n, o_lang = 'en' OR starts_with(o_lang, 'en-') AS english FROM live WHERE o_lang IS NOT NULL GROUP BY o_lang",
    "rdfa_rows": f"SELECT '{EX}nation/' || n_nationkey AS s, '{TYPE}' AS p, '{EX}Nation' AS o, 0 AS o_kind FROM nation UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}name', n_name, 2 FROM nation UNION ALL SELECT '{EX}nation/' || n_nationkey, '{EX}inRegion', '{EX}region/' || n_regionkey, 0 FROM nation",
    "xml_result_rows": "SELECT r_name AS name, 2 AS name_kind, 'en' AS name_lang, NULL AS missing FROM region",
    "persist_roundtrip": f"{_W} SELECT g, count(*) AS triples FROM live GROUP BY g",
    "edit_undo_redo": f"{_W} SELECT p, count(*) AS n FROM (SELECT DISTINCT s, p, o, o_kind, o_dt, o_lang, g, line FROM live WHERE p <> '{VOC}linksTo') GROUP BY p",
    "import_closure": f"SELECT '{EX}nation/0' AS id, 0 AS level UNION ALL SELECT '{EX}region/' || n_regionkey, 1 FROM nation WHERE n_nationkey = 0",
    "list_retract": f"WITH {_LINE}, w AS (SELECT count(*) AS n FROM ln WHERE k <> (SELECT min(l_orderkey) FROM lineitem)) SELECT unnest(['{TYPE}', '{RDF}first', '{RDF}rest']) AS p, n AS triples FROM w",
    "literal_map_find": "WITH k AS (SELECT CAST(lit_id AS VARCHAR) AS value, strip_accents(lower(token)) AS key FROM rdf_litindex WHERE token IS NOT NULL AND lit_id IS NOT NULL) SELECT value FROM k WHERE key = 'of' INTERSECT SELECT value FROM k WHERE key = 'near' EXCEPT SELECT value FROM k WHERE key = 'the'",
    "members_of_sets": f"WITH {_LINE}, m AS (SELECT DISTINCT 'l' || k AS s, member FROM ln UNION SELECT 'r' || n_regionkey, '{EX}nation/' || n_nationkey FROM nation) SELECT member, count(*) AS n FROM m GROUP BY member",
}
