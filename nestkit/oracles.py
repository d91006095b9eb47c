"""SQL for DuckDB that says the same as the queries, written from the rules and not from the Spark plans: brackets come
from pieces of text that end with one, keys from range frames over positions, parents from the level above."""

from __future__ import annotations

_PLAIN = "{}[]:,<>()#"
_CONTROL = "||".join(f"chr({c})" for c in (0x1C, 0x1D, 0x02, 0x03, 0x1E, 0x1F, 0x01, 0x04, 0x11, 0x13, 0x1B))
_DEEP = 9


def _mask(t: str, debug: bool = False) -> str:
    body = "regexp_replace(replace(x, chr(15), ''), '([{}\\[\\]:,<>()#])', '\\\\\\1', 'g')" if debug else f"translate(replace(x, chr(15), ''), '{_PLAIN}', {_CONTROL})"
    cut = f"string_split(regexp_replace({t}, '\"([^\"]*)\"', chr(14) || chr(15) || '\"\\1\"' || chr(14), 'g'), chr(14))"
    return f"array_to_string(list_transform({cut}, lambda x: CASE WHEN starts_with(x, chr(15)) THEN {body} ELSE x END), '')"


def _tuples(t: str) -> str:
    one = f"regexp_replace({t}, '\"\":([^{{}}\\[\\]]*?),\"\":([^{{}}\\[\\]]*?)', '\\1:\\2', 'g')"
    two = f"regexp_replace({one}, '([{{,])\\s*([^\":{{\\[\\]}}\\s]+)(\\s*:)', '\\1\"\\2\"\\3', 'g')"
    return f"replace({two}, '\"\":', '\"undefined\":')"


def _fence(t: str, strict: bool = False) -> str:
    number = "[\\d\\.]+" if strict else "-?[\\d.]+(?:[eE][+-]?\\d+)?"
    return f"regexp_replace({t}, '((?:\"[^\"]*\"|[^:,{{}}]*)\\s*:\\s*(?:\"[^\"]*\"|{number}|true|false|null))', '\"#\":{{\\1}},\"#\":#', 'g')"


def _unfence(t: str) -> str:
    return f"replace(replace({t}, '\"#\":{{', ''), '}},\"#\":#', '')"


def _unguard(t: str) -> str:
    return f"translate({t}, {_CONTROL}, '{_PLAIN}')"


_ORDERS = """SELECT o_orderkey AS doc, to_json({'status': o_orderstatus, 'total': o_totalprice, 'lines': lines, 'priority': o_orderpriority})::VARCHAR AS jsn
  FROM orders JOIN (SELECT l_orderkey, list(line ORDER BY line) AS lines FROM (SELECT l_orderkey,
    {'n': l_linenumber, 'part': l_partkey, 'qty': l_quantity, 'off': l_discount, 'flag': l_returnflag} AS line FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey"""
_CUSTOMERS = """SELECT c_custkey AS doc, to_json({'name': c_name, 'balance': c_acctbal, 'of': {'nation': c_nationkey, 'segment': c_mktsegment}, 'note': NULL::VARCHAR})::VARCHAR AS jsn FROM customer"""
_NATIONS = "(SELECT n_regionkey, list({'key': n_nationkey, 'name': n_name} ORDER BY n_nationkey, n_name) AS nations FROM nation GROUP BY 1) ON n_regionkey = r_regionkey"
_REGION_LISTS = f"SELECT r_regionkey::BIGINT AS doc, to_json(nations)::VARCHAR AS jsn FROM region JOIN {_NATIONS}"
_REGIONS = f"SELECT r_regionkey::BIGINT AS doc, to_json({{'name': r_name, 'nations': nations}})::VARCHAR AS jsn FROM region JOIN {_NATIONS}"
_PROPS = "SELECT event_id AS doc, props AS t FROM events"
_FENCED_ORDERS = f"SELECT doc, {_fence(_tuples(_mask('jsn')))} AS t FROM ({_ORDERS})"
_PAGES = "SELECT page_id AS doc, html AS t FROM pages"


def _chars(src: str) -> str:
    """ch: brackets and commas with their positions, which are the lengths of what stands before them."""
    return f"""src AS ({src}),
tk AS (SELECT doc, unnest(regexp_extract_all(t, '[^\\[\\]{{}},]*[\\[\\]{{}},]')) AS part, unnest(range(1, 1 + len(regexp_extract_all(t, '[\\[\\]{{}},]')))) AS k FROM src),
ch AS (SELECT doc, (sum(length(part)) OVER (PARTITION BY doc ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT AS idx, right(part, 1) AS sub FROM tk)"""


def _pairs(src: str) -> str:
    """nd: level, slot, open, close, nest, kpos and the text's pieces of each bracket pair."""
    return f"""{_chars(src)},
dl AS (SELECT *,
    max(CASE WHEN sub = ',' THEN idx END) OVER (PARTITION BY doc ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS comma,
    max(CASE WHEN sub = '[' THEN idx END) OVER (PARTITION BY doc ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS square,
    max(CASE WHEN sub = '{{' THEN idx END) OVER (PARTITION BY doc ORDER BY idx RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS curly,
    sum(CASE WHEN sub IN ('[', '{{') THEN 1 WHEN sub IN (']', '}}') THEN -1 ELSE 0 END) OVER w AS total,
    sum(CASE sub WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS arrays
  FROM ch WHERE sub IN ('[', ']', '{{', '}}', ',') WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING)),
br AS (SELECT doc, idx, coalesce(comma, square, curly, 0) AS kpos, arrays AS nest, sub IN ('[', '{{') AS opens,
    CASE WHEN sub IN ('[', '{{') THEN total - 1 ELSE total END AS level FROM dl WHERE sub <> ','),
ob AS (SELECT *, row_number() OVER (PARTITION BY doc, level, opens ORDER BY idx) - 1 AS slot FROM br),
pr AS (SELECT o.doc, o.level, o.slot, o.idx AS open, c.idx AS close, o.nest, o.kpos FROM ob o JOIN ob c
    ON o.doc = c.doc AND o.level = c.level AND o.slot = c.slot AND o.opens AND NOT c.opens),
nd AS (SELECT pr.*, ltrim(substr(t, kpos + 1, greatest(0, open - kpos)), ' ') AS fragment, {_unfence("substr(t, open, close - open + 1)")} AS json FROM pr JOIN src USING (doc))"""


_NAME = "replace(list_extract(string_split(rtrim(nullif(regexp_replace(fragment, '[{\\[]+', '', 'g'), ''), ':'), ':'), -1), '\"', '')"


def _keys(src: str) -> str:
    """sy: with the key as written, the symbol and the mark of an array's first container."""
    return f"""{_pairs(src)},
n1 AS (SELECT *, {_NAME} AS nm, string_split(replace(fragment, '"#":{{', ''), ':') AS parts FROM nd),
sy AS (SELECT * EXCLUDE (nm, parts), CASE WHEN nm = '#' THEN string_split(translate(json, '{{}}"', ''), ':')[1] ELSE nm END AS rawkey,
    CASE WHEN nm = '#' THEN '#' ELSE right(fragment, 1) END AS sym, coalesce(parts[2], parts[1]) AS arr,
    regexp_matches(coalesce(parts[2], parts[1]), '^\\[[\\[{{]') AS lead FROM n1)"""


def _number(family: str, level: str, named: str) -> str:
    """From rows kx (with k, the key so far): acid, ocid, ecid, lst and the final key and ord."""
    return f"""
a1 AS (SELECT *, sum(lead::INT) OVER (PARTITION BY {family} ORDER BY slot ROWS UNBOUNDED PRECEDING) AS acid,
    row_number() OVER (PARTITION BY {level}, k ORDER BY open) - 1 AS ocid FROM {named}),
a2 AS (SELECT *, row_number() OVER (PARTITION BY {level}, ocid ORDER BY open) - 1 AS ecid,
    coalesce(bool_or(arr IN ('[{{', '[[') AND sym IN ('[', '{{')) OVER (PARTITION BY {family}, acid ORDER BY slot ROWS UNBOUNDED PRECEDING), false) AS lst,
    row_number() OVER (PARTITION BY {family}, acid ORDER BY slot) - 1 AS nr FROM a1),
a3 AS (SELECT *, CASE WHEN open = 1 AND k IS NULL THEN '$' ELSE k END AS k2 FROM a2),
a4 AS (SELECT *, CASE WHEN lst THEN coalesce(k2, '') || '[' || nr || ']' ELSE k2 END AS key, '@{{' || ocid || ',' || ecid || '}}' AS ord FROM a3)"""


_OUT = """nth, CASE WHEN depth = 0 THEN -1 WHEN depth = 1 THEN 0 ELSE pnth END AS parenth, slot, open, close, nest, key, ord, sym, json,
    CASE WHEN depth = 0 THEN -1 WHEN depth = 1 THEN 0 ELSE pnth END AS parent_nth, parent_key, parent_ord"""


def _above(pick: int) -> str:
    """ab: each node as a child of its level and as a parent of the next, with the parent that opened last."""
    level = "OVER (PARTITION BY doc, grp ORDER BY open ROWS UNBOUNDED PRECEDING)"
    return f"""rl AS (SELECT *, true AS child, level AS grp FROM sy WHERE level <= {pick} UNION ALL SELECT *, false, level + 1 FROM sy WHERE level < {pick}),
ab AS (SELECT *, last_value(CASE WHEN NOT child THEN open END IGNORE NULLS) {level} AS lo, arg_max(CASE WHEN NOT child THEN [rawkey] END, CASE WHEN NOT child THEN open END) {level}[1] AS lr FROM rl)"""


def _nodes(src: str, pick: int = _DEEP) -> str:
    """fin: corrected nodes, one parent's array at a time."""
    return f"""WITH {_keys(src)},
{_above(pick)},
up AS (SELECT * EXCLUDE (child, grp, lo, lr), lo AS popen, lr AS praw FROM ab WHERE child),
kx AS (SELECT *, coalesce(rawkey, praw) AS k FROM up),{_number("doc, level, popen", "doc, level", "kx")},
nn AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY level, open) - 1 AS nth FROM a4),
fin AS (SELECT c.doc, c.level::BIGINT AS depth, c.nth, p.nth AS pnth, c.slot, c.open, c.close, c.nest::BIGINT AS nest, c.key, c.ord, c.sym, c.json, p.key AS parent_key, p.ord AS parent_ord,
    c.acid, c.ocid, c.ecid, c.lst FROM nn c LEFT JOIN nn p ON p.doc = c.doc AND p.level = c.level - 1 AND p.open = c.popen)"""


def _nodes_strict(src: str, pick: int = _DEEP) -> str:
    """fin: nodes with arrays counted a level at a time, and parents' keys as their level shows them."""
    return f"""WITH {_keys(src)},
{_above(pick)},
kx AS (SELECT * EXCLUDE (rawkey), coalesce(rawkey, last_value(CASE WHEN NOT child THEN rawkey END IGNORE NULLS) OVER (PARTITION BY doc, grp ORDER BY open ROWS UNBOUNDED PRECEDING)) AS k FROM ab),
{_number("doc, grp, child", "doc, grp, child", "kx")},
nn AS (SELECT *, row_number() OVER (PARTITION BY doc, child ORDER BY level, open) - 1 AS nth FROM a4),
fin AS (SELECT c.doc, c.level::BIGINT AS depth, c.nth, p.nth AS pnth, c.slot, c.open, c.close, c.nest::BIGINT AS nest, c.key, c.ord, c.sym, c.json, p.key AS parent_key, p.ord AS parent_ord
  FROM (SELECT * FROM nn WHERE child) c LEFT JOIN (SELECT * FROM nn WHERE NOT child) p ON p.doc = c.doc AND p.grp = c.grp AND p.open = c.lo)"""


def _masked(rows: str) -> str:
    return _tuples(_mask("jsn")) + f" AS t FROM ({rows})"


def _parsed(rows: str) -> str:
    fenced = f"SELECT doc, {_fence(_tuples(_mask('jsn')))} AS t FROM ({rows})"
    clean = f"CASE WHEN json_valid({_unguard('json')}) THEN {_unguard('json')} END"
    out = _OUT.replace("key, ord, sym, json", f"{_unguard('key')} AS key, ord, sym, {clean} AS json").replace("parent_key,", f"{_unguard('parent_key')} AS parent_key,")
    return f"{_nodes(fenced)} SELECT doc, depth, {out} FROM fin"


_TUPLE_TEXTS = """SELECT c_custkey AS doc, '{"":"a","":' || c_custkey || ',"":"seg","":"' || coalesce(c_mktsegment, 'null') || '","":{"":' || coalesce(c_nationkey::VARCHAR, 'null') || '},{ bare : 1, other:2}}' AS t FROM customer"""
_BRACKETS = f"WITH {_chars(_PAGES)}, sp AS (SELECT doc, idx, sub, t FROM ch JOIN src USING (doc) WHERE sub IN ('[', ']', '{{', '}}'))"


def _back(char: str, back: int) -> str:
    head = f"substr(t, 1, greatest(0, idx - {back})::BIGINT)"
    return f"CASE WHEN strpos({head}, '{char}') > 0 THEN length({head}) - strpos(reverse({head}), '{char}') + 1 END"


_KPOS = f"coalesce({_back(',', 1)}, {_back('[', 2)}, {_back('{', 1)}, 0)"

ORACLE_SQL = {
    "namespace_meta": """SELECT namespace, scope, '0.1.2' AS version, 'nestkit' AS repo FROM (VALUES ('cue', 'jsonObjectInterface'), ('def', 'no functions'), ('try', 'no functions'),
        ('fix', 'jsonKeyFragment, jsonPrimitives, jsonSafeGuards, jsonTuples'), ('lay', 'jsonPrimitives, jsonSafeGuards'), ('map', 'jsonSafeGuards, objectContainment'), ('use', 'parser, unroller'),
        ('get', 'characterIndices, jsonKeyFragment, jsonKeyIndex, jsonObjectBoundaries, jsonObjectFragment, jsonObjectMetadata, jsonStringFromStruct, jsonStringMask, unrolled')) AS v(namespace, scope)""",
    "json_from_struct": f"SELECT doc, jsn FROM ({_CUSTOMERS})",
    "json_from_array": f"SELECT doc, jsn FROM ({_REGION_LISTS})",
    "fence": f"SELECT doc, {_fence(_tuples(_mask('jsn')))} AS jsn FROM ({_ORDERS})",
    "fence_props": f"SELECT doc, {_fence('t')} AS jsn FROM ({_PROPS})",
    "unfence": f"SELECT doc, {_tuples(_mask('jsn'))} AS jsn FROM ({_ORDERS})",
    "guard_escape": f"SELECT doc_id, translate(text, '{_PLAIN}', {_CONTROL}) AS str FROM documents",
    "guard_debug": "SELECT page_id, regexp_replace(html, '([{}\\[\\]:,<>()#])', '\\\\\\1', 'g') AS str FROM pages",
    "unguard": "SELECT page_id, html AS str FROM pages",
    "quoted_mask": f"SELECT doc, {_mask('jsn')} AS jsn FROM ({_CUSTOMERS})",
    "quoted_mask_debug": f"SELECT doc, {_mask('jsn', True)} AS jsn FROM ({_CUSTOMERS})",
    "string_mask": f"SELECT doc, {_tuples(_mask('jsn'))} AS jsn FROM ({_CUSTOMERS})",
    "tuples_fix": f"SELECT doc, {_tuples('t')} AS jsn FROM ({_TUPLE_TEXTS})",
    "char_indices": f"{_BRACKETS} SELECT doc, idx, sub FROM sp",
    "key_index": f"{_BRACKETS} SELECT doc, idx, {_KPOS} AS kpos FROM sp",
    "key_fragment": f"{_BRACKETS}, kp AS (SELECT *, {_KPOS} AS kpos FROM sp) SELECT doc, idx, ltrim(substr(t, kpos + 1, greatest(0, idx - kpos)::BIGINT), ' ') AS key FROM kp",
    "key_name": f"WITH {_pairs(_FENCED_ORDERS)} SELECT doc, open, {_NAME} AS key FROM nd",
    "object_fragment": f"WITH {_pairs(_FENCED_ORDERS)} SELECT doc, open, json FROM nd",
    "object_interface": f"""WITH {_pairs(_FENCED_ORDERS)} SELECT doc, true AS raise, level AS depth, slot, level - 1 AS pre, open, close, kpos, nest, fragment AS key,
        NULL::VARCHAR AS arr_sym, NULL::VARCHAR AS arr_ctx, NULL::VARCHAR AS ord, NULL::VARCHAR AS sym, json, NULL::VARCHAR AS acid, NULL::VARCHAR AS ocid, NULL::VARCHAR AS ecid, false AS list FROM nd""",
    "containment": f"""WITH {_chars(_FENCED_ORDERS)}, dp AS (SELECT doc, idx, sub, sum(CASE sub WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS in_arrays,
        sum(CASE sub WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w AS in_objects FROM ch WHERE sub IN ('[', ']', '{{', '}}') WINDOW w AS (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING))
      SELECT doc, idx, sub, in_arrays + in_objects - 1 - (CASE WHEN sub IN ('[', '{{') THEN 1 ELSE -1 END) + r AS pre, in_arrays + in_objects - 1 + r AS depth, in_arrays, in_objects, r = 0 AS raise
      FROM dp, (VALUES (0), (1)) AS v(r)""",
    "boundaries": f"""WITH {_pairs(_FENCED_ORDERS)} SELECT doc, level + r - 1 AS pre, level + r AS depth, r = 0 AS raise, slot, open, close, nest FROM nd, (VALUES (0), (1)) AS v(r) WHERE level + r <= 2""",
    "metadata": f"{_nodes(_FENCED_ORDERS)} SELECT doc, depth, slot, open, close, key, sym, ord, acid, ocid, ecid, lst AS list FROM fin",
    "unroller": f"{_nodes(_PROPS)} SELECT doc, depth, {_OUT} FROM fin",
    "unrolled_orders": f"{_nodes(_FENCED_ORDERS)} SELECT doc, depth, {_OUT} FROM fin",
    "unrolled_strict": f"{_nodes_strict(_FENCED_ORDERS.replace(_fence(_tuples(_mask('jsn'))), _fence(_tuples(_mask('jsn')), True)))} SELECT doc, depth, {_OUT} FROM fin",
    "unrolled_depth_1": f"{_nodes(_FENCED_ORDERS, 1)} SELECT doc, depth, {_OUT} FROM fin",
    "parser_customers": _parsed(_CUSTOMERS),
    "parser_regions": f"SELECT t AS str, starts_with(t, '[{{') OR starts_with(t, '[[') AS is_array_root, n.* FROM (SELECT doc, {_masked(_REGION_LISTS)}) m JOIN ({_parsed(_REGION_LISTS)}) n USING (doc)",
    "parser_nested": f"""SELECT doc, any_value(t) AS str, any_value(starts_with(t, '[{{') OR starts_with(t, '[[')) AS is_array_root, depth, count(*) AS n, string_agg(key, '|' ORDER BY nth) AS keys
      FROM (SELECT doc, {_masked(_REGIONS)}) m JOIN ({_parsed(_REGIONS)}) n USING (doc) WHERE depth <= 2 GROUP BY doc, depth""",
    "parser_orders": _parsed(_ORDERS),
    "parser_orders_nested": f"""SELECT doc, false AS is_array_root, depth, count(*) AS n, string_agg(key, '|' ORDER BY nth) AS keys, sum(strlen(json))::BIGINT AS bytes
      FROM ({_parsed(_ORDERS)}) WHERE depth <= 3 GROUP BY doc, depth""",
    "level_stats": f"{_nodes(_FENCED_ORDERS)} SELECT depth, sym, count(*) AS n, count(DISTINCT doc) AS docs, sum(nth)::BIGINT AS nths, max(close) AS far FROM fin GROUP BY 1, 2",
    "leaf_pivot": """SELECT l_orderkey AS doc, 4 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_discount, l_returnflag) AS line,
        l_linenumber AS n, l_partkey AS part, l_quantity AS qty, l_discount AS "off" FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
}
