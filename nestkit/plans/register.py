"""SQL names for the functions on text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions import text as T
from ..functions.meta import HOME, SCOPES, VERSION


def _q(text: str) -> str:
    """A SQL literal; control characters as escapes, so that the statement stays printable."""
    return "'" + "".join(f"\\u{ord(c):04x}" if ord(c) < 32 else {"\\": "\\\\", "'": "\\'"}.get(c, c) for c in text) + "'"


def _before(char: str, back: int) -> str:
    head = f"substr(jsn, 1, greatest(0, idx - {back}))"
    return f"if(instr(reverse({head}), '{char}') > 0, length({head}) - instr(reverse({head}), '{char}') + 1, null)"


def definitions(strict: bool = False) -> dict[str, str]:
    """Name and signature of each SQL function, and its body."""
    plain, control = _q("".join(T.GUARDS)), _q("".join(T.GUARDS.values()))
    guard = f"if(esc, translate(str, {plain}, {control}), regexp_replace(str, {_q(T.DELIMITER)}, {_q(chr(92) * 2 + '$1')}))"
    quote = f"if(esc, {_q(T.QUOTE_GUARD)}, {_q(chr(92) + '“')})"
    if strict:
        marked = f"regexp_replace(replace(jsn, {_q(chr(92) + chr(34))}, {quote}), {_q('"([^"]*)"')}, {_q(T.CUT + T.QUOTED)} || '\"$1\"' || {_q(T.CUT)})"
        bare = f"replace(x, {_q(T.QUOTED)}, '')"
    else:
        marked = f"regexp_replace(jsn, {_q(r'"((?:[^"\\]|\\.)*+)"')}, {_q(T.CUT + T.QUOTED)} || '\"$1\"' || {_q(T.CUT)})"
        bare = f"regexp_replace(replace(x, {_q(T.QUOTED)}, ''), {_q(r'(?<!\\)((?:\\\\)*)\\"')}, if(esc, {_q('$1' + T.QUOTE_GUARD)}, {_q('$1' + chr(92) * 2 + '“')}))"
    inside = guard.replace("str,", f"{bare},")
    tuples = f"regexp_replace(jsn, {_q(T.NAMELESS)}, {_q(T.NAMELESS_AS)})"
    tuples = f"regexp_replace({tuples}, {_q(T.BARE_NAME)}, {_q(T.BARE_NAME_AS)})"
    fence = T._KEY + '(?:"[^"]*"|' + T._NUMBER[strict] + "|true|false|null)"
    name = "element_at(split(rtrim(':', nullif(regexp_replace(key, '[{\\\\[]+', ''), '')), ':'), -1)"
    out = {
        "fix_jsonKeyFragment(key STRING)": f"replace({name}, '\"', '')",
        "fix_jsonPrimitives(jsn STRING)": f"regexp_replace(jsn, {_q('(' + fence + ')')}, {_q(T.FENCE_OPEN + '$1' + T.FENCE_CLOSE)})",
        "fix_jsonSafeGuards(str STRING, esc BOOLEAN)": guard,
        "fix_jsonTuples(jsn STRING)": f"replace({tuples}, '\"\":', '\"undefined\":')",
        "get_jsonKeyFragment(jsn STRING, open INT, keypos INT)": "ltrim(substr(jsn, keypos + 1, greatest(0, open - keypos)))",
        "get_jsonKeyIndex(jsn STRING, idx INT)": f"coalesce({_before(',', 1)}, {_before('[', 2)}, {_before('{', 1)}, 0)",
        "get_jsonObjectFragment(jsn STRING, open INT, close INT)": f"replace(replace(substr(jsn, open, greatest(0, close - open + 1)), {_q(T.FENCE_OPEN)}, ''), {_q(T.FENCE_CLOSE)}, '')",
        "lay_jsonPrimitives(jsn STRING)": f"replace(replace(jsn, {_q(T.FENCE_OPEN)}, ''), {_q(T.FENCE_CLOSE)}, '')",
        "lay_jsonSafeGuards(str STRING)": f"replace(translate(str, {control}, {plain}), {_q(T.QUOTE_GUARD)}, {_q('\"' if strict else chr(92) + '\"')})",
        "map_jsonSafeGuards(jsn STRING, esc BOOLEAN)": f"array_join(transform(split({marked}, {_q(T.CUT)}), x -> if(startswith(x, {_q(T.QUOTED)}), {inside}, x)), '')",
    }
    table = "SELECT cast(sum(g + length(s)) OVER (ORDER BY k) - length(s) + 1 AS INT) AS idx, s AS sub FROM (SELECT k, m.`0` AS g, m.`1` AS s FROM (SELECT posexplode(arrays_zip(transform(split(str, rgx), x -> length(x)), regexp_extract_all(str, rgx, 0))) AS (k, m)) WHERE m.`1` IS NOT NULL)"
    out["get_characterIndices(str STRING, rgx STRING)"] = f"TABLE {table}"
    for n, scope in SCOPES.items():
        out[f"{n}_meta()"] = f"named_struct('scope', {_q(scope)}, 'version', '{VERSION}', 'repo', '{HOME}')"
    return out


def register(spark: SparkSession, strict: bool = False) -> list[str]:
    """Creates the temporary SQL functions and returns their names."""
    names = []
    for signature, body in definitions(strict).items():
        if body.startswith("TABLE "):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE (idx INT, sub STRING) RETURN {body[6:]}")
        else:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(")[0])
    return names
