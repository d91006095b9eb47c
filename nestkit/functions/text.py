"""Column functions on JSON text: serialising, guarding delimiters, fencing primitives, keys and fragments.

All are built-in expressions, so they run inside the JVM on batch and streaming frames alike. Where a function has
strict, True gives the documented quirks of plain string surgery and False (the default) the corrected result: negative
numbers and exponents are fenced, and escaped quotes survive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: each delimiter and the control character that stands for it inside a quoted text.
GUARDS = {
    "{": "\x1c",
    "}": "\x1d",
    "[": "\x02",
    "]": "\x03",
    ":": "\x1e",
    ",": "\x1f",
    "<": "\x01",
    ">": "\x04",
    "(": "\x11",
    ")": "\x13",
    "#": "\x1b",
}
QUOTE_GUARD, CUT, QUOTED = "\x05", "\x0e", "\x0f"
FENCE_OPEN, FENCE_CLOSE = '"#":{', '},"#":#'
# Fixed patterns of the format: two fields without a name, a name without quotes, a delimiter. Both engines' SQL uses them.
NAMELESS, NAMELESS_AS = r'"":([^{}\[\]]*?),"":([^{}\[\]]*?)', "$1:$2"
BARE_NAME, BARE_NAME_AS = r'([{,])\s*([^":{\[\]}\s]+)(\s*:)', '$1"$2"$3'
DELIMITER = r"([{}\[\]:,<>()#])"
#: A text whose quoted parts hold nothing to guard; possessive, so that its length does not matter.
_NOTHING_TO_GUARD = r'^(?:[^"\x0e\x0f]++|"[^"\\{}\[\]:,<>()#\x0e\x0f]*+")*+\z'
#: A key starts where a run of other characters starts; possessive, so that long prose costs one pass.
_KEY = r'(?:"[^"]*"|(?:\G|(?<![^:,{}]))[^:,{}]*+)\s*:\s*'
_NUMBER = {True: r"[\d.]+", False: r"-?[\d.]+(?:[eE][+-]?\d+)?"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def json_text(value: Column | str) -> Column:
    """JSON text of a value of any type. Null fields stay; numeric literals keep their form (1.0 stays 1.0)."""
    wrapped = F.to_json(F.struct(_col(value).alias("v")), {"ignoreNullFields": "false"})
    return wrapped.substr(F.lit(6), F.length(wrapped) - 6)


def guard(text: Column | str, escape: bool = True) -> Column:
    """Delimiters replaced by control characters, or (escape False) with a backslash before them."""
    if escape:
        return F.translate(_col(text), "".join(GUARDS), "".join(GUARDS.values()))
    return F.regexp_replace(_col(text), DELIMITER, r"\\$1")


def unguard(text: Column | str, strict: bool = False) -> Column:
    """The inverse of guard(escape=True); a guarded quote comes back escaped, or bare if strict."""
    t = F.translate(_col(text), "".join(GUARDS.values()), "".join(GUARDS))
    return F.replace(t, F.lit(QUOTE_GUARD), F.lit('"' if strict else '\\"'))


def guard_quoted(text: Column | str, escape: bool = True, strict: bool = False) -> Column:
    """guard() inside quoted texts only. An escaped quote becomes its own control character, or a curly quote."""
    quote = F.lit(QUOTE_GUARD if escape else "\\“")
    if strict:
        marked = F.regexp_replace(F.replace(_col(text), F.lit('\\"'), quote), '"([^"]*)"', f'{CUT}{QUOTED}"$1"{CUT}')
    else:
        marked = F.regexp_replace(_col(text), r'"((?:[^"\\]|\\.)*+)"', f'{CUT}{QUOTED}"$1"{CUT}')

    def inside(x: Column) -> Column:
        bare = F.replace(x, F.lit(QUOTED), F.lit(""))
        if not strict:  # a quote behind an odd number of backslashes; the closing one can follow an even number
            bare = F.regexp_replace(bare, r'(?<!\\)((?:\\\\)*)\\"', "$1" + (QUOTE_GUARD if escape else "\\\\“"))
        return guard(bare, escape)

    guarded = F.array_join(F.transform(F.split(marked, CUT, -1), lambda x: F.when(x.startswith(QUOTED), inside(x)).otherwise(x)), "")
    return F.when(_col(text).rlike(_NOTHING_TO_GUARD), _col(text)).otherwise(guarded)


def fix_tuples(text: Column | str) -> Column:
    """Consecutive fields without a name become name and value; bare names get quotes; a name left over is undefined."""
    folded = F.regexp_replace(_col(text), NAMELESS, NAMELESS_AS)
    quoted = F.regexp_replace(folded, BARE_NAME, BARE_NAME_AS)
    return F.replace(quoted, F.lit('"":'), F.lit('"undefined":'))


def mask(value: Column | str, strict: bool = False) -> Column:
    """Serialised, guarded and with names everywhere: the text that unrolling starts from."""
    guarded = guard_quoted(json_text(value), True, strict)
    if strict:
        return fix_tuples(guarded)
    # In JSON with guarded texts each colon follows a quote, so that without an empty name there is nothing to fold, and
    # no bare name that folding would leave.
    return F.when(F.contains(guarded, F.lit('"":')), fix_tuples(guarded)).otherwise(guarded)


def fence(text: Column | str, strict: bool = False) -> Column:
    """Each key with a primitive value wrapped so that it reads as an object."""
    return F.regexp_replace(_col(text), f'({_KEY}(?:"[^"]*"|{_NUMBER[strict]}|true|false|null))', f"{FENCE_OPEN}$1{FENCE_CLOSE}")


def unfence(text: Column | str) -> Column:
    return F.replace(F.replace(_col(text), F.lit(FENCE_OPEN), F.lit("")), F.lit(FENCE_CLOSE), F.lit(""))


def key_index(text: Column | str, idx: Column | str) -> Column:
    """Where the key before the bracket at idx begins: behind the last comma; else the last [ before the character
    next to the bracket; else the last {; else 0."""

    def before(char: str, back: int) -> Column:
        head = _col(text).substr(F.lit(1), F.greatest(F.lit(0), _col(idx) - back))
        at = F.instr(F.reverse(head), char)
        return F.when(at > 0, F.length(head) - at + 1)

    found = F.coalesce(before(",", 1), before("[", 2), before("{", 1), F.lit(0))
    return F.when(_col(text).isNotNull() & _col(idx).isNotNull(), found)


def key_fragment(text: Column | str, open_: Column | str, key_at: Column | str) -> Column:
    """Text behind the key's beginning, up to and with the bracket."""
    return F.ltrim(_col(text).substr(_col(key_at).cast("int") + 1, F.greatest(F.lit(0), _col(open_) - _col(key_at)).cast("int")))


def key_name(fragment: Column | str) -> Column:
    """The key in a fragment: without brackets, quotes and colons; null if nothing is left."""
    bare = F.nullif(F.regexp_replace(_col(fragment), r"[{\[]+", ""), F.lit(""))
    return F.replace(F.element_at(F.split(F.rtrim(bare, F.lit(":")), ":", -1), -1), F.lit('"'), F.lit(""))


def object_fragment(text: Column | str, open_: Column | str, close: Column | str) -> Column:
    """The region from open to close, without fences."""
    return unfence(_col(text).substr(_col(open_).cast("int"), F.greatest(F.lit(0), _col(close) - _col(open_) + 1).cast("int")))


def valid_json(text: Column | str) -> Column:
    """The text if it parses as JSON, else null."""
    return F.when(F.try_parse_json(_col(text)).isNotNull(), _col(text))
