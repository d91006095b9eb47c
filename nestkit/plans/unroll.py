"""unrolled() for JSON text and parser() for values of any type."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.levels import PAIRS, Pairs
from ..operators.nodes import FIELDS, trees, unroller


def unrolled(df: DataFrame, by: str | Sequence[str], text: str, upto: int | None, pairs: Pairs = PAIRS, strict: bool = False) -> DataFrame:
    """Nodes of JSON text, primitives included. Brackets inside quoted texts count; mask the text first to avoid it."""
    by = [by] if isinstance(by, str) else list(by)
    return unroller(df.select(*by, T.fence(text, strict).alias("_fenced")), by, "_fenced", upto, pairs, strict)


def parser(df: DataFrame, by: str | Sequence[str], value: Column | str, max_depth: int | None, shape: str = "flat", strict: bool = False, variant: bool = False) -> DataFrame:
    """Serialises, masks and unrolls a value of any type; json is unmasked, and null where it does not parse.

    flat: by, str, is_array_root and FIELDS, one row a node. nested: by, str, levels, is_array_root, one row a document,
    with no levels for a value without brackets. variant: json is a parsed value (VARIANT, which sorts its keys and
    drops trailing zeros) instead of text; a null value of str (a null document) gives no row in the flat shape.
    """
    if shape not in ("flat", "nested"):
        raise ValueError("shape is flat or nested")
    by = [by] if isinstance(by, str) else list(by)
    masked = df.select(*by, T.mask(value, strict).alias("str"))
    fenced = masked.select(*by, "str", T.fence("str", strict).alias("_fenced"))

    def clean(n: Column, fields: list[str] = FIELDS) -> list[Column]:
        plain = T.unguard(n["json"], strict)
        out = {f: n[f] for f in fields} | {"json": F.try_parse_json(plain) if variant else T.valid_json(plain)}
        if not strict:
            parent = n["parent"]
            out |= {"key": T.unguard(n["key"]), "parent": F.struct(parent["nth"].alias("nth"), T.unguard(parent["key"]).alias("key"), parent["ord"].alias("ord"))}
        return [c.alias(f) for f, c in out.items()]

    root = (F.col("str").startswith("[{") | F.col("str").startswith("[[")).alias("is_array_root")
    if shape == "flat":
        found = trees(fenced, by, "_fenced", max_depth, strict=strict).select(*by, "str", F.explode("nodes").alias("_n"))
        return found.select(*by, "str", root, *clean(F.col("_n")))
    children = lambda level: F.transform(level["children"], lambda n: F.struct(*clean(n, FIELDS[1:])))
    levels = F.transform("nodes", lambda level: F.struct(level["depth"].alias("depth"), children(level).alias("children")))
    return trees(fenced, by, "_fenced", max_depth, strict=strict, levels=True).select(*by, "str", levels.alias("levels"), root)
