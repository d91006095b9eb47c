"""Positions of matches, nesting depth and paired levels.

Every operator keeps the documents' key columns and works within a document. Those of documents (contained()) need no
exchange, since a text's brackets and levels follow from the text alone (scan.py); those of tables of characters take one
hash exchange on the key for the whole chain.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from . import scan

Pairs = Sequence[tuple[str, str]]
PAIRS: Pairs = (("[", "]"), ("{", "}"))


def bracket_pattern(pairs: Pairs = PAIRS, more: str = "") -> str:
    return "[" + "".join("\\" + c for c in dict.fromkeys([*(c for p in pairs for c in p), *more])) + "]"


def character_indices(df: DataFrame, by: Sequence[str], text: str, pattern: str) -> DataFrame:
    """by, idx, sub: all matches of a pattern and the positions (from 1) where they start; sub is the pattern's first
    group if it has one. One pass over the text: a position is the sum of the lengths before it."""
    group = 1 if re.compile(pattern.replace("(?<", "(?P<") if re.search(r"\(\?<\w", pattern) else pattern).groups else 0
    at, lit = F.col(text), F.lit(pattern)
    columns = [F.transform(F.split(at, pattern, -1), F.length).alias("gap"), F.regexp_extract_all(at, lit, F.lit(0)).alias("whole")]
    if group:
        columns.append(F.regexp_extract_all(at, lit, F.lit(1)).alias("sub"))
    rows = df.select(*by, F.posexplode(F.arrays_zip(*columns)).alias("k", "m")).where("m.whole is not null")
    upto = Window.partitionBy(*by).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("m.whole")
    idx = F.sum(F.col("m.gap") + size).over(upto) - size + 1
    return rows.select(*by, idx.alias("idx"), F.col("m.sub" if group else "m.whole").alias("sub"))


def object_containment(chars: DataFrame, by: Sequence[str], pairs: Pairs = PAIRS) -> DataFrame:
    """by, idx, sub, pre, depth, depths, raise: each bracket as a child (raise) and as a parent of the level below."""
    upto = Window.partitionBy(*by).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    depths = [F.sum(F.when(F.col("sub") == o, 1).when(F.col("sub") == c, -1).otherwise(0)).over(upto) for o, c in pairs]
    total = sum(depths[1:], depths[0]) - 1
    step = F.when(F.col("sub").isin([o for o, _ in pairs]), 1).otherwise(-1)
    rows = chars.select(*by, "idx", "sub", total.alias("total"), F.array(*depths).alias("depths"), step.alias("step"))
    return _roles(rows, by)


def _roles(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    # In a step of its own: a generator next to windows would run before them.
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("r"))
    return rows.select(*by, "idx", "sub", (F.col("total") - F.col("step") + F.col("r")).alias("pre"), (F.col("total") + F.col("r")).alias("depth"), "depths", (F.col("r") == 0).alias("raise"))


def contained(docs: DataFrame, by: Sequence[str], text: str, pairs: Pairs = PAIRS) -> DataFrame:
    """object_containment() of all brackets of texts, without a table of characters in between."""
    depths = [f"_depth{i}" for i in range(len(pairs))]
    kinds = [("idx", "bigint"), ("sub", "string"), ("total", "bigint"), ("step", "int"), *[(d, "bigint") for d in depths]]
    docs = docs.select(*by, text)
    schema = Y.StructType([*[docs.schema[c] for c in by], *[Y.StructField(n, Y.DataType.fromDDL(k)) for n, k in kinds]])
    rows = docs.mapInArrow(scan.contained(list(by), text, list(pairs)), schema)
    return _roles(rows.withColumn("depths", F.array(*depths)), by)


def object_boundaries(contained: DataFrame, by: Sequence[str], pick: int | None) -> DataFrame:
    """by, pre, depth, raise, slot, open, close, nest: the k-th opening bracket of a level paired with the k-th closing
    one; levels beyond pick are dropped before anything is paired, and without pick there are none."""
    level = contained.where(F.greatest("pre", "depth") <= F.lit(pick).cast("int"))
    level = level.select(*by, F.least("pre", "depth").alias("a"), F.greatest("pre", "depth").alias("b"), "raise", (F.col("pre") > F.col("depth")).alias("pin"), "idx", F.get("depths", F.lit(0)).alias("nest"))
    slot = F.row_number().over(Window.partitionBy(*by, "b", "raise", "pin").orderBy("idx")) - 1
    bracket = F.struct("idx", "nest")
    paired = level.withColumn("slot", slot).groupBy(*by, "a", "b", "raise", "slot").agg(F.min_by(bracket, "pin").alias("head"), F.max_by(bracket, "pin").alias("tail"))
    return paired.select(*by, F.col("a").alias("pre"), F.col("b").alias("depth"), "raise", "slot", F.col("head.idx").alias("open"), F.col("tail.idx").alias("close"), F.col("head.nest").alias("nest"))
