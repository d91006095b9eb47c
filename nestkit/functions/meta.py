"""What each namespace holds, generated from the list of its functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION, HOME = "0.1.2", "nestkit"
#: The functions of each namespace, besides meta itself.
FUNCTIONS = {
    "cue": ["jsonObjectInterface"],
    "def": [],
    "fix": ["jsonKeyFragment", "jsonPrimitives", "jsonSafeGuards", "jsonTuples"],
    "get": ["characterIndices", "jsonKeyFragment", "jsonKeyIndex", "jsonObjectBoundaries", "jsonObjectFragment", "jsonObjectMetadata", "jsonStringFromStruct", "jsonStringMask", "unrolled"],
    "lay": ["jsonPrimitives", "jsonSafeGuards"],
    "map": ["jsonSafeGuards", "objectContainment"],
    "try": [],
    "use": ["parser", "unroller"],
}
SCOPES = {n: ", ".join(names) or "no functions" for n, names in FUNCTIONS.items()}


def meta(namespace: str) -> Column:
    """struct<scope, version, repo> of one namespace."""
    return F.struct(F.lit(SCOPES[namespace]).alias("scope"), F.lit(VERSION).alias("version"), F.lit(HOME).alias("repo"))


def registry(spark: SparkSession) -> DataFrame:
    """One row a namespace."""
    return spark.createDataFrame([(n, s, VERSION, HOME) for n, s in SCOPES.items()], "namespace string, scope string, version string, repo string")
