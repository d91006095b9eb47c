"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Only DataFrame expressions. What is shuffled is a narrow row (id, length, prefix hash, digest). Each level keeps only
groups of two or more for the next, so a text of a length that no other text has never reaches the hash levels, and
drop_exact() reads whole contents only of texts that share length and prefix with another one. mark_exact() gives every
row's digest to the caller and so takes all of them in its one scan; there the levels decide which rows are grouped. Groups are never gathered: each level is a partial aggregate and a semi-join, which
Spark splits where one key holds much of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, fresh, table

PREFIX = 256


def mark_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256; texts compare after lower-casing A to Z.

    A null text counts as empty, and empty texts form one group. Long texts are compared whole. Of equal texts the largest id stays. Rows that repeat
    id and text each get the same values. A null id is smaller than any other; in a group of null ids alone keep_id is
    null and each row is kept. An empty table gives an empty result. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession)
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    # The caller gets every row's digest, so it is taken in the one scan that the table needs; the levels below only
    # decide which rows are grouped by it.
    narrow = scratch.save(
        docs.select(F.col(id_col).alias("id"), norm.alias("t")).select(
            "id",
            F.octet_length("t").cast("long").alias("n"),
            F.xxhash64(F.substring("t", 1, PREFIX)).alias("prefix"),
            F.sha2(F.col("t").cast("binary"), 256).alias("sha"),
        )
    )
    # Copies collapse before they meet, and each level is a written table: it goes to the rows if its files are small, and
    # else Spark can split the join where one key has much of the rows.
    lengths = scratch.save(narrow.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select("n"))
    pairs = narrow.groupBy("n", "prefix").agg(F.count("*").alias("c")).where("c > 1")
    prefixes = scratch.save(pairs.join(scratch.small(lengths), "n", "left_semi").select("n", "prefix"))
    alike = narrow.join(scratch.small(prefixes), ["n", "prefix"], "left_semi")
    groups = scratch.save(alike.groupBy("sha").agg(F.max("id").alias("keep"), F.count("*").alias("c")).where("c > 1"))
    scratch.only(narrow, groups)
    marked = narrow.join(scratch.small(groups), "sha", "left")
    keep = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("keep"))
    return marked.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that mark_exact does not keep; all columns stay, whatever their names. Of rows that repeat
    id and text one stays, and so of equal texts without any id.

    The first scan takes lengths and prefix hashes. Only texts that share both with another one are read again for their
    digest; a text of its own length or prefix is kept without. What to drop is a written table, broadcast if it is
    small, so that texts need not move; beyond that they are shuffled to it.
    """
    scratch = Scratch(docs.sparkSession)
    size, prefix, sha, best, hit, row = fresh(docs, "size", "prefix", "sha", "best", "hit", "row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Lower-casing A to Z changes neither a length nor where a prefix ends.
    levels = docs.withColumns({size: F.octet_length(text).cast("long"), prefix: F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX)))})
    narrow = scratch.save(levels.select(size, prefix))
    lengths = scratch.save(narrow.groupBy(size).agg(F.count("*").alias("c")).where("c > 1").select(size))
    pairs = narrow.groupBy(size, prefix).agg(F.count("*").alias("c")).where("c > 1")
    alike = scratch.save(pairs.join(scratch.small(lengths), size, "left_semi").select(size, prefix, F.lit(True).alias(hit)))
    digest = F.sha2(ascii_lower(text).cast("binary"), 256)
    rows = scratch.save(levels.join(scratch.small(alike), [size, prefix]).select(F.col(id_col).alias(row), digest.alias(sha)))
    groups = rows.groupBy(sha).agg(F.max(row).alias(best), F.count("*").alias("c")).where("c > 1")
    groups = scratch.save(groups.select(sha, best, F.lit(True).alias(row)))
    # Groups whose best id has several rows.
    several = rows.withColumnRenamed(row, hit).join(scratch.small(groups), sha).where(F.col(hit).eqNullSafe(F.col(best)))
    several = scratch.save(several.groupBy(sha).agg(F.count("*").alias("c")).where("c > 1").select(sha, F.lit(True).alias(size)))
    scratch.only(alike, groups, several)
    marked = levels.join(scratch.small(alike), [size, prefix], "left").withColumn(sha, F.when(F.col(hit), digest)).drop(size, prefix, hit)
    kept = marked.join(scratch.small(groups), sha, "left").where(F.col(row).isNull() | F.col(id_col).eqNullSafe(F.col(best)))
    return one_of_each(kept, sha, several, scratch).select(*docs.columns)


def one_of_each(rows: DataFrame, key: str, several: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with one row of each key that the saved table several names; only those rows are shuffled."""
    if not several.limit(1).count():
        return rows
    named = several.select(key)
    single = rows.join(scratch.small(named, of=several), key, "left_anti")
    return single.unionByName(rows.join(scratch.small(named, of=several), key, "left_semi").dropDuplicates([key]))


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark_exact(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
