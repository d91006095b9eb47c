"""Repeated runs of lines, found with a suffix array over line numbers and deleted but for their first copy.

The suffix array comes from distributed prefix doubling. Lines that occur once cannot be part of a repeated run and are
left out at the start. A suffix starts with the rank of its line; a round sorts the suffixes that still tie by (own rank,
rank of the suffix 2^k lines on) and so doubles the length that ranks tell apart. A round is a join, an aggregate to
distinct pairs, and a range-partitioned sort of those pairs, whose running counts give the new ranks; nothing is
grouped by line, so a line that makes up much of the corpus is dealt over all tasks like the rest. Suffixes that no longer tie, or
whose run meets the document's end or a line that occurs once, drop out of the rounds.

Suffixes that share their first n lines are an interval of the suffix array, with a longest common prefix of n lines or
more. A descent from long prefixes to short ones finds for each suffix the longest one that it shares with a suffix that
comes earlier in the corpus (by id, then line): the maximal repeated run that starts there and is a later copy. At step k
an interval splits by the ranks of the next 2^k lines. All members of a part but the earliest go down into it, and take
the earliest along as a witness; the earliest itself searches on in the interval that it came from. The runs' lines,
joined where runs overlap, are deleted, so of each run the first copy stays.

A place in the corpus is one number: its document's in the order of ids, and the line's in the lower PLACE bits. So the
earliest member of a part is the least number, and the rounds carry no ids or digests of documents.

A run counts if it has MIN_LINES lines, or is a line of at least LINE_CHARS characters. Runs do not cross documents; blank
lines are not part of the sequence and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Lines of the shortest run.
MIN_LINES = 2
#: Characters of the shortest single line that is a run: about ten words, where chance repeats end.
LINE_CHARS = 50
SPACES = " \t\n\x0b\f\r"
KEY = ["d1", "d2"]
#: Bits of a line's number in its document; a text of 2 GB has fewer lines with content. 33 bits are left for documents.
PLACE = 30


def _document(id_col: str, text_col: str) -> list[Column]:
    """128 bits that stand for a row's id and text."""
    return [F.xxhash64(F.col(id_col), F.col(text_col)).alias("d1"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("d2")]


def _line(pos: str) -> Column:
    return F.col(pos).bitwiseAND(F.lit((1 << PLACE) - 1))


def _offsets(sizes: DataFrame) -> DataFrame:
    """pid, before: how much lies in the partitions before each; sizes (pid, n) has one row a partition."""
    offsets, total = [], 0
    for pid, n in sizes.orderBy("pid").collect():
        offsets.append((pid, total))
        total += n
    return F.broadcast(sizes.sparkSession.createDataFrame(offsets, "pid long, before long"))


def _starts(groups: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """groups (keys, c) with rank: how many rows the groups before it hold, in the order of the keys."""
    ranged = scratch.save(groups.repartitionByRange(*keys).withColumn("pid", F.spark_partition_id().cast("long")))
    inside = F.sum("c").over(Window.partitionBy("pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    before = _offsets(ranged.groupBy("pid").agg(F.sum("c").alias("n")))
    return scratch.save(ranged.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "pid").withColumn("rank", F.col("before") + F.col("inside")).drop("pid", "before", "inside"))


def suffix_array(lines: DataFrame, numbers: DataFrame, scratch: Scratch) -> DataFrame:
    """lines: d1, d2, idx, long, h1, h2 (the line); numbers: d1, d2, number. Returns those whose line repeats as pos (the
    document's number and idx), long, rank (its place in the suffix array, equal for suffixes that end alike) and ranks (of
    each round k in which the next 2^k lines exist and only hold repeated lines; equal ranks mean equal lines)."""
    groups = lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1")
    named = lines.join(_starts(groups, ["h1", "h2"], scratch), ["h1", "h2"]).select(*KEY, "idx", "long", "rank")
    pos = F.shiftleft("number", PLACE) + F.col("idx")
    now = scratch.save(named.join(numbers, KEY).select(pos.alias("pos"), "long", "rank", F.array("rank").alias("ranks"), F.lit(True).alias("open")))
    done, k = now.where("not open"), 0
    now = now.where("open")
    while now.limit(1).count():
        step = 1 << k
        ahead = done.unionByName(now).where(_line("pos") >= step).select((F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"), (F.size("ranks") == k + 1).alias("whole"))
        pairs = now.withColumnRenamed("rank", "r1").join(ahead, "pos", "left")
        pairs = scratch.save(pairs.withColumn("r2", F.coalesce("r2", F.lit(-1))).withColumn("whole", F.coalesce("whole", F.lit(False))))
        groups = _starts(pairs.groupBy("r1", "r2").agg(F.count("*").alias("c")), ["r1", "r2"], scratch)
        # A class of c suffixes owns c ranks from its own on, so ranks of different classes never meet.
        base = groups.groupBy("r1").agg(F.min("rank").alias("base"))
        groups = groups.join(base, "r1").select("r1", "r2", "c", (F.col("r1") + F.col("rank") - F.col("base")).alias("rank"))
        # A suffix that ends here takes part once more: it gets the class's first rank, before those that go on.
        found = F.when(F.col("whole"), F.concat("ranks", F.array("rank"))).otherwise(F.col("ranks"))
        named = scratch.save(pairs.join(groups, ["r1", "r2"]).select("pos", "long", "rank", found.alias("ranks"), (F.col("whole") & (F.col("c") > 1)).alias("open")))
        scratch.drop(pairs)
        done, now, k = done.unionByName(named.where("not open")), named.where("open"), k + 1
    return done.drop("open")


def later_runs(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """suffixes with lines: the length of the longest run from there on that has an earlier copy; only where there is one."""
    top = suffixes.agg(F.max(F.size("ranks"))).first()[0] or 0
    state = scratch.save(suffixes.select("pos", "long", "ranks", F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("c1"), F.lit(0).cast("long").alias("c2"), F.lit(True).alias("seeks")))
    for k in range(top - 1, -1, -1):
        ahead = suffixes.where(F.size("ranks") > k).select(F.col("pos").alias("at"), F.get("ranks", F.lit(k)).alias("r"))
        here = state.where("lines = 0").withColumn("r", F.get("ranks", F.lit(k)))
        beyond = state.where("lines > 0").withColumn("at", F.col("pos") + F.col("lines")).join(ahead, "at", "left").drop("at")
        named = scratch.save(here.unionByName(beyond))
        parts = named.where("r is not null").groupBy("c1", "c2", "r").agg(F.min("pos").alias("first"), F.max(F.when(F.col("seeks"), F.col("pos"))).alias("last"), F.count("*").alias("c"))
        # A part matters if another member than its earliest seeks.
        parts = parts.where("c > 1").select("c1", "c2", "r", "first", F.coalesce(F.col("last") > F.col("first"), F.lit(False)).alias("goes"))
        parts = scratch.save(parts)
        joined = named.join(scratch.small(parts), ["c1", "c2", "r"], "left")
        earliest = F.col("pos") == F.col("first")
        stay = F.struct(F.lit(0).alias("by"), F.col("c1").alias("n1"), F.col("c2").alias("n2"), F.col("seeks").alias("s"))
        down = lambda seeks, k=k: F.struct(F.lit(1 << k).alias("by"), F.xxhash64("c1", "c2", "r", F.lit(k)).alias("n1"), F.xxhash64(F.lit(1), "r", "c2", "c1", F.lit(k)).alias("n2"), seeks.alias("s"))
        none = F.filter(F.array(stay), lambda x: F.lit(False))
        moves = F.when(F.col("first").isNull(), F.array(stay)).when(earliest & F.col("goes"), F.array(stay, down(F.lit(False)))).when(earliest, F.array(stay)).when(F.col("goes"), F.array(down(F.col("seeks")))).otherwise(none)
        moved = joined.select("pos", "long", "ranks", "lines", F.explode(moves).alias("m"))
        before, state = state, scratch.save(moved.select("pos", "long", F.when((F.col("lines") + F.col("m.by")) == 0, F.col("ranks")).alias("ranks"), (F.col("lines") + F.col("m.by")).alias("lines"), F.col("m.n1").alias("c1"), F.col("m.n2").alias("c2"), F.col("m.s").alias("seeks")))
        scratch.drop(before, named, parts)
    return state.where("seeks and lines > 0").select("pos", "long", "lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, line_chars: int = LINE_CHARS) -> DataFrame:
    """One row per row of docs: id, n_lines, n_deleted, longest_run (lines of the longest run in the document that is a
    later copy and counts; 0 if there is none), text without the later copies.

    A null text stays null with 0 lines. Long texts are read whole. Rows that repeat id and text count as one document and
    get equal results. Null ids come first in the order of copies. A line's first copy always stays, so no line vanishes
    from the corpus; a run may overlap its own copy. An empty table gives an empty result. Other columns are not read.
    """
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    scratch = Scratch(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = source.select("id", "text", *_document("id", "text"))
    content = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    each = keyed.where("text is not null").select(*KEY, "id", F.posexplode(content).alias("idx", "line"))
    lines = scratch.save(each.select(*KEY, "id", "idx", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), (F.length("line") >= line_chars).alias("long")))
    # Equal rows are one document: each place of it once.
    repeated = lines.where("idx = 0").groupBy(*KEY).count().where("count > 1").select(*KEY)
    if repeated.limit(1).count():
        lines = lines.join(repeated, KEY, "left_anti").unionByName(lines.join(repeated, KEY, "left_semi").dropDuplicates([*KEY, "idx"]))
    # Null ids come first, rows of one id in the order of their digests.
    numbers = _starts(lines.where("idx = 0").select("id", *KEY, F.lit(1).alias("c")), ["id", *KEY], scratch).select(*KEY, F.col("rank").alias("number"))
    runs = later_runs(scratch.save(suffix_array(lines, numbers, scratch)), scratch)
    runs = runs.select(F.shiftright("pos", PLACE).alias("number"), _line("pos").cast("int").alias("idx"), "long", "lines")
    # The end of the run that counts from each line on, and how far the runs before it reach.
    end = F.when(F.col("lines") >= min_lines, F.col("idx") + F.col("lines")).when(F.col("long"), F.col("idx") + 1)
    runs = runs.withColumn("end", end.cast("int")).where("end is not null")
    reached = F.max("end").over(Window.partitionBy("number").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("from", F.greatest("idx", F.coalesce(reached, F.lit(0))))
    places = F.when(F.col("from") < F.col("end"), F.sequence("from", F.col("end") - 1)).otherwise(F.array().cast("array<int>"))
    found = runs.groupBy("number").agg(F.sort_array(F.flatten(F.collect_list(places))).alias("gone"), F.max(F.col("end") - F.col("idx")).cast("long").alias("longest"))
    found = scratch.save(found.join(numbers, "number").drop("number"))
    scratch.only(found)
    # Texts and results meet by document, at every size alike. A task hashes its share of the results; texts are not sorted.
    out = keyed.join(found.hint("shuffle_hash"), KEY, "left").withColumn("all", F.split("text", "\n", -1))
    # ls: all lines; ps: places of those with content; then the places that stay. Each is bound once, and every step
    # takes time in proportion to the lines.
    filled = r"btrim(x, ' \t\n\u000b\f\r') != ''"
    places = f"filter(transform(ls, (x, i) -> if({filled}, i, null)), i -> i is not null)"
    stay = "array_except(sequence(0, size(ls) - 1), transform(gone, g -> get(ps, g)))"
    body = f"element_at(transform(array({places}), ps -> array_join(transform({stay}, i -> get(ls, i)), '\n')), 1)"
    kept = F.when(F.size("gone") > 0, F.expr(f"element_at(transform(array(split(text, '\n', -1)), ls -> {body}), 1)")).otherwise(F.col("text"))
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce(F.size("all"), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest_run"),
        kept.alias("text"),
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


#: The same by comparing each place of a line with every earlier place of it: equal lines on a diagonal of two documents
#: are a run. Rows of one id and different texts count in the order of their texts here.
OP8_SQL = f"""WITH dc AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS d FROM (SELECT DISTINCT doc_id, text FROM documents)),
al AS (SELECT d, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM dc WHERE text IS NOT NULL),
sq AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY pos) - 1 AS k FROM al WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
pr AS (SELECT p.d, p.k, q.d AS e, p.k - q.k AS apart FROM sq p JOIN sq q ON p.line = q.line AND (q.d < p.d OR q.d = p.d AND q.k < p.k)),
il AS (SELECT *, k - row_number() OVER (PARTITION BY d, e, apart ORDER BY k) AS island FROM pr),
ru AS (SELECT d, k, max(k) OVER (PARTITION BY d, e, apart, island) + 1 - k AS lines FROM il),
bs AS (SELECT d, k, max(lines) AS lines FROM ru GROUP BY 1, 2),
en AS (SELECT sq.d, sq.pos, sq.k, CASE WHEN lines >= {MIN_LINES} THEN lines WHEN lines = 1 AND length(line) >= {LINE_CHARS} THEN 1 END AS n FROM sq LEFT JOIN bs USING (d, k)),
gn AS (SELECT d, pos, n, coalesce(max(k + n) OVER (PARTITION BY d ORDER BY k ROWS UNBOUNDED PRECEDING) > k, false) AS gone FROM en),
ou AS (SELECT d, count(*)::INTEGER AS n_lines, count(*) FILTER (gone)::INTEGER AS n_deleted, coalesce(max(n), 0)::BIGINT AS longest_run,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '') AS kept FROM al LEFT JOIN gn USING (d, pos) GROUP BY d)
SELECT s.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(longest_run, 0) AS longest_run, CASE WHEN n_deleted > 0 THEN kept ELSE s.text END AS text
FROM documents s JOIN dc ON dc.doc_id IS NOT DISTINCT FROM s.doc_id AND dc.text IS NOT DISTINCT FROM s.text LEFT JOIN ou USING (d)"""
