"""Mixing sources to target weights by entropy balancing, with DataFrame expressions only.

The mix takes each document at a rate between 0 and 2 that is as near to 1 as can be (least relative entropy against
one copy each) while every source's words meet its target. The dual of that problem is convex and has one multiplier
a source: rate = min(2, exp(multiplier * size / mean size of the source)). Newton steps solve it; one step is one
aggregate over the table of (source, size, documents), kept inside a bracket by bisection. Rates become copies by
systematic rounding along the sizes of a source, so a source's words miss the target by about one document. Documents of
one source and size take leftover copies in the order of a hash of the id; where that order is cut is found exactly, by
counting the hash's digits, so no group of documents is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, table

CAP = 2.0
#: Hashes that order documents of one source and size have ROUNDS digits of DIGIT bits.
DIGIT, ROUNDS = 6, 9


def targets(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """sources (skey, source_size) with the target of each: weights repeat along skey, and no target exceeds CAP times
    the source; the excess is shared again by weight until none does (water filling, solved by prefix sums over the
    sources in the order in which they fill). The windows run over one row a source."""
    every = Window.partitionBy()
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy("skey")) - 1) % len(weights) + 1).cast("int"))
    level = Window.orderBy("fills", "skey").rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("weight", pick).withColumn("room", CAP * F.col("source_size")).withColumn("fills", F.col("room") / F.col("weight"))
    s = s.withColumn("left", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("room").over(level), F.lit(0.0)))
    s = s.withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(level), F.lit(0.0)))
    # The level that all earlier sources reach and this one does not.
    s = s.withColumn("water", F.col("left") / F.col("open")).withColumn("before", F.coalesce(F.lag("fills").over(Window.orderBy("fills", "skey")), F.lit(0.0)))
    s = s.withColumn("water", F.min(F.when((F.col("fills") >= F.col("water")) & (F.col("before") <= F.col("water")), F.col("water"))).over(every))
    target = F.when(F.col("water").isNull(), F.col("room")).otherwise(F.least("room", F.col("water") * F.col("weight")))
    return s.select("skey", "source_size", target.alias("target"))


def _solve(cells: DataFrame, state: DataFrame, scratch: Scratch, tolerance: float = 1e-9, most: int = 100) -> DataFrame:
    """Newton's iterations on the multipliers; state has one row a source."""
    for _ in range(most):
        x = F.try_divide("size", "mean")
        rate = F.when(F.col("lam") * x >= F.log(F.lit(CAP)), F.lit(CAP)).otherwise(F.exp(F.least(F.col("lam") * x, F.lit(1.0))))
        words = F.col("docs") * F.col("size")
        sums = (
            cells.join(state.where("not solved"), "skey")
            .groupBy("skey")
            .agg(F.sum(words * rate).alias("got"), F.sum(F.when(F.col("lam") * x < F.log(F.lit(CAP)), words * x * rate).otherwise(0.0)).alias("slope"))
        )
        step = state.join(sums, "skey", "left")
        miss = F.col("got") - F.col("target")
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss < 0, F.col("hi")).otherwise(F.col("lam"))
        newton = F.col("lam") - miss / F.nullif("slope", F.lit(0.0))
        done = F.col("solved") | (F.abs(miss) <= tolerance * F.greatest("target", F.lit(1.0))) | (hi - lo <= 1e-14 * (F.abs(hi) + F.abs(lo)))
        moved = step.select("skey", "source_size", "target", "mean", done.alias("solved"), "lam", lo.alias("lo"), hi.alias("hi"), newton.alias("newton"))
        free = (F.col("newton") > F.col("lo")) & (F.col("newton") < F.col("hi"))
        moved = moved.withColumn("lam", F.when(F.col("solved"), F.col("lam")).when(free, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("newton")
        before, state = state, scratch.save(moved)
        scratch.drop(before)
        if not state.where("not solved").limit(1).count():
            return state
    raise RuntimeError(f"multipliers are not solved after {most} steps")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict:
    """Expressions of a row's source (in code-point order, null last), size, and place among equals (52 bits)."""
    return {
        "skey": F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col))),
        "size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "u": F.xxhash64(F.col(id_col), F.lit("copies")).bitwiseAND(F.lit((1 << (DIGIT * ROUNDS)) - 1)),
    }


def plan(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float) -> tuple[DataFrame, DataFrame]:
    """The rows as id, skey, size, u; and for each source and size: source_size, target, rate, each (whole copies of
    every document) and cut (documents with a smaller u take one more). Both are written tables."""
    narrow = scratch.save(docs.select(F.col(id_col).alias("id"), *[e.alias(n) for n, e in _keyed(docs, id_col, text_col, source_col).items()]))
    cells = scratch.save(narrow.groupBy("skey", "size").agg(F.count("*").alias("docs")))
    words = F.col("size") * F.col("docs")
    mean, heavy = F.sum(words) / F.sum("docs"), F.try_divide(F.sum(words * F.col("size")), F.sum(words))
    sources = cells.groupBy("skey").agg(F.sum(words).alias("source_size"), mean.alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), heavy.alias("heavy"))
    sources = scratch.save(sources)
    s = targets(sources.select("skey", "source_size"), weights, share).join(sources.drop("source_size"), "skey")
    least, part = F.try_divide("least", "mean"), F.log(F.try_divide("target", "source_size"))
    full = F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12)
    state = s.select(
        "skey", "source_size", "target", "mean",
        (full | F.col("least").isNull()).alias("solved"),
        # A full source takes everything at the cap: any multiplier from here on does that.
        F.when(full, F.log(F.lit(CAP)) / least).otherwise(part * F.col("mean") / F.col("heavy")).alias("lam"),
        F.when(part < 0, part / least * (1 + 1e-9) - 1e-9).otherwise(F.lit(-1e-9)).alias("lo"),
        (F.when(part > 0, F.log(F.lit(CAP)) / least).otherwise(F.lit(0.0)) + 1e-9).alias("hi"),
    )
    state = _solve(cells, scratch.save(state), scratch)
    tilt = F.col("lam") * F.try_divide("size", "mean")
    rate = F.when(tilt >= F.log(F.lit(CAP)), F.lit(CAP)).otherwise(F.exp(F.least(tilt, F.lit(1.0))))
    rate = F.when((F.col("size") == 0) | F.col("lam").isNull(), F.lit(1.0)).when(F.col("target") >= CAP * F.col("source_size") * (1 - 1e-12), F.lit(CAP)).otherwise(rate)
    # Systematic rounding over the sizes of a source, largest first so that the small ones even out what is left: as
    # many rows as it has different sizes, not documents.
    along = Window.partitionBy("skey").orderBy(F.desc("size"))
    rated = cells.join(state, "skey").withColumn("rate", rate).withColumn("upto", F.floor(F.sum(F.col("docs") * F.col("rate")).over(along) + 0.5))
    total = F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0))
    rated = rated.withColumn("total", F.greatest(F.lit(0), F.least(total, CAP * F.col("docs"))).cast("long"))
    rated = scratch.save(rated.select("skey", "size", "docs", "source_size", "target", "rate", F.expr("total div docs").alias("each"), F.expr("total % docs").alias("rest")))
    cuts = _cuts(narrow, rated.where("rest > 0").select("skey", "size", "rest"), scratch)
    done = rated.join(scratch.small(cuts), ["skey", "size"], "left")
    return narrow, scratch.save(done.select("skey", "size", "source_size", "target", "rate", "each", F.coalesce("cut", F.lit(0)).cast("long").alias("cut")))


def _cuts(narrow: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """For each source and size of wanted the least cut such that rest of its rows, counted by different ids, have a u
    below it. A round counts one digit of u among the rows that are still in question and finds by running sums, of at
    most 2^DIGIT rows a group, the digit at which rest is reached."""
    state, found = scratch.save(wanted.withColumn("top", F.lit(0).cast("long"))), []
    for k in range(ROUNDS):
        low = DIGIT * (ROUNDS - 1 - k)
        digit = F.shiftright("u", low).bitwiseAND(F.lit((1 << DIGIT) - 1))
        rows = narrow.join(scratch.small(state), ["skey", "size"]).where(F.shiftright("u", low + DIGIT) == F.col("top"))
        counts = rows.groupBy("skey", "size", "top", "rest", digit.alias("digit")).agg(F.count("*").alias("c"), F.max("u").alias("last"), F.min("u").alias("first"))
        along = Window.partitionBy("skey", "size").orderBy("digit")
        counts = counts.withColumn("upto", F.sum("c").over(along))
        # The digit at which rest is reached; a row less than all of it means another round.
        at = scratch.save(counts.where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("c") < F.col("rest"))))
        whole = (F.col("upto") == F.col("rest")) | (F.col("first") == F.col("last"))
        found.append(at.where(whole).select("skey", "size", (F.col("last") + 1).alias("cut")))
        left = F.col("rest") - (F.col("upto") - F.col("c"))
        state = scratch.save(at.where(~whole).select("skey", "size", left.alias("rest"), ((F.col("top") * (1 << DIGIT)) + F.col("digit")).alias("top")))
        if not state.limit(1).count():
            break
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return scratch.save(out)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row per row of docs: id, size (words), source_size, target (of its source), taken (words), rate, copies.

    A null text has size 0, a null source is a source of its own and comes last. Long texts are counted whole. A document of size 0 has rate 1 and
    one copy. Of documents of one source and size those with the smaller hash of the id take the copies left over; rows
    that repeat an id take the same number. Reruns agree. A source whose target is twice its size takes every document
    twice. An empty table gives an empty result. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    narrow, cells = plan(docs, scratch, id_col, text_col, source_col, weights, share)
    scratch.only(narrow, cells)
    copies = F.col("each") + (F.col("u") < F.col("cut")).cast("long")
    found = narrow.join(scratch.small(cells), ["skey", "size"])
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "rate", copies.alias("copies"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """docs with each row as often as the mix takes it; all columns stay, whatever their names. Copies follow from a
    row's source, size and id, so texts do not move where the table of sources and sizes is small enough to go to them."""
    scratch = Scratch(docs.sparkSession)
    _, cells = plan(docs, scratch, id_col, text_col, source_col, weights, share)
    skey, size, u, each, cut = names = fresh(docs, "skey", "size", "u", "each", "cut")
    cells = scratch.save(cells.select(*[F.col(c).alias(n) for c, n in zip(("skey", "size", "each", "cut"), (skey, size, each, cut))]))
    scratch.only(cells)
    keys = _keyed(docs, id_col, text_col, source_col)
    joined = docs.withColumns(dict(zip(names, keys.values()))).join(scratch.small(cells), [skey, size])
    times = F.array_repeat(F.lit(0), (F.col(each) + (F.col(u) < F.col(cut)).cast("long")).cast("int"))
    return joined.select(*docs.columns, F.explode(times).alias(u)).select(*docs.columns)


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
