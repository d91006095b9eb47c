"""Near-duplicates by SimHash fingerprints and a tiled exact comparison.

Fingerprints of equal value collapse to one row before anything is compared. The rest are dealt into tiles by the
population counts of their two halves: two fingerprints within the radius cannot differ by more than the radius in
the sum of those counts, so only neighbouring tiles meet. A tile holds a bounded number of fingerprints (a hot cell
gets more tiles). Inside a pair of tiles, blocks sorted by the counts of their four quarters are skipped by the same
bound, and the others are compared exactly with exclusive-or and bit counts. A pair of tiles emits a spanning forest
of its links, never all pairs, and the components of those forests are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches, table
from .components import components

TILE = 65536
BLOCK = 256


def shingle_hashes(text: bytes | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of the text's shingles, in order and with repeats. Fewer words are one shingle; no word: none."""
    # bytes.lower() and bytes.split() know ASCII only: A to Z, and 20, 09 to 0D.
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    n = max(1, len(parts) - words + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, stops)), np.uint64, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    total, whole = np.zeros(64, np.int64), len(hashes) // 255 * 255
    # Sums of 255 bits fit into a byte.
    for at in range(0, whole, 255 * 256):
        bits = np.unpackbits(hashes[at : min(whole, at + 255 * 256)].view(np.uint8), bitorder="little").reshape(-1, 255, 64)
        total += bits.sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    rest = np.unpackbits(hashes[whole:].view(np.uint8), bitorder="little").reshape(-1, 64)
    return total + rest.sum(0, dtype=np.uint8)


def majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes. None: 0."""
    return int(np.packbits(bit_counts(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, words, seed))


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words, seed) for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fps.view(np.int64), pa.int64())], ["id", "fp"])

    return run


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; parent stays flat, with the smallest index as the root."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _boxes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x sorted by the bit counts of its quarters, and the least and largest counts of each block."""
    quarters = np.bitwise_count(x.view(np.uint16).reshape(-1, 4))
    order = np.lexsort(quarters.T)
    x, quarters, starts = x[order], quarters[order].astype(np.int16), np.arange(0, len(x), BLOCK)
    return x, np.minimum.reduceat(quarters, starts), np.maximum.reduceat(quarters, starts)


def link_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles of fingerprints, or in one (b is None)."""
    a, alo, ahi = _boxes(a)
    alone = b is None
    b, blo, bhi = (a, alo, ahi) if alone else _boxes(b)
    both, shift = (a, 0) if alone else (np.concatenate([a, b]), len(a))
    parent = np.arange(len(both))
    for p in range(len(alo)):
        apart = np.maximum(0, np.maximum(alo[p] - bhi, blo - ahi[p])).sum(1)
        left = a[p * BLOCK : (p + 1) * BLOCK, None]
        for q in np.nonzero(apart <= radius)[0]:
            if alone and q < p:
                continue
            near = np.bitwise_count(left ^ b[None, q * BLOCK : (q + 1) * BLOCK]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                unite(parent, i + p * BLOCK, j + q * BLOCK + shift)
    linked = np.nonzero(parent != np.arange(len(both)))[0]
    return both[linked], both[parent[linked]]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tiles in batch.column("tiles"):
                arrays = [np.asarray(t["fps"].values, np.int64).view(np.uint64) for t in tiles]
                x, y = link_tiles(arrays[0], arrays[1] if len(arrays) > 1 else None, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    return run


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    A null text counts as empty; a text without words has fingerprint zero and is linked like any other. Long texts
    count whole. Rows that
    repeat id or text are in one component. Null ids do not count as the smallest unless a component has no other. An
    empty table gives an empty result. Other columns of docs are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    narrow = scratch.save(source.mapInArrow(_fingerprints(words, seed), f"id {kind}, fp long"))
    half = lambda shift: F.bit_count(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit(0xFFFFFFFF)))
    nodes = scratch.save(narrow.groupBy("fp").agg(F.min("id").alias("least")).withColumn("hi", half(32)).withColumn("lo", half(0)))
    # At most 33 x 33 cells, so this table can be broadcast.
    cells = scratch.save(nodes.groupBy("hi", "lo").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")))
    tiles = nodes.join(F.broadcast(cells), ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    tiles = tiles.groupBy("hi", "lo", "part").agg(F.collect_list("fp").alias("fps"))
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near]))
    sent = tiles.withColumn("step", step).withColumn("h2", F.col("hi") + F.col("step.i")).withColumn("l2", F.col("lo") + F.col("step.j"))
    sent = sent.join(F.broadcast(cells.select(F.col("hi").alias("h2"), F.col("lo").alias("l2"), F.col("parts").alias("others"))), ["h2", "l2"])
    sent = sent.withColumn("p2", F.explode(F.expr("sequence(0, others - 1)")))
    own, other = F.struct("hi", "lo", "part"), F.struct(F.col("h2").alias("hi"), F.col("l2").alias("lo"), F.col("p2").alias("part"))
    sent = sent.select(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), F.struct("fps").alias("tile"))
    pairs = sent.groupBy("x", "y").agg(F.collect_list("tile").alias("tiles")).where("x = y or size(tiles) = 2").select("tiles")
    links = scratch.save(pairs.mapInArrow(_links(radius), "a long, b long"))
    roots = components(links, scratch)
    linked = roots.join(nodes.select("fp", "least"), roots.node == nodes.fp).select("node", "root", "least")
    # A root has no row as a node, so it adds its own smallest id.
    own = roots.select("root").distinct().join(nodes.select("fp", "least"), F.col("root") == nodes.fp).select(F.col("root").alias("node"), "root", "least")
    linked = scratch.save(linked.unionByName(own))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    named = scratch.save(linked.join(smallest, "root").select(F.col("node").alias("fp"), "component"))
    labels = scratch.save(nodes.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))
    scratch.only(narrow, labels)
    out = narrow.join(scratch.small(labels), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
