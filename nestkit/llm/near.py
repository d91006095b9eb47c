"""Near copies by SimHash: links of a wide fingerprint, then an exact check of the five-word shingles.

This is the operator of simhash.py for another kind of similarity: the Jaccard similarity of two texts' sets of five-word
shingles is 0.8 or more. A fingerprint has WIDE words of 64 bits, because 64 bits cannot tell texts of that similarity
(about 10 bits apart) from others. Texts are dealt into tiles by the sizes of their sets, which a similarity of 0.8 holds
within a factor of 1.25, so only neighbouring tiles meet; inside, blocks sorted by size are skipped by the same bound, and
the others are compared with exclusive-or and bit counts. Links of fingerprints join texts into candidate groups.

Within a group the sets themselves are compared, so no text is linked below the threshold. A group is not compared pair
by pair: a search visits each text once and compares it with those not reached yet, and emits a spanning forest. Its
components are those of all links of the group. A group is cut into parts of bounded bytes. First each part is searched
together with the group's smallest node; only groups that are not one component by then have their parts compared two by
two.

A pair at exactly 0.8 has at most 0.19 of its bits different (sets of 4 and 5), 48 of 256 on average with a deviation of
6.2; RADIUS is 3.9 deviations beyond, and FIRST 3.8 for the first 64 bits. Unrelated texts are within RADIUS with a
probability of 2e-12.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, small_batches
from .components import components
from .exact_dedup import one_of_each
from .simhash import BLOCK, TILE, bit_counts, shingle_hashes, unite

WORDS, SEED, SIMILAR = 5, 42, 0.8
WIDE, RADIUS, FIRST = 4, 72, 24
#: Bytes of the sets in one part of a group.
PART = 8 << 20
# Fixed values of the splitmix64 generator, which makes more hashes of one.
GAMMA, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The different hashes of the text's shingles, sorted."""
    return np.unique(shingle_hashes(text, words, SEED))


def wide_fingerprint(hashes: np.ndarray) -> list[int]:
    """WIDE words (signed), each the majority of the bits of hashes of its own; zeros for the empty set."""
    out = []
    for k in range(WIDE):
        h = hashes + np.uint64(k * GAMMA % (1 << 64))
        for shift, factor in zip((30, 27), MIX):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        out.append(np.packbits(bit_counts(h ^ (h >> np.uint64(31))) * 2 > len(h), bitorder="little").view(np.int64)[0])
    return out


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
        prints = np.array([wide_fingerprint(s) for s in sets], np.int64).reshape(-1, WIDE)
        columns = [b.column("id"), b.column("th"), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), *[pa.array(p) for p in prints.T]]
        yield pa.RecordBatch.from_arrays(columns, ["id", "th", "node", "n", *[f"f{k}" for k in range(WIDE)]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
        nodes = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])


def link_prints(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles (sizes of sets, and a row of WIDE words for each), or in one (b
    is None): places in the rows of a and then b."""
    alone = b is None
    orders = [np.argsort(t[0], kind="stable") for t in ((a,) if alone else (a, b))]
    (n, x), (m, y) = [(t[0][o], t[1][o]) for t, o in zip((a, a if alone else b), (orders[0], orders[-1]))]
    shift = 0 if alone else len(n)
    parent = np.arange(len(n) if alone else len(n) + len(m))
    first = np.arange(0, len(m), BLOCK)
    least, most = m[first], m[np.minimum(first + BLOCK, len(m)) - 1]
    for p in range(0, len(n), BLOCK):
        left, sizes = x[p : p + BLOCK], n[p : p + BLOCK]
        for q in first[(most >= SIMILAR * sizes[0]) & (least * SIMILAR <= sizes[-1])].tolist():
            if alone and q < p:
                continue
            right = y[q : q + BLOCK]
            i, j = np.nonzero(np.bitwise_count(left[:, None, 0] ^ right[None, :, 0]) <= FIRST)
            apart = np.bitwise_count(left[i] ^ right[j]).sum(1, dtype=np.int64)
            near = apart <= RADIUS
            if near.any():
                unite(parent, i[near] + p, j[near] + q + shift)
    back = orders[0] if alone else np.concatenate([orders[0], orders[1] + shift])
    linked = np.nonzero(parent != np.arange(len(parent)))[0]
    return back[linked], back[parent[linked]]


def _print_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tiles in batch.column("tiles"):
            found = []
            for t in tiles:
                rows = t["rows"].values
                column = lambda name, rows=rows: np.asarray(rows.field(name), np.int64)
                found.append((column("node"), column("n"), np.stack([column(f"f{k}") for k in range(WIDE)], 1).view(np.uint64)))
            nodes = np.concatenate([f[0] for f in found])
            x, y = link_prints(found[0][1:], found[1][1:] if len(found) > 1 else None)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[x]), pa.array(nodes[y])], ["a", "b"])


def candidate_links(nodes: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """nodes (node, n, f0 ...) with different nodes and no empty sets: links (a, b) that join all nodes whose
    fingerprints are near and whose sizes are within the similarity."""
    # Two sizes within a factor of 1.25 are in the same cell or in neighbouring ones.
    cell = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / SIMILAR)) + 1e-9).cast("int")
    nodes = nodes.withColumn("cell", cell)
    # As many rows as sizes have powers of 1.25: a few dozen.
    cells = scratch.save(nodes.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    tiles = nodes.join(F.broadcast(cells), "cell").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    tiles = tiles.groupBy("cell", "part").agg(F.collect_list(F.struct("node", "n", *[f"f{k}" for k in range(WIDE)])).alias("rows"))
    sent = tiles.withColumn("to", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)))
    sent = sent.join(F.broadcast(cells.select(F.col("cell").alias("to"), F.col("parts").alias("others"))), "to")
    sent = sent.withColumn("place", F.explode(F.expr("sequence(0, others - 1)")))
    own, other = F.struct("cell", "part"), F.struct(F.col("to").alias("cell"), F.col("place").alias("part"))
    sent = sent.select(F.least(own, other).alias("x"), F.greatest(own, other).alias("y"), F.struct("rows").alias("tile"))
    pairs = sent.groupBy("x", "y").agg(F.collect_list("tile").alias("tiles")).where("x = y or size(tiles) = 2").select("tiles")
    return pairs.mapInArrow(_print_links, "a long, b long")


def link_sets(sets: list[np.ndarray], similar: float = SIMILAR) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets (places in the list) whose similarity is similar or more."""
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].ravel()
    ends = np.cumsum(sizes)
    own = [codes[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist())]
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    # left: places not reached yet; flat: their codes one after the other.
    left, flat, links, queue = np.arange(len(sets)), codes, [], []
    while len(left):
        if not queue:
            queue = [int(left[0])]
            left, flat = left[1:], flat[sizes[left[0]] :]
            continue
        at = queue.pop()
        mark[own[at]] = 1
        n = sizes[left]
        shared = np.add.reduceat(mark[flat], np.cumsum(n) - n)
        mark[own[at]] = 0
        near = shared >= similar * (n + sizes[at] - shared) - 1e-9
        if near.any():
            found = left[near].tolist()
            links += [(at, x) for x in found]
            queue += found
            left, flat = left[~near], flat[np.repeat(~near, n)]
    return links


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for group in batch.column("sets"):
            rows = {r["node"].as_py(): np.frombuffer(r["hashes"].as_py(), np.uint64) for r in group.values}
            nodes = np.array(list(rows), np.int64)
            links = np.array(link_sets(list(rows.values())), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[links[:, 0]]), pa.array(nodes[links[:, 1]])], ["a", "b"])


def _search(placed: DataFrame, sets: DataFrame, by: list[str]) -> DataFrame:
    """Links (a, b) found in each group of placed (by, node)."""
    groups = placed.join(sets, "node").groupBy(*by).agg(F.collect_list(F.struct("node", "hashes")).alias("sets")).where("size(sets) > 1")
    return groups.select("sets").mapInArrow(_links, "a long, b long")


def _components(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, part: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: rows (id, th: a hash of the text, node: one of its set) and nodes with their root."""
    source = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    words = "".join(f", f{k} long" for k in range(WIDE))
    narrow = scratch.save(source.mapInArrow(_keyed, f"id {kind}, th long, node long, n long{words}"))
    # Equal sets are one node. The empty set is near no other.
    nodes = scratch.save(narrow.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", *[f"f{k}" for k in range(WIDE)])]))
    roots = scratch.save(components(scratch.save(candidate_links(nodes, scratch, tile)), scratch))
    # A root has no row as a node.
    grouped = roots.select("node", F.col("root").alias("key")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("key")).distinct())
    members = scratch.save(grouped.join(nodes.select("node", "n"), "node"))
    groups = scratch.save(members.groupBy("key").agg(F.ceil(F.sum("n") * 8 / part).cast("int").alias("parts")))
    placed = scratch.save(members.join(scratch.small(groups), "key").select("key", "parts", "node", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("p")))
    # The sets of the texts in groups, made from one text each.
    wanted = scratch.save(narrow.join(scratch.small(placed.select("node"), of=placed), "node", "left_semi").groupBy("node").agg(F.min("th").alias("th")).select("th").distinct())
    sets = source.join(scratch.small(wanted), "th", "left_semi").select("text")
    sets = scratch.save(sets.mapInArrow(_sets, "node long, hashes binary").dropDuplicates(["node"]))
    reps = placed.select("key", "p").distinct().select("key", F.col("key").alias("node"), "p")
    links = scratch.save(_search(placed.select("key", "node", "p").unionByName(reps).distinct(), sets, ["key", "p"]))
    roots = scratch.save(components(links, scratch))
    cut = placed.where("parts > 1")
    if cut.limit(1).count():
        rooted = cut.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        apart = scratch.save(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key"))
        pairs = cut.join(scratch.small(apart), "key", "left_semi").withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
        pairs = pairs.where("p != q").select("key", "node", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
        links = links.unionByName(scratch.save(_search(pairs, sets, ["key", "p", "q"])))
        roots = scratch.save(components(links, scratch))
    return narrow, roots


def _first(narrow: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with the root of their component, and of each root the first row: the smallest id, null ids last."""
    rooted = narrow.select("id", "th", "node").join(scratch.small(roots), "node", "left").select("id", "th", F.coalesce("root", "node").alias("root"))
    rooted = scratch.save(rooted)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("th"))
    first = rooted.groupBy("root").agg(F.min(order).alias("f"), F.count("*").alias("c"))
    return rooted, scratch.save(first.select("root", F.col("f.id").alias("best"), F.col("f.th").alias("best_th"), "c"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, tile: int = TILE) -> DataFrame:
    """One row per row of docs: id, component_id (smallest id reachable over links).

    A null text counts as empty, and texts without words are equal. Long texts count whole. Rows that repeat id or text
    are in one component. Null ids do not count as the smallest unless a component has no other. An empty table gives an
    empty result. Other columns of docs are not read.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rooted, first = _first(*_components(docs, id_col, text_col, scratch, part, tile), scratch)
    scratch.only(rooted, first)
    return rooted.join(scratch.small(first), "root").select(F.col("id").alias(id_col), F.col("best").alias("component_id"))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part: int = PART, tile: int = TILE) -> DataFrame:
    """docs with one row of each component: that of the smallest id (null ids last; of several texts of that id, the one
    of the smallest hash; of repeated rows one). All columns stay, whatever their names. Rows are told apart by id and
    text, so another text of a dropped row's id stays."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rooted, first = _first(*_components(docs, id_col, text_col, scratch, part, tile), scratch)
    best = F.col("id").eqNullSafe(F.col("best")) & (F.col("th") == F.col("best_th"))
    groups = rooted.join(scratch.small(first.where("c > 1"), of=first), "root")
    row, th, hit = fresh(docs, "id", "th", "hit")
    gone = scratch.save(groups.where(~best).select(F.col("id").alias(row), F.col("th").alias(th)).distinct())
    several = scratch.save(groups.where(best).groupBy("id", "th").agg(F.count("*").alias("c")).where("c > 1").select(F.xxhash64("id", "th").alias(hit)))
    scratch.only(gone, several)
    marked = docs.withColumn(th, F.xxhash64(text_col))
    dropped = scratch.small(gone)
    kept = marked.join(dropped, (marked[th] == dropped[th]) & F.col(id_col).eqNullSafe(F.col(row)), "left_anti")
    return one_of_each(kept.withColumn(hit, F.xxhash64(id_col, th)), hit, several, scratch).select(*docs.columns)
