import random

import numpy as np
import pyarrow as pa
import pytest

from nestkit.llm.common import Scratch, small_batches
from nestkit.llm.near import FIRST, RADIUS, SIMILAR, candidate_links, drop_near, link_prints, link_sets, near_components, shingles, wide_fingerprint

import corpus_pipeline

from .cases import ROWS, documents, empty


def brute_sets(rows, words=5):
    out = []
    for r in rows:
        w = (r[1] or "").lower().split()
        out.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def brute(rows):
    """The smallest id of each row's component over all pairs."""
    sets, out = brute_sets(rows), {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for r, s in zip(rows, sets):
            for q, t in zip(rows, sets):
                if (s == t or len(s & t) >= 0.8 * len(s | t)) and out[q[0]] < out[r[0]]:
                    out[r[0]], changed = out[q[0]], True
    return out


def variants(lengths=(30, 120, 400)):
    """Texts in groups, with a word in so many changed, so that their similarities lie on both sides of 0.8."""
    rng, rows = random.Random(3), []
    for g in range(8):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice(lengths))]
        for k in range(7):
            words = list(base)
            for at in rng.sample(range(len(words)), k * len(words) // 120):
                words[at] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    return rows


def test_stage_finds_what_a_radius_of_three_bits_misses(spark):
    """596/917 of the sf0.1 documents: similarity 0.921, 9 bits apart."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (596, 917)")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [596]


def test_components_against_all_pairs(spark):
    rows = variants()
    want = brute(rows)
    for part, tile in ((8 << 20, 65536), (2000, 5)):
        got = {r.doc_id: r.component_id for r in near_components(documents(spark, rows), part=part, tile=tile).collect()}
        assert got == want
    kept = drop_near(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    assert 8 < len(set(want.values())) < len(rows)


def test_forest_of_sets():
    sets = [shingles(r[1].encode()) for r in variants()]
    links = link_sets(sets)
    assert len(links) < len(sets)
    for a, b in links:
        both = len(np.intersect1d(sets[a], sets[b]))
        assert both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)


def test_edge_rows(spark):
    rows = [r for r in ROWS if r[0] is not None]
    got = near_components(documents(spark, rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
    assert near_components(documents(spark)).count() == len(ROWS)
    assert None in {r.doc_id for r in drop_near(documents(spark)).collect()}
    assert near_components(empty(spark)).count() == 0 and drop_near(empty(spark)).count() == 0


def test_rows_are_told_apart_by_id_and_text(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(3, text, "en", "a", 1), (5, text, "en", "a", 1), (5, "something else that is near to no other text here", "en", "a", 1), (None, text, "en", "a", 1)]
    rows += [(7, "twice the same row of one id and text", "en", "a", 1)] * 2 + [(None, "twice the same row without any id at all", "en", "a", 1)] * 2
    frame = documents(spark, rows)
    kept = drop_near(frame)
    assert kept.columns == frame.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted({rows[0][:2], rows[2][:2], rows[4][:2], rows[6][:2]}, key=str)


def test_recall_of_fingerprints():
    """Pairs of sets at 0.8 or a little above, small ones too: within both radii but for a few in a thousand."""
    rng, missed, n_pairs = np.random.default_rng(7), 0, 0
    for n in [4, 5, 8, 9, 17, 40, 100, 400] * 250:
        shared = rng.integers(0, 1 << 63, n, np.uint64)
        extra = rng.integers(0, 1 << 63, int(n / SIMILAR) - n, np.uint64)
        cut = len(extra) // 2
        a, b = (np.array(wide_fingerprint(np.concatenate([shared, e])), np.int64).view(np.uint64) for e in (extra[:cut], extra[cut:]))
        apart = np.bitwise_count(a ^ b)
        missed += apart.sum(dtype=int) > RADIUS or apart[0] > FIRST
        n_pairs += 1
    assert missed <= n_pairs // 1000


def test_tiles_give_the_links_of_all_pairs():
    rows = variants((6, 30, 120))
    sets = [shingles(r[1].encode()) for r in rows]
    n, x = np.array([len(s) for s in sets]), np.array([wide_fingerprint(s) for s in sets], np.int64).view(np.uint64)
    half = len(rows) // 2
    one = list(zip(*link_prints((n, x), None)))
    parts = [link_prints((n[:half], x[:half]), None), tuple(v + half for v in link_prints((n[half:], x[half:]), None)), link_prints((n[:half], x[:half]), (n[half:], x[half:]))]
    split = [e for p in parts for e in zip(*p)]

    def classes(links):
        out = list(range(len(rows)))
        for _ in rows:
            for a, b in links:
                out[a] = out[b] = min(out[a], out[b])
        return out

    near = lambda i, j: np.bitwise_count(x[i] ^ x[j]).sum(dtype=int) <= RADIUS and np.bitwise_count(x[i][0] ^ x[j][0]) <= FIRST
    want = classes([(i, j) for i in range(len(rows)) for j in range(i) if near(i, j) and min(n[i], n[j]) >= SIMILAR * max(n[i], n[j])])
    # Blocks are skipped by size, single pairs are not, so links of other sizes may come on top.
    for got in (classes(one), classes(split)):
        assert all(got[i] == got[want[i]] for i in range(len(rows)))


@pytest.mark.parametrize("sizes", [[40], [0, 21], [45, 45], [40, 0, 40]])
def test_batches_of_any_length_come_back_once(spark, sizes):
    """Batches above the bound of those that are read, with empty ones between, as tiles with many links and none give."""

    def run(batches):
        for _ in batches:
            pass
        for k, n in enumerate(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(range(100 * k, 100 * k + n), pa.int64())], ["a"])

    small_batches(spark, rows=20)
    got = spark.range(0, 1, 1, 1).mapInArrow(run, "a long").collect()
    assert [r.a for r in got] == [100 * k + i for k, n in enumerate(sizes) for i in range(n)]


def test_tiles_with_many_links_beside_tiles_without(spark):
    """Cells of 2,500 equal fingerprints, more links than a batch has rows, and cells of one, all in one task."""
    rows = [(5_000 * k + i, n, *[k] * 4) for k, n in enumerate([10, 40, 160, 640]) for i in range(2500 if k % 2 else 1)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        small_batches(spark)
        scratch = Scratch(spark)
        links = scratch.save(candidate_links(spark.createDataFrame(rows, "node long, n long, f0 long, f1 long, f2 long, f3 long"), scratch)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Forests: each node but a root of its cell once.
    assert len(links) == len({r.a for r in links}) == 2 * 2499 and all(r.a // 5_000 == r.b // 5_000 for r in links)
