import random
import re

import numpy as np
import xxhash

from nestkit.llm.components import components
from nestkit.llm.common import Scratch
from nestkit.llm.simhash import BLOCK, fingerprint, link_tiles, simhash_components

from .cases import ROWS, documents, empty


def brute_fingerprint(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs, radius=3):
    """pairs: (id, fingerprint)."""
    out = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for i, f in pairs:
            for j, g in pairs:
                if (f ^ g).bit_count() <= radius and out[j] < out[i]:
                    out[i], changed = out[j], True
    return out


def test_fingerprints():
    texts = [r[1] for r in ROWS] + ["a b", "A b", "one two three four", "x" * 10, "Ä ä"]
    for t in texts:
        assert fingerprint(t.encode() if t is not None else None) == brute_fingerprint(t)


def test_components_of_edge_rows(spark):
    rows = [r for r in ROWS if r[0] is not None]
    got = simhash_components(documents(spark, rows)).collect()
    prints = sorted({(r[0], brute_fingerprint(r[1])) for r in rows})
    want = brute_components(prints)
    assert len(got) == len(rows)
    for r in got:
        assert r.fingerprint == f"{dict(prints)[r.doc_id]:016x}" and r.component_id == want[r.doc_id]


def test_null_id_and_empty_table(spark):
    assert simhash_components(documents(spark)).count() == len(ROWS)
    assert simhash_components(empty(spark)).count() == 0


def test_tiles_find_every_link():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 3 * BLOCK, dtype=np.uint64), *[base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(6)]]))
    rng.shuffle(x)

    def classes(edges):
        out = {int(v): int(v) for v in x}
        for _ in range(len(x)):
            before = dict(out)
            for a, b in edges:
                out[a] = out[b] = min(out[a], out[b])
            if out == before:
                return out

    want = classes([(int(a), int(b)) for k, a in enumerate(x) for b in x[:k] if (int(a) ^ int(b)).bit_count() <= 3])
    half = len(x) // 3
    edges = []
    for a, b in ((x[:half], None), (x[half:], None), (x[:half], x[half:])):
        left, right = link_tiles(a.copy(), None if b is None else b.copy(), 3)
        edges += list(zip(left.tolist(), right.tolist()))
    assert len(edges) < 2 * len(x)
    assert classes(edges) == want


def test_components_of_a_long_chain_and_a_star(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (7, 6)]
    edges = [(b, a) if random.random() < 0.5 else (a, b) for a, b in edges]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{i: 1000 for i in range(1001, 1400)}}


def test_small_tiles(spark, monkeypatch):
    """Several tiles in a cell give the same components."""
    from nestkit.llm import simhash

    rng = random.Random(8)
    rows = []
    for i in range(60):
        words = [f"w{rng.randint(0, 60)}" for _ in range(60)]
        rows.append((i, " ".join(words), "en", "a", 1))
        for k in range(3):
            words[rng.randrange(60)] = f"new{k}"
            rows.append((100 * (k + 1) + i, " ".join(words), "en", "a", 1))
    want = brute_components([(r[0], brute_fingerprint(r[1])) for r in rows])
    monkeypatch.setattr(simhash, "TILE", 2)
    assert {r.doc_id: r.component_id for r in simhash_components(documents(spark, rows)).collect()} == want
    assert len(set(want.values())) < len(rows)
