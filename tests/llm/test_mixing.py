import math
import re

import pytest

from nestkit.llm.mixing import mix, mix_documents

from .cases import ROWS, documents, empty


def brute_targets(rows, weights=(3, 1, 2), share=1.5):
    sizes = {}
    for _, t, _, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return sizes, target


def check(spark, rows, near):
    frame = documents(spark, rows)
    got = mix(frame).collect()
    sizes, target = brute_targets(rows)
    source = {r[0]: r[3] for r in rows}
    assert sorted([r.doc_id for r in got], key=str) == sorted([r[0] for r in rows], key=str)
    taken = {s: 0 for s in sizes}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= near(s, sizes, rows)
    assert sorted(map(tuple, mix(frame).collect()), key=str) == sorted(map(tuple, got), key=str)
    return got


def largest(s, sizes, rows):
    return max(len((r[1] or "").split()) for r in rows if r[3] == s) + 1


def test_edge_rows(spark):
    check(spark, ROWS, largest)


def test_near_targets(spark):
    rows = [(i, "w " * (1 + (i * 37) % 211), "en", f"s{i % 7}" if i % 3 else "s0", 1) for i in range(1500)]
    check(spark, rows, lambda s, sizes, _: 0.02 * sizes[s] + 100)


def test_hot_sizes_are_cut_exactly(spark):
    """Every source comes within one document of its target, however many are of one size."""
    rows = [(i, "w w w w", "en", "abc"[i // 10_000], 1) for i in range(30_000)]
    check(spark, rows, lambda s, sizes, _: 4)


@pytest.mark.parametrize("digit, rounds", [(1, 40), (3, 17)])
def test_cuts_by_small_digits(spark, monkeypatch, digit, rounds):
    """Digits so small that every group takes several rounds."""
    from nestkit.llm import mixing

    monkeypatch.setattr(mixing, "DIGIT", digit)
    monkeypatch.setattr(mixing, "ROUNDS", rounds)
    rows = [(i, "w " * (3 + i % 2), "en", "ab"[i // 150], 1) for i in range(300)]
    check(spark, rows, lambda s, sizes, _: 4)


def test_multipliers_are_the_optimum(spark):
    """Rates against a bisection on the dual, source by source."""
    rows = [(i, "w " * (1 + (i * 37) % 61), "en", f"s{i % 3}" if i % 5 else "s0", 1) for i in range(300)]
    sizes, target = brute_targets(rows)
    words = {r[0]: len(r[1].split()) for r in rows}
    got = {r.doc_id: r.rate for r in mix(documents(spark, rows)).collect()}
    for s in sizes:
        own = [r[0] for r in rows if r[3] == s]
        mean = sum(words[i] for i in own) / len(own)
        rate = lambda lam, i: min(2.0, math.exp(min(1.0, lam * words[i] / mean)))
        lo, hi = -50.0, 50.0
        if target[s] >= 2 * sizes[s] * (1 - 1e-12):
            assert all(got[i] == 2.0 for i in own)
            continue
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(words[i] * rate(mid, i) for i in own) < target[s] else (lo, mid)
        assert all(got[i] == pytest.approx(rate(lo, i), rel=1e-6) for i in own)


def test_unsolved_is_an_error(spark):
    from nestkit.llm.common import Scratch
    from nestkit.llm.mixing import _solve

    cells = spark.createDataFrame([("0a", 5, 3)], "skey string, size long, docs long")
    state = spark.createDataFrame([("0a", 15, 22.5, 5.0, False, 0.0, -1e-9, 2.0)], "skey string, source_size long, target double, mean double, solved boolean, lam double, lo double, hi double")
    scratch = Scratch(spark)
    with pytest.raises(RuntimeError):
        _solve(cells, scratch.save(state), scratch, most=1)


def test_rates_are_tilted_and_capped(spark):
    rows = [(i, "w " * n, "en", s, 1) for i, (n, s) in enumerate([(5, "a"), (50, "a"), (500, "a"), (5, "b"), (50, "b"), (900, "b"), (40, "c")])]
    got = {r.doc_id: r for r in mix(documents(spark, rows)).collect()}
    assert all(0 < r.rate <= 2 for r in got.values())
    assert (got[0].rate - got[1].rate) * (got[1].rate - got[2].rate) >= 0


def test_copies_of_documents(spark):
    frame = documents(spark)
    copies = {r.doc_id: r.copies for r in mix(frame).collect()}
    got = mix_documents(frame)
    assert got.columns == frame.columns and {(r._u, r._size, r._skey) for r in got.select("_u", "_size", "_skey").collect()} == {("extra",) * 3}
    counts = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert {i: n for i, n in copies.items() if n and i != 8} == {i: n for i, n in counts.items() if i != 8}


def test_empty_and_wordless(spark):
    assert mix(empty(spark)).count() == 0 and mix_documents(empty(spark)).count() == 0
    got = mix(documents(spark, [(1, "", "en", "a", 0), (2, None, "en", None, 0)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
