import hashlib
import string

from nestkit.llm.exact_dedup import drop_exact, mark_exact

from .cases import ROWS, documents, empty

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t, *_ in rows:
        n = (t or "").translate(LOWER)
        ids = [x for x in groups[n] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    got = mark_exact(documents(spark)).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(ROWS)


def test_equal_prefix_and_length_are_not_enough(spark):
    rows = [(i, "p" * 400 + c, "en", "s", 1) for i, c in enumerate("aabbcA")]
    assert sorted([tuple(r) for r in mark_exact(documents(spark, rows)).collect()], key=str) == brute(rows)


def test_many_copies(spark):
    rows = [(i, "same" if i % 3 else f"other {i}", "en", "s", 1) for i in range(900)]
    assert sorted([tuple(r) for r in mark_exact(documents(spark, rows)).collect()], key=str) == brute(rows)


def test_drop_keeps_columns_and_one_row(spark):
    frame = documents(spark)
    kept = drop_exact(frame)
    assert kept.columns == frame.columns
    want = sorted({(r[0], r[4]) for r in brute(ROWS) if r[3]}, key=str)
    assert sorted([r.doc_id for r in kept.collect()], key=str) == [r[0] for r in want]
    assert {(r._sha, r._gone) for r in kept.collect()} == {("extra", "extra")}


def test_drop_against_brute_force(spark):
    """Lengths, prefixes and contents that agree in part; ids with several texts; repeated rows; no ids."""
    long = "p" * 400
    rows = [(1, "Same"), (2, "sAme"), (2, "other"), (3, "diff"), (4, long + "a"), (5, long + "b"), (6, long.upper() + "A"), (7, "twice"), (7, "twice"), (7, "TWICE"), (None, "none"), (None, "NONE"), (8, None), (9, ""), (9, "only")]
    frame = documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    want = sorted(((max([i for i in ids if i is not None], default=None), t) for t, ids in groups.items()), key=str)
    got = drop_exact(frame)
    assert got.columns == frame.columns
    assert sorted([(r.doc_id, (r.text or "").translate(LOWER)) for r in got.collect()], key=str) == want


def test_empty(spark):
    assert mark_exact(empty(spark)).count() == 0 and drop_exact(empty(spark)).count() == 0
