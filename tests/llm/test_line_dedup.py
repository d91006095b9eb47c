import random

import duckdb
import pytest

from nestkit.llm.line_dedup import LINE_CHARS, OP8_SQL, dedup_lines

from .cases import ROWS, documents, empty


def brute(rows, m=2, chars=LINE_CHARS):
    """From each line on, the longest run that any earlier line starts too; what counts is deleted."""
    docs = []
    for i, t in sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = [] if t is None else t.split("\n")
        docs.append((i, t, lines, [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]))
    seqs = [[lines[k] for k in places] for _, _, lines, places in docs]
    gone, longest, places = [set() for _ in docs], [0] * len(docs), {}
    for d, seq in enumerate(seqs):
        for k, line in enumerate(seq):
            best = 0
            for a, i in places.get(line, []):
                n = 0
                while i + n < len(seqs[a]) and k + n < len(seq) and seqs[a][i + n] == seq[k + n]:
                    n += 1
                best = max(best, n)
            best = best if best >= m else int(best > 0 and len(line) >= chars)
            gone[d] |= set(range(k, k + best))
            longest[d] = max(longest[d], best)
            places.setdefault(line, []).append((d, k))
    out = {}
    for (i, t, lines, at), g, n in zip(docs, gone, longest):
        cut = {at[k] for k in g}
        out[i, t] = (len(lines), len(g), n, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in cut))
    return sorted([(r[0], *out[r[0], r[1]]) for r in rows], key=str)


def values(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


def test_edge_rows(spark):
    assert values(dedup_lines(documents(spark))) == brute(ROWS)


@pytest.mark.parametrize("m", [1, 2, 3, 4])
def test_random_runs(spark, m):
    rng = random.Random(m)
    passage = [f"p{k}" for k in range(9)]
    rows = []
    for i in range(40):
        lines = [rng.choice(["x", "y", "", f"own {i} {k}", "z " * LINE_CHARS]) for k in range(rng.randint(0, 9))]
        if rng.random() < 0.6:
            a = rng.randint(0, 4)
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[a : a + rng.randint(2, 5)]
        rows.append((i, "\n".join(lines), "en", "s", 1))
    rows += [(100 + i, rows[3][1], "en", "s", 1) for i in range(20)]
    assert values(dedup_lines(documents(spark, rows), min_lines=m)) == brute(rows, m)


def test_overlaps_and_single_lines(spark):
    long = "a line that is long enough to count as a run by itself"
    texts = ["a\nb\nc\nd", "b\nc\nd\ne", "x\na\nb\nc\nd\ne\ny", "r\nr\nr\nr", f"u\n{long}\nv", f"w\n{long}", "a\n\nb\n \nc", "short\nq1", "short\nq2"]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = values(dedup_lines(documents(spark, rows)))
    assert got == brute(rows)
    assert [r[4] for r in got] == ["a\nb\nc\nd", "e", "x\ny", "r", f"u\n{long}\nv", "w", "\n ", "short\nq1", "short\nq2"]
    assert [r[3] for r in got] == [0, 3, 4, 3, 0, 1, 3, 0, 0]


def test_a_line_that_is_everywhere(spark):
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["hot", "hot", "cold", f"own {i} {k}"]) for k in range(12)), "en", "s", 1) for i in range(60)]
    assert values(dedup_lines(documents(spark, rows))) == brute(rows)


def test_first_copies_stay(spark):
    rows = [(i, "\n".join(["head", "a", "b", "c", f"tail {i}"]), "en", "s", 1) for i in range(300)]
    got = {r.doc_id: r for r in dedup_lines(documents(spark, rows)).collect()}
    assert got[0].n_deleted == 0 and all(got[i].text == f"tail {i}" and got[i].longest_run == 4 for i in range(1, 300))


def test_empty_and_bad_length(spark):
    assert dedup_lines(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        dedup_lines(empty(spark), min_lines=0)


def test_one_plan_at_every_size(spark):
    """Texts and results meet in the way that large tables take, for small ones too, and texts are not sorted for it."""
    rows = [(i, "\n".join(["head", "a", "b", "c", f"tail {i}"]), "en", "s", 1) for i in range(30)]
    plan = dedup_lines(documents(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan and "Sort " not in plan


def test_ids_order_copies(spark):
    """Negative, null and repeated ids: the first copy is that of the null id, then of the smallest."""
    run = "one repeated line\nanother repeated line"
    rows = [(5, run + "\nv", "en", "s", 1), (-7, run + "\nw", "en", "s", 1), (None, "x\n" + run, "en", "s", 1), (-7, "own", "en", "s", 1), (5, run + "\nv", "en", "s", 1)]
    got = values(dedup_lines(documents(spark, rows)))
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] is None] == [0] and [r[2] for r in got if r[0] == 5] == [2, 2]


def sql(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?)", [list(r[:2]) for r in rows])
    return sorted(c.execute(OP8_SQL).fetchall(), key=str)


def test_sql_says_the_same():
    rng = random.Random(4)
    hot = [(i, "\n".join(rng.choice(["hot", "hot", "cold", "", "z " * LINE_CHARS, f"own {i} {k}"]) for k in range(12)), "en", "s", 1) for i in range(40)]
    for rows in ([], ROWS, hot, hot + [(100 + i, hot[3][1], "en", "s", 1) for i in range(9)] + hot[:2]):
        assert sql(rows) == brute(rows)
