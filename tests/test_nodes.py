import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nestkit.operators.levels import bracket_pattern, character_indices, contained, object_boundaries, object_containment
from nestkit.operators.nodes import boundaries, unroller
from nestkit.plans.unroll import parser, unrolled


def rows(spark, text, upto=9, **options):
    frame = spark.createDataFrame([(1, text)], "d int, t string")
    return unrolled(frame, "d", "t", upto, **options).orderBy("nth", "open").collect()


G1 = "select 1 d, named_struct('a', 1, 'arr', array(named_struct('x', 2), named_struct('x', 3)), 's', 'p:q') o"
G1_NODES = [
    (0, 0, None, 0, 1, 89, 0, "$", "@{0,0}", "{", None, None, None),
    (1, 1, 0, 0, 6, 12, 0, "a", "@{0,0}", "#", 0, "$", "@{0,0}"),
    (1, 2, 0, 1, 26, 66, 1, "arr", "@{0,1}", "[", 0, "$", "@{0,0}"),
    (1, 3, 0, 2, 72, 82, 0, "s", "@{0,2}", "#", 0, "$", "@{0,0}"),
    (2, 4, 2, 0, 27, 45, 1, "arr[0]", "@{0,0}", "{", 2, "arr", "@{0,1}"),
    (2, 5, 2, 1, 47, 65, 1, "arr[1]", "@{1,0}", "{", 2, "arr", "@{0,1}"),
    (3, 6, 4, 0, 32, 38, 1, "x", "@{0,0}", "#", 4, "arr[0]", "@{0,0}"),
    (3, 7, 5, 1, 52, 58, 1, "x", "@{1,0}", "#", 5, "arr[1]", "@{1,0}"),
]


@pytest.mark.parametrize("strict", [False, True])
def test_golden_tree(spark, strict):
    got = parser(spark.sql(G1), "d", "o", 3, strict=strict).orderBy("nth").collect()
    assert [(r.depth, r.nth, r.parenth, r.slot, r.open, r.close, r.nest, r.key, r.ord, r.sym, r.parent.nth, r.parent.key, r.parent.ord) for r in got] == G1_NODES
    assert got[0].str == '{"a":1,"arr":[{"x":2},{"x":3}],"s":"p\x1eq"}' and not got[0].is_array_root
    assert [json.loads(r.json) for r in got[1:]] == [{"a": 1}, [{"x": 2}, {"x": 3}], {"s": "p:q"}, {"x": 2}, {"x": 3}, {"x": 2}, {"x": 3}]


@pytest.mark.parametrize("depth, n", [(None, 0), (-1, 0), (0, 1), (1, 4), (2, 6), (3, 8), (9, 8)])
def test_depth_limit(spark, depth, n):
    assert parser(spark.sql(G1), "d", "o", depth).count() == n


def test_array_index_of_another_parent(spark):
    text = '{"arr":[{"x":1}],"o":{"q":5}}'
    assert [r.key for r in rows(spark, text)] == ["$", "arr", "o", "arr[0]", "q", "x"]
    assert [r.key for r in rows(spark, text, strict=True)] == ["$", "arr", "o", "arr[0]", "q[1]", "x"]


def test_parent_values(spark):
    text = '{"A":[{"x":1}],"B":[5,{"z":1}]}'
    fixed, strict = rows(spark, text), rows(spark, text, strict=True)
    assert (fixed[4].key, fixed[6].parent.key, fixed[6].parent.ord) == ("B", "B", fixed[4].ord)
    assert (strict[4].key, strict[4].ord, strict[6].parent.key, strict[6].parent.ord) == ("B[1]", "@{0,1}", "A[1]", "@{1,0}")


def test_negative_number_and_quotes(spark):
    got = parser(spark.sql("select 1 d, named_struct('a', -1.5D, 's', 'a\"b', 'a:b', 1) o"), "d", "o", 3).orderBy("nth").collect()
    assert [r.key for r in got] == ["$", "a", "s", "a:b"]
    assert [json.loads(r.json) for r in got] == [{"a": -1.5, "s": 'a"b', "a:b": 1}, {"a": -1.5}, {"s": 'a"b'}, {"a:b": 1}]
    strict = parser(spark.sql("select 1 d, named_struct('s', 'a\"b', 'a:b', 1) o"), "d", "o", 3, strict=True).orderBy("nth").collect()
    assert [r.json for r in strict] == [None, None, '{"a:b":1}'] and strict[2].key == "a\x1eb"


def test_roots(spark):
    assert rows(spark, "5") == [] and rows(spark, None) == [] and rows(spark, "") == []
    assert [(r.nth, r.key) for r in rows(spark, '[[{"x":1}],[2]]')] == [(0, "$"), (1, "[0]"), (2, "[1]"), (3, "[0]"), (4, "x")]
    assert [r.key for r in rows(spark, "[1,2]")] == ["$"]
    several = rows(spark, '{"a":{}}{"b":{}}')
    assert [r.nth for r in several if r.depth == 0] == [0, 0] and {r.parenth for r in several if r.depth == 1} == {0}


def test_unbalanced_text_does_not_fail(spark):
    for text in ("{{", "}}", '{"a":[1}', "]["):
        rows(spark, text)


def test_nested_shape(spark):
    frame = spark.sql(G1).unionByName(spark.sql("select 2 d, named_struct('a', 7, 'arr', cast(array() as array<struct<x:int>>), 's', 'q') o"))
    got = {r.d: r for r in parser(frame, "d", "o", 9, shape="nested").collect()}
    assert [(level.depth, len(level.children)) for level in got[1].levels] == [(0, 1), (1, 3), (2, 2), (3, 2)]
    assert [c.key for c in got[2].levels[1].children] == ["a", "arr", "s"]
    scalar = parser(spark.sql("select 1 d, 5 o"), "d", "o", 9, shape="nested").first()
    assert scalar.levels == [] and scalar.str == "5" and scalar.is_array_root is False
    assert parser(spark.sql("select 1 d, array(named_struct('a', 1)) o"), "d", "o", 1).first().is_array_root


def test_characters_and_containment(spark):
    frame = spark.createDataFrame([(1, "{[]}"), (2, "a[b]"), (3, None), (4, "none")], "d int, t string")
    chars = character_indices(frame, ["d"], "t", bracket_pattern())
    assert [(r.idx, r.sub) for r in chars.where("d = 2").orderBy("idx").collect()] == [(2, "["), (4, "]")]
    got = object_containment(chars.where("d = 1"), ["d"]).orderBy("idx", F.desc("raise")).collect()
    assert [(r.idx, r.pre, r.depth, r["raise"]) for r in got] == [(1, -1, 0, True), (1, 0, 1, False), (2, 0, 1, True), (2, 1, 2, False), (3, 1, 0, True), (3, 2, 1, False), (4, 0, -1, True), (4, 1, 0, False)]
    assert [list(r.depths) for r in got[::2]] == [[0, 1], [1, 1], [0, 1], [0, 0]]
    pairs = object_boundaries(object_containment(chars.where("d = 1"), ["d"]), ["d"], 9).orderBy("depth", "raise").collect()
    assert [(r.pre, r.depth, r["raise"], r.open, r.close) for r in pairs] == [(-1, 0, True, 1, 4), (0, 1, False, 1, 4), (0, 1, True, 2, 3), (1, 2, False, 2, 3)]
    assert object_boundaries(object_containment(chars, ["d"]), ["d"], None).count() == 0


def test_pattern_with_a_group(spark):
    frame = spark.createDataFrame([(1, "k=1;key=22")], "d int, t string")
    assert [(r.idx, r.sub) for r in character_indices(frame, ["d"], "t", r"k\w*=(\d+)").orderBy("idx").collect()] == [(1, "1"), (5, "22")]


def test_one_exchange_for_the_brackets(spark):
    frame = spark.createDataFrame([(1, "{}")], "d int, t string")
    plan = unroller(frame, ["d"], "t", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the brackets, and the texts they are cut from


def test_time_is_linear_in_the_document(spark):
    """A node's cost does not depend on where in the document it stands."""

    def seconds(n):
        text = "[" + ",".join('{"a":%d,"b":"x"}' % i for i in range(n)) + "]"
        frame = spark.createDataFrame([(1, text)], "d int, t string").cache()
        took = []
        for _ in range(2):
            began = time.time()
            assert unrolled(frame, "d", "t", 9).selectExpr("count(*) c", "sum(length(json)) s").first().c == 3 * n + 1
            took.append(time.time() - began)
        return min(took)

    seconds(1000)
    assert seconds(20_000) < 2.2 * seconds(10_000)


def test_two_documents_of_one_key_fail(spark):
    frame = spark.createDataFrame([(1, "{}"), (1, "[{}]")], "d int, t string")
    with pytest.raises(Exception, match="two documents have the same key"):
        unrolled(frame, "d", "t", 3).collect()


def test_pieces_of_text_in_bytes(spark):
    text = '{"ä":[{"日本":"ü😀"},{"k":1}],"é":2}'
    got = rows(spark, text)
    assert [r.key for r in got] == ["$", "ä", "é", "ä[0]", "ä[1]", "日本", "k"]
    assert [json.loads(r.json) for r in got] == [json.loads(text), [{"日本": "ü😀"}, {"k": 1}], {"é": 2}, {"日本": "ü😀"}, {"k": 1}, {"日本": "ü😀"}, {"k": 1}]


def test_variant(spark):
    got = parser(spark.sql(G1), "d", "o", 3, variant=True).selectExpr("nth", "cast(variant_get(json, '$.a', 'int') as int) a").orderBy("nth").collect()
    assert got[0].a == 1


def walk(text):
    """Spans and parents of brackets by a stack."""
    stack, spans = [], []
    for i, c in enumerate(text, 1):
        if c in "[{":
            stack.append((i, len(spans)))
            spans.append([len(stack) - 1, i, None, stack[-2][0] if len(stack) > 1 else None])
        elif c in "]}":
            start, k = stack.pop()
            spans[k][2] = i
    return sorted(map(tuple, spans), key=lambda s: (s[0], s[1]))


VALUES = st.recursive(st.integers(-99, 99) | st.booleans() | st.none() | st.text(alphabet="xyz", max_size=3), lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.sampled_from(["a", "b", "cc", "d1"]), inner, max_size=3), max_leaves=12)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["p", "q", "r"]), VALUES, max_size=3), min_size=12, max_size=12))
def test_against_a_stack_walker(spark, values):
    from nestkit.functions import text as T

    texts = [(i, json.dumps(v, separators=(",", ":"))) for i, v in enumerate(values)]
    frame = spark.createDataFrame(texts, "d int, t string")
    fenced = dict(frame.select("d", T.fence("t")).collect())
    got: dict[int, list] = {}
    for r in unrolled(frame, "d", "t", 50).collect():
        got.setdefault(r.d, []).append(r)
    for d, text in texts:
        nodes = sorted(got[d], key=lambda r: r.nth)
        spans = walk(fenced[d])
        assert [(r.depth, r.open, r.close) for r in nodes] == [s[:3] for s in spans]
        assert [r.nth for r in nodes] == list(range(len(nodes)))
        by_open = {r.open: r for r in nodes}
        for r, s in zip(nodes, spans):
            assert r.parenth == (None if s[3] is None else by_open[s[3]].nth)
            if s[3] is not None:
                assert (r.parent.key, r.parent.ord) == (by_open[s[3]].key, by_open[s[3]].ord)
        assert json.loads(nodes[0].json) == values[d]


@pytest.mark.parametrize("strict", [False, True])
def test_brackets_are_not_rows_of_a_plan(spark, strict):
    """One window, over whole texts, shows that a key is one document's. Nothing is sorted or exchanged for nodes."""
    frame = spark.createDataFrame([(1, "{}")], "d int, t string")
    for nodes in (unrolled(frame, "d", "t", 3, strict=strict), parser(frame, "d", "t", 3, strict=strict)):
        plan = nodes._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Window [") == plan.count("Sort [") == plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_pieces_do_not_change_nodes(spark, monkeypatch):
    """Texts taken a few bytes at a time and rows given out one by one make the same nodes."""
    import pyarrow as pa

    from nestkit.operators import scan

    texts = pa.record_batch({"d": [1, 2, 3, 4], "t": ['{"a":[1,{"b":"é"}]}', None, "]{[}", '[[{"x":1}],{},{"#":{"y":2},"#":#}]']})
    names = ["at", "depth", "slot", "open", "close", "key", "ord", "json", "parent"]

    def run():
        return [r for b in scan.flat(["d"], "t", [("[", "]"), ("{", "}")], 9, False, names)(iter([texts])) for r in b.to_pylist()]

    whole = run()
    monkeypatch.setattr(scan, "PIECE", 1)
    monkeypatch.setattr(scan, "OUT", 1)
    assert run() == whole and len(whole) > 8


@pytest.mark.parametrize("pairs", [[("[", "]"), ("{", "}")], [("«", "»"), ("{", "}")]])
def test_levels_of_texts_equal_those_of_characters(spark, pairs):
    texts = ['{"a":[1,{"é":[]}]}', "]{[}", None, "", "é«{»}{«»«", "}}{{", "[[]]]"]
    frame = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    chars = object_containment(character_indices(frame, ["d"], "t", bracket_pattern(pairs)), ["d"], pairs)
    plain = lambda df: sorted(map(repr, df.collect()))
    got = contained(frame, ["d"], "t", pairs)
    assert plain(got) == plain(chars) and got.schema.simpleString() == chars.schema.simpleString()
    for pick in (None, 0, 2, 9):
        want, found = object_boundaries(chars, ["d"], pick), boundaries(frame, ["d"], "t", pick, pairs)
        assert plain(found) == plain(want) and found.schema.simpleString() == want.schema.simpleString()
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
