import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nestkit.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("r")).first()["r"]


def test_scalar_cases(spark):
    fenced = '{"#":{"a":1},"#":#,"#":{"b":"x"},"#":#}'
    assert one(spark, T.fence("t"), t='{"a":1,"b":"x"}') == fenced
    assert one(spark, T.unfence("t"), t=fenced) == '{"a":1,"b":"x"}'
    assert one(spark, T.fence("t"), t="[1,2]") == "[1,2]"
    assert one(spark, T.key_name("t"), t='"o":{"p":{') == "p"
    assert one(spark, T.key_name("t"), t="[{") is None
    assert one(spark, T.key_name("t"), t='"#":{') == "#"
    assert one(spark, T.guard("t", False), t="a{b:c") == "a\\{b\\:c"
    assert one(spark, T.guard_quoted("t"), t='{"s":"p:q"}') == '{"s":"p\x1eq"}'
    assert one(spark, T.unguard("t"), t="p\x1eq") == "p:q"
    assert one(spark, T.key_index("t", F.lit(6)), t='{"a":{') == 1
    assert one(spark, T.key_fragment("t", F.lit(6), F.lit(1)), t='{"a":{') == '"a":{'
    assert one(spark, T.object_fragment("t", F.lit(1), F.lit(19)), t='{"#":{"a":1},"#":#}') == '{"a":1}'


def test_tuples(spark):
    assert one(spark, T.fix_tuples("t"), t='{"":"a","":1,"":"b","":{"":"c","":2}}') == '{"a":1,"b":{"c":2}}'
    assert one(spark, T.fix_tuples("t"), t='{"":1,"":2,"":3}') == '{"1":2,"undefined":3}'
    assert one(spark, T.fix_tuples("t"), t='{ bare : 1,two:2}') == '{"bare" : 1,"two":2}'


def test_numbers(spark):
    t = '{"a":-1.5,"b":1e+20,"c":2}'
    assert one(spark, T.fence("t"), t=t) == '{"#":{"a":-1.5},"#":#,"#":{"b":1e+20},"#":#,"#":{"c":2},"#":#}'
    assert one(spark, T.fence("t", strict=True), t=t) == '{"a":-1.5,"#":{"b":1},"#":#e+20,"#":{"c":2},"#":#}'


def test_json_text_keeps_literals_and_nulls(spark):
    row = spark.sql("select named_struct('a', 1.0D, 'b', cast(-2.50 as decimal(5,2)), 'c', null, 's', 'st, apt 5, city') v, array(1, 2) l, 'x\"y' s, 5 n")
    got = row.select(T.json_text("v").alias("v"), T.json_text("l").alias("l"), T.json_text("s").alias("s"), T.json_text("n").alias("n")).first()
    assert list(got) == ['{"a":1.0,"b":-2.50,"c":null,"s":"st, apt 5, city"}', "[1,2]", '"x\\"y"', "5"]


@pytest.mark.parametrize("value", ['a"b', "back\\", 'q\\"r', "{[:,<>()#]}", "plain", "", '"', "\\\\"])
def test_mask_round_trip(spark, value):
    frame = spark.createDataFrame([(value,)], "s string").select(F.struct("s").alias("v"))
    masked, back = frame.select(T.mask("v"), T.unguard(T.mask("v"))).first()
    assert json.loads(back) == {"s": value}
    assert not set(masked[6:-2]) & set("{}[]:,<>()#")


def test_nothing_to_guard_is_the_same(spark):
    """The short way for texts without delimiters in quotes, and long texts."""
    texts = ['{"a":"x"}', '{"a":"x,y"}', '"', 'a"b"c"', '{"a":"\\n"}', '"x"' * 20_000, '"' + "y" * 300_000 + '"', '{"q":"[' + "z" * 300_000 + '"}', "\n", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, got in zip(texts, [r.g for r in frame.select(T.guard_quoted("t").alias("g")).collect()]):
        want = re.sub(r'"((?:[^"\\]|\\.)*+)"', lambda m: '"' + "".join(T.GUARDS.get(c, c) for c in m[1]) + '"', t)
        assert got == want


def test_strict_quote_loses_its_backslash(spark):
    frame = spark.sql("select named_struct('s', 'a\"b') v")
    masked, back = frame.select(T.mask("v", True), T.unguard(T.mask("v", True), True)).first()
    assert masked == '{"s":"a\x05b"}' and back == '{"s":"a"b"}'


def test_null_stays_null(spark):
    frame = spark.sql("select cast(null as string) t")
    for c in (T.fence("t"), T.unfence("t"), T.guard("t"), T.unguard("t"), T.guard_quoted("t"), T.fix_tuples("t"), T.key_name("t"), T.valid_json("t"), T.key_index("t", F.lit(1))):
        assert frame.select(c).first()[0] is None


WORDS = st.text(alphabet='ab1":,{}[] \n.-', max_size=40)


@settings(max_examples=25, deadline=None)
@given(st.lists(WORDS, min_size=20, max_size=20))
def test_fence_equals_the_plain_pattern(spark, texts):
    """The anchored key pattern against the one that backtracks."""
    # A fixed pattern: the format's own rule, as the yardstick.
    plain = re.compile(r'((?:"[^"]*"|[^:,{}]*)\s*:\s*(?:"[^"]*"|[\d.]+|true|false|null))')
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fence("t", True).alias("f"), T.unfence(T.fence("t")).alias("u")).collect()
    for r in rows:
        assert r.f == plain.sub(r'"#":{\1},"#":#', r.t)
        if "#" not in r.t:
            assert r.u == r.t


def test_names_are_fixed_only_where_one_is_empty(spark):
    """mask() skips two patterns over the text where no name is empty, with the same result."""
    names = ["a", "", "x:y", "{b", "c ,d", 'e"', "f\\", '":', "g, h :"]
    maps = [dict(zip(names[i:] + names[:i], ['', '":', "{p: 1, q :2}", ', r :', '"', "\\", "[1,s:", None, "é"])) for i in range(len(names))] + [{"": "a"}, {"a": '"":'}, {}]
    frame = spark.createDataFrame([(m,) for m in maps], "m map<string,string>").select("m", F.map_keys("m").alias("k"), F.map_entries("m").alias("e"), F.create_map(F.lit(""), F.lit(1.5)).alias("n"), F.lit(7).alias("i"), F.lit(",t :").alias("s"))
    for c in (*frame.columns, F.struct("m", "e", "n")):
        got = frame.select(T.mask(c).alias("got"), T.fix_tuples(T.guard_quoted(T.json_text(c))).alias("want"))
        assert "contains(" in got._jdf.queryExecution().analyzed().toString().lower()
        assert all(r.got == r.want for r in got.collect())
