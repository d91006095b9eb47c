import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from nestkit import oracles
from nestkit import queries as core
from nestkit.functions import text as T
from nestkit.functions.meta import SCOPES, meta
from nestkit.plans.register import register

SF = "/root/testdata/sf0.001"


def plain(v):
    if not isinstance(v, (list, dict)) and pd.isna(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    return int(v) if isinstance(v, float) and v == int(v) else v


def values(frame):
    return sorted(repr([plain(v) for v in row]) for row in frame[sorted(frame)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def test_every_query_has_sql():
    assert set(core.QUERIES) == set(oracles.ORACLE_SQL)
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), duck.sql(oracles.ORACLE_SQL[name]).df()
    assert sorted(got) == sorted(want)
    assert values(got) == values(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_meta(spark):
    for n in SCOPES:
        assert spark.range(1).select(meta(n).alias("m")).first().m.scope == SCOPES[n]


@pytest.mark.parametrize("strict", [False, True])
def test_sql_names(spark, strict):
    assert len(register(spark, strict)) == 19
    texts = ['{"a":-1,"b":"x:y"}', '{"":"a","":1}', '{"s":"q\\"r","t":"e\\\\"}', "a{b#c", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    sql = frame.selectExpr(
        "fix_jsonPrimitives(t)", "lay_jsonPrimitives(fix_jsonPrimitives(t))", "fix_jsonSafeGuards(t, true)", "fix_jsonSafeGuards(t, false)", "lay_jsonSafeGuards(fix_jsonSafeGuards(t, true))",
        "map_jsonSafeGuards(t, true)", "map_jsonSafeGuards(t, false)", "fix_jsonTuples(t)", "fix_jsonKeyFragment(t)", "get_jsonKeyIndex(t, 6)", "get_jsonKeyFragment(t, 6, 1)", "get_jsonObjectFragment(t, 1, 7)",
    ).collect()
    from pyspark.sql import functions as F

    six, one = F.lit(6), F.lit(1)
    columns = frame.select(
        T.fence("t", strict), T.unfence(T.fence("t", strict)), T.guard("t"), T.guard("t", False), T.unguard(T.guard("t"), strict),
        T.guard_quoted("t", True, strict), T.guard_quoted("t", False, strict), T.fix_tuples("t"), T.key_name("t"), T.key_index("t", six), T.key_fragment("t", six, one), T.object_fragment("t", one, F.lit(7)),
    ).collect()
    assert [list(r) for r in sql] == [list(r) for r in columns]
    assert [tuple(r) for r in spark.sql("select idx, sub from get_characterIndices('a[b]', '[\\\\[\\\\]]') order by idx").collect()] == [(2, "["), (4, "]")]
    assert spark.sql("select use_meta().version v").first().v == "0.1.2"


def test_meta_names_what_is_registered(spark):
    from nestkit.functions.meta import FUNCTIONS

    known = {f"{n}_{f}" for n, names in FUNCTIONS.items() for f in [*names, "meta"]}
    assert len(known) == 28 and set(register(spark)) <= known


def test_a_missing_package_leaves_the_core(tmp_path):
    """Without a package that an operator needs, the core's queries are still there."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(set(e.queries()) & set(e.core.QUERIES)))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert out.stdout.split() == [str(len(core.QUERIES))], out.stderr


def test_core_stands_alone(tmp_path):
    """Without the folders of training-data operators and the pipeline the rest imports and lists its queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "nestkit"), tmp_path / "nestkit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.split() == ["True", str(len(core.QUERIES))], out.stderr
