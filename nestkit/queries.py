"""One query for each function and operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions.meta import registry
from .operators import levels, nodes
from .plans.unroll import parser, unrolled
from .sources.tables import customer_values, order_documents, region_values, table

DEEP = 9
FLAT = ["doc", "depth", "nth", "parenth", "slot", "open", "close", "nest", "key", "ord", "sym", "json"]


def _flat(df: DataFrame, keep_text: bool = False) -> DataFrame:
    """Plain columns; a root's missing parent is -1, so that no column of whole numbers holds nulls."""
    up = {c: F.coalesce(c, F.lit(-1)) for c in ("parenth", "parent_nth")}
    return df.withColumn("parent_nth", F.col("parent.nth")).withColumns(up).select(*[c for c in ("str", "is_array_root") if c in df.columns and keep_text], *FLAT, "parent_nth", F.col("parent.key").alias("parent_key"), F.col("parent.ord").alias("parent_ord"))


def _props(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("doc"), F.col("props").alias("text"))


def _masked_orders(spark, d) -> DataFrame:
    return order_documents(spark, d).select("doc", T.mask("value").alias("text"))


def _tuples(spark, d) -> DataFrame:
    """JSON text of values without field names, and with bare names."""
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    c = table(spark, d, "customer")
    text = F.concat(F.lit('{"":"a","":'), n("c_custkey"), F.lit(',"":"seg","":"'), n("c_mktsegment"), F.lit('","":{"":'), n("c_nationkey"), F.lit("},{ bare : 1, other:2}}"))
    return c.select(F.col("c_custkey").alias("doc"), text.alias("text"))


def _brackets(spark, d) -> DataFrame:
    """Bracket positions in pages, with their texts."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("doc"), F.col("html").alias("text"))
    at = levels.character_indices(pages, ["doc"], "text", levels.bracket_pattern())
    return at.join(pages, "doc")


def namespace_meta(spark: SparkSession, d: str) -> DataFrame:
    return registry(spark)


def json_from_struct(spark, d):
    return customer_values(spark, d).select("doc", T.json_text("value").alias("jsn"))


def json_from_array(spark, d):
    return region_values(spark, d).select("doc", T.json_text("value.nations").alias("jsn"))


def fence(spark, d):
    return _masked_orders(spark, d).select("doc", T.fence("text").alias("jsn"))


def fence_props(spark, d):
    return _props(spark, d).select("doc", T.fence("text").alias("jsn"))


def unfence(spark, d):
    return _masked_orders(spark, d).select("doc", T.unfence(T.fence("text")).alias("jsn"))


def guard_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", T.guard("text").alias("str"))


def guard_debug(spark, d):
    return table(spark, d, "pages").select("page_id", T.guard("html", False).alias("str"))


def unguard(spark, d):
    return table(spark, d, "pages").select("page_id", T.unguard(T.guard("html")).alias("str"))


def quoted_mask(spark, d):
    return customer_values(spark, d).select("doc", T.guard_quoted(T.json_text("value")).alias("jsn"))


def quoted_mask_debug(spark, d):
    return customer_values(spark, d).select("doc", T.guard_quoted(T.json_text("value"), False).alias("jsn"))


def string_mask(spark, d):
    return customer_values(spark, d).select("doc", T.mask("value").alias("jsn"))


def tuples_fix(spark, d):
    return _tuples(spark, d).select("doc", T.fix_tuples("text").alias("jsn"))


def char_indices(spark, d):
    return _brackets(spark, d).select("doc", "idx", "sub")


def key_index(spark, d):
    return _brackets(spark, d).select("doc", "idx", T.key_index("text", "idx").alias("kpos"))


def key_fragment(spark, d):
    return _brackets(spark, d).select("doc", "idx", T.key_fragment("text", "idx", T.key_index("text", "idx")).alias("key"))


def _fenced_orders(spark, d) -> DataFrame:
    return _masked_orders(spark, d).select("doc", T.fence("text").alias("text"))


def _cut_orders(spark, d, *fields: str) -> DataFrame:
    return nodes.cut_nodes(_fenced_orders(spark, d), ["doc"], "text", DEEP, fields=fields)


def key_name(spark, d):
    return _cut_orders(spark, d, "open", "fragment").select("doc", "open", T.key_name("fragment").alias("key"))


def object_fragment(spark, d):
    return _cut_orders(spark, d, "open", "json")


def object_interface(spark, d):
    side = lambda c: F.struct(F.col(c).alias("idx"), F.col("nest"))
    rows = _cut_orders(spark, d, *nodes.PLACES[1:]).withColumn("h", side("open")).withColumn("t", side("close"))
    record = nodes.interface_record(F.col("depth"), F.col("h"), F.col("t"), F.col("slot"), F.col("kpos"), F.lit(True), F.col("fragment"), F.col("json"))
    empty = {c: F.col(c).cast("string") for c in ("arr_ctx", "acid", "ocid", "ecid")}
    return rows.select("doc", record.alias("r")).select("doc", "r.*").withColumns(empty)


def containment(spark, d):
    rows = levels.contained(_fenced_orders(spark, d), ["doc"], "text")
    return rows.select("doc", "idx", "sub", "pre", "depth", F.get("depths", F.lit(0)).alias("in_arrays"), F.get("depths", F.lit(1)).alias("in_objects"), "raise")


def boundaries(spark, d):
    return nodes.boundaries(_fenced_orders(spark, d), ["doc"], "text", 2)


def metadata(spark, d):
    fields = ["depth", "slot", "open", "close", "key", "sym", "ord", "acid", "ocid", "ecid", "list"]
    return nodes.object_metadata(_fenced_orders(spark, d), ["doc"], "text", DEEP, fields=fields)


def unroller(spark, d):
    return _flat(nodes.unroller(_props(spark, d), ["doc"], "text", DEEP))


def unrolled_orders(spark, d):
    return _flat(unrolled(_masked_orders(spark, d), "doc", "text", DEEP))


def unrolled_strict(spark, d):
    return _flat(unrolled(_masked_orders(spark, d), "doc", "text", DEEP, strict=True))


def unrolled_depth_1(spark, d):
    return _flat(unrolled(_masked_orders(spark, d), "doc", "text", 1))


def parser_customers(spark, d):
    return _flat(parser(customer_values(spark, d), "doc", "value", DEEP))


def parser_regions(spark, d):
    return _flat(parser(region_values(spark, d), "doc", "value.nations", DEEP), True)


def parser_orders(spark, d):
    return _flat(parser(order_documents(spark, d), "doc", "value", DEEP))


def parser_orders_nested(spark, d):
    """Of each order and level: its nodes, their keys and the bytes of their texts."""
    found = parser(order_documents(spark, d), "doc", "value", 3, shape="nested").select("doc", "is_array_root", F.explode("levels").alias("level"))
    keys, sizes = F.array_join("level.children.key", "|"), F.aggregate("level.children.json", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x))
    return found.select("doc", "is_array_root", F.col("level.depth").alias("depth"), F.size("level.children").cast("long").alias("n"), keys.alias("keys"), sizes.alias("bytes"))


def parser_nested(spark, d):
    found = parser(region_values(spark, d), "doc", "value", 2, shape="nested").select("doc", "str", "is_array_root", F.explode("levels").alias("level"))
    return found.select("doc", "str", "is_array_root", F.col("level.depth").alias("depth"), F.size("level.children").cast("long").alias("n"), F.array_join("level.children.key", "|").alias("keys"))


def level_stats(spark, d):
    nodes_ = unrolled(_masked_orders(spark, d), "doc", "text", DEEP)
    return nodes_.groupBy("depth", "sym").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"), F.sum("nth").alias("nths"), F.max("close").alias("far"))


def leaf_pivot(spark, d):
    """Primitives of order lines back as columns, one row a line."""
    leaves = unrolled(_masked_orders(spark, d), "doc", "text", DEEP).where("sym = '#' and depth = 3").select("doc", F.col("parent.nth").alias("line"), "key", F.regexp_extract("json", r":(.*)\}$", 1).alias("value"))
    named = lambda k, kind: F.max(F.when(F.col("key") == k, F.col("value"))).cast(kind).alias(k)
    return leaves.groupBy("doc", "line").agg(named("n", "int"), named("part", "bigint"), named("qty", "double"), named("off", "double"))


QUERIES = {
    "namespace_meta": namespace_meta,
    "json_from_struct": json_from_struct,
    "json_from_array": json_from_array,
    "fence": fence,
    "fence_props": fence_props,
    "unfence": unfence,
    "guard_escape": guard_escape,
    "guard_debug": guard_debug,
    "unguard": unguard,
    "quoted_mask": quoted_mask,
    "quoted_mask_debug": quoted_mask_debug,
    "string_mask": string_mask,
    "tuples_fix": tuples_fix,
    "char_indices": char_indices,
    "key_index": key_index,
    "key_fragment": key_fragment,
    "key_name": key_name,
    "object_fragment": object_fragment,
    "object_interface": object_interface,
    "containment": containment,
    "boundaries": boundaries,
    "metadata": metadata,
    "unroller": unroller,
    "unrolled_orders": unrolled_orders,
    "unrolled_strict": unrolled_strict,
    "unrolled_depth_1": unrolled_depth_1,
    "parser_customers": parser_customers,
    "parser_regions": parser_regions,
    "parser_nested": parser_nested,
    "parser_orders": parser_orders,
    "parser_orders_nested": parser_orders_nested,
    "level_stats": level_stats,
    "leaf_pivot": leaf_pivot,
}
