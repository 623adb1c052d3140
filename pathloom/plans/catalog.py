"""Queries over order documents and events, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import JsonFrame, number_of, string_of


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orderkey, doc``: every order with its customer and its line items. Line items move once, by order; an order gets its customer while it is small."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    item = F.struct(
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("disc"), F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").cast("date").alias("ship"),
    )
    lines = read("lineitem").select("l_orderkey", item.alias("item")).repartition("l_orderkey")  # else items are collected before they move as well
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("item")).alias("items"))
    customers = read("customer").select("c_custkey", "c_name", "c_mktsegment")
    orders = read("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    doc = F.struct(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderpriority").alias("priority"),
        F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).alias("customer"),
        F.coalesce("items", F.array().cast(items.schema["items"].dataType)).alias("items"),
    )
    return orders.select(F.col("o_orderkey").alias("orderkey"), F.to_json(doc).alias("doc"))


def _frame(spark: SparkSession, sf_dir: str) -> JsonFrame:
    return JsonFrame(order_documents(spark, sf_dir))


ITEMS = """
WITH o AS (SELECT orders.* FROM orders JOIN customer ON o_custkey = c_custkey),
it AS (
  SELECT o.*, l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount) - 1 AS i,
         count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM o JOIN lineitem l ON l_orderkey = o_orderkey)
"""


def _nodes(query: str, **columns):
    """A query whose rows are orderkey and columns over the node."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = {n: c() for n, c in columns.items()}
        return _frame(spark, sf_dir).nodes(query, parents="flag" in made).select("orderkey", *(c.alias(n) for n, c in made.items()))

    return run


def _num() -> Column:
    return number_of(F.col("value"))


def _str() -> Column:
    return string_of(F.col("value"))


def _place() -> Column:
    return F.element_at("ord", -1)["place"]


def _item(where: str, select: str = "l_extendedprice AS price") -> str:
    return f"{ITEMS} SELECT o_orderkey AS orderkey, {select} FROM it WHERE {where}"


NODE_QUERIES = {
    "jp_name": ("$.status", {"status": _str}, "SELECT o_orderkey AS orderkey, o_orderstatus AS status FROM orders"),
    "jp_nested_name": ("$.customer.segment", {"segment": _str}, "SELECT o_orderkey AS orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey"),
    "jp_index": ("$.items[0].price", {"price": _num}, _item("i = 0")),
    "jp_negative_index": ("$.items[-1].price", {"price": _num}, _item("i = n - 1")),
    "jp_slice": ("$.items[1:3].price", {"price": _num}, _item("i IN (1, 2)")),
    "jp_slice_step": ("$.items[::2].price", {"price": _num}, _item("i % 2 = 0")),
    "jp_slice_reverse": ("$.items[::-1]", {"price": lambda: number_of(F.try_variant_get("value", "$.price", "variant")), "place": lambda: -_place()}, _item("true", "l_extendedprice AS price, i::INTEGER AS place")),
    "jp_wildcard_array": ("$.items[*].qty", {"qty": _num}, _item("true", "l_quantity AS qty")),
    "jp_wildcard_object": ("$.customer.*", {"key": lambda: F.col("key"), "text": lambda: F.try_variant_get("value", "$", "string")},
        "WITH c AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) SELECT o_orderkey AS orderkey, 'key' AS key, c_custkey::VARCHAR AS text FROM c UNION ALL SELECT o_orderkey, 'name', c_name FROM c UNION ALL SELECT o_orderkey, 'segment', c_mktsegment FROM c"),
    "jp_union_names": ("$['status','priority']", {"text": _str}, "SELECT o_orderkey AS orderkey, o_orderstatus AS text FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders"),
    "jp_union_bag": ("$.items[0,0,-1].price", {"price": _num}, f"{ITEMS} SELECT o_orderkey AS orderkey, l_extendedprice AS price FROM it, (VALUES (1), (2), (3)) v(b) WHERE (b < 3 AND i = 0) OR (b = 3 AND i = n - 1)"),
    "jp_filter_gt": ("$.items[?@.qty > 40].price", {"price": _num}, _item("l_quantity > 40")),
    "jp_filter_ge": ("$.items[?@.qty >= 40].price", {"price": _num}, _item("l_quantity >= 40")),
    "jp_filter_lt": ("$.items[?@.qty < 5].price", {"price": _num}, _item("l_quantity < 5")),
    "jp_filter_le": ("$.items[?@.ship <= '1993-06-30'].price", {"price": _num}, _item("l_shipdate < TIMESTAMP '1993-07-01'")),
    "jp_filter_eq": ("$.items[?@.flag == 'R'].price", {"price": _num}, _item("l_returnflag = 'R'")),
    "jp_filter_ne": ("$.items[?@.flag != 'R'].price", {"price": _num}, _item("l_returnflag <> 'R'")),
    "jp_logical": ("$.items[?@.qty > 40 && !(@.flag == 'R') || @.qty == 1].price", {"price": _num}, _item("(l_quantity > 40 AND l_returnflag <> 'R') OR l_quantity = 1")),
    "jp_exists": ("$.items[?@.disc].price", {"price": _num}, _item("l_discount > 0")),
    "jp_not_exists": ("$.items[?!@.disc].price", {"price": _num}, _item("l_discount = 0")),
    "jp_root_reference": ("$.items[?@.price > $.total].price", {"price": _num}, _item("l_extendedprice > o_totalprice")),
    "jp_nothing": ("$.items[?@.absent == $.missing && @.qty > 45].price", {"price": _num}, _item("l_quantity > 45")),
    "jp_length": ("$.items[?length(@) > 7 && length(@.flag) == 1].price", {"price": _num}, _item("l_discount > 0")),
    "jp_count": ("$[?count(@[?@.qty > 40]) >= 2]", {"size": lambda: F.size(F.try_variant_get("value", "$", "array<variant>")).cast("long")},
        f"{ITEMS} SELECT o_orderkey AS orderkey, count(*) AS size FROM it GROUP BY ALL HAVING count(*) FILTER (l_quantity > 40) >= 2"),
    "jp_value": ("$[?value(@[?@.qty > 40].flag) == 'A']", {"size": lambda: F.size(F.try_variant_get("value", "$", "array<variant>")).cast("long")},
        f"{ITEMS} SELECT o_orderkey AS orderkey, count(*) AS size FROM it GROUP BY ALL HAVING count(*) FILTER (l_quantity > 40) = 1 AND count(*) FILTER (l_quantity > 40 AND l_returnflag = 'A') = 1"),
    "jp_match": ("$.items[?match(@.ship, '1997-0[1-6].*')].price", {"price": _num}, _item("l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-07-01'")),
    "jp_search": ("$.items[?search(@.ship, '-12-2')].price", {"price": _num}, _item("month(l_shipdate) = 12 AND day(l_shipdate) BETWEEN 20 AND 29")),
    "jp_nested_filter": ("$[?@[?@.qty == 50]]", {"key": lambda: F.col("key")}, f"{ITEMS} SELECT DISTINCT o_orderkey AS orderkey, 'items' AS key FROM it WHERE l_quantity = 50"),
    "jp_descendant": ("$..price", {"price": _num}, _item("true")),
    "jp_descendant_filter": ("$..[?@.qty > 48].part", {"part": _num}, _item("l_quantity > 48", "l_partkey::DOUBLE AS part")),
    "jp_paths": ("$.items[?@.qty == 50]", {"path": lambda: F.col("path")}, _item("l_quantity = 50", "'$[''items''][' || i || ']' AS path")),
    "jp_parent_key": ("$.items[*].qty", {"key": lambda: F.col("key"), "flag": lambda: F.try_variant_get("parent", "$.flag", "string")}, _item("true", "'qty' AS key, l_returnflag AS flag")),
}


def _sums(df: DataFrame, *others: Column) -> DataFrame:
    """Item count and price sum of rewritten documents, which are parsed once, as far as prices go."""
    items = F.from_json("doc", "items array<struct<price:double>>")["items"]
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, i: a + F.coalesce(i["price"], F.lit(0.0)))
    each = F.transform(F.array(items), lambda x: F.struct(F.size(x).cast("long").alias("items"), F.round(total(x), 2).alias("total")))
    return df.select("orderkey", *others, F.inline(each))


PER_ORDER = f"""{ITEMS}, each AS (
  SELECT o.o_orderkey AS orderkey, o.o_totalprice AS ototal, it.i, it.n, it.l_quantity AS qty, it.l_extendedprice AS price, it.l_discount AS disc
  FROM o LEFT JOIN it ON it.l_orderkey = o.o_orderkey)
"""


def _delete(spark, sf_dir):
    return _sums(_frame(spark, sf_dir).delete("$.items[?@.qty > 25]"))


def _delete_if(spark, sf_dir):
    return _sums(_frame(spark, sf_dir).delete_if("$.items[*]", lambda value, parent, key, path: key % 2 == 0))


def _delete_descendant(spark, sf_dir):
    return _sums(_frame(spark, sf_dir).delete("$..disc").where(~F.contains("doc", F.lit('"disc"'))))


def _replace(spark, sf_dir):
    return _sums(_frame(spark, sf_dir).replace("$.items[?@.qty > 25].price", 1.0))


def _replace_by(spark, sf_dir):
    return _sums(_frame(spark, sf_dir).replace("$.items[*].price", by=lambda value, parent, key, path: value + parent["qty"]))


def _insert(spark, sf_dir):
    made = _frame(spark, sf_dir).insert("$.customer.vip", True)
    return made.select("orderkey", F.try_variant_get(F.try_parse_json("doc"), "$.customer.vip", "boolean").alias("vip"))


def _insert_errors(spark, sf_dir):
    made = _frame(spark, sf_dir).insert("$.items[3]", {"price": 0.5}, errors="why")
    return _sums(made, F.col("why").isNull().alias("done")).select("orderkey", "items", "done")


def _map_select(spark, sf_dir):
    nodes = _frame(spark, sf_dir).query("$.items[*]")
    qty = F.try_variant_get("value", "$.qty", "double")
    return nodes.where(qty > 10).reject(qty > 20).map(qty=qty).drop("ord")


def _find(spark, sf_dir):
    qty = F.try_variant_get("value", "$.qty", "double")
    return _frame(spark, sf_dir).query("$.items[*]").find(qty > 30).select("orderkey", qty.alias("qty"))


def _with_index(spark, sf_dir):
    return _frame(spark, sf_dir).query("$.items[*].qty").with_index().select("orderkey", F.col("index").cast("long").alias("index"), _num().alias("qty"))


def _tally(spark, sf_dir):
    return _frame(spark, sf_dir).query("$.items[*].flag").tally(_str(), "flag")


def _aggregate(spark, sf_dir):
    return _frame(spark, sf_dir).query("$.items[*].price").aggregate(total=F.round(F.sum(_num()), 2), most=F.max(_num()))


def _search(spark, sf_dir):
    found = _frame(spark, sf_dir).search("$.items[?@.qty > 25].line")
    return found.select("orderkey", F.array_join("found", ",").alias("lines"))


def _exists_documents(spark, sf_dir):
    return _frame(spark, sf_dir).exists("$.items[6]").select("orderkey")


def _sql_functions(spark, sf_dir):
    from ..functions.sql import register

    register(spark)
    order_documents(spark, sf_dir).createOrReplaceTempView("pathloom_orders")
    return spark.sql("""
      SELECT orderkey, cast(json_value(doc, '$.total') AS double) AS total, cast(size(json_query(doc, '$.items[*]')) AS bigint) AS items,
             json_exists(doc, '$.items[?@.qty == 50]') AS full
      FROM pathloom_orders""")


def _sql_table_function(spark, sf_dir):
    from ..functions.sql import register

    register(spark)
    order_documents(spark, sf_dir).createOrReplaceTempView("pathloom_orders")
    return spark.sql("SELECT orderkey, path, cast(value AS double) AS qty FROM pathloom_orders, LATERAL json_nodes(doc, '$.items[?@.qty > 49].qty')")


def _events(query: str):
    def run(spark, sf_dir):
        events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "props")
        return JsonFrame(events, "props").nodes(query).select("event_id", number_of(F.col("value")).cast("long").alias("k"))

    return run


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, doc``: a tiny number, a whole one beyond doubles, values of all kinds, and an object that repeats a name."""
    k = F.col("n_nationkey").cast("string")
    big = (F.lit(9007199254740992) + F.col("n_nationkey")).cast("string")
    doc = F.concat(F.lit("["), k, F.lit(',"'), F.col("n_name"), F.lit('",null,'), k, F.lit("e-10,true,"), big, F.lit(',{"a":-1,"a":'), k, F.lit('},["x'), k, F.lit('"]]'))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("key"), doc.alias("doc"))


def _mixed_nodes(query: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = JsonFrame(_mixed(spark, sf_dir).withColumnRenamed("key", "nation")).nodes(query)
        return found.select("nation", F.col("path").alias("node"))

    return run


def _mixed_value(spark, sf_dir):
    found = JsonFrame(_mixed(spark, sf_dir).withColumnRenamed("key", "nation")).nodes("$[6].a")
    return found.select("nation", number_of(F.col("value")).alias("a"))


def _changed(change):
    return lambda spark, sf_dir: _sums(change(_frame(spark, sf_dir)))


def _delete_root(spark, sf_dir):
    return _frame(spark, sf_dir).delete("$").select("orderkey", "doc")


def _column_functions(spark, sf_dir):
    from ..functions.columns import json_exists, json_query, json_value

    docs, doc = _frame(spark, sf_dir).variants(), F.col("doc")
    total, items = json_value(doc, "$.total").cast("double"), F.size(json_query(doc, "$.items[*]")).cast("long")
    return docs.select("orderkey", total.alias("total"), items.alias("items"), json_exists(doc, "$.items[?@.qty == 50]").alias("full"))


def _reduce(spark, sf_dir):
    nodes = _frame(spark, sf_dir).query("$.items[*].line")
    return nodes.reduce(number_of(F.col("value")), F.lit(0.0), lambda a, x: a * 10 + x, "digits")


def _each_slice(spark, sf_dir):
    nodes = _frame(spark, sf_dir).query("$.items[*].qty")
    return nodes.each_slice(2, _num(), "qty").select("orderkey", F.col("slice").cast("long").alias("slice"), F.array_max("qty").alias("most"))


def _zip(spark, sf_dir):
    frame = _frame(spark, sf_dir)
    pairs = frame.query("$.items[*].qty").zip(frame.query("$.items[?@.disc].disc"), _num(), _num())
    return pairs.select("orderkey", F.col("index").cast("long").alias("index"), F.col("left").alias("qty"), F.col("right").alias("disc"))


def _mixed_sql(*cases: str) -> str:
    """(place, condition on the key n) -> the nodes there."""
    parts = (f"SELECT n_nationkey::BIGINT AS nation, '$[{place}]' AS node FROM nation WHERE {where}" for place, _, where in (c.partition(":") for c in cases))
    return " UNION ALL ".join(parts)


OTHER = {
    "jp_mixed_positive": (_mixed_nodes("$[?@ > 0]"), _mixed_sql("0:n_nationkey > 0", "3:n_nationkey > 0", "5:true")),
    "jp_mixed_zero": (_mixed_nodes("$[?@ == 0]"), _mixed_sql("0:n_nationkey = 0", "3:n_nationkey = 0")),
    "jp_mixed_beyond_doubles": (_mixed_nodes("$[?@ == 9007199254740993 || @ > 9007199254741002]"), _mixed_sql("5:n_nationkey = 1 OR n_nationkey > 10")),
    "jp_mixed_null": (_mixed_nodes("$[?@ == null || @ == true]"), _mixed_sql("2:true", "4:true")),
    "jp_mixed_strings": (_mixed_nodes("$[?@ >= 'J' && @ != 1]"), _mixed_sql("1:n_name >= 'J'")),
    "jp_mixed_containers": (_mixed_nodes("$[?@ == $[7]]"), _mixed_sql("7:true")),
    "jp_dynamic_regex": (_mixed_nodes("$[?search($[7][0], $[7][0]) && length(@) == count($[7].*)]"), _mixed_sql("6:true", "7:true")),
    "jp_nested_functions": (_mixed_nodes("$[?length(value($[7][*])) == length($[7][0]) && count(@.*) == 1]"), _mixed_sql("6:true", "7:true")),
    "jp_repeated_name": (_mixed_value, "SELECT n_nationkey::BIGINT AS nation, n_nationkey::DOUBLE AS a FROM nation"),
    "jp_delete_index": (_changed(lambda f: f.delete("$.items[-1]")), f"{PER_ORDER} SELECT orderkey, count(i) FILTER (i < n - 1) AS items, round(coalesce(sum(price) FILTER (i < n - 1), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_delete_slice": (_changed(lambda f: f.delete("$.items[::2]")), f"{PER_ORDER} SELECT orderkey, count(i) FILTER (i % 2 = 1) AS items, round(coalesce(sum(price) FILTER (i % 2 = 1), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_delete_union": (_changed(lambda f: f.delete("$.items[0, 2, ?@.qty == 50]")), f"{PER_ORDER} SELECT orderkey, count(i) FILTER (i NOT IN (0, 2) AND qty <> 50) AS items, round(coalesce(sum(price) FILTER (i NOT IN (0, 2) AND qty <> 50), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_delete_root": (_delete_root, "SELECT o_orderkey AS orderkey, '{}' AS doc FROM orders JOIN customer ON o_custkey = c_custkey"),
    "jp_column_functions": (_column_functions, f"{PER_ORDER} SELECT orderkey, ototal AS total, count(i) AS items, coalesce(bool_or(qty = 50), false) AS full FROM each GROUP BY orderkey, ototal"),
    "jp_reduce": (_reduce, f"{ITEMS}, d AS (SELECT o_orderkey AS orderkey, list_transform(list(l_linenumber ORDER BY i), lambda x: x::DOUBLE) AS l FROM it GROUP BY ALL) SELECT orderkey, list_reduce(l, lambda a, x: a * 10 + x, 0.0::DOUBLE) AS digits FROM d"),
    "jp_each_slice": (_each_slice, f"{ITEMS} SELECT o_orderkey AS orderkey, i // 2 AS slice, max(l_quantity) AS most FROM it GROUP BY ALL"),
    "jp_zip": (_zip, f"{ITEMS}, d AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY i) - 1 AS j FROM it WHERE l_discount > 0) SELECT it.o_orderkey AS orderkey, it.i AS index, it.l_quantity AS qty, d.l_discount AS disc FROM it LEFT JOIN d ON d.o_orderkey = it.o_orderkey AND d.j = it.i"),
    "jp_delete": (_delete, f"{PER_ORDER} SELECT orderkey, count(i) FILTER (qty <= 25) AS items, round(coalesce(sum(price) FILTER (qty <= 25), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_delete_if": (_delete_if, f"{PER_ORDER} SELECT orderkey, count(i) FILTER (i % 2 = 1) AS items, round(coalesce(sum(price) FILTER (i % 2 = 1), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_delete_descendant": (_delete_descendant, f"{PER_ORDER} SELECT orderkey, count(i) AS items, round(coalesce(sum(price), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_replace": (_replace, f"{PER_ORDER} SELECT orderkey, count(i) AS items, round(coalesce(sum(CASE WHEN qty > 25 THEN 1.0 ELSE price END), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_replace_by": (_replace_by, f"{PER_ORDER} SELECT orderkey, count(i) AS items, round(coalesce(sum(price + qty), 0.0), 2) AS total FROM each GROUP BY orderkey"),
    "jp_insert": (_insert, "SELECT o_orderkey AS orderkey, true AS vip FROM orders JOIN customer ON o_custkey = c_custkey"),
    "jp_insert_errors": (_insert_errors, f"{PER_ORDER} SELECT orderkey, CASE WHEN count(i) = 3 THEN 4 ELSE count(i) END AS items, count(i) = 3 AS done FROM each GROUP BY orderkey"),
    "jp_map_select_reject": (_map_select, _item("l_quantity > 10 AND l_quantity <= 20", "l_quantity AS qty")),
    "jp_find": (_find, f"{ITEMS} SELECT o_orderkey AS orderkey, arg_min(l_quantity, i) AS qty FROM it WHERE l_quantity > 30 GROUP BY ALL"),
    "jp_each_with_index": (_with_index, _item("true", "i AS index, l_quantity AS qty")),
    "jp_tally": (_tally, f"{ITEMS} SELECT l_returnflag AS flag, count(*) AS n FROM it GROUP BY ALL"),
    "jp_aggregate": (_aggregate, f"{ITEMS} SELECT o_orderkey AS orderkey, round(sum(l_extendedprice), 2) AS total, max(l_extendedprice) AS most FROM it GROUP BY ALL"),
    "jp_search_values": (_search, f"{ITEMS}, s AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY i) AS lines FROM it WHERE l_quantity > 25 GROUP BY ALL) SELECT o_orderkey AS orderkey, coalesce(lines, '') AS lines FROM o LEFT JOIN s ON l_orderkey = o_orderkey"),
    "jp_exists_documents": (_exists_documents, _item("i = 6", "").replace(", \n", " ").replace("orderkey,  FROM", "orderkey FROM")),
    "jp_sql_functions": (_sql_functions, f"{PER_ORDER} SELECT orderkey, ototal AS total, count(i) AS items, coalesce(bool_or(qty = 50), false) AS full FROM each GROUP BY orderkey, ototal"),
    "jp_sql_table_function": (_sql_table_function, _item("l_quantity > 49", "'$[''items''][' || i || '][''qty'']' AS path, l_quantity AS qty")),
    "jp_events_name": (_events("$.k"), "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL"),
    "jp_events_filter": (_events("$[?@ > 50]"), "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k')::BIGINT > 50"),
}


def queries() -> dict:
    return {name: _nodes(q, **columns) for name, (q, columns, _) in NODE_QUERIES.items()} | {name: run for name, (run, _) in OTHER.items()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in NODE_QUERIES.items()} | {name: sql for name, (_, sql) in OTHER.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["jp_filter_gt"](spark, sf_dir)
