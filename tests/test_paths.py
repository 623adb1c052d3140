import io
import json

import pytest
from pyspark.sql import functions as F

from pathloom import cli
from pathloom.operators import native
from pathloom.operators.evaluate import delete, find, insert, replace
from pathloom.operators.frame import JsonFrame, loads, text_of
from pathloom.plans.parser import parse
from pathloom.plans.syntax import PathError

DOCS = [
    '{"obj":{"x":"y"},"arr":[2,3],"o":{"p":1,"q":2,"t":{"u":6}},"e":"f","a":[3,5,1,2,4,6,{"b":"j"},{"b":"k"},{"b":{}},{"b":"kilo"},null,1.0,true,"3"],"it\'s \\\\":{"z\\n":[1]}}',
    '[[1,2],[3],{"a":1,"b":[1,2,3]},"abc",5,null,[]]', '"x"', "no json", None, '{"a":[{"x":1,"y":1},{"x":2},{"y":[1]},{"x":"s","y":"s"},{"x":null,"y":null}]}',
]
NATIVE = [
    "$", "$.a", "$.a[*]", "$.*", "$.a[1]", "$.a[-1]", "$.a[2:5]", "$.a[5:1:-2]", "$.a[::-1]", "$.a[::0]", "$.a[0,1,0]", "$['o','e']", "$.a[?@>3]", "$.a[?@.b]", "$.a[?@.b=='k']", "$.a[?@.b!='k']",
    "$.a[?@<='3']", "$.a[?@==null]", "$.a[?@>=null]", "$.a[?@==1]", "$.a[?@.x==@.y]", "$.a[?@.x<=@.y]", "$.a[?!@.x]", "$.a[?@.b && @.b=='j' || @==true]", "$[?count(@.*)>1]", "$[?length(@)>2]",
    "$[?@[?@>2]]", "$[?value(@.a)==1]", "$.a[?match(@.b,'k.*')]", "$.a[?search(@.b,'[jk]')]", "$.a[?@==$.arr[0]]", "$['it\\'s \\\\'].*[0]", "$[1:,0][*]", "$.a[?@.nope==$.nope]", "$[?count(@)==2]", "$[?@[0]==1,?@.b]",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id int, doc string")


def plain(value) -> str:
    return json.dumps(value, sort_keys=True).replace("1.0", "1")


@pytest.mark.parametrize("query", NATIVE)
def test_backends_agree(docs, query):
    path = parse(query)
    assert native.expressible(path)
    want = sorted((k, n.path, plain(n.value)) for k, t in enumerate(DOCS) for root, good in [loads(t)] if good for n in find(path, root))
    rows = JsonFrame(docs).nodes(query).select("id", "path", F.to_json("value").alias("v")).collect()
    assert sorted((r.id, r.path, plain(json.loads(r.v))) for r in rows) == want


def test_order_and_preserve_order(docs):
    rows = JsonFrame(docs).nodes("$.a[3:0:-1,0]").orderBy("id", "ord").where("id = 0").collect()
    assert [r.path for r in rows] == [f"$['a'][{k}]" for k in (3, 2, 1, 0)]
    kept = JsonFrame(docs, preserve_order=True).nodes("$.*").where("id = 0").orderBy("ord").collect()
    assert [r.key for r in kept] == ["obj", "arr", "o", "e", "a", "it's \\"]


def test_descendants(docs):
    rows = JsonFrame(docs).nodes("$..b").orderBy("id", "ord").collect()
    assert [r.path for r in rows][-1] == "$[2]['b']"
    assert [n.value for n in find(parse("$..*"), [[[1]], [2], 3])] == [[[1]], [2], 3, [1], 1, 2]


COMPARE = {"obj": {"x": "y"}, "arr": [2, 3], "n": 1, "f": 1.0, "z": None}


@pytest.mark.parametrize(("test", "holds"), [
    ("$.absent1 == $.absent2", True), ("$.absent1 <= $.absent2", True), ("$.absent == 'g'", False), ("$.absent != 'g'", True), ("1 <= 2", True), ("1 > 2", False), ("13 == '13'", False), ("'a' <= 'b'", True),
    ("$.obj == $.arr", False), ("$.obj == $.obj", True), ("$.arr == $.arr", True), ("$.obj == 17", False), ("$.obj <= $.arr", False), ("$.obj <= $.obj", True), ("1 <= $.arr", False), ("1 != $.arr", True),
    ("true <= true", None), ("$.n == $.f", True), ("$.z == null", True), ("$.absent == null", False), ("$.z <= null", True), ("$.z < null", False),
])
def test_comparisons(spark, test, holds):
    query = f"$[?{test}]"
    if holds is None:
        with pytest.raises(PathError):
            parse(query)
        return
    assert bool(find(parse(query), COMPARE)) == holds
    frame = spark.createDataFrame([(text_of(COMPARE),)], "doc string")
    assert (JsonFrame(frame).nodes(query).count() > 0) == holds


def test_rewriting():
    d = {"a": [0, 1, 2, 3], "b": {"x": 1, "y": {"x": 2}}}
    assert delete(parse("$.a[0,2]"), d) == ({"a": [1, 3], "b": d["b"]}, [0, 2])
    assert delete(parse("$..x"), d) == ({"a": d["a"], "b": {"y": {}}}, [1, 2]) and delete(parse("$"), d)[0] == {}
    assert delete(parse("$.a[*]"), d, lambda n: n.value % 2 == 0)[0]["a"] == [1, 3]
    assert replace(parse("$..x"), d, 0)["b"] == {"x": 0, "y": {"x": 0}} and replace(parse("$.a[*]"), d, by=lambda n: n.value + n.key)["a"] == [0, 2, 4, 6]
    assert insert(parse("$.b.new"), d, 5)["b"]["new"] == 5 and insert(parse("$.a[4]"), d, 9)["a"] == [0, 1, 2, 3, 9]
    for query, message in {"$.a[3]": "already has index 3", "$.a[5]": "too small", "$.b": 'already has key "b"', "$.*": "singular query", "$.q.r": "no parent"}.items():
        with pytest.raises(PathError, match=message):
            insert(parse(query), d, 1)
    with pytest.raises(PathError):
        replace(parse("$"), d, 1)
    assert d == {"a": [0, 1, 2, 3], "b": {"x": 1, "y": {"x": 2}}}


def test_frame_rewriting(docs):
    out = {r.id: r for r in JsonFrame(docs).delete("$..b", "gone").collect()}
    assert out[0].gone == ['"j"', '"k"', "{}", '"kilo"'] and out[3].doc == "no json" and out[4].doc is None
    why = {r.id: r.why for r in JsonFrame(docs).insert("$.new", 1, errors="why").collect()}
    assert why[0] is None and "is no object" in why[1]


def test_sql_functions(spark, docs):
    from pathloom.functions.sql import register

    register(spark)
    docs.createOrReplaceTempView("docs_of_test")
    rows = spark.sql("SELECT id, json_value(doc, '$.o.p') AS v, size(json_query(doc, '$.a[*]')) AS n, json_exists(doc, '$.a') AS e FROM docs_of_test ORDER BY id").collect()
    assert tuple(rows[0]) == (0, "1", 14, True) and tuple(rows[3]) == (3, None, 0, False)
    assert spark.sql("SELECT path FROM docs_of_test, LATERAL json_nodes(doc, '$..u')").first().path == "$['o']['t']['u']"


def test_stream(spark, docs, tmp_path):
    from pathloom.streaming.nodes import stream_nodes

    docs.where("doc is not null").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for k, query in enumerate(("$.a[?@.b]", "$..b")):
        q = stream_nodes(stream, query).writeStream.format("memory").queryName(f"nodes_{k}").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(f"nodes_{k}").count() == JsonFrame(docs).nodes(query).count()


def run_cli(*argv, stdin=""):
    out = io.StringIO()
    return cli.main(list(argv), io.StringIO(stdin), out), out.getvalue()


def test_command_line(tmp_path):
    (tmp_path / "d.json").write_text('{"a":[1,2]}')
    file = str(tmp_path / "d.json")
    assert run_cli("$.a[*]", file, "-c") == (0, "[1,2]\n")
    assert run_cli("$.a[0]", "-d", "-c", stdin='{"a":[1,2]}') == (0, '{"a":[2]}\n')
    assert run_cli("$.a[2]", file, "-i", "-v", "1.5", "-c") == (0, '{"a":[1,2,1.5]}\n')
    assert run_cli("$.a", file, "-r", "-v", "-1", "-c")[1] == '{"a":"-1"}\n'
    assert run_cli("$.a[*]", file, "-p", "-c")[1] == "[\"$['a'][0]\",\"$['a'][1]\"]\n"
    assert run_cli("$.a")[1] == "Query is valid\n" and run_cli("$.a", stdin="{")[0] == 1
    code, text = run_cli("$.a[", file)
    assert code == 1 and "^" in text


def test_catalog_on_small_tables(spark):
    import duckdb

    from pathloom.plans import catalog

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("orders", "lineitem", "customer", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    oracles = catalog.oracles()
    for name in ("jp_filter_gt", "jp_slice_reverse", "jp_union_bag", "jp_length", "jp_delete", "jp_events_filter"):
        df = catalog.queries()[name](spark, sf)
        want = con.sql(oracles[name])
        rows = sorted(tuple(str(r[c]) for c in want.columns) for r in df.collect())
        assert rows == sorted(tuple(map(str, r)) for r in want.fetchall()), name


def test_delete_descendant_is_one_pass(spark):
    """Documents are made and changed once, and line items move once, by order (F5)."""
    from pathloom.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["jp_delete_descendant"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, plan
        docs = catalog.order_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        moved = [x for x in docs.splitlines() if "Exchange hashpartitioning" in x]
        assert len(moved) == 4 and not any("items" in x for x in moved), docs
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_own_documents_are_changed_in_place():
    d = {"a": [{"x": 1, "y": [{"x": 2}]}], "x": "x"}
    out, gone = delete(parse("$..x"), d, own=True)
    assert out is d and d == {"a": [{"y": [{}]}]} and gone == ["x", 1, 2]
    assert replace(parse("$.a[0,0]['y','y']"), d, 7, own=True) is d and d == {"a": [{"y": 7}]}
    wide = [[k] for k in range(3000)]
    assert replace(parse("$[*]"), wide, 0, own=True) == [0] * 3000


@pytest.mark.parametrize("verb", ["replace", "insert", "delete_if"])
def test_documents_are_not_copied(spark, monkeypatch, verb):
    """what a worker parsed is its own; and errors of an insert are found in one pass."""
    from pathloom.operators import evaluate
    from pathloom.plans import catalog

    monkeypatch.setattr(evaluate.copy, "deepcopy", lambda x, *_: pytest.fail("copied") if isinstance(x, (dict, list)) else x)
    d = {"a": [1, 2]}
    if verb == "replace":
        assert replace(parse("$.a[*]"), d, by=lambda n: n.value + 1, own=True) == {"a": [2, 3]} == d
    elif verb == "delete_if":
        assert delete(parse("$.a[*]"), d, lambda n: n.key == 0, own=True) == ({"a": [2]}, [1]) and d == {"a": [2]}
    else:
        assert insert(parse("$.a[2]"), d, 3, own=True) == {"a": [1, 2, 3]} == d
        plan = catalog.queries()["jp_insert_errors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1, plan


def test_names_are_deleted_at_any_depth():
    for query in ("$..x", "$..['x','a']", "$.b..x", "$[*]..y"):
        d = {"x": 1, "a": {"x": {"x": 2}, "y": [{"x": 3, "z": [[{"x": 4}], "x"]}]}, "b": [{"x": []}, {"y": {}}]}
        assert delete(parse(query), d, values=False) == (delete(parse(query), d)[0], [])
    assert delete(parse("$..x"), "x", values=False) == ("x", [])


def test_texts_are_not_repeated_for_nodes(spark, docs):
    """only with ``keep_doc`` a document goes along with each of its nodes."""
    plan = lambda **how: JsonFrame(docs).nodes("$..b", **how)._jdf.queryExecution().analyzed().toString()
    made = lambda **how: next(x for x in plan(**how).splitlines() if "MapInArrow" in x)
    assert "c1#" not in made().split("[")[1] and "c1#" in made(keep_doc=True).split("[")[1]
    rows = JsonFrame(docs).nodes("$..b", keep_doc=True).collect()
    assert {r.doc for r in rows} == {DOCS[0], DOCS[1]}
    many = spark.createDataFrame([(0, text_of(list(range(45_000)))), (1, "[5]")], "id int, doc string").coalesce(1)
    found = JsonFrame(many, preserve_order=True).nodes("$[*]", parents=False)
    assert [(r.id, r.n, r.low, r.high) for r in found.groupBy("id").agg(F.count("*").alias("n"), F.min("ord")[0]["place"].alias("low"), F.max("pos").alias("high")).orderBy("id").collect()] == [(0, 45_000, 0, 44_999), (1, 1, 0, 0)]


@pytest.mark.parametrize("variant", [False, True])
def test_root_is_emptied_in_catalyst(docs, variant):
    """F11."""
    more = docs.unionByName(docs.sparkSession.createDataFrame([(10, " [1]"), (11, "\t{}"), (12, "[1"), (13, "7"), (14, ' "[" ')], docs.schema))
    frame = JsonFrame(more.select("id", F.try_parse_json("doc").alias("doc")) if variant else more)
    made = frame.delete("$")
    assert "Python" not in made._jdf.queryExecution().toString()
    slow = JsonFrame(frame.delete("$", "gone")).to_json()
    assert {r.id: r.doc for r in JsonFrame(made).to_json().collect()} == {r.id: r.doc for r in slow.select("id", "doc").collect()}


def test_zip_moves_documents_once(spark):
    """what lies by document does not move for its pairs."""
    from pathloom.plans import catalog

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.queries()["jp_zip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any("qty" in x or "index" in x or "_x" in x for x in moved), plan


def test_sql_functions_parse_a_batch_once(monkeypatch):
    """F14."""
    import pyarrow as pa

    from pathloom.functions import sql
    from pathloom.operators import frame

    parsed = []
    monkeypatch.setattr(frame, "loads", lambda t: parsed.append(t) or loads(t))
    texts = ['{"a":1}', "no", None, '{"a":[2]}']
    docs, query = pa.array(texts), pa.array(["$.a"] * 3 + [None])
    for _ in range(3):
        assert sql.json_value.func(docs, query).to_pylist() == ["1", None, None, None] and sql.json_exists.func(docs, query).to_pylist() == [True, False, False, False]
        assert sql.json_query.func(pa.array(texts), query).to_pylist() == [["1"], [], [], []]
    assert parsed == texts
    monkeypatch.setattr(frame, "MOST_BYTES", 0)
    assert sql.json_value.func(pa.array(['{"a":"x"}']), pa.array(["$.a"])).to_pylist() == ["x"]


def test_scalars_are_not_visited():
    from pathloom.operators.evaluate import Node, visit

    d = {"a": 1, "b": [2, {"c": 3}], "e": {}}
    assert [n.path for n in visit(Node(d, None, ()))] == ["$", "$['b']", "$['b'][1]", "$['e']"]
    assert [n.path for n in find(parse("$..[?@.c]"), d)] == ["$['b'][1]"] and [n.value for n in find(parse("$..*"), 5)] == []
    assert find(parse("$[?@ == 1]"), [1, True]) != find(parse("$[?@ == true]"), [1, True])
