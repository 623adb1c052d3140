"""The Python surface: documents in a DataFrame, queried and rewritten by path."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.parser import parse
from ..plans.syntax import Path, PathError
from ..shipping import ship
from . import evaluate, native

NODE = "ord array<struct<branch:int,place:int>>, path string, key string, pos int, value string, parent string"
MOST_NODES, MOST_CHARS = 20_000, 4_000_000  # in an Arrow batch

UNSET = object()  # no value given; None is null


ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), check_circular=False)


def text_of(value) -> str:
    if type(value) is int or type(value) is float and math.isfinite(value):
        return repr(value)
    return ENCODER.encode(value)


def loads(text: str | None):
    """Parsed JSON, or None-with-False for what is no JSON."""
    try:
        return (json.loads(text), True) if text is not None else (None, False)
    except (ValueError, RecursionError):  # nested beyond what a parser takes: as no JSON
        return None, False


class JsonFrame:
    """Documents of JSON text (or VARIANT) in the column ``doc``; the other columns go along.

    ``preserve_order`` keeps the members of objects in the order of the text, which VARIANT sorts; it and
    queries that Catalyst can't express run over the text in Arrow batches.
    """

    def __init__(self, df: DataFrame, doc: str = "doc", preserve_order: bool = False):
        self.df, self.doc, self.preserve_order = df, doc, preserve_order
        self.is_variant = isinstance(df.schema[doc].dataType, T.VariantType)

    def _native(self, path: Path) -> bool:
        return not self.preserve_order and native.expressible(path)

    def _texts(self) -> DataFrame:
        return self.df.withColumn(self.doc, F.to_json(F.col(f"`{self.doc}`"))) if self.is_variant else self.df

    def variants(self) -> DataFrame:
        return self.df if self.is_variant else native.parsed(self.df, self.doc)

    def nodes(self, query: str | Path, keep_doc: bool = False, parents: bool = True) -> DataFrame:
        """A row for each node: the other columns, then ``ord, path, key, pos, value, parent`` (value and parent VARIANT; without
        ``parents`` parent may be NULL, which spares a wide one being written out for each of its children).

        Within a document ``ord`` gives the order of the nodelist. Documents that are null or no JSON have no nodes.
        """
        path = parse(query) if isinstance(query, str) else query
        others = [c for c in self.df.columns if keep_doc or c != self.doc]
        kept = [F.col(f"`{c}`") for c in others]
        if self._native(path):
            found = native.rows(self.variants(), self.doc, path)
            return found.select(*kept, *(F.col(f"_{c}").alias(c) for c in ("ord", "path", "key", "pos", "value", "parent")))
        found = self._python_nodes(path, parents, keep_doc)
        kept = [F.col(f"c{k}").alias(c) for k, c in enumerate(self.df.columns) if c in others]
        return found.select(*kept, "ord", "path", "key", "pos", F.try_parse_json("value").alias("value"), F.try_parse_json("parent").alias("parent"))

    def _python_nodes(self, path: Path, parents: bool, keep_doc: bool) -> DataFrame:
        ship(self.df.sparkSession)
        texts = self._texts()
        at = texts.columns.index(self.doc)
        texts = texts.toDF(*(f"c{k}" for k in range(len(texts.columns))))  # whatever the names
        beside = [k for k in range(len(texts.columns)) if keep_doc or k != at]  # a document's text is not repeated for each node
        schema = T.StructType([*(texts.schema.fields[k] for k in beside), *T.StructType.fromDDL(NODE).fields])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, places, made, size, host, wide = [], [], ([], [], [], [], []), 0, None, None
                for k, text in enumerate(batch.column(at).to_pylist()):
                    root, good = loads(text)
                    if not good:
                        continue
                    for place, node in enumerate(evaluate.find(path, root)):
                        key = node.keys[-1] if node.keys else None
                        named = isinstance(key, str)
                        value = text_of(node.value)
                        if parents and node.parent is not host:  # siblings share a text
                            host, wide = node.parent, None if node.parent is None else text_of(node.parent)
                        rows.append(k)
                        places.append(place)
                        for column, x in zip(made, (node.path, key if named else None, None if named else key, value, wide)):
                            column.append(x)
                        size += len(value) + len(wide or "")
                        if len(rows) >= MOST_NODES or size >= MOST_CHARS:
                            yield batch_of(batch, rows, places, made)
                            rows, places, made, size = [], [], ([], [], [], [], []), 0
                yield batch_of(batch, rows, places, made)

        def batch_of(batch: pa.RecordBatch, rows: list, places: list, made: tuple) -> pa.RecordBatch:
            n, at_rows = len(rows), pa.array(rows, pa.int64())
            order = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int32)), pa.array(places, pa.int32())], ["branch", "place"])
            order = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), order)
            columns = [pa.array(x, pa.int32() if k == 2 else pa.string()) for k, x in enumerate(made)]
            return pa.RecordBatch.from_arrays([*(batch.column(k).take(at_rows) for k in beside), order, *columns], names=schema.names)

        return texts.mapInArrow(run, schema)

    def query(self, query: str | Path) -> Nodes:
        return Nodes(self.nodes(query), [c for c in self.df.columns if c != self.doc])

    def _beside(self) -> tuple[DataFrame, Column]:
        """The documents and a column of their VARIANT, parsed once."""
        if self.is_variant:
            return self.df, F.col(f"`{self.doc}`")
        return native.with_variant(self.df, self.doc, "_variant"), F.col("_variant")

    def search(self, query: str | Path, out: str = "found") -> DataFrame:
        """``df`` with the values of each document's nodelist, in order, as an array of JSON texts."""
        path = parse(query) if isinstance(query, str) else query
        if not self._native(path):
            return self.df.withColumn(out, json_query(F.col(f"`{self.doc}`") if not self.is_variant else F.to_json(F.col(f"`{self.doc}`")), path))
        source, doc = self._beside()
        return source.withColumn(out, texts_of(path, doc)).drop("_variant")

    def exists(self, query: str | Path) -> DataFrame:
        """The documents where the query finds something."""
        path = parse(query) if isinstance(query, str) else query
        if not self._native(path):
            return self.search(path, "_found").where("size(_found) > 0").drop("_found")
        source, doc = self._beside()
        return source.where(found_in(path, doc)).drop("_variant")

    def find_paths(self, query: str | Path) -> DataFrame:
        nodes = self.nodes(query)
        return nodes.select(*(c for c in nodes.columns if c not in ("key", "pos", "value", "parent")))

    # rewriting: a document that is null or no JSON stays as it is

    def _rewrite(self, change: Callable, deleted: str | None = None) -> DataFrame:
        """``change(document) -> (document, deleted values)`` on each text."""
        ship(self.df.sparkSession)

        def run(texts: pa.Array) -> pa.Array:
            new, gone = [], []
            for text in texts.to_pylist():
                root, good = loads(text)
                root, lost = change(root) if good else (None, [])
                new.append(text_of(root) if good else text)
                if deleted:
                    gone.append([text_of(x) for x in lost])
            gone = pa.array(gone, pa.list_(pa.string())) if deleted else pa.nulls(len(new), pa.list_(pa.string()))
            return pa.StructArray.from_arrays([pa.array(new, pa.string()), gone], ["_new", "_gone"])

        done = F.arrow_udf(run, "_new string, _gone array<string>")
        source = self._texts()
        kept = [F.col(f"`{c}`") for c in source.columns]
        out = source.select(*kept, F.inline(F.array(done(F.col(f"`{self.doc}`")))))  # no filter is moved below a generator, which would change documents twice
        new = F.try_parse_json("_new") if self.is_variant else F.col("_new")
        out = out.withColumn(self.doc, new)
        return (out.withColumn(deleted, F.col("_gone")) if deleted else out).drop("_new", "_gone")

    def delete(self, query: str | Path, deleted: str | None = None) -> DataFrame:
        """Without the nodes found; ``deleted`` names a column for their values."""
        path = parse(query) if isinstance(query, str) else query
        if deleted is None and not path.segments:
            return self._emptied()
        if deleted is None and self._native(path):
            return self._edit(path, None)
        return self._rewrite(lambda root: evaluate.delete(path, root, own=True, values=deleted is not None), deleted)

    def _emptied(self) -> DataFrame:
        """Documents without what they contain; scalars stay. Text that is JSON begins with its container's bracket."""
        source, doc = self._beside()
        if self.is_variant:
            empty = [(native.array_view(doc).isNotNull(), "[]"), (native.object_view(doc).isNotNull(), "{}")]
            new = F.when(empty[0][0], F.parse_json(F.lit("[]"))).when(empty[1][0], F.parse_json(F.lit("{}"))).otherwise(doc)
        else:
            text = F.col(f"`{self.doc}`")
            first = F.ltrim(text, F.lit(" \t\n\r")).substr(1, 1)
            new = F.when(doc.isNull(), text).when(first == "{", "{}").when(first == "[", "[]").otherwise(F.to_json(doc))
        return source.withColumn(self.doc, new).drop("_variant")

    def _edit(self, path: Path, value: Column | None) -> DataFrame:
        """Rewriting in Catalyst; members of rewritten documents are sorted."""
        source, doc = self._beside()
        new = native.edited(doc, path.segments, doc, value)
        if not self.is_variant:
            new = F.when(doc.isNull(), F.col(f"`{self.doc}`")).otherwise(F.to_json(new))
        return source.withColumn(self.doc, new).drop("_variant")

    def delete_if(self, query: str | Path, choice: Callable, deleted: str | None = None) -> DataFrame:
        """Without the nodes for which ``choice(value, parent, key, path)`` holds."""
        path = parse(query) if isinstance(query, str) else query
        return self._rewrite(lambda root: evaluate.delete(path, root, lambda n: choice(n.value, n.parent, n.key, n.path), own=True), deleted)

    def replace(self, query: str | Path, value=UNSET, by: Callable | None = None) -> DataFrame:
        """With ``value`` (None: null), or ``by(value, parent, key, path)``, at every match."""
        path = parse(query) if isinstance(query, str) else query
        if (value is UNSET) == (by is None):
            raise PathError("replace takes a value or a function, just one of them", str(path))
        if not path.segments:
            raise PathError("replace needs a parent: the root cannot be replaced", str(path))
        if by is None and self._native(path):
            return self._edit(path, F.parse_json(F.lit(text_of(value))))
        change = (lambda n: by(n.value, n.parent, n.key, n.path)) if by else None
        return self._rewrite(lambda root: (evaluate.replace(path, root, None if by else value, change, own=True), []))

    def insert(self, query: str | Path, value, exists: Callable | None = None, errors: str | None = None) -> DataFrame:
        """With ``value`` at a new name or array end; a document where that can't be fails the job, unless ``errors`` names a column for the reason."""
        path = parse(query) if isinstance(query, str) else query
        if not path.singular or not path.segments:
            raise PathError("insert may only be used with a singular query", str(path))
        if errors is None:
            return self._rewrite(lambda root: (evaluate.insert(path, root, value, exists, own=True), []))

        def change(root):
            try:
                return evaluate.insert(path, root, value, exists, own=exists is None), []  # what exists() did before an error doesn't count
            except PathError as e:
                return root, [e.detail]

        return self._rewrite(change, errors).withColumn(errors, F.try_variant_get(F.try_parse_json(F.get(errors, 0)), "$", "string"))

    def to_json(self, pretty: bool = False) -> DataFrame:
        if not pretty:
            return self._texts()
        ship(self.df.sparkSession)
        show = F.pandas_udf(lambda s: s.map(lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False), na_action="ignore"), "string")
        return self._texts().withColumn(self.doc, show(F.col(f"`{self.doc}`")))


class Nodes:
    """A nodelist with the verbs of an enumeration; ``df`` is the plain DataFrame. Conditions and results are Columns over ``value``, ``key``, ``path``, ..."""

    def __init__(self, df: DataFrame, ids: list[str]):
        self.df, self.ids = df, ids

    def map(self, **columns: Column) -> DataFrame:
        return self.df.select(*self.ids, "ord", *(c.alias(n) for n, c in columns.items()))

    def where(self, condition: Column) -> Nodes:
        return Nodes(self.df.where(condition), self.ids)

    def reject(self, condition: Column) -> Nodes:
        return self.where(~F.coalesce(condition, F.lit(False)))

    def filter_map(self, **columns: Column) -> DataFrame:
        return self.map(**columns).dropna(subset=list(columns))

    def first(self, n: int = 1) -> DataFrame:
        """The first nodes of each document."""
        return self.with_index("_index").where(F.col("_index") < n).drop("_index")

    def find(self, condition: Column) -> DataFrame:
        return self.where(condition).first()

    def with_index(self, name: str = "index") -> DataFrame:
        return self.df.withColumn(name, F.row_number().over(Window.partitionBy(*self.ids).orderBy("ord")) - 1)

    def count(self) -> DataFrame:
        return self.df.groupBy(*self.ids).agg(F.count("*").alias("n"))

    def aggregate(self, **columns: Column) -> DataFrame:
        return self.df.groupBy(*self.ids).agg(*(c.alias(n) for n, c in columns.items()))

    def group_by(self, **columns: Column):
        return self.df.groupBy(*(c.alias(n) for n, c in columns.items()))

    def tally(self, column: Column, name: str = "value") -> DataFrame:
        return self.df.groupBy(column.alias(name)).agg(F.count("*").alias("n"))

    def _in_order(self, column: Column) -> DataFrame:
        """A row a document: ``_all``, its nodes' values of a column in order."""
        each = self.df.groupBy(*self.ids).agg(F.sort_array(F.collect_list(F.struct("ord", column.alias("_x")))).alias("_all"))
        return each.withColumn("_all", F.transform("_all", lambda s: s["_x"]))

    def reduce(self, column: Column, initial: Column, merge: Callable[[Column, Column], Column], name: str = "value") -> DataFrame:
        """Each document's nodes folded in order, as ``each_with_object`` does with an object that grows."""
        return self._in_order(column).withColumn(name, F.aggregate("_all", initial, merge)).drop("_all")

    each_with_object = reduce

    def each_slice(self, n: int, column: Column, name: str = "values") -> DataFrame:
        """Runs of ``n`` nodes of a document (the last may be shorter) as arrays, numbered by ``slice``."""
        if n < 1:
            raise ValueError("slices have at least one node")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / n)), lambda k: F.slice("_all", k * n + 1, F.lit(n)))
        return self._in_order(column).select(*self.ids, F.posexplode(runs).alias("slice", name))

    def zip(self, other: Nodes, left: Column, right: Column) -> DataFrame:
        """Nodes of two queries over the same documents side by side; the first decides how many."""
        mine = self._in_order(left).withColumnRenamed("_all", "_mine")
        theirs = other._in_order(right).withColumnRenamed("_all", "_theirs")
        both = mine.join(theirs, self.ids, "left")  # by document alone: lists of documents that lie by their key need not move again
        pairs = both.select(*self.ids, "_theirs", F.posexplode("_mine").alias("index", "left"))
        return pairs.select(*self.ids, "index", "left", F.get("_theirs", F.col("index")).alias("right"))

    def each(self, action: Callable) -> None:
        self.df.foreach(action)

    def __iter__(self):
        return self.df.orderBy(*self.ids, "ord").toLocalIterator()


def texts_of(path: Path, doc: Column) -> Column:
    """The values that an expressible query finds in a VARIANT, as JSON texts."""
    found = F.transform(native.nodelist(path, doc, doc), lambda v: F.to_json(v))
    return F.when(doc.isNull(), F.array().cast("array<string>")).otherwise(found)


def found_in(path: Path, doc: Column) -> Column:
    found = native.one(doc, path).isNotNull() if path.singular else F.size(native.nodelist(path, doc, doc)) > 0
    return doc.isNotNull() & found


def json_query(text: Column, query: str | Path) -> Column:
    """The values a query finds in a column of JSON text, as an array of JSON texts."""
    path = parse(query) if isinstance(query, str) else query

    def run(texts: pd.Series) -> pd.Series:
        found = (loads(t) for t in texts)
        return pd.Series([[text_of(n.value) for n in evaluate.find(path, root)] if good else [] for root, good in found], dtype=object)

    return F.pandas_udf(run, "array<string>")(text)


MOST_BYTES = 8_000_000  # of texts whose parsed form is kept
_LAST: list = []  # a batch of texts and its parsed form; the functions of a query get the same batch one after the other


def _parsed(docs: pa.Array) -> Iterable:
    """``loads`` of each text, once for all functions over a column; large batches are parsed as they are read."""
    if docs.nbytes > MOST_BYTES:
        return map(loads, docs.to_pylist())
    if not (_LAST and (_LAST[0] is docs or _LAST[0].equals(docs))):
        _LAST[:] = [docs, [loads(t) for t in docs.to_pylist()]]
    return _LAST[1]


def nodelists(docs: pa.Array, queries: pa.Array) -> Iterator[list]:
    """The nodelists; empty for what is no JSON or has no query."""
    for (root, good), q in zip(_parsed(docs), queries.to_pylist()):
        yield evaluate.find(parse(q), root) if good and q is not None else []


def number_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def string_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")
