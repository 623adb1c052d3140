"""Paths in SQL: ``json_query``, ``json_exists``, ``json_value`` and the table function ``json_nodes``."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import NOTHING, find
from ..operators.frame import nodelists, text_of
from ..plans.parser import parse
from ..shipping import ship


@F.arrow_udf("array<string>")
def json_query(docs: pa.Array, queries: pa.Array) -> pa.Array:
    """All values, as JSON texts."""
    return pa.array([[text_of(n.value) for n in nodes] for nodes in nodelists(docs, queries)], pa.list_(pa.string()))


@F.arrow_udf("boolean")
def json_exists(docs: pa.Array, queries: pa.Array) -> pa.Array:
    return pa.array([bool(nodes) for nodes in nodelists(docs, queries)], pa.bool_())


@F.arrow_udf("string")
def json_value(docs: pa.Array, queries: pa.Array) -> pa.Array:
    """The single node's value: a string as it is, others as JSON text; NULL unless there is just one."""
    only = (nodes[0].value if len(nodes) == 1 else NOTHING for nodes in nodelists(docs, queries))
    return pa.array([v if isinstance(v, str) else None if v is NOTHING else text_of(v) for v in only], pa.string())


@F.udtf(returnType="ord int, path string, key string, pos int, value string")
class JsonNodes:
    """One row a node; usable with LATERAL."""

    def eval(self, doc: str, query: str):
        try:
            root = json.loads(doc) if doc is not None else None
        except ValueError:
            return
        if doc is None or query is None:
            return
        for place, n in enumerate(find(parse(query), root)):
            yield place, n.path, n.key if isinstance(n.key, str) else None, n.key if isinstance(n.key, int) else None, text_of(n.value)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.udf.register("json_query", json_query)
    spark.udf.register("json_exists", json_exists)
    spark.udf.register("json_value", json_value)
    spark.udtf.register("json_nodes", JsonNodes)
