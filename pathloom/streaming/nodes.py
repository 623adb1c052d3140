"""Queries over streams of documents.

Per-document work is stateless, so :class:`JsonFrame` runs on a streaming DataFrame as it is: native queries as
lateral generators, others (descendant segments too) in Arrow batches. Windows over nodes are Spark's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frame import JsonFrame


def stream_nodes(df: DataFrame, query: str, doc: str = "doc") -> DataFrame:
    if not df.isStreaming:
        raise ValueError("not a stream")
    return JsonFrame(df, doc).nodes(query)


def windowed(df: DataFrame, query: str, time: str, late: str, width: str, *aggregates: Column, doc: str = "doc", slide: str | None = None) -> DataFrame:
    """Aggregates over the nodes of each time window; documents later than ``late`` are dropped."""
    nodes = stream_nodes(df.withWatermark(time, late), query, doc)
    return nodes.groupBy(F.window(time, width, slide)).agg(*aggregates)
