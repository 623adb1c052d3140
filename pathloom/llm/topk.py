"""Exact top-k search by inner product: exhaustive term-at-a-time accumulation.

Vectors become integers, floor(1024 * x), and their dimensions terms. A block of candidates is an
inverted index: for each term the candidates that have it and their weights. A query row goes through
its terms one by one and scatters weight times weight into a dense array of scores; the k best of the
block are found by partition, and the blocks' winners are merged by query. Candidates are cut into
blocks of bounded size, and so are the queries, so that neither side is broadcast or gathered whole.

Defined results: vectors that are null, or hold null or non-finite components, and rows without an
id take no part; an empty vector scores 0; of two lengths the longer one's rest counts as 0; rows that
repeat an id are rows of their own (only the query's own row is left out, and each repeated query
row is answered); ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, table

CANDIDATES = 50_000
QUERIES = 4_000
PART = "query_at long, query_id long, vec_id long, score long"


def dense(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = lists.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def width_of(*tables: pa.Table) -> int:
    return max((pa.compute.max(pa.compute.list_value_length(t.column("terms"))).as_py() or 0) for t in tables if len(t))


class Postings:
    """Of each term the places that have it and their weights, in the order of (id, place)."""

    def __init__(self, weights: np.ndarray):
        self.size, self.terms = len(weights), []
        for column in weights.T:
            places = np.flatnonzero(column)
            whole = len(places) == len(column)
            self.terms.append((slice(None) if whole else places, np.ascontiguousarray(column if whole else column[places])))

    def scores(self, query: np.ndarray) -> np.ndarray:
        total = np.zeros(self.size, dtype=np.int64)
        for term in np.flatnonzero(query):
            places, weights = self.terms[term]
            total[places] += weights * query[term]
        return total


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller place, best first."""
    places = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        places = np.concatenate([above, ties[: k - len(above)]])
    return places[np.argsort(-scores[places], kind="stable")][:k]


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vectors`` where ``is_query(id)`` holds."""
    x = F.col(f"`{vector}`")
    fits = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    rows, _ = keep(
        vectors.where(F.col(f"`{key}`").isNotNull() & x.isNotNull() & fits).select(
            F.col(f"`{key}`").cast("long").alias("id"),
            F.transform(x, lambda v: F.floor(F.lit(1024.0) * v.cast("double"))).alias("terms"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "vectors",
    )
    asked = rows.where(is_query(F.col("id")))
    blocks, lots = max(1, -(-rows.count() // candidates)), max(1, -(-asked.count() // queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda n: F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")
    left = asked.withColumns({"lot": one(lots), "block": every(blocks)})
    right = rows.withColumns({"block": one(blocks), "lot": every(lots)})

    def search(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(ask) and len(have):
            have = have.sort_by([("id", "ascending"), ("at", "ascending")])
            ids, ats = have.column("id").to_numpy(), have.column("at").to_numpy()
            width = width_of(ask, have)
            postings = Postings(dense(have.column("terms"), width))
            for query, at, weights in zip(ask.column("id").to_pylist(), ask.column("at").to_pylist(), dense(ask.column("terms"), width)):
                scores = postings.scores(weights)
                near = best(scores, k + 1)
                near = near[ats[near] != at][:k]
                out.append((np.full(len(near), at), np.full(len(near), query), ids[near], scores[near]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_at", "query_id", "vec_id", "score"])

    found = left.groupBy("lot", "block").cogroup(right.groupBy("lot", "block")).applyInArrow(search, PART)
    order = Window.partitionBy("query_at").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
