"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into buckets of a size that fits in memory: the bucket is a
seeded hash of the record's address (file and row), never of its content, so repeated rows and ids
spread like any others. Pass two brings each bucket into one task, orders it by the same hash,
shuffles it with a seeded Fisher-Yates and writes it. The buckets one after the other are a random
permutation of all records, cut into shards whose row counts are at most one apart (the law
``rows``); a record's place in its shard is its ``slot``.

A lost task reads the same records of a stored table again and draws the same numbers, so the files are
the same. What isn't a plain scan is first written as a table in the shared folder.

Defined results: a null text counts no bytes (one for the record) and has the crc of no bytes;
repeated rows and ties get slots of their own; with fewer records than shards the last shards are
empty; an empty table gives no rows; whatever the columns are called, they are kept as ``record``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, new_path, table

BUCKET_BYTES = 24 << 20
SEED = 20_240


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    order = list(range(n))
    draws = rng.integers(0, np.arange(n, 0, -1)).tolist() if n else []
    for k, d in enumerate(draws):
        order[k], order[k + d] = order[k + d], order[k]
    return np.array(order, dtype=np.int64)


def addressed(docs: DataFrame) -> DataFrame:
    """``record`` (all columns) and its address; stored first, unless it is a scan of files."""
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record")
    try:
        return docs.select(record, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return addressed(keep(docs.select(record), "records")[0]).select("record.record", "file", "row")


def shuffle(docs: DataFrame, folder: str, shards: int = 8, seed: int = SEED, text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``docs`` under ``folder`` in one directory a shard; the files as ``record, slot, shard``.

    The driver keeps one count a bucket (of ``bucket_bytes`` each): 8 bytes for every 24 MB of text.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = addressed(docs).withColumn("h", F.xxhash64(F.lit(seed), "file", "row"))
    total = rows.agg(F.sum(F.coalesce(F.octet_length(F.col("record").getField(text)), F.lit(0)) + 1)).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(n)).cast("int"))
    sizes = dict(rows.groupBy("bucket").count().collect())
    offsets = np.concatenate([[0], np.cumsum([sizes.get(b, 0) for b in range(n)])]).tolist()
    each, more = divmod(offsets[-1], shards)
    starts = np.array([s * each + min(s, more) for s in range(shards)])
    schema = T.StructType([*rows.select("record").schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        bucket = pa.Table.from_batches(held)
        for b in set(bucket.column("bucket").to_pylist()):  # one, as partitions are buckets
            own = bucket.filter(pa.compute.equal(bucket.column("bucket"), b))
            order = fisher_yates(len(own), np.random.default_rng([seed, b]))
            for at in range(0, len(own), 2000):
                part = own.take(pa.array(order[at : at + 2000]))
                place = offsets[b] + at + np.arange(len(part))
                # of empty shards, which begin where the next one does, the last is taken: it holds the row
                shard = np.searchsorted(starts, place, side="right") - 1
                columns = [part.column("record").combine_chunks(), pa.array(place - starts[shard]), pa.array(shard.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["record", "slot", "shard"])

    buckets = rows.repartitionById(int(n), F.col("bucket")).sortWithinPartitions("bucket", "h", "file", "row").select("record", "bucket")
    buckets.mapInArrow(run, schema).write.partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(schema).parquet(folder)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shuffle(table(spark, sf_dir, "documents"), new_path(spark, "shards"))
    text = F.coalesce("record.text", F.lit(""))
    return written.select(
        "record.doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
