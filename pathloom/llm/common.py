"""What the corpus operators share: table access, a folder all executors reach, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}
LOCAL = ("local", "local[")  # masters whose tasks share this machine's folders


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and authority, as Spark's own tables there are addressed (a bare one lies in the default filesystem)."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return full if full.startswith("file://") or not full.startswith("file:") else "file://" + full[len("file:") :]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where that is unset and all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named.rstrip("/"))
    if not spark.sparkContext.master.startswith(LOCAL) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDERS:
        _OWN_FOLDERS[app] = "file://" + tempfile.mkdtemp(prefix="pathloom-")
    return _OWN_FOLDERS[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write ``df`` as a table in the shared folder and read it again."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables made by :func:`keep` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bind_text(docs: DataFrame, *columns: str) -> DataFrame:
    """Project ``columns`` (quoted, so that odd or clashing extra columns never matter)."""
    return docs.select(*(F.col(f"`{c}`") for c in columns))


def open_uri(uri: str):
    """(filesystem, path) of a qualified uri, for tasks that write or read files of their own format.

    A path without a scheme is refused: it would mean the machine's own disk here and Spark's default filesystem there.
    """
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"no scheme: {uri}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def parts(batches: Iterator[pa.RecordBatch], text: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``most`` bytes in the column number ``text`` (a longer text is alone in one).

    What a worker no longer uses goes back to the system at the end, as it may live on beside others.
    """
    import ctypes

    import pyarrow.compute as pc

    for batch in batches:
        start = size = 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
            if k > start and size + n > most:
                yield batch.slice(start, k - start)
                start, size = k, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def once(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """``docs`` with a column whose expression is evaluated once a row: what filters or reads it later is not merged into it.

    A generator of one row lies above it: the optimizer moves no predicate below that and copies nothing out of it.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*kept, value.alias("_once")).select(*kept, F.explode(F.array("_once")).alias(name))


def join_few(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", most: int = 200_000) -> DataFrame:
    """``many`` joined with a stored table, by broadcast if that is counted to have at most ``most`` rows (of a few hundred bytes), else by shuffle."""
    return many.join(F.broadcast(few) if few.count() <= most else few, keys, how)


def join_hot(many: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", parts: int = 1000, counts: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``few``, which has a row or none for each key, where keys of ``many`` may be hot.

    Keys with over 1/``parts`` of the rows, of which there are fewer than ``parts``, are joined by broadcast; the rest shuffles, no
    key of which has more rows than that. ``many`` and ``few`` should be stored tables, as they are read twice; ``counts``
    (keys, ``_n``) may give the rows of the keys that can be hot.
    """
    if counts is None:
        counts = many.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    hot, _ = keep(counts.where(F.col("_n") > F.lit(max(total / parts, 1000))).select(*keys), "hot")  # a thousand rows are no burden
    if not hot.take(1):
        return many.join(few, keys, how)
    rest = many.join(F.broadcast(hot), keys, "left_anti").join(few, keys, how)
    few_hot = few.join(F.broadcast(hot), keys, "left_semi")
    return many.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few_hot), keys, how).unionByName(rest)
