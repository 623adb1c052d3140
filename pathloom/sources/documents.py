"""JSON documents from files and into files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.frame import JsonFrame

CLIP = 257  # characters of a message about invalid JSON


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """One document a file: ``file, doc``."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One document a line (JSON Lines); blank lines are none."""
    lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))
    return lines.where(F.trim("doc") != "")


def from_texts(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "file long, doc string")


def check(df: DataFrame, doc: str = "doc", out: str = "invalid") -> DataFrame:
    """``df`` with a clipped message where ``doc`` is no JSON (null: valid)."""
    text = F.col(f"`{doc}`")
    message = F.concat(F.lit("Invalid JSON: "), text).substr(1, CLIP)
    return df.withColumn(out, F.when(text.isNotNull() & F.try_parse_json(text).isNull(), message))


def write_lines(frame: JsonFrame, path: str, pretty: bool = False) -> None:
    """Documents as text; pretty ones span lines."""
    frame.to_json(pretty).select(F.col(f"`{frame.doc}`").alias("value")).write.text(path)


def write_table(frame: JsonFrame, path: str) -> None:
    """Documents as VARIANT in Parquet, for queries that read only the members they need."""
    frame.variants().write.parquet(path)
