"""WARC files and a Merkle audit of their replicas.

Pages become WARC/1.1 records, each a gzip member of its own, in one file a task; next to each file lies
an index of record offsets. For the audit every file of a replica becomes a tree: leaves are hashes of
single records and their ranges of offsets (bytes beyond the index are one more leaf), inner nodes hash the ordered hashes of ``FAN``
children. Roots of the replicas are compared, and from level to level only the children of nodes that differ are
read and joined, until the differing leaves name the damaged records and their offsets. Files of which the trees differ in
height are compared leaf by leaf.

Defined results: a null html is a record without payload, a null url has an empty target; repeated rows are
records of their own; a file that a replica lacks, whose index can't be read, or that is too short, differs in the records it lacks; a
record or file that only the other replica has is a row without page and digest, not intact; an empty table makes no file and audits to an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, keep, new_path, open_uri, table

FAN = 16
FILE_BYTES = 256 << 20
INDEX = "file string, record long, offset long, length long, page_id long, payload_sha256 string"
NODES = "file string, level int, node long, first long, last long, hash binary"


def record_bytes(page_id: int | None, url: str | None, html: bytes, digest: str) -> bytes:
    name = hashlib.sha256(f"{page_id}\x1f{url}\x1f{digest}".encode()).hexdigest()
    target = "".join(c for c in (url or "") if c not in "\r\n")
    head = (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uuid.UUID(name[:32])}>\r\nWARC-Target-URI: {target}\r\n"
        f"WARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Block-Digest: sha256:{digest}\r\nContent-Type: text/html\r\nContent-Length: {len(html)}\r\n\r\n"
    )
    return head.encode() + html + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a date, so that equal records give equal bytes."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` as WARC files; the index of their records, kept as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_uri(folder)
        fs.create_dir(base, recursive=True)
        name, out, entries, at = None, None, [], 0

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{base}/{name}.idx") as index:
                index.write(json.dumps([e[:2] for e in entries]).encode())

        def rows() -> pa.RecordBatch:
            offset, length, page, digest = zip(*entries)
            columns = [[name] * len(entries), range(len(entries)), offset, length, page, digest]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["file", "record", "offset", "length", "page_id", "payload_sha256"])

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(k) for k in range(3))):
                if out is None:
                    name, entries, at = f"{uuid.uuid4().hex}.warc.gz", [], 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                body = (html.as_py() or "").encode()
                digest = hashlib.sha256(body).hexdigest()
                data = member(record_bytes(page_id.as_py(), url.as_py(), body, digest))
                out.write(data)
                entries.append((at, len(data), page_id.as_py(), digest))
                at += len(data)
                if at >= file_bytes:
                    close()
                    yield rows()
                    out = None
        if out is not None:
            close()
            yield rows()

    asked = pages.select(F.col("`page_id`").cast("long"), F.col("`url`"), F.col("`html`"))
    return keep(asked.mapInArrow(run, INDEX), "index")[0]


def read_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a whole file."""
    at = 0
    while at < len(data):
        unpacker, made = zlib.decompressobj(31), []
        while not unpacker.eof and at < len(data):
            piece = data[at : at + (1 << 16)]
            made.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        head, _, rest = b"".join(made).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def replicate(index: DataFrame, source: str, target: str, alter: Callable[[int | None, bytes], bytes] | None = None) -> None:
    """Copy the files of ``index``; ``alter(page_id, record)`` stands for what a bad disk does to one of them."""
    files = index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "page_id"))).alias("r")) if alter else index.select("file").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, a), (_, b) = open_uri(source), open_uri(target)
        fs.create_dir(b, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_stream(f"{a}/{row['file']}", compression=None) as old, fs.open_output_stream(f"{b}/{row['file']}", compression=None) as new:
                    if alter is None:
                        while part := old.read(1 << 22):
                            new.write(part)
                    else:
                        for r in row["r"]:
                            new.write(alter(r["page_id"], old.read(r["length"])))
                with fs.open_input_stream(f"{a}/{row['file']}.idx") as old, fs.open_output_stream(f"{b}/{row['file']}.idx") as new:
                    new.write(old.read())
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["file"])

    files.mapInArrow(run, "file string").write.format("noop").mode("overwrite").save()


def tree(leaves: list[bytes], fan: int = FAN) -> list[list[bytes]]:
    """Levels of a tree, leaves (0) first; hashes of leaves and inner nodes begin differently."""
    levels = [[hashlib.sha256(b"\0" + x).digest() for x in leaves]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hashlib.sha256(b"\1" + b"".join(below[k : k + fan])).digest() for k in range(0, len(below), fan)])
    return levels


def nodes(files: DataFrame, folder: str, fan: int = FAN) -> DataFrame:
    """Tree nodes of each file of a replica, kept as a table by level: place, range of offsets and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                try:
                    with fs.open_input_stream(f"{base}/{name}.idx") as source:
                        ranges = [(int(a), int(n)) for a, n in json.loads(source.read())]
                    leaves = []
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as source:
                        for offset, length in ranges:
                            leaves.append(hashlib.sha256(source.read(length)).digest() + struct.pack(">QQ", offset, length))
                        more, size = hashlib.sha256(), 0
                        while part := source.read(1 << 22):
                            more.update(part)
                            size += len(part)
                    if size:
                        ranges.append((sum(ranges[-1]) if ranges else 0, size))
                        leaves.append(more.digest() + struct.pack(">QQ", *ranges[-1]))
                except (FileNotFoundError, ValueError, TypeError, struct.error):  # no such file, or an index that says nothing
                    continue
                for level, row in enumerate(tree(leaves, fan) if leaves else []):
                    wide = fan**level
                    first = [ranges[k * wide][0] for k in range(len(row))]
                    last = [sum(ranges[min((k + 1) * wide, len(ranges)) - 1]) for k in range(len(row))]
                    columns = [pa.array([name] * len(row)), pa.array([level] * len(row), pa.int32()), pa.array(range(len(row)), pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(row, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "level", "node", "first", "last", "hash"])

    path = new_path(files.sparkSession, "nodes")
    made = files.mapInArrow(run, NODES)
    made.write.partitionBy("level").parquet(path)
    return files.sparkSession.read.schema(made.schema).parquet(path).select(*made.columns)


def differing(mine: DataFrame, theirs: DataFrame, fan: int = FAN) -> DataFrame:
    """``file, record, first, last`` of the leaves that differ or that only one has: from the roots down, along differing nodes only."""
    spark = mine.sparkSession
    height = lambda d, name: d.groupBy("file").agg(F.max("level").alias(name))
    both, path = keep(height(mine, "a").join(height(theirs, "b"), "file", "full"), "heights")
    uneven, top = both.where("NOT a <=> b").select("file"), both.agg(F.max(F.greatest("a", "b"))).first()[0]
    above, old = None, [path]
    for level in range(-1 if top is None else top, -1, -1):
        roots = both.where((F.col("a") == level) & F.col("a").eqNullSafe(F.col("b"))).select("file")
        starts = roots.union(uneven) if level == 0 else roots

        def here(nodes: DataFrame, level=level, starts=starts, above=above) -> DataFrame:
            own = nodes.where(F.col("level") == level).withColumn("above", F.floor(F.col("node") / fan))
            out = own.join(starts, "file", "left_semi")
            return out if above is None else out.unionByName(own.join(above, ["file", "above"], "left_semi"))

        other = here(theirs).select("file", "node", *(F.col(c).alias(f"{c}2") for c in ("first", "last", "hash")))
        found = here(mine).join(other, ["file", "node"], "full").where("NOT hash <=> hash2")
        found, path = keep(found.select("file", "node", F.coalesce("first", "first2").alias("first"), F.coalesce("last", "last2").alias("last")), "differing")
        above = found.select("file", F.col("node").alias("above"))
        old.append(path)
    discard(spark, *old[:-1])
    if top is None:
        return mine.select("file", F.col("node").alias("record"), "first", "last").limit(0)
    return found.select("file", F.col("node").alias("record"), "first", "last")


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """The WARC files of a folder, of which no byte is read."""
    try:
        there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], "file string")
    return there.select(F.substring_index("path", "/", -1).alias("file"))


def audit(index: DataFrame, a: str, b: str) -> DataFrame:
    """Each record of ``index`` with ``intact``: whether replica ``b`` holds it as ``a`` does; and what only ``b`` holds, not intact."""
    spark = index.sparkSession
    files, _ = keep(index.select("file").union(_names(spark, a)).union(_names(spark, b)).distinct(), "files")
    files = files.repartition(max(1, files.count()), "file")  # one file or a few a task
    bad = differing(nodes(files, a), nodes(files, b)).select("file", "record", F.lit(True).alias("bad"))
    return index.join(bad, ["file", "record"], "full").withColumn("intact", F.col("bad").isNull()).drop("bad")


def flip(page_id: int | None, record: bytes) -> bytes:
    """The damage of the query's drill: one bit of the records of every 97th page."""
    if page_id is None or page_id % 97 != 13:
        return record
    at = len(record) // 2
    return record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :]


def op9_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drill over all pages: write, replicate with known damage, and find it."""
    a, b = new_path(spark, "warc-a"), new_path(spark, "warc-b")
    index = write(table(spark, sf_dir, "pages"), a)
    replicate(index, a, b, flip)
    return audit(index, a, b).select("page_id", "payload_sha256", "intact")


ORACLE = """
SELECT page_id, sha256(coalesce(html, '')) AS payload_sha256, coalesce(page_id % 97 <> 13, true) AS intact FROM pages
"""
