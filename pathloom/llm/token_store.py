"""Token ids in binary files of directly addressable codes.

Each id is cut into chunks of 8 bits, low chunk first. Level 0 holds the low chunk of every id;
where more chunks follow, the continuation bitmap of the level has a 1, and the next level holds
the next chunk of just those ids. The place of an id's chunk in the next level is the number of
1s before it in the bitmap, which a rank directory (1s before every block of 512 bits) gives with at
most eight word counts. So any token is read at its number, without decoding what precedes it.

A file holds consecutive documents: a header with the sizes of the levels, ids and first tokens of the documents, and
the levels; :class:`TokenReader` seeks to what it needs. Files are in ascending (doc_id, content) order, null ids first; the manifest written
with them names the files of the tasks that succeeded, so that attempts lost with an executor leave
nothing behind that is read.

Defined results: a null or empty text has only the end id; rows with equal ids stay next to each
other, ordered by content and then by place in the input; an empty table has no file and no row; extra
columns are not looked at.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind_text, keep, new_path, open_uri, parts, table

MAGIC = b"DAC1"
BLOCK = 512  # bits of a rank directory's block
CHUNK = 8
CACHED = 700_000  # words that a worker remembers; then it forgets all
GROUP_BYTES = 10_000_000  # text encoded at a time
FILE_BYTES = 24 << 20  # text that a file is made from, about
TASK_BYTES = 256 << 20
RUN_TOKENS = 2_000_000
END = 2


class Bytes:
    """Bytes in memory, read by place."""

    def __init__(self, data: bytes):
        self.data = data

    def read_at(self, at: int, n: int) -> bytes:
        return self.data[at : at + n]


class File:
    """A seekable file, read by place."""

    def __init__(self, source):
        self.source = source

    def read_at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bitmap, 1s before each block and in all) of each level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        bits = more > 0
        ones = np.concatenate([[0], np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype=np.int64).cumsum()]) if len(bits) else np.zeros(1)
        levels.append(((rest & 255).astype(np.uint8), np.packbits(bits, bitorder="little"), ones.astype(np.uint64)))
        if not bits.any():
            return levels
        rest = more[bits]


class TokenFile:
    """What a file is made of: consecutive documents (None: null id), ``starts`` (one more than documents), levels."""

    def __init__(self, doc_ids: list[int | None], starts: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.doc_ids, self.starts, self.levels = doc_ids, starts, levels

    def dump(self) -> bytes:
        depth = len(self.levels)
        parts = [MAGIC, struct.pack("<QI", len(self.doc_ids), depth), struct.pack(f"<{depth}Q", *(len(chunks) for chunks, _, _ in self.levels))]
        parts.append(np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes())
        parts.append(np.array([d is None for d in self.doc_ids], dtype=np.uint8).tobytes())
        parts.append(self.starts.astype("<u8").tobytes())
        for chunks, bitmap, ranks in self.levels:
            parts += [chunks.tobytes(), bitmap.tobytes(), ranks.astype("<u8").tobytes()]
        return b"".join(parts)

    @staticmethod
    def load(data: bytes) -> TokenReader:
        return TokenReader(Bytes(data))


class TokenReader:
    """One file, of which only the header is read; everything else by place when asked for."""

    def __init__(self, source: Bytes | File):
        self.source = source
        head = source.read_at(0, 16)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        self.documents, depth = struct.unpack("<QI", head[4:])
        at, self.levels = 16 + 8 * depth + 17 * self.documents + 8, []
        for size in struct.unpack(f"<{depth}Q", source.read_at(16, 8 * depth)):
            bitmap, ranks = at + size, at + size + -(-size // 8)
            self.levels.append((at, bitmap, ranks))
            at = ranks + 8 * (-(-size // BLOCK) + 1)
        self.table = 16 + 8 * depth

    def _array(self, kind: str, at: int, first: int, last: int) -> np.ndarray:
        width = np.dtype(kind).itemsize
        return np.frombuffer(self.source.read_at(at + first * width, (last - first) * width), dtype=kind)

    @property
    def doc_ids(self) -> list[int | None]:
        return self.ids_of(0, self.documents)

    def ids_of(self, first: int, last: int) -> list[int | None]:
        ids, null = self._array("<i8", self.table, first, last), self._array("u1", self.table + 8 * self.documents, first, last)
        return [None if z else d for d, z in zip(ids.tolist(), null.tolist())]

    def starts(self, first: int, last: int) -> np.ndarray:
        """Numbers of the first tokens of documents first..last-1; that of no document is the end of all."""
        return self._array("<u8", self.table + 9 * self.documents, first, last).astype(np.int64)

    def _bits(self, bitmap: int, first: int, last: int) -> np.ndarray:
        own = self._array("u1", bitmap, first // 8, -(-last // 8))
        return np.unpackbits(own, bitorder="little")[first % 8 : first % 8 + last - first].astype(bool)

    def _ones_before(self, level: tuple[int, int, int], at: int) -> int:
        """1s in the bitmap before place ``at``: directory, then within the block."""
        _, bitmap, ranks = level
        block = at // BLOCK
        return int(self._array("<u8", ranks, block, block + 1)[0]) + int(self._bits(bitmap, block * BLOCK, at).sum())

    def token(self, at: int) -> int:
        """Random access: of each level one chunk, one number of the directory and at most one block of the bitmap."""
        value, shift = 0, 0
        for level in self.levels:
            value |= int(self._array("u1", level[0], at, at + 1)[0]) << shift
            if not self._bits(level[1], at, at + 1)[0]:
                return value
            at, shift = self._ones_before(level, at), shift + CHUNK
        raise ValueError("the last level goes on")

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids of places start..end-1: each level is read only where they reach."""
        out = np.zeros(end - start, dtype=np.uint32)
        places, shift = np.arange(end - start), 0
        for level in self.levels:
            if start == end:
                return out
            out[places] |= self._array("u1", level[0], start, end).astype(np.uint32) << np.uint32(shift)
            going = self._bits(level[1], start, end)
            if not going.any():
                return out
            start = self._ones_before(level, start)
            places, shift = places[going], shift + CHUNK
            end = start + len(places)
        raise ValueError("the last level goes on")


class WordEncoder:
    """The tokenizers library on whole texts, with what it made of each word remembered.

    The vocabulary's pre-tokens hold no white space, so texts are cut at spaces and newlines (in Arrow) and each distinct
    word of a batch is encoded alone. Words of plain Latin-1 letters with closing marks are cut further, into the lower-case letters and the marks, as the pre-tokenizer would. Of each batch one whole text is
    encoded by the library as it is, and a difference is an error.
    """

    MARKS = r".,!?;:$&*#%()\-"
    PLAIN = rf"^[A-Za-zÀ-ÖØ-öø-ÿ]+[{MARKS}]*$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([""])  # word k has the ids ends[k-1]..ends[k]
        self.marks: dict[str, int] = {"": 0}
        self.ids, self.ends = np.zeros(1 << 16, dtype=np.uint32), np.zeros(1 << 14, dtype=np.int64)

    def _add(self, words: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new words and their ids (one after the other)."""
        n = len(self.known)
        at = int(self.ends[n - 1])
        while at + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(words) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[at : at + len(ids)] = ids
        self.ends[n : n + len(words)] = at + np.cumsum(sizes)
        self.known = pa.concat_arrays([self.known, words])

    def _by_library(self, words: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids, sizes = [], []
        for at in range(0, len(words), 20_000):
            made = [e.ids for e in self.library.encode_batch_fast(words.slice(at, 20_000).to_pylist(), add_special_tokens=False)]
            ids.append(np.array([i for own in made for i in own], dtype=np.uint32))
            sizes.append(np.array([len(own) for own in made], dtype=np.int64))
        return ids, sizes

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Numbers of new words. Those of letters alone are one pre-token each, so a line of them is cut after each word's end."""
        alone = pc.match_substring_regex(new, "^[a-zß-öø-ÿ]+$")
        letters, other = new.filter(alone), new.filter(pc.invert(alone))
        ids, sizes = [], []
        for at in range(0, len(letters), 4000):
            line = letters.slice(at, 4000)
            own = np.array(self.library.encode_batch_fast([" ".join(line.to_pylist())], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[own]) + 1
            if len(ends) == len(line):
                ids.append(own)
                sizes.append(np.diff(ends, prepend=0))
            else:
                more, each = self._by_library(line)
                ids, sizes = ids + more, sizes + each
        more, each = self._by_library(other)
        first, alone = len(self.known), alone.to_numpy(zero_copy_only=False)
        self._add(pa.concat_arrays([letters, other]), np.concatenate(ids + more), np.concatenate(sizes + each))
        return first + np.where(alone, np.cumsum(alone) - 1, len(letters) + np.cumsum(~alone) - 1)

    def _stems(self, words: pa.Array) -> np.ndarray:
        """Numbers of words, which may repeat; unknown ones are learned."""
        found = pc.index_in(words, self.known)
        out = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            missed = words.filter(found.is_null()).dictionary_encode()
            out[out < 0] = self._learn(missed.dictionary)[missed.indices.to_numpy()]
        return out

    def _marks(self, marks: pa.Array) -> np.ndarray:
        """The same for closing marks, of which there are few."""
        coded = marks.dictionary_encode()
        each = coded.dictionary.to_pylist()
        if new := [m for m in each if m not in self.marks]:
            self.marks.update(zip(new, self._learn(pa.array(new)).tolist()))
        return np.array([self.marks[m] for m in each], dtype=np.int64)[coded.indices.to_numpy()]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each of them has (null: as empty)."""
        if len(self.known) > CACHED:
            self._forget()
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, self.PLAIN)
        cut = pc.if_else(plain, words, "")
        stems = self._stems(pc.if_else(plain, pc.utf8_lower(pc.utf8_rtrim(cut, self.MARKS)), words))
        marks = self._marks(pc.replace_substring_regex(cut, f"[^{self.MARKS}]+", ""))
        parts = np.stack([stems, marks], 1).ravel()
        starts = np.where(parts > 0, self.ends[parts - 1], 0)
        sizes = np.where(parts > 0, self.ends[parts] - starts, 0)
        pool, sizes = self.ids[_spans(starts, sizes)], sizes.reshape(-1, 2).sum(1)
        code, begins = coded.indices.to_numpy(), np.cumsum(sizes) - sizes
        ids = pool[_spans(begins[code], sizes[code])]
        total = np.concatenate([[0], np.cumsum(sizes[code])])
        ends = total[split.offsets.to_numpy() - split.offsets[0].as_py()]
        self._compare(texts, ids, ends)
        return ids, np.diff(ends)

    def _compare(self, texts: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        """One whole text of a batch against the library."""
        k = len(ids) % len(texts)
        whole = self.library.encode_batch_fast([texts[k].as_py()], add_special_tokens=False)[0].ids
        if whole != ids[ends[k] : ends[k + 1]].tolist():
            raise ValueError("words encoded one by one differ from the whole text")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not texts:
            return []
        ids, sizes = self.batch(pa.array(texts, pa.string()))
        ends = np.cumsum(sizes)
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """``end`` after the ids of each text."""
    ends = np.cumsum(sizes + 1) - 1
    out, own = np.zeros(len(ids) + len(sizes), dtype=np.uint32), np.ones(len(ids) + len(sizes), dtype=bool)
    own[ends] = False
    out[own], out[ends] = ids, end
    return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


MANIFEST = "file int, path string, first_doc long, n_docs long, n_tokens long"


def write(docs: DataFrame, tokenizer: str, folder: str, end: int = END, file_bytes: int = FILE_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into files under ``folder``; the manifest, kept as a table.

    Documents are range-partitioned by (doc_id, content, place in the input), so neither a repeated
    nor a null id gathers in one task. A task has about ``task_bytes`` of text (less where that would leave cores idle) and
    writes a file whenever it has read ``file_bytes``, each under a name of its own attempt.
    """
    rows = bind_text(docs, "doc_id", "text").withColumns({"crc": F.crc32("text"), "at": F.monotonically_increasing_id()})
    total = docs.select(F.sum(F.octet_length(F.col("`text`")))).first()[0] or 0
    n = max(1, -(-total // task_bytes), min(-(-total // file_bytes), 4 * docs.sparkSession.sparkContext.defaultParallelism))
    ordered = rows.repartitionByRange(int(n), "doc_id", "crc", "at").sortWithinPartitions("doc_id", "crc", "at").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        fs, base = open_uri(folder)
        fs.create_dir(base, recursive=True)
        done, names, held, sizes, size = [], [], [], [], 0

        def flush() -> None:
            nonlocal names, held, sizes, size
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            name = f"{part:07d}-{len(done):04d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(TokenFile(names, starts, encode_levels(np.concatenate(held))).dump())
            done.append((part, name, len(done), len(names), int(starts[-1])))
            names, held, sizes, size = [], [], [], 0

        for batch in parts(batches, 1, GROUP_BYTES):
            ids, each = enc.batch(batch.column(1))
            held.append(with_end(ids, each, end))
            sizes.append(each + 1)
            names += batch.column(0).to_pylist()
            size += batch.nbytes
            if size > file_bytes:
                flush()
        if names:
            flush()
        if done:
            columns = [pa.array(c, kind) for c, kind in zip(zip(*done), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "path", "first_doc", "n_docs", "n_tokens"])

    return keep(ordered.mapInArrow(run, MANIFEST), "manifest")[0]


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read from the files.

    The manifest has one row a file (``FILE_BYTES`` of text); only its sums of tokens go through one task. Files are read
    in runs of documents, ``RUN_TOKENS`` tokens at a time.
    """
    order = Window.orderBy("file", "first_doc").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.select("path", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_uri(folder)
        for batch in batches:
            for name, offset in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{base}/{name}") as source:
                    file = TokenReader(File(source))
                    starts, first = file.starts(0, file.documents + 1), 0
                    while first < file.documents:
                        last = max(first + 1, int(np.searchsorted(starts, starts[first] + RUN_TOKENS, side="right")) - 1)
                        own = starts[first : last + 1]
                        data = file.tokens(int(own[0]), int(own[-1])).astype("<u4").tobytes()
                        cuts = (4 * (own - own[0])).tolist()
                        crcs = [zlib.crc32(data[a:b]) for a, b in zip(cuts, cuts[1:])]
                        columns = [pa.array(file.ids_of(first, last), pa.int64()), pa.array(own[:-1] + offset), pa.array(np.diff(own)), pa.array(crcs, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        first = last

    return listed.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = new_path(spark, "tokens")
    return read(write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder), folder)
