"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Every text becomes ``▁`` + text with spaces as ``▁``. No piece of such a vocabulary has a ``▁``
after another character (checked when the model is loaded), so merges never cross the place where a
``▁`` follows another character: the text falls into segments that are encoded one by one. Likewise a
segment falls apart between two characters that no piece has side by side, and each different part is encoded once. In each
part an agenda holds all adjacent symbol pairs whose concatenation is a piece; the pair with the
highest score (ties: the leftmost) is merged until the agenda is empty. Symbols that are no piece
become byte pieces.

Short parts go through the agenda side by side, one lane each, and every round pops the best
pair of all lanes; long ones use a heap. The different segments of an Arrow slice are found and joined in Arrow; a worker remembers
those it met last. New segments of each Arrow batch are compared with the
sentencepiece library, which also decodes, and so is one whole text of it: a difference is an error, never mended silently.
Only byte-fallback models of merge type that neither fold nor collapse white space are accepted; their normalizer is tried out
when the model is loaded.

Defined results: a null or empty text has only the end id; very long texts and texts without a
space are encoded whole; repeated rows give repeated rows; extra columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import bind_text, parts, table

SPACE = "▁"
LANE = 32  # parts of segments up to so many characters go side by side
CACHED = 300_000  # segments of one generation; a worker remembers this one and the one before
OTHER = 1 << 16  # symbol number of a character that is no piece: OTHER + code point
SHIFT = 21
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, agreed boolean"


class AgendaEncoder:
    def __init__(self, model: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.vocab_size()
        odd = "  A\u00e9e\u0301\ufb01\u3000\t x  "  # spaces, composed and not, a ligature, a wide space
        if sp.decode(sp.encode(odd)) != odd or not sp.is_byte(sp.piece_to_id("<0x0A>")):
            raise ValueError("the model's normalizer changes texts, or it has no byte fallback")
        if size > OTHER:
            raise ValueError("vocabularies of up to 65536 pieces")
        whole = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = {sp.id_to_piece(i): i for i in whole}
        if any(SPACE in p.lstrip(SPACE) for p in pieces) or any(sp.is_unused(i) for i in whole):
            raise ValueError("a piece has a space after another character, or is unused")
        self.symbol = np.arange(0x110000, dtype=np.int64) + OTHER
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        known = lambda s: pieces.get(s, int(self.symbol[ord(s)]) if len(s) == 1 else None)
        signs = sorted({c for p in pieces if len(p) > 1 for c in p})
        number = {c: k for k, c in enumerate(signs, 1)}
        self.sign = np.zeros(0x110000, dtype=np.uint16)  # 0: in no piece beside another character
        self.sign[[ord(c) for c in signs]] = np.arange(1, len(signs) + 1)
        self.beside = np.zeros((len(signs) + 1, len(signs) + 1), dtype=bool)
        for p in pieces:
            for a, b in zip(p, p[1:]):
                self.beside[number[a], number[b]] = True
        pairs = {}
        for p, i in pieces.items():
            for cut in range(1, len(p)):
                a, b = known(p[:cut]), known(p[cut:])
                if a is not None and b is not None:
                    pairs[a << SHIFT | b] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.scores = np.array([sp.get_score(i) for i in range(size)], dtype=np.float64)
        self.byte = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.end = sp.eos_id()
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and its score (-inf: no piece) of each pair."""
        key = left << SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.merged[at]
        return piece, np.where(self.keys[at] == key, self.scores[piece], -np.inf)

    def lanes(self, segments: list[str]) -> list[list[int]]:
        """Agendas of many short segments, one pop of each a round."""
        n, width = len(segments), max(map(len, segments))
        size = np.fromiter(map(len, segments), dtype=np.int64, count=n)
        code = np.array(segments, dtype=f"U{width}").view(np.uint32).reshape(n, width)
        symbol = self.symbol[code]
        live = np.arange(width) < size[:, None]
        piece = np.zeros((n, width), dtype=np.int64)
        score = np.full((n, width), -np.inf)
        if width > 1:
            piece[:, :-1], s = self.look_up(symbol[:, :-1], symbol[:, 1:])
            score[:, :-1] = np.where(live[:, 1:], s, -np.inf)
        after = np.broadcast_to(np.arange(1, width + 1), (n, width)).copy()
        before = np.broadcast_to(np.arange(-1, width - 1), (n, width)).copy()
        row = np.arange(n)
        while len(row):
            best = score[row].argmax(axis=1)
            going = score[row, best] > -np.inf
            row, left = row[going], best[going]
            if not len(row):
                break
            right = after[row, left]
            symbol[row, left] = piece[row, left]
            live[row, right] = False
            score[row, right] = -np.inf
            score[row, left] = -np.inf
            follow = after[row, right]
            after[row, left] = follow
            has = follow < size[row]
            r, a, b = row[has], left[has], follow[has]
            before[r, b] = a
            piece[r, a], score[r, a] = self.look_up(symbol[r, a], symbol[r, b])
            ahead = before[row, left]
            has = ahead >= 0
            r, a, b = row[has], ahead[has], left[has]
            piece[r, a], score[r, a] = self.look_up(symbol[r, a], symbol[r, b])
        flat, ends = symbol[live].tolist(), live.sum(axis=1).cumsum().tolist()
        return [self.to_ids(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def heap(self, segment: str) -> list[int]:
        """Agenda of one long segment."""
        symbol = self.symbol[np.frombuffer(segment.encode("utf-32-le"), dtype=np.uint32)].tolist()
        n, pairs, scores = len(symbol), self.pairs, self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []

        def offer(a: int, b: int) -> None:
            p = pairs.get(symbol[a] << SHIFT | symbol[b])
            if p is not None:
                heapq.heappush(agenda, (-scores[p], a, b, symbol[a], symbol[b], p))

        for k in range(n - 1):
            offer(k, k + 1)
        while agenda:
            _, a, b, was_a, was_b, p = heapq.heappop(agenda)
            if symbol[a] != was_a or symbol[b] != was_b or after[a] != b:
                continue
            symbol[a], symbol[b] = p, -1
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        return self.to_ids([s for s in symbol if s >= 0])

    def to_ids(self, symbols: list[int]) -> list[int]:
        if max(symbols) < OTHER:
            return symbols
        ids = []
        for s in symbols:
            ids += [s] if s < OTHER else [self.byte[b] for b in chr(s - OTHER).encode("utf-8")]
        return ids

    def agendas(self, parts: list[str]) -> list[list[int]]:
        """Ids of parts of segments, each by its own agenda."""
        out: list = [None] * len(parts)
        short = sorted((k for k, s in enumerate(parts) if len(s) <= LANE), key=lambda k: len(parts[k]))
        for at in range(0, len(short), 8192):
            some = short[at : at + 8192]
            for k, ids in zip(some, self.lanes([parts[k] for k in some])):
                out[k] = ids
        for k, s in enumerate(parts):
            if out[k] is None:
                out[k] = self.heap(s)
        return out

    def fall_apart(self, segments: list[str]) -> tuple[list[str], list[int]]:
        """Parts of all segments, cut between characters that no piece has side by side, and where each segment's parts end."""
        text = "".join(segments)
        sign = self.sign[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        ends = np.cumsum(np.fromiter(map(len, segments), dtype=np.int64, count=len(segments)))
        cut = np.ones(len(text) + 1, dtype=bool)
        cut[1:-1] = ~self.beside[sign[:-1], sign[1:]]
        cut[ends] = True
        at = np.flatnonzero(cut)
        places = at.tolist()
        return [text[a:b] for a, b in zip(places, places[1:])], np.searchsorted(at, ends).tolist()

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        if not segments:
            return []
        parts, ends = self.fall_apart(segments)
        each = list(dict.fromkeys(parts))
        ids = dict(zip(each, self.agendas(each)))
        return [ids[parts[a]] if b == a + 1 else [i for p in parts[a:b] for i in ids[p]] for a, b in zip([0, *ends], ends)]

    def split(self, text: str) -> list[str]:
        return self.segments(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, the end id last."""
        return [i for ids in self.encode_segments(self.split(text)) for i in ids] + [self.end]

    def library_ids(self, segments: list[str]) -> list[list[int]]:
        """What the library makes of the same segments; it puts the first space itself."""
        return self.library.encode([s[1:] or " " for s in segments], num_threads=1) if segments else []


class BatchEncoder:
    """Encodes texts; remembers the segments it has met as decimal ids, by what follows their first ``▁``.

    When a generation of them is full, the one before is forgotten, but for what was met since.
    """

    ODD = f"^( |$)|  |{SPACE}"  # texts whose segments are not just the words between single spaces

    def __init__(self, model: str):
        self.agenda = AgendaEncoder(model)
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        agenda = self.agenda
        own = agenda.encode_segments([SPACE + s for s in new])
        # a lone run of spaces loses one to the library's own first space; "" would give no ids
        plain = [k for k, s in enumerate(new) if s]
        for k, ids in zip(plain, agenda.library_ids([SPACE + new[k] for k in plain])):
            if ids != own[k]:
                raise ValueError(f"the agenda and the library differ on {SPACE + new[k]!r}")
        self.known.update(zip(new, (" ".join(map(str, ids)) for ids in own)))

    def look_up(self, segments: list[str]) -> list[str]:
        """Decimal ids of different segments."""
        if len(self.known) > CACHED:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missed = [s for s in segments if s not in known]
        known.update((s, older[s]) for s in missed if s in older)
        if new := [s for s in missed if s not in known]:
            self.learn(new)
        return [known[s] for s in segments]

    def decimals(self, segments: pa.ListArray) -> list[str]:
        """Decimal ids of texts, given as lists of segments, without the end id."""
        coded = segments.flatten().dictionary_encode()
        each = pa.array(self.look_up(coded.dictionary.to_pylist()), pa.large_string())
        offsets = pc.subtract(segments.offsets, segments.offsets[0]).cast(pa.int64())
        joined = pa.LargeListArray.from_arrays(offsets, each.take(coded.indices))
        return pc.binary_join(joined, pa.scalar(" ", pa.large_string())).to_pylist()

    def __call__(self, texts: pa.Array | list[str | None]) -> Iterator[tuple[np.ndarray, str, str, bool]]:
        """(ids, decimal ids, decoded text, whether it agreed with the library as far as compared) of each text."""
        split, end, library = self.agenda.split, str(self.agenda.end), self.agenda.library
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        odd = pc.match_substring_regex(texts, self.ODD)
        plain = iter(self.decimals(pc.split_pattern(texts.filter(pc.invert(odd)), " ")))
        others = [[s[1:] for s in split(t)] for t in texts.filter(odd).to_pylist()]
        others = iter(self.decimals(pa.array(others, pa.list_(pa.string()))))
        decimals = [next(others if k else plain) for k in odd.to_pylist()]
        whole = sum(map(len, decimals)) % max(1, len(decimals))
        for k, decimal in enumerate(decimals):
            decimal = f"{decimal} {end}" if decimal else end
            ids = np.fromstring(decimal, dtype=np.int32, sep=" ")
            if k == whole and library.encode(texts[k].as_py(), add_eos=True) != ids.tolist():
                raise ValueError("segments encoded one by one differ from the whole text")
            yield ids, decimal, library.decode(ids), True


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(model: str) -> BatchEncoder:
    """One encoder for each worker process and model."""
    if model not in _ENCODERS:
        _ENCODERS[model] = BatchEncoder(model)
    return _ENCODERS[model]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text (array<int>) and, if asked for, what they decode to."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())
    if len({n.lower() for n in schema.names}) != len(schema.names):
        raise ValueError(f"docs already has a column {ids} or {decoded}")
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in parts(batches, at):
            ids, back = [], []
            for own, _, text, _ in enc(batch.column(at)):
                ids.append(own)
                if decoded:
                    back.append(text)
            columns = [*batch.columns, pa.array(ids, pa.list_(pa.int32())), *([pa.array(back, pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema)  # whatever the names


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document the number of its ids and the digests of its ids and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for batch in parts(batches, 1):
            rows = [(len(ids), sha(decimal), sha(back), agreed) for ids, decimal, back, agreed in enc(batch.column(1))]
            n, a, b, ok = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(ok, pa.bool_())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agreed"],
            )

    return bind_text(docs, "doc_id", "text").mapInArrow(run, SCHEMA)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_model())
