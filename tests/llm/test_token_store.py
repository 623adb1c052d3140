import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathloom.llm import token_store as D
from pathloom.llm.common import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OWN = D.WordEncoder(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [D.END]


@given(st.text(max_size=60) | st.text(alphabet="aBst're., \n\téÀß×İΣς\u0301<|endoftext|>", max_size=80))
@settings(max_examples=400, deadline=None)
def test_words_are_the_library(text):
    assert np.frombuffer(OWN([text])[0], "<u4").tolist() == ids_of(text)[:-1]


@given(st.lists(st.sampled_from([0, 1, 255, 256, 49407, 65536, 2**24, 2**32 - 1]), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_any_token_is_addressable(values):
    ids = np.array(values, dtype=np.uint32)
    file = D.TokenFile.load(D.TokenFile([None], np.array([0, len(ids)]), D.encode_levels(ids)).dump())
    assert [file.token(k) for k in range(0, len(ids), 7)] == values[::7]
    for a in range(0, len(ids), 97):
        assert file.tokens(a, len(ids)).tolist() == values[a:]
    assert file.doc_ids == [None]


def check(rows, docs):
    by = sorted(docs, key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [r.doc_id for r in by]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows]).tolist()][:-1]
    made = lambda t: (len(ids_of(t)), zlib.crc32(np.array(ids_of(t), dtype="<u4")))
    pairs = lambda x: sorted((str(i), n, c) for i, n, c in x)
    assert pairs((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == pairs((r.doc_id, *made(r.text)) for r in docs)


def test_query(spark, sf):
    check(D.op8_token_store(spark, sf).collect(), spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_odd_rows_and_many_files(spark, odd_docs, no_docs):
    folder = new_path(spark, "tokens")
    manifest = D.write(odd_docs, PATH, folder, file_bytes=100_000)
    assert manifest.count() > 2
    check(D.read(manifest, folder).collect(), odd_docs.collect())
    assert D.read(D.write(no_docs, PATH, folder), folder).collect() == []


@given(st.text(alphabet="aBé.,!?;:$&*#%()-'<|>Σ́ \n", max_size=60))
@settings(max_examples=400, deadline=None)
def test_closing_marks_are_the_library(text):
    assert np.frombuffer(OWN([text])[0], "<u4").tolist() == ids_of(text)[:-1]


def test_a_difference_from_the_whole_text_is_an_error():
    import pyarrow as pa
    import pytest

    own = D.WordEncoder(PATH)
    own.batch(pa.array(["one two"]))
    own.ids[0] += 1
    with pytest.raises(ValueError):
        own.batch(pa.array(["one two"]))


def test_reader_seeks():
    """One token reads the header, one chunk a level, one number of the directory and at most a block of bits."""
    read = []

    class Counting(D.Bytes):
        def read_at(self, at, n):
            read.append(n)
            return super().read_at(at, n)

    ids = np.random.default_rng(1).integers(0, 50_000, 200_000).astype(np.uint32)
    data = D.TokenFile([7, None], np.array([0, 5, len(ids)]), D.encode_levels(ids)).dump()
    file = D.TokenReader(Counting(data))
    for k in (0, 511, 512, 199_999):
        read.clear()
        assert file.token(k) == ids[k] and sum(read) < 200
    assert file.ids_of(1, 2) == [None] and file.starts(1, 3).tolist() == [5, len(ids)]
    assert file.tokens(5, 5).tolist() == [] and file.tokens(510, 1030).tolist() == ids[510:1030].tolist()


def test_runs_of_documents(spark, monkeypatch):
    monkeypatch.setattr(D, "RUN_TOKENS", 3)
    docs = spark.createDataFrame([(k, "a b " * (k % 5)) for k in range(40)], "doc_id long, text string")
    folder = new_path(spark, "tokens")
    check(D.read(D.write(docs, PATH, folder), folder).collect(), docs.collect())
