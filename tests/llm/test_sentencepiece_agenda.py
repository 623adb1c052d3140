import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.llm import sentencepiece_agenda as S

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = S.BatchEncoder(MODEL)


@given(st.text(max_size=60) | st.text(alphabet=" ▁abst\n\té中́\x00<s>/x0A\u3000", max_size=80))
@settings(max_examples=400, deadline=None)
def test_agenda_is_the_library(text):
    expected = LIBRARY.encode(text, add_eos=True)
    assert OWN.agenda.encode(text) == expected
    ids, _, back, agreed = next(OWN([text]))
    assert list(ids) == expected and agreed and back == LIBRARY.decode(expected)


def test_heap_and_lanes_agree():
    rng = random.Random(3)
    for _ in range(200):
        segment = "▁" + "".join(rng.choice("abcdefthening ".replace(" ", "")) for _ in range(rng.randint(1, 31)))
        assert OWN.agenda.heap(segment) == OWN.agenda.lanes([segment])[0]


def brute(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op1_sentencepiece(spark, sf).collect()
    assert len(rows) == len(texts) and all(r.agreed for r in rows)
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == brute(texts[r.doc_id]) for r in rows)


def test_odd_rows(odd_docs, no_docs):
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    rows = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in S.digests(odd_docs, MODEL).collect()), key=key)
    assert rows == sorted(((r.doc_id, *brute(r.text)) for r in odd_docs.collect()), key=key)
    assert S.digests(no_docs, MODEL).collect() == []


def test_encode_keeps_the_columns(odd_docs):
    plain = odd_docs.drop("ids")
    out = S.encode(plain, MODEL, decoded="back")
    assert out.columns == [*plain.columns, "ids", "back"]
    for r in out.where("doc_id < 5 or doc_id > 7").collect():
        assert r.ids == LIBRARY.encode(r.text or "", add_eos=True)
    with pytest.raises(ValueError):
        S.encode(odd_docs, MODEL)


def test_segments_met_again_are_not_learned_again(monkeypatch):
    """A generation is forgotten only if nothing of it was met since; before, whatever a slice lacked was learned anew."""
    monkeypatch.setattr(S, "CACHED", 40)
    own, learned = S.BatchEncoder(MODEL), []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda new: (learned.extend(new), learn(new)))
    for k in range(12):
        texts = [f"rare{k}x{j}" for j in range(30)] + ["often"] * (k % 2)
        assert [list(r[0]) for r in own(texts)] == [LIBRARY.encode(t, add_eos=True) for t in texts]
    assert learned.count("often") == 1 and len(own.known) + len(own.older) <= 150


def test_odd_spaces_beside_plain_texts():
    texts = ["a b", "", " ", "  ", " a", "a ", "a  b", "▁", "a▁b", "▁ a", "a ▁", "a\nb c\n", "\n", None, "one two", "  x  y  ", "x" * 5000 + " y" * 3000, "　 a▁"]
    for some in (texts, texts[:1], texts[1:3], []):
        rows = list(OWN(some))
        assert [list(ids) for ids, *_ in rows] == [LIBRARY.encode(t or "", add_eos=True) for t in some]
        assert all(decimal == " ".join(map(str, ids)) and back == LIBRARY.decode(ids.tolist()) for ids, decimal, back, _ in rows)


def test_parts_of_a_segment_are_encoded_once(monkeypatch):
    asked, agendas = [], OWN.agenda.agendas
    monkeypatch.setattr(OWN.agenda, "agendas", lambda parts: (asked.extend(parts), agendas(parts))[1])
    segments = [f"▁end.\nBeginning{mark}\nNext" for mark in ".,;"]
    assert OWN.agenda.encode_segments(segments) == OWN.agenda.library_ids(segments)
    assert asked.count("\n") == 1 and asked.count("Next") == 1
