import random

import pytest

from pathloom.llm import simhash


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_near_copies(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, family = [], []
    for f in range(40):
        base = [word() for _ in range(220)]
        rows.append(" ".join(base))
        family.append(f)
        for _ in range(f % 4):
            copy = list(base)
            for at in rng.sample(range(220), 3):
                copy[at] = word()
            rows.append(" ".join(copy))
            family.append(f)
    rows += ["", None, " "]
    family += [99, 99, 99]
    docs = spark.createDataFrame([(len(rows) - k, t, None, None, None) for k, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.one_of_each(docs).collect()
    ids = {len(rows) - k: f for k, f in enumerate(family)}
    assert sorted(ids[r.doc_id] for r in kept) == sorted(set(family))
    least = {f: min(i for i, g in ids.items() if g == f) for f in set(family)}
    assert {r.doc_id for r in kept} == set(least.values())


def remaining(texts, similarity=0.8):
    """Smallest places of the groups of exact similarity, by brute force."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if not a | b or len(a & b) >= similarity * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {k for k in range(len(texts)) if find(k) == k}


def kept_places(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id for r in simhash.one_of_each(docs).collect()}


def test_similarity_decides_exactly(spark):
    words = [f"w{k}" for k in range(5000)]
    texts = []
    for f, (shared, own) in enumerate([(40, 10), (39, 10), (160, 40), (160, 41), (60, 20), (65, 20), (300, 75), (300, 76)]):
        base = words[f * 600 : f * 600 + shared + own + 4]
        texts += [" ".join(base), " ".join(base[: shared + 4])]  # similarity shared / (shared + own)
    want = remaining(texts)
    assert want == {0, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 14, 15}
    assert kept_places(spark, texts) == want


def test_no_pair_is_missed(spark):
    rng = random.Random(8)
    texts = [t for n in range(1, 13) for _ in range(12) for t in short_pair(rng, n)]
    want = remaining(texts)
    assert 150 < len(want) < 220
    assert kept_places(spark, texts) == want


def short_pair(rng, n):
    """Two texts of n shingles and of one or two more."""
    base = [f"{rng.getrandbits(40):x}" for _ in range(n + 6)]
    return " ".join(base[: n + 4]), " ".join(base[: n + rng.choice((5, 6))])


def test_stages(spark, odd_docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 300").unionByName(odd_docs.where("doc_id is null").selectExpr(*pipeline.COLUMNS))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = pipeline.near_copies(spark, docs, sf).collect()
    for r in kept:  # no two that stay are near
        for q in kept[:60]:
            a, b = shingles(r.text), shingles(q.text)
            assert r is q or len(a & b) < 0.9 * len(a | b)
    gone = texts.keys() - {r.doc_id for r in kept}
    for d in gone:  # what goes is near something that stays
        a = shingles(texts[d])
        assert max(len(a & b) / max(1, len(a | b)) if a | b else 1 for b in (shingles(r.text) for r in kept)) > 0.5
    for stage in (pipeline.decontamination, pipeline.personal_data):
        assert stage(spark, docs, sf).columns == pipeline.COLUMNS
    last = pipeline.token_ids(spark, docs, sf)
    assert last.count() == docs.count()
    assert pipeline.near_copies(spark, docs.limit(0), sf).collect() == []


def test_run(spark, sf):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = pipeline.run(spark, sf).collect()
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert 0.4 * n < len(rows) < n and all(r.n_tokens == len(r.ids) for r in rows)


def test_hot_shingles_are_exact_and_not_squared(spark, monkeypatch):
    """A passage that makes up most of many texts, and a crowd of near copies, in chunks."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(3)
    word = lambda: f"{rng.getrandbits(40):x}"
    passage, base = [word() for _ in range(50)], [word() for _ in range(300)]
    texts = [" ".join([word() for _ in range(rng.randint(6, 16))] + passage) for _ in range(150)]
    for _ in range(150):
        copy = list(base)
        copy[rng.randrange(300)] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    assert kept_places(spark, texts) == remaining(texts)
    compared, real = [], simhash._confirmed

    def counting(pairs, *rest):
        compared.append(pairs.distinct().count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_confirmed", counting)
    kept_places(spark, [t for t in texts if len(t.split()) == 300])
    assert compared[0] < 150 * 60 and compared[1] == 0  # all are linked by neighbours; no pair is left


def test_copies_of_one_text_meet_it(spark, monkeypatch):
    """Copies with changes of their own, near the text they come from and mostly too far from each other."""
    rng = random.Random(12)
    word = lambda: f"{rng.getrandbits(40):x}"
    base = [word() for _ in range(300)]
    texts = [" ".join(base)]
    for _ in range(140):
        copy = list(base)
        for at in rng.sample(range(300), 5):
            copy[at] = word()
        texts.append(" ".join(copy + [word() for _ in range(rng.randrange(8))]))
    rng.shuffle(texts)
    compared, real = [], simhash._confirmed

    def counting(pairs, *rest):
        compared.append(pairs.distinct().count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "_confirmed", counting)
    want = remaining(texts)
    assert kept_places(spark, texts) == want and len(want) < 10
    assert compared[1] < 141 * 10  # of 9,870 pairs


def test_fingerprints_are_joined_first(spark, monkeypatch):
    from xxhash import xxh64_intdigest

    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"{rng.getrandbits(40):x}" for _ in range(400)]
        texts += [" ".join(words), " ".join(words[:-1])]
    given, found, compared, join, real = [], [], [], simhash.near_links, simhash._confirmed

    def joining(fps, *rest):
        given.extend(r.fp & (2**64 - 1) for r in fps.collect())
        links = join(fps, *rest)
        found.append(links.count())
        return links

    def counting(pairs, *rest):
        compared.append(pairs.distinct().count())
        return real(pairs, *rest)

    monkeypatch.setattr(simhash, "near_links", joining)
    monkeypatch.setattr(simhash, "_confirmed", counting)
    monkeypatch.setattr(simhash, "_neighbours", lambda live: live.selectExpr("node u", "node v", "size", "pos", "size size2", "pos pos2").limit(0))
    assert kept_places(spark, texts) == {2 * k for k in range(30)}
    sets = [[xxh64_intdigest(s.encode(), 42) for s in shingles(t)] for t in texts]
    assert set(given) == {sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for hs in sets}
    assert found[0] > 20 and compared[0] > 20 and compared[1] < 10  # fingerprints alone link most of them
