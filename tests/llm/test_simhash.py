import random

import numpy as np
from xxhash import xxh64_intdigest

from pathloom.llm import simhash as H
from pathloom.llm.components import components


def brute_fingerprint(text, width=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(fps, errors=3):
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    bits = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= errors):
            root[find(int(j))] = find(i)
    return [find(k) for k in range(len(fps))]


def expected(docs):
    fps = [brute_fingerprint(r.text) for r in docs]
    classes = brute_classes(fps)
    least = {}
    for r, c in zip(docs, classes):
        if r.doc_id is not None:
            least[c] = min(r.doc_id, least.get(c, r.doc_id))
    return sorted(((r.doc_id, f"{f:016x}", least.get(c)) for r, f, c in zip(docs, fps, classes)), key=str)


def test_query(spark, sf):
    rows = H.op6_simhash(spark, sf).collect()
    assert sorted((tuple(r) for r in rows), key=str) == expected(spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_odd_rows(odd_docs, no_docs):
    docs = odd_docs.where("length(text) < 60000 or text is null")
    rows = [(r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in H.near_components(docs).collect()]
    assert sorted(rows, key=str) == expected(docs.collect())
    assert H.near_components(no_docs).collect() == []


def links_join(spark, values, errors, most):
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    frame = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in components(H.near_links(frame, errors, most)).collect()}
    mine = [roots.get(s[0], s[0]) for s in signed]
    theirs = brute_classes(values, errors)
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def crowd(seed, n):
    """Clusters around few centres, so that node pairs are deep and full."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    out = {0, (1 << 64) - 1}
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, 9)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    return sorted(out, key=lambda v: rng.random())


def test_trie_join_is_exact(spark):
    links_join(spark, crowd(1, 900), 3, 40_000)


def test_large_nodes_are_split(spark):
    links_join(spark, crowd(2, 500), 3, 40)


def test_other_budgets(spark):
    links_join(spark, crowd(3, 300), 1, 30)
    links_join(spark, crowd(4, 300), 7, 40_000)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (3, 2)]
    rows = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in rows} == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}
    assert len(rows) == 101
