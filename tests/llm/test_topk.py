import math
import random

from pathloom.llm import topk as K


def brute(rows, is_query, k):
    vecs = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, x) in enumerate(vecs):
        if is_query(q):
            scores = sorted((-sum(p * r for p, r in zip(x, y)), i) for b, (i, y) in enumerate(vecs) if b != a)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def run(spark, rows, k=10, **how):
    frame = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<float>, score int")
    return sorted(tuple(r) for r in K.top_k(frame, lambda i: i % 10 == 0, k, **how).collect())


def test_blocks_ties_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)]) for k in range(120)]
    rows += [(200, None), (201, [1.0, None]), (210, [float("nan")]), (211, [float("inf")]), (None, [1.0]), (220, []), (221, [0.5]), (30, [0.5] * 6), (30, [0.5] * 6)]
    want = brute(rows, lambda i: i % 10 == 0, 10)
    assert run(spark, rows) == want
    assert run(spark, rows, candidates=25, queries=4) == want
    assert run(spark, rows[:4], 10) == brute(rows[:4], lambda i: i % 10 == 0, 10)
    assert run(spark, []) == []
