from collections import Counter

import numpy as np

from pathloom.llm import sharding as S
from pathloom.llm.common import new_path


def law_holds(rows, shards):
    by = Counter(r.shard for r in rows)
    sizes = [by.get(k, 0) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))


def test_query(spark, sf):
    rows = S.op2_sharding(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "coalesce(octet_length(text), 0) + 1 AS size", "crc32(coalesce(text, '')) AS crc").collect()
    law_holds(rows, 8)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, r.size, r.crc) for r in docs)
    again = S.op2_sharding(spark, sf).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))  # the seed decides
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order) and abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_odd_rows_and_many_buckets(spark, odd_docs, no_docs):
    rows = S.shuffle(odd_docs, new_path(spark, "shards"), shards=4, bucket_bytes=100_000).collect()
    law_holds(rows, 4)
    assert Counter(map(str, (r.record for r in rows))) == Counter(map(str, odd_docs.collect()))
    law_holds(S.shuffle(odd_docs, new_path(spark, "shards"), shards=40).collect(), 40)
    assert S.shuffle(no_docs, new_path(spark, "shards")).collect() == []


def test_fisher_yates_is_uniform():
    rng = np.random.default_rng(1)
    seen = Counter(tuple(S.fisher_yates(3, rng).tolist()) for _ in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850
