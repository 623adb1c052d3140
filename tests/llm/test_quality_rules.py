import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import quality_rules as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = Q.op5_quality(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert len(rows) > 40 and (rows.predicted == rows.quality).mean() > 0.95
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = Q.op5_quality(spark, sf)
    assert scores.count() == docs.count() and scores.where("not (score between 0 and 1)").count() == 0


def test_expression_is_the_ensemble(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(400), "b": rng.random(400)}
    y = ((x["a"] > 0.5) & (x["b"] > 0.3)).astype(float)
    model = Q.fit(x, y)
    assert ((model.scores(x) > 0.5) == y).mean() > 0.97
    frame = spark.createDataFrame(list(zip(x["a"].tolist(), x["b"].tolist(), range(400))), "a double, b double, k int")
    got = [r.s for r in frame.withColumn("s", model.column({"a": F.col("a"), "b": F.col("b")})).orderBy("k").collect()]
    assert np.allclose(got, model.scores(x))


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 0, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(odd_docs, labels)
    scored = Q.with_score(odd_docs.drop("score"), model)
    assert scored.columns == [c for c in odd_docs.columns if c != "score"] + ["score"] and scored.where("score is null").count() == 0
    assert Q.with_score(no_docs, Q.train(no_docs, labels)).collect() == []
    assert Q.fit({"a": np.zeros(0)}, np.zeros(0)).scores({"a": np.zeros(2)}).tolist() == [0.5, 0.5]
