import pytest

from pathloom.llm import common, sharding, simhash


def test_uris(spark, tmp_path):
    assert common.qualified(spark, str(tmp_path)) == f"file://{tmp_path}"  # the default filesystem here is the local one
    assert common.qualified(spark, f"file:{tmp_path}") == f"file://{tmp_path}"
    fs, path = common.open_uri(f"file://{tmp_path}")
    fs.create_dir(f"{path}/x")
    assert (tmp_path / "x").is_dir()
    with pytest.raises(ValueError):
        common.open_uri(str(tmp_path))


def test_bare_path_follows_the_default_filesystem(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    was = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://tables/")
    conf.set("fs.viewfs.mounttable.tables.link./here", f"file://{tmp_path}")
    try:
        assert common.qualified(spark, "/here/x") == "viewfs://tables/here/x"
    finally:
        conf.set("fs.defaultFS", was or "file:///")


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_files_of_one_name_in_two_folders_are_two(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    for k in (1, 2):
        docs.coalesce(1).write.parquet(str(tmp_path / f"k={k}"))
        (made,) = (tmp_path / f"k={k}").glob("part-*.parquet")
        made.rename(tmp_path / f"k={k}" / "part-0.parquet")
    both = spark.read.parquet(str(tmp_path))
    assert sharding.addressed(both).select("file", "row").distinct().count() == 2
    assert simhash.one_of_each(both).count() == 1


def test_once_keeps_odd_columns(spark):
    from pyspark.sql import functions as F

    out = common.once(spark.createDataFrame([(1, 2)], "`a.b` int, x int"), "y", F.col("x") + 1)
    assert out.columns == ["a.b", "x", "y"] and out.where("y = 3").count() == 1
