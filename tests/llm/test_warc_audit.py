import hashlib

from pathloom.llm import warc_audit as M
from pathloom.llm.common import new_path

PAGES = [(k, f"http://a.com/{k}\r\nx", f"<p>{k}</p>" * (k * 50)) for k in range(70)] + [(None, None, None), (13, None, "é"), (13, None, "é"), (110, "u", "z" * 300_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS file", "2 AS record").repartition(3)


def test_drill_finds_just_the_damage(spark):
    a, b = new_path(spark, "a"), new_path(spark, "b")
    index = M.write(frame(spark, PAGES), a, file_bytes=4_000)
    assert index.select("file").distinct().count() > 3
    M.replicate(index, a, b, M.flip)
    rows = M.audit(index, a, b).collect()
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    want = sorted((str(p), digest(h), p is None or p % 97 != 13) for p, _, h in PAGES)
    assert sorted((str(r.page_id), r.payload_sha256, r.intact) for r in rows) == want
    M.replicate(index, a, c := new_path(spark, "c"))
    assert M.audit(index, a, c).where("not intact").count() == 0
    assert M.audit(index, a, new_path(spark, "none")).where("intact").count() == 0  # a lost replica


def test_files_are_warc(spark):
    folder = new_path(spark, "a")
    index = M.write(frame(spark, PAGES).coalesce(1), folder)
    (name,) = {r.file for r in index.collect()}
    with open(folder.removeprefix("file://") + "/" + name, "rb") as f:
        records = list(M.read_records(f.read()))
    assert len(records) == len(PAGES)
    assert sorted(block for _, block in records) == sorted((h or "").encode() for _, _, h in PAGES)
    assert all(h["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(b).hexdigest() for h, b in records)


def test_tree_levels():
    levels = M.tree([bytes([k]) for k in range(40)], fan=4)
    assert [len(x) for x in levels] == [40, 10, 3, 1] and len(M.tree([b"x"])) == 1
    assert M.tree([b"a", b"b"])[-1] != M.tree([b"b", b"a"])[-1]


def test_empty(spark):
    index = M.write(frame(spark, []), a := new_path(spark, "a"))
    assert M.audit(index, a, a).collect() == []


def test_surplus_and_damaged_indexes(spark):
    a, b = new_path(spark, "a"), new_path(spark, "b")
    index = M.write(frame(spark, PAGES), a, file_bytes=4_000)
    M.replicate(index, a, b)
    first, second, third, *_ = sorted({r.file for r in index.collect()})
    local = b.removeprefix("file://")
    with open(f"{local}/{first}", "ab") as f:
        f.write(b"more")  # bytes that only b has
    with open(f"{local}/{second}.idx", "w") as f:
        f.write("[[0, 1], [")
    with open(f"{local}/extra.warc.gz", "wb") as f, open(f"{local}/extra.warc.gz.idx", "w") as g:
        f.write(b"xy")
        g.write("[[0, 1], [1, 1]]")
    rows = M.audit(index, a, b).collect()
    n = {f: sum(r.file == f for r in index.collect()) for f in (first, second)}
    assert sorted(((r.file, r.record) for r in rows if not r.intact), key=str) == sorted([(first, n[first]), *((second, k) for k in range(n[second])), ("extra.warc.gz", 0), ("extra.warc.gz", 1)], key=str)
    assert sum(r.intact for r in rows) == index.count() - n[second]


def test_descent_reads_only_children_of_differing_nodes(spark):
    a, b = new_path(spark, "a"), new_path(spark, "b")
    index = M.write(frame(spark, [(k, None, str(k)) for k in range(600)]).coalesce(1), a)
    M.replicate(index, a, b, M.flip)
    rows = M.audit(index, a, b).where("not intact").collect()
    assert sorted(r.page_id for r in rows) == [k for k in range(600) if k % 97 == 13]
