"""SimHash near-duplicates: fingerprints, and a self-join of their binary trie.

Fingerprints at most ``errors`` bits apart agree wholly in one of ``errors + 1`` equal blocks of
bits, so each fingerprint is turned ``errors + 1`` times, once with every block in front, and only
fingerprints with the same front block meet. The rest is a binary trie: pairs of its nodes are
walked together, level by level; a pair with unlike branches carries the differing bits so far, and
is pruned once they exceed the budget. A node is a range of the sorted fingerprints. Small node
pairs are compared outright.

A node pair with more rows than fit a task is first split in Spark: both nodes go to their 256
children eight bits below, and only child pairs within the budget are kept, again and again, until all
fit. Each task returns no pairs but a spanning forest of the links it found, so that dense clusters
stay linear; components follow from those links.

Defined results: a null or empty text, or one without words, has fingerprint zero and links like any
other; fewer words than a shingle make one shingle; rows with a null doc_id take part, but the id of a
component is the smallest id that is not null (null if there is none); repeated rows are returned
as often as they come; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind_text, discard, join_few, join_hot, keep, parts, table
from .components import components

BITS = 64
SEED = 42
MOST = 40_000  # rows of a node pair that one task walks
STEP = 8  # bits by which larger node pairs are split
LEAF = 256  # node pairs of at most so many comparisons are compared outright
AT_ONCE = 2_000_000  # comparisons held at a time


def _hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of a text's shingles in their order, with repeats; fewer words than a shingle make one."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z only, and just the ASCII spaces
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    last = ends[min(width, len(words)) - 1 :] - 1
    first = np.concatenate([[0], ends])[: len(last)]
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())), dtype=np.uint64, count=len(last))


def _majority(hashes: np.ndarray) -> int:
    """Bit k is 1 where more than half the hashes have it."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """Bit k is 1 where more than half the shingles' XXH64 have it; repeats count."""
    return _majority(_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            made = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return bind_text(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]  # which pairs of places are near


# ---- the trie -------------------------------------------------------------------------------


def _settle(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Give linked places the smallest label they reach."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _compare(pairs: np.ndarray, near: Near, label: np.ndarray) -> None:
    """All places of small node pairs (lo1, hi1, lo2, hi2) against each other."""
    cost = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    groups = np.cumsum(cost) // AT_ONCE
    for part in np.split(np.arange(len(pairs)), np.flatnonzero(np.diff(groups)) + 1):
        p, n = pairs[part], cost[part]
        which = np.repeat(np.arange(len(p)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = (p[:, 3] - p[:, 2])[which]
        i, j = p[which, 0] + k // wide, p[which, 2] + k % wide
        below = i < j
        i, j = i[below], j[below]
        apart = label[i] != label[j]  # what is linked already needs no look
        i, j = i[apart], j[apart]
        linked = near(i, j)
        _settle(label, i[linked], j[linked])


def walk(fp: np.ndarray, pairs: np.ndarray, depth: int, errors: int, near: Near, label: np.ndarray, bits: int = BITS) -> None:
    """Walk node pairs (lo1, hi1, lo2, hi2, differing bits) of sorted ``fp`` from bit ``depth`` down to ``bits``."""
    while len(pairs):
        cost = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (cost <= LEAF) | (depth >= bits)
        if small.any():
            _compare(pairs[small, :4], near, label)
            pairs = pairs[~small]
        if not len(pairs):
            return
        ones = np.concatenate([[0], np.cumsum((fp >> np.uint64(BITS - 1 - depth)) & np.uint64(1)).astype(np.int64)])
        lo1, hi1, lo2, hi2, off = pairs.T
        cut1, cut2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        own = lo1 == lo2  # a node with itself: its two halves meet once
        below = [
            np.stack([lo1, cut1, lo2, cut2, off], 1),
            np.stack([cut1, hi1, cut2, hi2, off], 1),
            np.stack([lo1, cut1, cut2, hi2, off + 1], 1),
            np.stack([cut1, hi1, lo2, cut2, off + 1], 1)[~own],
        ]
        pairs = np.concatenate(below)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= errors)]
        depth += 1


def _forest(node: np.ndarray, own: np.ndarray, side: np.ndarray, fp: np.ndarray, depth: np.ndarray, off: np.ndarray, errors: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole node pairs, given as rows in the order of (node, side, fp)."""
    starts = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1])
    stops = np.append(starts[1:], len(node))
    ones = np.concatenate([[0], np.cumsum(side)])
    cross = stops - (ones[stops] - ones[starts])  # where the second side begins
    pairs = np.stack([starts, np.where(own[starts], stops, cross), np.where(own[starts], starts, cross), stops, off[starts]], 1)
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    label = np.arange(len(node))
    for d in np.unique(depth[pairs[:, 0]]):
        walk(fp, pairs[depth[pairs[:, 0]] == d], int(d), errors, lambda i, j: np.bitwise_count(fp[i] ^ fp[j]) <= errors, label)
    linked = np.flatnonzero(label != np.arange(len(node)))
    return linked, label[linked]


def _turned_back(fp: np.ndarray, turn: np.ndarray) -> np.ndarray:
    by = turn.astype(np.uint64)
    return np.where(by == 0, fp, (fp >> by) | (fp << (np.uint64(BITS) - np.maximum(by, np.uint64(1)))))


def _walk_rows(errors: int):
    names = ["turn", "a", "b", "depth", "off", "side", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[pa.RecordBatch], last: bool):
            rows = pa.Table.from_batches(held).combine_chunks()
            c = {n: rows.column(n).to_numpy() for n in names}
            n = len(c["turn"])
            new = (c["turn"][1:] != c["turn"][:-1]) | (c["a"][1:] != c["a"][:-1]) | (c["b"][1:] != c["b"][:-1]) | (c["depth"][1:] != c["depth"][:-1])
            edge = np.flatnonzero(new) + 1
            end = n if last else (int(edge[-1]) if len(edge) else 0)
            rest = [] if last else [pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in rows.slice(end).columns], names=rows.column_names)]
            if not end:
                return None, rest
            node = np.concatenate([[0], np.cumsum(new)])[:end]
            fp = (c["key"][:end].astype(np.int64) ^ np.int64(-(2**63))).view(np.uint64)
            i, j = _forest(node, c["a"][:end] == c["b"][:end], c["side"][:end], fp, c["depth"][:end], c["off"][:end].astype(np.int64), errors)
            turn = c["turn"][:end]
            u, v = (_turned_back(fp[x], turn[x]).view(np.int64) for x in (i, j))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"]), rest

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 2 * MOST:
                made, held = links(held, False)
                size = sum(b.num_rows for b in held)
                if made is not None:
                    yield made
        if size:
            yield links(held, True)[0]

    return run


def near_links(fps: DataFrame, errors: int = 3, most: int = MOST) -> DataFrame:
    """Links (u, v) that span all pairs of distinct ``fps`` (fp: long) at most ``errors`` bits apart.

    Rows are (turn, node a, node b, depth, differing bits, side, key): ``key`` is the turned
    fingerprint with its sign bit flipped, so that signed order is unsigned order; a and b are
    the first ``depth`` bits of the two nodes; side tells to which of them the row belongs.
    """
    if not 0 <= errors < BITS or BITS % (errors + 1):
        raise ValueError("errors + 1 must divide 64")
    block = BITS // (errors + 1)
    spark = fps.sparkSession
    turned = lambda t: "fp" if t == 0 else f"(shiftleft(fp, {t}) | shiftrightunsigned(fp, {BITS - t}))"
    rows = (
        fps.select(F.explode(F.array(*(F.struct(F.lit(t).alias("turn"), F.expr(turned(t)).alias("rot")) for t in range(0, BITS, block)))).alias("x"))
        .select("x.turn", F.expr(f"shiftrightunsigned(x.rot, {BITS - block})").alias("a"), F.expr("x.rot ^ (-9223372036854775807L - 1L)").alias("key"))
        .select("turn", "a", F.col("a").alias("b"), F.lit(block).alias("depth"), F.lit(0).alias("off"), F.lit(0).alias("side"), "key")
    )
    node = ["turn", "a", "b", "depth", "off"]
    done, old = [], []
    rows, path = keep(rows, "nodes")
    while True:
        large = rows.groupBy(*node).count().where(F.col("count") > most).select(*node)
        large, large_path = keep(large, "large")
        if not large.take(1):
            done.append(rows)
            break
        old += [path, large_path]
        done.append(rows.join(large, node, "left_anti"))
        rot = "(key ^ (-9223372036854775807L - 1L))"
        own = F.expr(f"shiftrightunsigned({rot}, 64 - depth - {STEP}) & {(1 << STEP) - 1}")
        down = (
            rows.join(large, node)
            .withColumns({"x": own, "y": F.explode(F.sequence(F.lit(0).cast("long"), F.lit((1 << STEP) - 1).cast("long")))})
            .withColumn("off2", F.expr("off + bit_count(x ^ y)"))
            .where(F.col("off2") <= errors)
        )
        down = down.select(
            "turn",
            F.expr(f"shiftleft(a, {STEP}) | CASE WHEN a = b THEN least(x, y) WHEN side = 0 THEN x ELSE y END").alias("a"),
            F.expr(f"shiftleft(b, {STEP}) | CASE WHEN a = b THEN greatest(x, y) WHEN side = 0 THEN y ELSE x END").alias("b"),
            F.expr(f"depth + {STEP}").alias("depth"), F.col("off2").alias("off"),
            F.expr("CASE WHEN a = b THEN CASE WHEN x > y THEN 1 ELSE 0 END ELSE side END").alias("side"), "key",
        )
        rows, path = keep(down, "nodes")
    todo = done[0]
    for more in done[1:]:
        todo = todo.unionByName(more)
    todo = todo.select(*node, "side", "key").repartition(*node).sortWithinPartitions(*node, "side", "key")
    links, _ = keep(todo.mapInArrow(_walk_rows(errors), "u long, v long"), "links")
    discard(spark, path, *old)
    return links


# ---- near copies: exact similarity of shingle sets ----------------------------------------

SAMPLED, SHARE = 20_000, 0.1  # documents in which frequent shingles are looked for: so many, or this share if more
OFTEN, HOT = 3, 500_000  # a shingle in so many of them is hot; at most so many hot ones are held


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of a text's shingles as sorted XXH64; fewer words than a shingle make one."""
    return np.unique(_hashes(text, width))


def _hot(docs: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles of a sample, rarer ones first. They only set an order: results don't depend on them."""
    n = docs.count()
    part = max(1, n // max(SAMPLED, int(n * SHARE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 0):
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), width).view(np.int64))], names=["h"])

    some = docs.where(F.pmod(F.xxhash64("file", "row"), F.lit(part)) == 0).select("text")
    often = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    found = often.orderBy(F.desc("count"), "h").limit(HOT).select("h").toPandas()["h"]
    return found.to_numpy(dtype=np.int64)[::-1].view(np.uint64)


def _heads(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``file, row, doc_id, node, fp, size, head, last``: a hash, the fingerprint and the size of the set, and those of its shingles, first
    in an order of all shingles (hot ones last), of which two sets of this similarity must share one; ``last`` is the head's end in that order."""
    hot = _hot(docs, width)
    order = np.argsort(hot)
    sent = docs.sparkSession.sparkContext.broadcast((hot[order], order + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        known, rank = sent.value
        for batch in parts(batches, 3):
            node, fp, size, head, last = [], [], [], [], []
            for t in batch.column(3):
                h = shingles(t.as_py(), width)
                node.append(xxh64_intdigest(h.tobytes(), SEED))
                fp.append(_majority(h))
                place = np.zeros(len(h), dtype=np.int64)
                if len(known) and len(h):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    place = np.where(known[at] == h, rank[at], 0)
                    order = np.argsort(place, kind="stable")
                    h, place = h[order], place[order]
                k = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
                size.append(len(h))
                head.append(h[:k].view(np.int64))
                last.append({"place": int(place[:k][-1]), "hash": int(h[:k][-1]) - (1 << 63)} if len(h) else None)  # hashes are in unsigned order
            made = [*(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (node, fp)), pa.array(size, pa.int32()), pa.array(head, pa.list_(pa.int64()))]
            made.append(pa.array(last, pa.struct([("place", pa.int64()), ("hash", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["file", "row", "doc_id", "node", "fp", "size", "head", "last"])

    return docs.select("file", "row", "doc_id", "text").mapInArrow(run, "file string, row long, doc_id long, node long, fp long, size int, head array<long>, last struct<place: long, hash: long>")


def _plausible(pairs: DataFrame, each: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose heads don't rule this similarity out.

    What two sets share up to the end of the head that ends first lies in both heads; beyond, they share at most the rest of that set.
    """
    of = lambda n: each.select(F.col("node").alias(n), *(F.col(c).alias(f"{c}_{n}") for c in ("size", "head", "last")))
    both = F.size(F.array_intersect("head_u", "head_v"))
    rest = F.when(F.col("last_u") <= F.col("last_v"), F.col("size_u") - F.size("head_u")).otherwise(F.col("size_v") - F.size("head_v"))
    enough = both + rest >= (F.col("size_u") + F.col("size_v")) * (similarity / (1 + similarity)) - 1e-9
    return pairs.distinct().join(of("u"), "u").join(of("v"), "v").where(enough).select("u", "v")


def _confirmed(pairs: DataFrame, each: DataFrame, docs: DataFrame, width: int, similarity: float) -> tuple[DataFrame, list[str]]:
    """Those of the pairs of nodes (u, v) whose whole sets have this Jaccard similarity."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t.as_py(), width).tobytes() for t in batch.column(1)], pa.binary())], names=["node", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in (a, b))
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    pairs, pairs_path = keep(_plausible(pairs, each, similarity), "pairs")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    places, places_path = keep(each.join(nodes, "node").select("node", "first.file", "first.row"), "places")
    texts = join_few(docs.select("file", "row", "text"), places, ["file", "row"]).select("node", "text")
    held, held_path = keep(texts.mapInArrow(sets, "node long, held binary"), "sets")
    both = pairs.join(held.select(F.col("node").alias("u"), F.col("held").alias("a")), "u").join(held.select(F.col("node").alias("v"), F.col("held").alias("b")), "v")
    links, path = keep(both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"), "links")
    discard(docs.sparkSession, pairs_path, places_path, held_path)
    return links, [path]


def _alike(each: DataFrame, similarity: float, errors: int) -> tuple[DataFrame, list[str]]:
    """Pairs (u, v) of nodes that fingerprints link: those of one fingerprint with its first node, and first nodes along the links that
    the trie join of fingerprints at most ``errors`` bits apart finds."""
    of, path = keep(each.groupBy("fp").agg(F.min(F.struct("size", "node")).alias("at"), F.count("*").alias("_n")), "fingerprints")
    links = near_links(of.select("fp"), errors)
    end = lambda n: of.select(F.col("fp").alias(n), F.col("at").alias(f"at_{n}"))
    across = links.join(end("u"), "u").join(end("v"), "v").select(F.col("at_u").alias("a"), F.col("at_v").alias("b"))
    same = join_hot(each.select("fp", F.struct("size", "node").alias("a")), of.where("_n > 1").select("fp", F.col("at").alias("b")), ["fp"], counts=of.select("fp", "_n")).select("a", "b")
    fit = f"a.node <> b.node AND least(a.size, b.size) >= {similarity!r}D * greatest(a.size, b.size) - 1e-9D"
    pairs = across.unionByName(same).where(fit).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    return pairs, [path]


CHUNK = 100_000  # rows of a shingle in which neighbours are looked for in one task


def _reaches(similarity: float) -> str:
    """Whether two sets whose first common shingle is at places pos and pos2 of their orders can be this similar."""
    return f"least(size, size2) >= {similarity!r}D * greatest(size, size2) - 1e-9D AND least(size - pos, size2 - pos2) >= {similarity / (1 + similarity)!r}D * (size + size2) - 1e-9D"


def _meeting(each: DataFrame, similarity: float) -> tuple[DataFrame, list[str]]:
    """``node, size, pos, key, chunk`` of the places of heads at which another set may be met.

    A set can only be similar to sets up to a size ``most`` that first share its shingle at ``pos``; places for which
    no set of that shingle is small enough, or none reaches this one's size, fall out before anything is paired.
    """
    most = (F.col("size") - F.col("pos")) * (1 + similarity) / similarity - F.col("size") + 1e-6
    heads = each.select("node", "size", F.posexplode("head").alias("pos", "key")).withColumn("most", most)
    of_key, path = keep(heads.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("lo"), F.max("most").alias("hi")).where("n > 1"), "keys")
    met = join_hot(heads, of_key, ["key"], counts=of_key.select("key", F.col("n").alias("_n"))).where("most >= lo AND size <= hi")
    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CHUNK)).cast("int")
    live, live_path = keep(met.select("node", "size", "pos", "key", chunk.alias("chunk")), "live")
    return live, [path, live_path]


def _neighbours(live: DataFrame) -> DataFrame:
    """Pairs (u, v, size, pos, size2, pos2) within a chunk of a shingle, about two a row, and between the first ones of chunks.

    Neighbours by size, and every row with the chunk's centre: the one with the fewest rarer shingles, as a text has of which the
    others are copies with changes. Two such copies may be too far apart where each is near the centre.
    """
    side, chunk = F.struct("size", "node", "pos"), Window.partitionBy("key", "chunk")
    inside = live.select("key", side.alias("a"), F.lag(side).over(chunk.orderBy("size", "node")).alias("b"), F.min(F.struct("pos", "size", "node")).over(chunk).alias("c"))
    firsts = live.groupBy("key", "chunk").agg(F.min(F.struct("pos", "size", "node")).alias("a"))
    across = firsts.select("key", "a", F.lag("a").over(Window.partitionBy("key").orderBy("chunk")).alias("b"), F.min("a").over(Window.partitionBy("key")).alias("c"))
    both = inside.select("a", F.explode(F.array("b", F.struct("c.size", "c.node", "c.pos"))).alias("b"))
    both = both.unionByName(across.select(*(F.struct(f"{x}.size", f"{x}.node", f"{x}.pos").alias(x) for x in "abc")).select("a", F.explode(F.array("b", "c")).alias("b")))
    pairs = both.where("b.node IS NOT NULL AND a.node <> b.node")
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"), "a.size", "a.pos", F.col("b.size").alias("size2"), F.col("b.pos").alias("pos2"))


def _apart(live: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[str]]:
    """Pairs within a shingle that are not linked so far: all that don't belong to its largest class against everything."""
    named, path = keep(live.drop("chunk").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    of_key = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("roots"), F.sum("n").alias("_n"))
    of_key, key_path = keep(of_key.where("roots > 1"), "keys")
    mixed, mixed_path = keep(join_hot(named, of_key.select("key", "top"), ["key"], counts=of_key.select("key", "_n")), "mixed")
    other = mixed.select("key", *(F.col(c).alias(f"{c}2") for c in ("node", "size", "pos", "root")))
    pairs = mixed.where("root <> top").join(other, "key").where("root <> root2 AND (root2 = top OR node < node2)")
    return pairs.select(F.col("node").alias("u"), F.col("node2").alias("v"), "size", "pos", "size2", "pos2"), [path, key_path, mixed_path]


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, errors: int = 3) -> DataFrame:
    """``docs`` without near copies: of each group of linked texts the row with the smallest doc_id (null last) stays.

    Texts link exactly when their sets of ``width``-word shingles have this Jaccard ``similarity`` or more; texts without
    words are one group. SimHash comes first: pairs that the trie join of their fingerprints links (at most ``errors`` of 64 bits
    apart) are compared as whole sets. Fingerprints that near tell nearly the same sets only; the rest of the pairs meet by a shingle
    of their heads, so none is missed: neighbours and centres within a shingle together with the SimHash pairs, then what is not
    linked by then, so that groups of many near copies stay about linear.
    """
    from .sharding import addressed

    spark = docs.sparkSession
    rows = addressed(docs)
    texts = rows.select("file", "row", F.col("record.doc_id").alias("doc_id"), F.col("record.text").alias("text"))
    made, made_path = keep(_heads(texts, width, similarity), "heads")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "file", "row"))
    each, each_path = keep(made.groupBy("node").agg(first.alias("first"), F.first("size").alias("size"), F.first("head").alias("head"), F.first("last").alias("last"), F.first("fp").alias("fp")), "distinct")
    alike, fp_old = _alike(each, similarity, errors)
    live, old = _meeting(each, similarity)
    reach = F.expr(_reaches(similarity))
    links, more = _confirmed(_neighbours(live).where(reach).select("u", "v").unionByName(alike), each, texts, width, similarity)
    old += more + fp_old
    apart, more = _apart(live, components(links))
    old += more
    rest, more = _confirmed(apart.where(reach).select("u", "v"), each, texts, width, similarity)
    old += more
    roots = components(links.union(rest))
    stay = each.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first")).select("first.file", "first.row")
    gone, _ = keep(made.select("file", "row").join(stay, ["file", "row"], "left_anti"), "gone")
    discard(spark, made_path, each_path, *old)
    return join_few(rows, gone, ["file", "row"], "left_anti").select(*(F.col("record").getField(c).alias(c) for c in docs.columns))


def near_components(docs: DataFrame, width: int = 3, errors: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` of every document; linked fingerprints share a component."""
    made, _ = keep(fingerprints(docs, width), "fingerprints")
    each, each_path = keep(made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(each.select("fp"), errors))
    named = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named, named_path = keep(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of, _ = keep(named.join(smallest, "root").select("fp", "component_id"), "classes")
    found = join_hot(made, of, ["fp"], counts=each.select("fp", F.col("n").alias("_n"))).select("doc_id", "fp", "component_id")
    discard(docs.sparkSession, each_path, named_path)
    return found


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
