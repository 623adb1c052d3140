"""Benchmark decontamination by templates.

Texts are canonicalised into templates: numbers, names (capitalised words; runs of them are one name; words that
begin a sentence are taken both literally and, function words apart, as names) and units (after a number) become typed placeholders, other words are folded
to lower case. Windows of the benchmark's templates are hashed, and the windows of every document meet them
by hash; so do windows of the plain folded words. What meets is aligned: along one alignment of a document
with an item each slot must become one thing (3 -> 7 everywhere), or the windows that break it don't count. A document is contaminated by an item if at least ``share`` of the item's windows
are found so over all alignments together, or ``RUN`` of its words in a row. Re-parameterised questions, other numbers or names in the same words, are caught; a template
must keep at least ``literal`` words of its window to count; where most windows of an item don't, they are
lengthened until they do, and an item without that many words is one window as a whole.

The benchmark is indexed in lots of bounded size, each broadcast and met by all documents; one lot holds about
``LOT_CHARS`` characters, so small benchmarks take one pass and large ones as many as needed.

Defined results: null and empty texts hold no windows, on either side; items shorter than a window are
one window of their own length; items without a word are never found; repeated rows are judged one by one and
repeated items are found each; an empty table gives an empty result; extra columns are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bind_text, parts, table

WINDOW, LITERAL, SHARE = 8, 5, 0.5
WHOLE = 4  # tokens of an item with few literal words that is one window
RUN = 30  # so many words of an item in a row contaminate, however long it is
LOT_CHARS = 8_000_000
CACHED = 200_000  # words that a worker remembers; then it forgets all
PART = 1_500_000  # characters looked at together
TOKENS = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?\n]").findall
WORD, CAPITAL, NUMBER, UNIT, ENDER, NAME = range(6)
UNITS = {
    unit: kind
    for kind, units in {
        "length": "mm cm m km inch inches foot feet ft yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres",
        "mass": "mg g kg ton tons tonne tonnes ounce ounces oz pound pounds lb lbs gram grams kilogram kilograms",
        "time": "s ms second seconds min minute minutes h hr hour hours day days week weeks month months year years",
        "money": "cent cents dollar dollars euro euros usd eur gbp yen",
        "volume": "ml l liter liters litre litres gallon gallons",
        "share": "percent pct",
    }.items()
    for unit in units.split()
}
#: words that begin a sentence and are no names
OPENERS = frozenset(
    "a about after all also although am among an and another any are as at be because been before both but by can compute could did do does during each either "
    "every few find first for from given had has have he hence her here his how however i if in into is it its let many me more most my neither no not now of on "
    "one or other our over she since so some such suppose than that the their then there therefore these they this those though through thus to under until up was "
    "we were what when where whether which while who whom whose why with without would you your".split()
)
HIT = "item_id long, windows int, of int, reworded boolean"


class Canon:
    """Tokens to kinds and hashes; remembers words."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.hash = lambda s: xxh64_intdigest(s.encode("utf-8"), 7)
        self.number, self.name = self.hash("<number>"), self.hash("<name>")
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.kinds: list[int] = []
        self.plain: list[int] = []
        self.typed: list[int] = []
        self.opener: list[bool] = []

    def learn(self, token: str) -> int:
        low = token.lower()
        kind = ENDER if token in ".!?\n" else NUMBER if token[0].isdigit() else UNIT if low in UNITS else CAPITAL if token[0].isupper() and (not token.isupper() or not token[1:]) else WORD
        plain = self.hash(low)
        typed = self.number if kind == NUMBER else self.hash(f"<{UNITS[low]}>") if kind == UNIT else self.name if kind == CAPITAL else plain
        self.code[token] = code = len(self.kinds)
        self.kinds.append(kind)
        self.plain.append(plain)
        self.typed.append(typed)
        self.opener.append(low in OPENERS)
        return code

    def __call__(self, texts: list[str | None]) -> tuple[View, View, View]:
        """The texts as plain words, as templates, and as templates in which words that begin a sentence are names too."""
        if len(self.kinds) > CACHED:
            self.clear()
        split = [TOKENS(t) if t else [] for t in texts]
        tokens = list(chain.from_iterable(split))
        code, learn = self.code, self.learn
        for t in set(tokens).difference(code):
            learn(t)
        codes = np.fromiter(map(code.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        text = np.repeat(np.arange(len(split)), [len(ws) for ws in split])
        kind = np.array(self.kinds, dtype=np.int8)[codes]
        plain, typed = np.array(self.plain, dtype=np.uint64)[codes], np.array(self.typed, dtype=np.uint64)[codes]
        words = kind != ENDER
        starts = np.concatenate([[True], text[1:] != text[:-1]])[: len(text)]
        before = np.where(starts, ENDER, np.concatenate([[ENDER], kind[:-1]])[: len(text)])
        inner = (kind == CAPITAL) & (before != ENDER)
        first = np.flatnonzero(words)
        views = [View(tokens, first, text[first], np.full(len(first), WORD, dtype=np.int8), plain[first], np.zeros(len(tokens), dtype=bool))]
        for name in (inner, inner | (kind == CAPITAL) & ~np.array(self.opener, dtype=bool)[codes]):
            slot = name | (kind == NUMBER) | ((kind == UNIT) & (before == NUMBER))
            later = name & ~starts & np.concatenate([[False], name[:-1]])[: len(text)]
            at = np.flatnonzero(words & ~later)
            views.append(View(tokens, at, text[at], np.where(name, NAME, np.where(slot, kind, WORD))[at], np.where(slot, typed, plain)[at], later))
        return tuple(views)


@dataclass
class View:
    """Texts one after the other: of each place its token, its text, its kind and its hash."""

    tokens: list[str]
    at: np.ndarray
    text: np.ndarray
    kind: np.ndarray
    hash: np.ndarray
    later: np.ndarray  # tokens that go on with the name before them

    def value(self, place: int) -> str:
        """The word, or the whole run of a name, in lower case."""
        k = end = int(self.at[place])
        if self.kind[place] == NAME:
            while end + 1 < len(self.tokens) and self.later[end + 1]:
                end += 1
        return " ".join(self.tokens[k : end + 1]).lower()


class Rolling:
    """Hashes of the windows of a view, of any width at the same cost."""

    def __init__(self, view: View):
        n, prime = len(view.hash), 0x9E3779B97F4A7C15
        back = pow(prime, -1, 1 << 64)
        powers = lambda p: np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, p, dtype=np.uint64)]), dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(view.hash * powers(prime)[:n], dtype=np.uint64)])
        self.back, self.text = powers(back), view.text

    def __call__(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``width`` tokens and which of them stay in one text."""
        n = len(self.text) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
        return (self.sums[width:] - self.sums[:n]) * self.back[:n], self.text[:n] == self.text[width - 1 :]


class Index:
    """Windows of benchmark items, plain (0), as templates (1) and as those with names at the beginning of sentences (2), by width."""

    def __init__(self, items: list[tuple[int, str]], width: int = WINDOW, literal: int = LITERAL):
        self.width = width
        self.items, self.views, self.tables, self.of = items, Canon()([t for _, t in items]), [], []
        for mode, view in enumerate(self.views):
            at, wide = self.places(view, len(items), width, literal) if mode else self.places(view, len(items), width, 0)
            self.of.append(np.bincount(view.text[at], minlength=len(items)).tolist())  # windows of each item that count
            rolling = Rolling(view)
            for w in np.unique(wide).tolist():
                hashes, places = rolling(w)[0], at[wide == w]
                places = places[np.argsort(hashes[places], kind="stable")]
                seen = np.zeros(1 << 20, dtype=bool)
                seen[hashes[places] >> np.uint64(44)] = True
                self.tables.append((mode, w, hashes[places], places, seen))

    @staticmethod
    def places(view: View, n: int, width: int, literal: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin that count, and their widths.

        Of items in which most windows have too few literal words, windows go on until they have enough;
        an item that has too few for that is one window, if it has ``WHOLE`` tokens and two literal words.
        """
        size = np.bincount(view.text, minlength=n)
        ends = np.cumsum(size)[view.text] if len(view.text) else view.text
        each, literals = np.arange(len(view.text)), np.concatenate([[0], np.cumsum(view.kind == WORD)])
        wide = np.minimum(width, size[view.text])
        whole = each + wide <= ends
        rich = whole & (literals[np.minimum(each + wide, len(each))] - literals[each] >= np.minimum(literal, wide))
        total, enough = (np.bincount(view.text[x], minlength=n) for x in (whole, rich))
        dense = whole & ~rich & (2 * enough < total)[view.text]
        until = np.searchsorted(literals, literals[each] + literal)  # the first end with enough literal words
        longer = dense & (until <= ends)
        wide = np.where(longer, until - each, wide)
        some = np.bincount(view.text[rich | longer], minlength=n)
        alone = dense & (each == ends - size[view.text]) & (some == 0)[view.text] & (size[view.text] >= WHOLE) & (literals[ends] - literals[each] >= 2)
        wide = np.where(alone, size[view.text], wide)
        at = np.flatnonzero(rich | longer | alone)
        return at, wide[at]

    def find(self, texts: list[str | None], canon: Canon) -> dict[int, dict[int, tuple[int, int, int]]]:
        """Per place of a text: item's place -> (windows found, mode, words of the longest verbatim run)."""
        out: dict[int, dict[int, tuple[int, int, int]]] = defaultdict(dict)
        met = defaultdict(list)
        views = canon(texts)
        rolling = [Rolling(view) for view in views]
        for mode, w, keys, places, seen in self.tables:
            view = views[mode]
            hashes, whole = rolling[mode](w)
            at = np.flatnonzero(seen[hashes >> np.uint64(44)] & whole)
            first, last = np.searchsorted(keys, hashes[at]), np.searchsorted(keys, hashes[at], side="right")
            for a, lo, hi in zip(at.tolist(), first.tolist(), last.tolist()):
                for x in places[lo:hi].tolist():
                    met[int(view.text[a]), int(self.views[mode].text[x]), mode, a - x].append((a, x, w))
        good: dict[tuple[int, int, int], set[int]] = defaultdict(set)
        run: dict[tuple[int, int], int] = defaultdict(int)
        for (d, item, mode, _), pairs in met.items():
            places = consistent(views[mode], self.views[mode], pairs)
            good[d, item, mode].update(places)
            if mode == 0:
                run[d, item] = max(run[d, item], longest(places) + self.width - 1)
        for (d, item, mode), places in sorted(good.items()):  # all alignments of a text with an item together
            n, of = len(places), self.of[mode][item]
            had = out[d].get(item)
            if n and (not had or n * self.of[had[1]][item] > had[0] * of):
                out[d][item] = (n, mode, run[d, item])
        return out


def consistent(mine: View, theirs: View, pairs: list[tuple[int, int, int]]) -> list[int]:
    """The item's windows of one alignment whose words are the same and whose slots each become one thing."""
    to, good = {}, []
    for a, x, w in sorted(pairs):
        new = {}  # slots first met in this window: they hold only if all of it does
        for k in range(w):
            t = int(theirs.kind[x + k])
            u, v = (t, theirs.value(x + k)), (int(mine.kind[a + k]), mine.value(a + k))
            if u[0] != v[0] or (u != v if t == WORD else (to[u] if u in to else new.setdefault(u, v)) != v):
                break
        else:
            to |= new
            good.append(x)
    return good


def longest(places: list[int]) -> int:
    """Length of the longest run of successive places, given in order."""
    best = n = 0
    for k, x in enumerate(places):
        n = n + 1 if k and x == places[k - 1] + 1 else 1
        best = max(best, n)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, literal: int = LITERAL, share: float = SHARE, lot_chars: int = LOT_CHARS, hits: str = "hits") -> DataFrame:
    """All columns of ``docs`` and ``hits``: the items found in each text (empty: clean), by item id."""
    if hits.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs already has a column {hits}")
    spark = docs.sparkSession
    at = docs.columns.index("text")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(hits, T.ArrayType(T.StructType.fromDDL(HIT)))])
    items = benchmark.select(F.col("`item_id`").alias("item_id"), F.col("`text`").alias("text")).where("text is not null")
    lots, lot, size = [], [], 0
    for row in items.toLocalIterator():  # one lot at a time is built; each is broadcast on its own
        lot.append((row.item_id, row.text))
        size += len(row.text)
        if size >= lot_chars:
            lots.append(lot)
            lot, size = [], 0
    if lot or not lots:
        lots.append(lot)
    out = docs.toDF(*(f"c{k}" for k in range(len(names)))).withColumn(hits, F.array().cast(schema[hits].dataType))
    for items_of_lot in lots:
        sent = spark.sparkContext.broadcast(Index(items_of_lot, width, literal))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, canon = sent.value, Canon()
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("windows", pa.int32()), ("of", pa.int32()), ("reworded", pa.bool_())]))
            for batch in parts(batches, at, PART):
                found = index.find(batch.column(at).to_pylist(), canon) if index.items else {}
                rows = []
                for d, before in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                    own = [
                        {"item_id": index.items[i][0], "windows": n, "of": index.of[mode][i], "reworded": mode > 0}
                        for i, (n, mode, run) in found.get(d, {}).items()
                        if n >= share * index.of[mode][i] or run >= RUN
                    ]
                    rows.append(sorted(before + own, key=lambda x: (x["item_id"] is None, x["item_id"] or 0)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=batch.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*names, hits)


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents in which no item is found."""
    return contaminated(docs, benchmark, **how, hits="_hits").where("size(_hits) = 0").drop("_hits")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bind_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.windows", F.col("h.of").alias("item_windows"), "h.reworded")
