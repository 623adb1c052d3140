"""Quality classifier: a sparse ensemble of rules over text statistics.

Small gradient-boosted trees are grown on a bounded sample of labelled rows; every path from a root to a
node is a conjunctive rule over the statistics. A lasso logistic regression weighs the rules and
leaves most of them out, and what remains is compiled into one Spark column expression, so that scoring
is a projection of the scan. Statistics are Spark columns too, the same for fitting and scoring.

Only the fit is bounded: at most ``MOST_ROWS`` labelled rows, those with the smallest hash of their id.
Every document is scored, over its whole text.

Defined results: a null text counts as an empty one, and that gets a score like any other; a null doc_id is
not held out and never learned from; repeated label rows count once (the lower label stays); with no
labelled rows or only one label, all scores are the smoothed share of label 1; an empty table gives
an empty result; extra columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind_text, once, table

MOST_ROWS = 6_000
FOLDS = 5
CUT = 0.3
TREES, DEPTH, BINS, LEAST, RATE = 24, 3, 24, 8, 0.3
LASSO = 0.002
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÁÂÃÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕØÙÚÛÝ"
SYMBOLS = "*$%&#|!~^<>{}\\@_="


def statistics(text: Column) -> dict[str, Column]:
    """Shares and counts of a text, all of them defined for the empty one."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    words = F.split(t, "[ \n\t]+")
    count = F.size(words)
    share = lambda part, of: F.when(of > 0, part / of).otherwise(0.0)
    less = lambda sign: n - F.length(F.replace(t, F.lit(sign)))
    symbols = sum((less(s) for s in SYMBOLS[1:]), less(SYMBOLS[0]))
    again = F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(count - 1, F.lit(1))), lambda a, b: a == b), lambda same: same))
    lines = F.split(t, "\n")
    return {
        "chars": n.cast("double"),
        "words": count.cast("double"),
        "word_chars": share(n, count),
        "capitals": share(n - F.length(F.translate(t, CAPITALS, "")), n),
        "symbols": share(symbols, count),
        "bars": share(less("|"), count),
        "shouts": share(less("!"), count),
        "new_words": share(F.size(F.array_distinct(words)), count),
        "repeats": share(again, count),
        "new_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(count, F.size(lines)),
        "stops": share(less("."), count),
        "commas": share(less(","), count),
    }


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above, threshold) must hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] > t) == above for s, above, t in self.terms])

    def column(self, x: dict[str, Column]) -> Column:
        out = F.lit(True)
        for s, above, t in self.terms:
            out = out & ((x[s] > t) if above else (x[s] <= t))
        return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def column(self, x: dict[str, Column]) -> Column:
        """The score as one expression."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(x), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))

    def scores(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum((w * r.holds(x) for r, w in self.weights), np.zeros(len(next(iter(x.values()))))))))


def _grow(x: dict[str, np.ndarray], cuts: dict[str, np.ndarray], pull: np.ndarray, bend: np.ndarray, rows: np.ndarray, path: tuple, paths: set, step: np.ndarray) -> None:
    """Split ``rows`` where the squared pull falls most; leaves add to ``step``, paths to ``paths``."""
    step[rows] = RATE * pull[rows].sum() / (bend[rows].sum() + 1)
    if len(path) == DEPTH or len(rows) < 2 * LEAST:
        return
    whole, choice = pull[rows].sum() ** 2 / (bend[rows].sum() + 1), (1e-6, None)
    for s, thresholds in cuts.items():
        if not len(thresholds):
            continue
        place = np.searchsorted(thresholds, x[s][rows], side="left")
        p, b, m = (np.bincount(place, w, len(thresholds) + 1).cumsum()[:-1] for w in (pull[rows], bend[rows], np.ones(len(rows))))
        gain = p**2 / (b + 1) + (pull[rows].sum() - p) ** 2 / (bend[rows].sum() - b + 1) - whole
        gain[(m < LEAST) | (len(rows) - m < LEAST)] = -1
        k = int(gain.argmax())
        if gain[k] > choice[0]:
            choice = (gain[k], (s, float(thresholds[k])))
    if choice[1] is None:
        return
    s, t = choice[1]
    above = x[s][rows] > t
    for up in (False, True):
        below = (*path, (s, up, t))
        paths.add(below)
        _grow(x, cuts, pull, bend, rows[above == up], below, paths, step)


def fit(x: dict[str, np.ndarray], y: np.ndarray) -> Ensemble:
    n, ones = len(y), int(y.sum())
    prior = (ones + 1) / (n + 2)
    if not 0 < ones < n:
        return Ensemble(float(np.log(prior / (1 - prior))), ())
    cuts = {s: np.unique(np.quantile(v, np.linspace(0.02, 0.98, BINS))) for s, v in x.items()}
    at, paths = np.full(n, np.log(prior / (1 - prior))), set()
    for _ in range(TREES):
        p, step = 1 / (1 + np.exp(-at)), np.zeros(n)
        _grow(x, cuts, y - p, p * (1 - p), np.arange(n), (), paths, step)
        at += step
    by_rows: dict[bytes, Rule] = {}
    for path in sorted(paths, key=lambda q: (len(q), q)):
        rule = Rule(path)
        held = rule.holds(x)
        if 0 < held.sum() < n:
            by_rows.setdefault(held.tobytes(), rule)  # of rules that hold for the same rows, the shortest
    rules = list(by_rows.values())
    r = np.array([rule.holds(x) for rule in rules], dtype=float).T
    mean, spread = r.mean(0), r.std(0)
    z = (r - mean) / spread
    w, bias, seen, t = np.zeros(len(rules)), float(np.log(ones / (n - ones))), np.zeros(len(rules)), 1.0
    size = 4 / (np.linalg.norm(z, 2) ** 2 / n + 1)
    for _ in range(600):  # accelerated proximal gradient
        miss = 1 / (1 + np.exp(-(bias + z @ seen))) - y
        bias -= size * miss.mean()
        new = seen - size * (z.T @ miss) / n
        new = np.sign(new) * np.maximum(np.abs(new) - size * LASSO, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        seen, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return Ensemble(float(bias - (w * mean / spread)[kept].sum()), tuple((rules[k], float(w[k] / spread[k])) for k in kept))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Ensemble:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    known = (
        labels.select(F.col("`doc_id`").alias("doc_id"), F.col("`quality`").alias("quality"))
        .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    labelled = bind_text(docs, "doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``most`` rows of two numbers
    x = statistics(F.col("text"))
    rows = labelled.select("doc_id", F.crc32("text").alias("crc"), "quality", *(c.alias(s) for s, c in x.items())).orderBy("doc_id", "crc").limit(most)
    sample = rows.toPandas()
    return fit({s: sample[s].to_numpy(dtype=float) for s in x}, sample["quality"].to_numpy(dtype=float))


def with_score(docs: DataFrame, model: Ensemble, score: str = "score") -> DataFrame:
    """``docs`` with the score of each row's text; a later filter on the score doesn't compute the statistics again."""
    x = statistics(F.col("`text`"))
    made = once(docs, "_x", F.struct(*(c.alias(s) for s, c in x.items())))
    return made.withColumn(score, model.column({s: F.col(f"_x.{s}") for s in x})).drop("_x")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_score(bind_text(docs, "doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
