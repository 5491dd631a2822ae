"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of each whole text are computed in batches. Boosted shallow trees are grown on
a bounded sample of labelled rows; every path from a tree's root to any of its nodes
becomes a rule, a conjunction of thresholds. A logistic model with a lasso penalty keeps
few of the rules, and what it keeps is compiled to a Spark column expression.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_fold, small_batches

STATS = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "symbols", "exclaims", "bars", "digits", "wide",
    "repeated_next", "distinct_words", "common_word", "repeated_lines", "log_line", "ended_words", "capital_words", "symbol_ends",
)
#: The most labelled rows that a model is fitted on, chosen by a hash of the id.
MAX_ROWS = 20_000
TREES, DEPTH, BINS, RATE = 30, 3, 24, 0.3
#: Lasso penalty a row, and rounds of its fitting.
PENALTY, ROUNDS = 0.0008, 250
FOLDS, THRESHOLD = 5, 0.3

_UPPER, _LOWER = slice(65, 91), slice(97, 123)
_SYMBOLS = np.frombuffer(b"#$%&*@^~=<>_+\\{}[]", np.uint8)
_ENDS = frozenset(b"#$%&*@^~=<>_+\\{}[]!|")


def text_stats(text: str | None) -> list[float]:
    """The statistics of one text; all zero where it has no words. Null counts as empty."""
    data = text.encode() if text else b""
    words = data.split()
    if not words:
        return [0.0] * len(STATS)
    size, n = len(data), len(words)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, wide = int(seen[_UPPER].sum()), int(seen[_LOWER].sum()), int(seen[128:].sum())
    letters = upper + lower
    black = sum(map(len, words))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    ended = capitals = marked = 0
    for w in counts:
        c = counts[w]
        last = w[-1]
        if last in b".,;:?":
            ended += c
        elif last in _ENDS:
            marked += c
        if len(w) > 1 and w.isupper():
            capitals += c
    return [
        float(np.log1p(size)),
        float(np.log1p(n)),
        black / n,
        (letters + wide) / black,
        upper / max(letters, 1),
        int(seen[_SYMBOLS].sum()) / black,
        int(seen[33]) / n,
        int(seen[124]) / n,
        int(seen[48:58].sum()) / black,
        wide / black,
        sum(map(eq, words, words[1:])) / n,
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        float(np.log1p(size / len(lines))),
        ended / n,
        capitals / n,
        marked / n,
    ]


def add_stats(df: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """Add `out`, the statistics of column `text` in the order of STATS (array<double>)."""

    small_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        flat = np.array([text_stats(x.as_py()) for x in texts], np.float64).reshape(-1)
        at = np.arange(len(texts) + 1, dtype=np.int32) * len(STATS)
        return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))

    return df.withColumn(out, of(F.col(text)))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, above or not, threshold)."""

    terms: tuple[tuple[int, bool, float], ...]

    def column(self, stats: Column) -> Column:
        hit = F.lit(True)
        for k, above, t in self.terms:
            hit = hit & (stats[k] > t if above else stats[k] <= t)
        return hit

    def array(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for k, above, t in self.terms:
            hit &= (x[:, k] > t) == above
        return hit


@dataclass(frozen=True)
class Model:
    intercept: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def score(self, stats: Column) -> Column:
        total = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(stats), F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score_array(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            total += w * rule.array(x)
        return 1 / (1 + np.exp(-total))


def _grow(codes: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, list[Rule]]:
    """A tree by second-order gain; its leaf value for each row, and the path to each node."""
    value, rules = np.zeros(len(codes)), []
    open_ = [(np.arange(len(codes)), ())]
    for depth in range(DEPTH + 1):
        below = []
        for rows, path in open_:
            if path:
                rules.append(Rule(path))
            g, h = gradient[rows], hessian[rows]
            value[rows] = g.sum() / (h.sum() + 1)
            best, total_g, total_h = (1e-3, -1, 0), g.sum(), h.sum()
            if depth == DEPTH or len(rows) < 20:
                continue
            for k, cut in enumerate(cuts):
                if not len(cut):
                    continue
                code = codes[rows, k]
                left_g = np.cumsum(np.bincount(code, g, len(cut) + 1))[:-1]
                left_h = np.cumsum(np.bincount(code, h, len(cut) + 1))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), k, at))
            _, k, at = best
            if k < 0:
                continue
            above = codes[rows, k] > at
            for side in (False, True):
                part = rows[above == side]
                if len(part):
                    below.append((part, (*path, (k, side, float(cuts[k][at])))))
        open_ = below
    return value, rules


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Logistic weights with an absolute-value penalty, by accelerated proximal gradient steps."""
    spread = r.std(axis=0) + 0.05
    z = r / spread
    step = 4.0 / (np.linalg.norm(z[:: max(1, len(z) // 4000)], 2) ** 2 / min(len(z), 4000) + 1)
    w = last = np.zeros(r.shape[1])
    b = float(np.log(y.mean() / (1 - y.mean())))
    for t in range(ROUNDS):
        ahead = w + t / (t + 3) * (w - last)
        error = 1 / (1 + np.exp(-(b + z @ ahead))) - y
        last = w
        w = ahead - step * (z.T @ error) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b -= step * float(error.mean())
    return b, w / spread


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of P(label 1). With no rows, or rows of one label, it is a constant."""
    if not len(y):
        return Model(0.0)
    if y.min() == y.max():
        return Model(4.0 if y[0] else -4.0)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    cuts = [c[c < col.max()] for c, col in zip(cuts, x.T, strict=True)]
    codes = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    total, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        value, found = _grow(codes, cuts, y - p, p * (1 - p))
        total += RATE * value
        rules.update(dict.fromkeys(found))
    matrix, kept = {}, []
    for rule in rules:
        hit = rule.array(x)
        if 3 <= hit.sum() <= len(y) - 3 and (key := hit.tobytes()) not in matrix:
            matrix[key] = hit
            kept.append(rule)
    if not kept:
        return Model(float(np.log(y.mean() / (1 - y.mean()))))
    b, w = _lasso(np.stack(list(matrix.values()), axis=1).astype(np.float64), y, PENALTY)
    some = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(b, tuple(kept[k] for k in some), tuple(float(w[k]) for k in some))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = FOLDS, held: int = 0, max_rows: int = MAX_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold, at most max_rows of them.

    The sample is the rows with the smallest hashes of their id; its ids are broadcast, so
    texts do not move. Its statistics, max_rows x len(STATS) numbers, come to the driver. An id that several
    documents have counts once, with the least statistics, so it weighs no more than another.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & (held_fold(F.col("doc_id"), folds) != held))
        .select(F.col("doc_id").alias("_id"), F.col(label).cast("double").alias("_y"))
        .distinct()
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(max_rows)
    )
    known = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    found = add_stats(known, "_text", "_stats").groupBy("_doc", "_y").agg(F.min("_stats").alias("_stats")).toPandas()
    found = found.sort_values(["_doc", "_y"], kind="stable")
    if not len(found):
        return Model(0.0)
    return fit(np.stack(found["_stats"].to_numpy()).astype(np.float64), found["_y"].to_numpy(np.float64))


def classify(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (P of label 1) and predicted (1 where score >= threshold).

    Null and empty texts are scored by their statistics, all zero. Columns of these names
    are replaced; others pass through.
    """
    scored = add_stats(df, text, "_stats").withColumn("score", model.score(F.col("_stats"))).drop("_stats")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected, columns as before, whatever their names."""
    packed = df.select(F.col(text).alias("_text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    return classify(packed, model, "_text", threshold).where("predicted = 1").select("_row.*")
