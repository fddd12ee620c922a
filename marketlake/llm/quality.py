"""Operator 10, quality classifier: a sparse rule ensemble.

Statistics of the text are Spark columns. On a bounded sample of labelled rows (``SAMPLE``, by hash of the id) small
boosted trees are grown; every path from a root is a conjunctive rule; a lasso logistic regression weighs the rules, and those with
weight become Spark column expressions, so that scoring is a projection over the whole table with no Python.

Defined results: a null or empty text has statistics 0 and gets a score like any other; without labels, or with one class,
the score is the smoothed share of label 1; of repeated labels the greatest counts; a null label or id is no label.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

SAMPLE, TREES, DEPTH, CUTS, RATE = 8_000, 24, 3, 24, 0.3
LASSO, ROUNDS, THRESHOLD = 0.002, 300, 0.3
SYMBOLS, UPPER, DIGITS = "$%&*#!|<>{}~^=", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SPACE = r"[\x20\x09-\x0D]+"
FEATURES = ("log_words", "word_length", "symbols", "uppercase", "digits", "distinct_words", "distinct_lines", "line_words")


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts; ratios of nothing are 0."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    lines = F.split(t, "\n")
    no_symbols = F.translate(t, SYMBOLS, "")
    no_upper = F.translate(no_symbols, UPPER, "")
    no_digits = F.translate(no_upper, DIGITS, "")
    n, n_words = F.length(t), F.size(words)
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return {
        "log_words": F.log1p(n_words.cast("double")),
        "word_length": share(n, n_words),
        "symbols": share(n - F.length(no_symbols), n),
        "uppercase": share(F.length(no_symbols) - F.length(no_upper), n),
        "digits": share(F.length(no_upper) - F.length(no_digits), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": F.log1p(share(n_words, F.size(lines))),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature index, whether above, cut)."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, cut in self.terms:
            out &= (x[:, f] > cut) if above else (x[:, f] <= cut)
        return out

    def column(self, features: list[str]) -> Column:
        out = F.lit(True)
        for f, above, cut in self.terms:
            c = F.col(features[f])
            out = out & ((c > cut) if above else (c <= cut))
        return out


@dataclass(frozen=True)
class Model:
    intercept: float
    weights: tuple[tuple[float, Rule], ...]

    def score(self, features: list[str]) -> Column:
        total = F.lit(self.intercept)
        for w, rule in self.weights:
            total = total + F.when(rule.column(features), F.lit(w)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], terms: tuple, rules: set, out: np.ndarray) -> None:
    """Splits ``rows`` where the second-order gain is best; notes each node's path as a rule and leaf steps in ``out``."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    if terms:
        rules.add(Rule(terms))
    best = (1e-6, None)
    if len(terms) < DEPTH:
        for f, edges in enumerate(cuts):
            if not len(edges):
                continue
            cell = np.searchsorted(edges, x[rows, f], side="left")
            gl = np.cumsum(np.bincount(cell, gradient[rows], len(edges) + 1))[:-1]
            hl = np.cumsum(np.bincount(cell, hessian[rows], len(edges) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(hl < 1) | (h - hl < 1)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), (f, float(edges[k])))
    if best[1] is None:
        out[rows] += RATE * g / (h + 1)
        return
    f, cut = best[1]
    low = x[rows, f] <= cut
    _grow(x, gradient, hessian, rows[low], cuts, (*terms, (f, False, cut)), rules, out)
    _grow(x, gradient, hessian, rows[~low], cuts, (*terms, (f, True, cut)), rules, out)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted trees give rules; lasso logistic regression (accelerated proximal gradient) weighs them."""
    share = (y.sum() + 1) / (len(y) + 2)
    start = math.log(share / (1 - share))
    if len(y) < 20 or y.min() == y.max():
        return Model(start, ())
    # Cuts lie midway between quantiles that differ: a value slightly off the common one is not taken for the other class.
    steps = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2), method="nearest")) for f in range(x.shape[1])]
    cuts = [(s[1:] + s[:-1]) / 2 for s in steps]
    rules: set[Rule] = set()
    margin = np.full(len(y), start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        _grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, (), rules, margin)
    ordered = sorted(rules, key=lambda r: (len(r.terms), r.terms))
    a = np.stack([r.holds(x) for r in ordered], axis=1).astype(np.float64)
    w, b = np.zeros(a.shape[1]), start
    v, c, t = w.copy(), b, 1.0
    rate = 4.0 * len(y) / (np.linalg.norm(a, 2) ** 2 + len(y))
    for _ in range(ROUNDS):
        error = 1 / (1 + np.exp(-(a @ v + c))) - y
        step = v - rate * (a.T @ error) / len(y)
        w_next = np.sign(step) * np.maximum(np.abs(step) - rate * LASSO, 0)
        b_next, t_next = c - rate * error.mean(), (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return Model(float(b), tuple((float(k), r) for k, r in zip(w, ordered) if abs(k) > 1e-6))


def fold(doc_id: Column) -> Column:
    """0 to 4; fold 0 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled rows outside the held-out fold, the first by hash of the id."""
    named = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = named.where(fold(F.col("doc_id")) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = materialize(chosen.withColumnRenamed("doc_id", "_doc"), "sample")
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), F.col("_id") == F.col("_doc"))
    rows = rows.groupBy("_doc", "label").agg(F.max("text").alias("text"))
    table = rows.select("_doc", "label", *(c.alias(n) for n, c in statistics(F.col("text")).items())).toPandas().sort_values("_doc")
    return fit(table[list(FEATURES)].to_numpy(float), table["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) to each row; a column of that name is replaced, all others stay, whatever their names."""
    stats = statistics(F.col(text))
    # Columns of their own, not fields of a struct: each statistic is then computed once, however many rules read it.
    names = {n: f"_stat_{n}" for n in FEATURES}
    while set(names.values()) & set(docs.columns):
        names = {n: f"_{c}" for n, c in names.items()}
    with_stats = docs.drop("score").select("*", *(stats[n].alias(c) for n, c in names.items()))
    return with_stats.withColumn("score", model.score([names[n] for n in FEATURES])).drop(*names.values())


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted to be of low quality go.

    Defined results: null and empty texts are scored as empty ones; repeated rows are scored alike; a null doc_id has no label
    but a score; extra columns stay, whatever their names (``score`` and ``label`` too); without labels every document scores 0.5
    and stays; an empty table gives no rows.
    """
    model = train(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    return score(rows, model).where(F.col("score") >= THRESHOLD).select("row.*")
