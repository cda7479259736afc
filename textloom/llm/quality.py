"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on samples of labelled documents give conjunctive rules, one for each node; a
lasso logistic regression weighs them and drops most. What is left is compiled into one
Spark expression over statistics that Spark's own functions compute.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import table
from textloom.llm.language_id import remainder

#: Bounds of the fit: labelled documents of each class; trees and their depth, and so the rules: 14 a tree at most.
MAX_EACH, TREES, DEPTH = 4_000, 40, 3
#: Loss (nats a document) that fewer rules may cost.
SLACK = 0.02
SPACE = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of ``_t`` (whole text) and ``_w`` (its words) as doubles; shares of nothing are 0."""
    n_chars, n_words = F.length("_t"), F.size("_w")
    lines = F.filter(F.split("_t", "\n"), lambda x: x != "")

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0)

    def chars(mark: str) -> Column:
        return share(n_chars - F.length(F.replace("_t", F.lit(mark), F.lit(""))), n_chars)

    return {
        "n_words": n_words.cast("double"),
        "word_length": share(n_chars - n_words, n_words),
        "longest_word": F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0)).cast("double"),
        "distinct_words": share(F.size(F.array_distinct("_w")), n_words),
        "upper": share(F.regexp_count("_t", F.lit("[A-Z]")), n_chars),
        "symbols": share(F.regexp_count("_t", F.lit("[#*$%&<>]")), n_chars),
        "digits": share(F.regexp_count("_t", F.lit("[0-9]")), n_chars),
        "bars": chars("|"),
        "exclamations": chars("!"),
        "full_stops": chars("."),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "words_per_line": share(n_words, F.size(lines)),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """``docs`` with a column for each statistic of its whole texts (null: empty), and their names."""
    base = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    base = base.withColumn("_w", F.filter(F.split("_t", SPACE), lambda x: x != ""))
    columns = statistics(F.col("_t"))
    return base.withColumns({f"_{k}": c for k, c in columns.items()}).drop("_t", "_w"), [f"_{k}" for k in columns]


@dataclass(frozen=True)
class Rule:
    """All of ``tests`` (feature number, above, threshold) hold."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, above, t in self.tests:
            out &= (x[:, k] > t) == above
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for k, above, t in self.tests:
            out = out & (F.col(names[k]) > t if above else F.col(names[k]) <= t)
        return out


def _grow(x: np.ndarray, y: np.ndarray, columns: np.ndarray, depth: int, path: tuple, out: list[Rule], least: int) -> None:
    """Split where the summed Gini impurity falls most; every node below the root is a rule."""
    if path:
        out.append(Rule(tuple(sorted(path))))
    if not depth or len(y) < 2 * least or y.min() == y.max():
        return
    best = None
    for k in columns:
        for t in np.unique(np.quantile(x[:, k], np.linspace(0.02, 0.98, 25))):
            left = x[:, k] <= t
            n = left.sum()
            if least <= n <= len(y) - least:
                p, q = y[left].mean(), y[~left].mean()
                cost = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                if best is None or cost < best[0] - 1e-12:
                    best = cost, k, float(t), left
    if best is None:
        return
    _, k, t, left = best
    for side, above in ((left, False), (~left, True)):
        _grow(x[side], y[side], columns, depth - 1, (*path, (int(k), above, t)), out, least)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> list[Rule]:
    """Distinct rules of trees that each see a part of the rows and of the features."""
    rng = np.random.default_rng(seed)
    found: dict[Rule, None] = {}
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    for _ in range(trees):
        rows = np.concatenate([rng.choice(c, min(len(c), 400)) for c in classes])
        columns = rng.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False)
        own: list[Rule] = []
        _grow(x[rows], y[rows], np.sort(columns), depth, (), own, 5)
        found.update(dict.fromkeys(own))
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, strength: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic regression, by accelerated proximal steps."""
    n, m = r.shape
    full = np.hstack([np.ones((n, 1)), r])
    step = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ v, -35, 35)))
        u = v - step * (full.T @ (p - y)) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * strength, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = u + (before - 1) / t * (u - w)
        w = u
    return float(w[0]), w[1:]


@dataclass
class Model:
    names: list[str]
    rules: list[tuple[Rule, float]]
    intercept: float

    def score(self) -> Column:
        """The model as one expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], rate: float) -> Model:
    """Rules, and weights at the greatest penalty whose loss on a fifth set aside is near the best; ``rate`` is the share of 1 in all labels."""
    if len(y) == 0 or y.min() == y.max():
        return Model(names, [], float(np.log(rate / (1 - rate))))
    rules = tree_rules(x, y)
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    aside = np.arange(len(y)) % 5 == 0
    losses = {}
    for strength in (0.1, 0.03, 0.01, 0.003, 0.001):
        b, w = lasso(r[~aside], y[~aside], strength)
        z = np.clip(r[aside] @ w + b, -35, 35)
        losses[strength] = np.mean(np.log1p(np.exp(z)) - y[aside] * z)
    chosen = max(s for s, loss in losses.items() if loss <= min(losses.values()) + SLACK)
    b, w = lasso(r, y, chosen)
    drawn = min(max(y.mean(), 1e-3), 1 - 1e-3)
    b += float(np.log(rate / (1 - rate)) - np.log(drawn / (1 - drawn)))  # the draw's classes are not as frequent as all labels' are
    return Model(names, [(rule, float(k)) for rule, k in zip(rules, w) if abs(k) > 1e-6], b)


def one_label(labels: DataFrame, key: str, label: str) -> DataFrame:
    """``key``, ``label``: a row for each key with labels of 0 and 1, the greatest of them."""
    known = labels.select(F.col(key).cast("long").alias("key"), F.col(label).cast("int").alias("label"))
    return known.filter("label IN (0, 1) AND key IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "label", key: str = "doc_id", max_each: int = MAX_EACH, seed: int = 11) -> Model:
    """Fit on about ``max_each`` labelled documents of each class at most, drawn by a hash of their key.

    Their statistics, a bounded table, come to the driver. Labels other than 0 and 1 are left
    out, and a key that has several counts once, as 1 if any of them is; one class, or none,
    gives that class's rate (a half if none) for every text.
    """
    known = one_label(labels, key, label).toDF("_key", "_label")
    sizes = dict(known.groupBy("_label").count().collect())
    rate = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    share = F.when(F.col("_label") == 1, min(1.0, max_each / max(1, sizes.get(1, 0)))).otherwise(min(1.0, max_each / max(1, sizes.get(0, 0))))
    drawn = known.filter(F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    own = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_key")  # at most about 2 * max_each rows
    rows, names = with_statistics(own, "_text")
    got = rows.select("_key", "_label", *names).toPandas().sort_values(["_key", *names])
    order = np.argsort((got["_key"].to_numpy(np.int64) * 2654435761) % (1 << 32), kind="stable")
    x, y = got[names].to_numpy(float)[order], got["_label"].to_numpy(float)[order]
    return fit_rules(x, y, names, rate)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``score``: every whole text, by built-in functions only; null texts are empty, and empty ones have a score.

    Rows stay apart, whatever their id, null ones too; texts are read whole, however long; other columns are not read.
    """
    rows, _ = with_statistics(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text")), "_text")
    return rows.select("doc_id", model.score().alias("score"))


def learn_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select("doc_id", F.col("quality").alias("label")).filter(remainder("doc_id", 3) != 1)
    found = score(docs, fit(docs, known))
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learn_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
