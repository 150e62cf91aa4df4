"""Quality scores: random Fourier features, ridge from summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, null_ids, written
from .rules import count_of, measured

FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-2, 7
FOLDS, HELD_OUT, FIT, CALIBRATE = 3, 1, 0, 2
#: Scores are calibrated in this many steps, whatever the number of rows.
BINS = 1000

STATS = ["log_words", "log_lines", "word_length", "symbols", "dup_lines", "repeats", "bangs", "capitals", "digits", "distinct", "stops", "line_words", "log_longest"]


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns STATS, numbers from the whole text alone."""
    x = docs.withColumn("__text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    x = measured(x, "__text")
    words = F.filter(F.split("__text", "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    x = x.withColumns({"__distinct": F.size(F.array_distinct(words)), "__longest": F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0)), "__digits": count_of("__text", "[0-9]"), "__stops": count_of("__text", r"[.?](?:\s|$)")})
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return x.select(*[c for c in docs.columns], F.log1p("n_words").alias("log_words"), F.log1p("n_lines").alias("log_lines"), per("word_chars", "n_words").alias("word_length"), per("n_symbols", "n_words").alias("symbols"),
                    per("n_dup_lines", "n_lines").alias("dup_lines"), per("n_repeat_words", "n_words").alias("repeats"), per("n_bangs", "n_words").alias("bangs"), per("n_capitals", "word_chars").alias("capitals"), per("__digits", "word_chars").alias("digits"),
                    per("__distinct", "n_words").alias("distinct"), per("__stops", "n_words").alias("stops"), F.log1p(per("n_words", "n_lines")).alias("line_words"), F.log1p("__longest").alias("log_longest"))


def fold(id_col: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@dataclass(frozen=True)
class Model:
    """All that a score needs; its size does not depend on the data."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the kernel's frequencies
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6) @ self.weights + self.phase
        return np.hstack([np.sqrt(2 / len(self.phase)) * np.cos(z), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising fit to bin means by pooling neighbours that fall: (knots, values), values pulled off 0 and 1."""
    pools: list[list[float]] = []
    for a, s, m in zip(x, y, n):
        pools.append([a * m, s, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    return np.array([a / m for a, _, m in pools]), np.array([(s + 0.5) / (m + 1) for _, s, m in pools])


def fitted(rows: DataFrame, labels: DataFrame, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """The model from rows (doc_id, STATS) and the labels of the learning folds.

    Each task adds up its rows' outer products of the features with themselves and the label;
    the sums of all tasks meet cell by cell, so the driver gets (features + 2)² numbers at most.
    Calibration rows come from a fold of their own and reach the driver as sums of BINS bins.
    """
    rng = np.random.default_rng(seed)
    d = len(STATS)
    means = rows.agg(*[F.avg(c) for c in STATS], *[F.stddev_pop(c) for c in STATS]).first()
    mean, scale = (np.array([v or 0.0 for v in part]) for part in (means[:d], means[d:]))
    blank = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(size=(d, features)) / width, rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    y = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter("y is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = written(rows.withColumn("fold", fold("doc_id")).filter(F.col("fold") != HELD_OUT).join(y, "doc_id").select("fold", "y", *STATS), "labelled")
    size = features + 2

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros((size, size)), False
        for b in batches:
            z = np.hstack([blank.features(b[STATS].to_numpy(float)), b[["y"]].to_numpy(float)])
            total, seen = total + z.T @ z, True
        if seen:
            yield pd.DataFrame({"cell": np.arange(size * size), "value": total.ravel()})

    cells = np.zeros(size * size)
    for cell, value in known.filter(F.col("fold") == FIT).mapInPandas(sums, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        cells[cell] = value
    a = cells.reshape(size, size)
    if not a[-2, -2]:  # nothing to learn from
        return blank
    beta = np.linalg.solve(a[:-1, :-1] + ridge * np.diag([1.0] * features + [1e-9]), a[:-1, -1])
    model = Model(blank.mean, blank.scale, blank.weights, blank.phase, beta, blank.knots, blank.values)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            r = model.raw(b[STATS].to_numpy(float))
            yield pd.DataFrame({"bin": np.clip((r + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32), "r": r, "y": b["y"]})

    bins = known.filter(F.col("fold") == CALIBRATE).mapInPandas(binned, "bin int, r double, y double").groupBy("bin").agg(F.avg("r"), F.sum("y"), F.count(F.lit(1))).orderBy("bin").collect()
    if not bins:
        return Model(blank.mean, blank.scale, blank.weights, blank.phase, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, values = isotonic(*(np.array(c, float) for c in list(zip(*bins))[1:]))
    return Model(blank.mean, blank.scale, blank.weights, blank.phase, beta, knots, values)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted, n_words).

    The statistics of every whole text are computed once and written; they alone enter the model.
    A null or empty text has statistics of 0 and gets their score; a null id is never labelled
    and not held out; several labels of one id count by their mean; without labels every score
    is 0.5; repeated rows are scored each; other columns are not looked at.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(statistics(rows).drop("text"), "statistics")
    model = fitted(rows.filter(F.col("doc_id") != NULL_ID), labels, **options)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = model.score(b[STATS].to_numpy(float))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32), "n_words": np.rint(np.expm1(b["log_words"])).astype(np.int64)})

    scored = null_ids(rows.mapInPandas(run, "doc_id bigint, score double, predicted int, n_words bigint"))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted", "n_words")
