"""Combining aligned predictions of several models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .metrics import clipped
from .ranking import avg_rank01


def wide(parts: dict[str, DataFrame], keys: list[str], tasks: int | None = None) -> DataFrame:
    """One row per key with the label ``y`` and one column per model; missing or conflicting rows are an error.

    ``tasks`` sets how many tasks share the rows, in place of the session's partition count.
    """
    long = reduce(DataFrame.unionByName, [d.select(*keys, "y", "p", F.lit(n).alias("model")) for n, d in parts.items()])
    long = long.repartition(tasks, *keys) if tasks else long
    out = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.min("y").alias("y"), F.max("y").alias("__y"), *[F.max(F.when(F.col("model") == n, F.col("p"))).alias(n) for n in parts])
    ok = (F.col("__n") == len(parts)) & (F.col("y") == F.col("__y")) & reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in parts])
    fail = F.raise_error(F.lit("models are not aligned by key and label")).cast("int")
    return out.withColumn("y", F.when(ok, F.col("y")).otherwise(fail)).drop("__n", "__y")


def blend(parts: dict[str, DataFrame], keys: list[str], how: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Mean, median, rank average or weighted mean of the models' probabilities."""
    names = list(parts)
    if how == "rank":
        long = reduce(DataFrame.unionByName, [d.select(*keys, "y", "p", F.lit(n).alias("model")) for n, d in parts.items()])
        ranked = avg_rank01(cut(long), ["model"], "p")
        return ranked.groupBy(*keys).agg(F.min("y").alias("y"), F.avg("rank01").alias("p"))
    df = wide(parts, keys)
    cols = F.array(*names)
    if how == "mean":
        p = F.aggregate(cols, F.lit(0.0), lambda a, x: a + x) / len(names)
    elif how == "median":
        s, m = F.array_sort(cols), len(names) // 2
        p = F.get(s, F.lit(m)) if len(names) % 2 else (F.get(s, F.lit(m - 1)) + F.get(s, F.lit(m))) / 2
    elif how == "weighted":
        p = reduce(lambda a, b: a + b, [F.col(n) * float(weights[n]) for n in names])
    else:
        raise ValueError(f"unknown blend {how}")
    return df.select(*keys, "y", p.alias("p"))


def _simplex(v: np.ndarray) -> np.ndarray:
    """Euclidean projection onto the probability simplex."""
    u = np.sort(v)[::-1]
    excess = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    out = np.maximum(v - excess[np.nonzero(u > excess)[0][-1]], 0)
    return out / out.sum()


def _cap(w: np.ndarray, inside: np.ndarray, cap: float) -> np.ndarray:
    """Scale a subset's total weight down to the cap and the others up accordingly."""
    total = w[inside].sum()
    if not inside.any() or total <= cap:
        return w
    if inside.all():
        raise ValueError("the cap leaves no other model")
    rest = w[~inside].sum()
    out = np.where(inside, w * cap / total, w * (1 - cap) / rest if rest else (1 - cap) / (~inside).sum())
    return out


def fit_blend_weights(
    parts: dict[str, DataFrame], keys: list[str], shrinkage: float, capped: list[str] = (), cap: float = 1.0, rate: float = 0.1, iterations: int = 200, tol: float = 1e-8, tasks: int | None = None,
) -> dict[str, float]:
    """Non-negative weights summing to 1 by projected gradient on log loss, shrunk to uniform.

    Each step is one aggregate of as many sums as there are models.
    """
    names = list(parts)
    df = cut(wide(parts, keys, tasks).select("y", *names))
    n, k = df.count(), len(names)
    inside = np.array([m in capped for m in names])
    w = _cap(np.full(k, 1 / k), inside, cap)
    for _ in range(iterations):
        p = clipped(reduce(lambda a, b: a + b, [F.col(m) * float(x) for m, x in zip(names, w)]), 1e-12)
        d = (p - F.col("y")) / (p * (1 - p))
        g = df.agg(*[F.sum(d * F.col(m)).alias(m) for m in names]).first()
        step = np.array([g[m] for m in names]) / n + 2 * shrinkage * (w - 1 / k)
        new = _cap(_simplex(w - rate * step), inside, cap)
        done = np.max(np.abs(new - w)) <= tol
        w = new
        if done:
            break
    return dict(zip(names, (float(x) for x in w)))


def validate_predictions(df: DataFrame, fold: str, last_date: str) -> DataFrame:
    """One row of violation counts over a prediction table."""
    d = F.col("event_date")
    bad = {
        "wrong_boundary": F.col("boundary") != "Original", "future_rows": d > F.lit(last_date).cast("date"), "wrong_fold": F.col("fold") != fold,
        "contaminated_context": F.col("context_max_date").isNull() | (F.col("context_max_date") >= d),
        "bad_probability": F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1),
    }
    return df.agg(F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in bad.items()])


def mixture(decision: Column, win_decision: Column, win_finish: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """P(win) from the decision/finish split, kept in [low, high]."""
    p = decision * win_decision + (1 - decision) * win_finish
    return F.greatest(F.least(p, F.lit(high)), F.lit(low))


def shrink(p: Column, prior: Column, support: Column, strength: float) -> Column:
    """Move a specialist probability towards its prior by support / (support + strength)."""
    w = F.coalesce(F.try_divide(support, support + strength), F.lit(0.0))
    return w * p + (1 - w) * prior
