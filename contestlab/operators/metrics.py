"""Prediction metrics, reliability, AUC, calibration, comparison and bootstrap."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored
from .isotonic import PIECE, interpolated, isotonic_blocks
from .ranking import cumulate

METRICS = ["row_count", "correct_count", "accuracy", "log_loss", "brier"]


def clipped(p: Column, eps: float) -> Column:
    return F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = clipped(p, eps)
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def logit(p: Column, eps: float = 1e-8) -> Column:
    q = clipped(p, eps)
    return F.ln(q / (1 - q))


def metric_columns(p: str = "p", y: str = "y", eps: float = 1e-15) -> list[Column]:
    pc, yc = F.col(p), F.col(y)
    hit = (pc >= 0.5).cast("int") == yc
    return [
        F.count(F.lit(1)).alias("row_count"), F.count_if(hit).alias("correct_count"), F.avg(hit.cast("double")).alias("accuracy"),
        F.avg(log_loss(pc, yc, eps)).alias("log_loss"), F.avg((pc - yc) * (pc - yc)).alias("brier")]


def metrics(df: DataFrame, by: list[str] = (), eps: float = 1e-15) -> DataFrame:
    """Count, hits, accuracy, log loss and Brier score, overall or by columns, in one aggregate."""
    return df.groupBy(*by).agg(*metric_columns(eps=eps)) if by else df.agg(*metric_columns(eps=eps))


def metrics_by_slice(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """The same metrics for every value of every slice, from one pass over the rows.

    Rows are first reduced to sums per combination of slice values, so only
    combinations are unpivoted.
    """
    yc, pc = F.col("y"), F.col("p")
    hit = ((pc >= 0.5).cast("int") == yc).cast("bigint")
    sums = df.select(*[c.cast("string").alias(n) for n, c in slices.items()], hit.alias("h"), log_loss(pc, yc).alias("l"), ((pc - yc) * (pc - yc)).alias("b"))
    cells = sums.groupBy(*slices).agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h"), F.sum("l").alias("l"), F.sum("b").alias("b"))
    long = cells.select(F.explode(F.array(*[F.struct(F.lit(n).alias("slice"), F.col(n).alias("value")) for n in slices])).alias("s"), "n", "h", "l", "b")
    out = long.groupBy("s.slice", "s.value").agg(*[F.sum(c).alias(c) for c in ("n", "h", "l", "b")])
    n = F.col("n")
    return out.select("slice", "value", n.alias("row_count"), F.col("h").alias("correct_count"), (F.col("h") / n).alias("accuracy"),
                      (F.col("l") / n).alias("log_loss"), (F.col("b") / n).alias("brier"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """One row per equal-width bin (empty ones with nulls): count, mean p, observed rate, share of the ECE."""
    inner = F.array(*[F.lit(float(e)) for e in np.linspace(0.0, 1.0, bins + 1)[1:-1]])
    b = F.size(F.filter(inner, lambda e: e <= F.col("p")))
    seen = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("observed"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    gap = F.col("n") / total * F.abs(F.col("mean_p") - F.col("observed"))
    return spine.join(seen, "bin", "left").select(
        "bin", (F.col("bin") / bins).alias("lower"), ((F.col("bin") + 1) / bins).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"),
        "mean_p", "observed", F.coalesce(gap, F.lit(0.0)).alias("ece_part"))


def ece(df: DataFrame, bins: int = 10) -> DataFrame:
    return reliability(df, bins).agg(F.sum("ece_part").alias("ece"))


def auc(df: DataFrame) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties one half, from counts per distinct score."""
    dist = df.groupBy("p").agg(F.sum(F.col("y").cast("bigint")).alias("pos"), F.sum((1 - F.col("y")).cast("bigint")).alias("neg"))
    cum = cumulate(cut(dist), [], "p", ["pos", "neg"])
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return cum.agg(F.try_divide(wins, (F.max("pos_all") * F.max("neg_all")).cast("double")).alias("auc"))


def calibration_line(df: DataFrame, steps: int = 50, tol: float = 1e-10) -> tuple[float, float]:
    """Intercept and slope of the label on logit(p): Newton steps, each one aggregate of five sums."""
    rows = cut(df.select(logit(F.col("p")).alias("x"), F.col("y").cast("double").alias("y")))
    beta = np.array([0.0, 1.0])
    for _ in range(steps):
        z = F.greatest(F.least(F.lit(float(beta[0])) + float(beta[1]) * F.col("x"), F.lit(30.0)), F.lit(-30.0))
        fit = 1 / (1 + F.exp(-z))
        w = F.greatest(fit * (1 - fit), F.lit(1e-8))
        r = F.col("y") - fit
        s = rows.agg(F.sum(w), F.sum(w * F.col("x")), F.sum(w * F.col("x") * F.col("x")), F.sum(r), F.sum(r * F.col("x"))).first()
        step = np.linalg.pinv(np.array([[s[0], s[1]], [s[1], s[2]]])) @ np.array([s[3], s[4]])
        beta = beta + step
        if float(np.max(np.abs(step))) < tol:
            break
    return float(beta[0]), float(beta[1])


def _aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate and baseline side by side; unmatched rows or labels are an error."""
    left = a.select(*keys, F.col("p").alias("pa"), F.col("y").alias("ya"))
    right = b.select(*keys, F.col("p").alias("pb"), F.col("y").alias("yb"))
    both = left.join(right, keys, "full_outer")
    fine = F.col("ya").isNotNull() & F.col("yb").isNotNull() & (F.col("ya") == F.col("yb"))
    fail = F.raise_error(F.lit("predictions are not aligned by key and label")).cast("double")
    return both.select(*keys, F.col("ya").alias("y"), F.when(fine, F.col("pa")).otherwise(fail).alias("pa"), F.col("pb"))


def _delta_terms() -> dict[str, Column]:
    y = F.col("y")

    def hit(p: str) -> Column:
        return ((F.col(p) >= 0.5).cast("int") == y).cast("double")

    return {
        "log_loss_delta": log_loss(F.col("pa"), y) - log_loss(F.col("pb"), y),
        "brier_delta": (F.col("pa") - y) * (F.col("pa") - y) - (F.col("pb") - y) * (F.col("pb") - y),
        "accuracy_delta": hit("pa") - hit("pb"),
    }


def paired_delta(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate minus baseline: log loss, Brier, accuracy."""
    return _aligned(a, b, keys).agg(*[F.avg(c).alias(n) for n, c in _delta_terms().items()])


def block_bootstrap(a: DataFrame, b: DataFrame, keys: list[str], event: str, iterations: int, seed: int) -> DataFrame:
    """Estimate and 95 % interval of the paired deltas, resampling whole events.

    Rows are reduced to sums per event first. Each event draws its number of copies
    per iteration from a seeded hash as a Poisson(1) count, so draws need no
    coordination and do not change with the partitioning.
    """
    terms = _delta_terms()
    per = _aligned(a, b, list(dict.fromkeys([*keys, event]))).groupBy(event).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(k) for k, c in terms.items()])
    per = cut(per)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("it").cast("string"), F.col(event).cast("string"))), 1, 13), 16, 10).cast("double") / float(16**13)
    mass, total, copies = math.exp(-1.0), 0.0, F.lit(0)
    for k in range(1, 18):
        total += mass
        copies = copies + F.when(F.col("u") >= total, 1).otherwise(0)
        mass /= k
    drawn = per.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("u", u).withColumn("k", copies)
    runs = drawn.groupBy("it").agg(*[F.try_divide(F.sum(F.col("k") * F.col(t)), F.sum(F.col("k") * F.col("n"))).alias(t) for t in terms])
    est = per.agg(*[(F.sum(t) / F.sum("n")).alias(t) for t in terms])
    cells = [F.struct(F.lit(t).alias("metric"), F.percentile(t, 0.025).alias("lower"), F.percentile(t, 0.975).alias("upper")) for t in terms]
    bounds = runs.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("r")).select("r.*")
    point = est.select(F.explode(F.array(*[F.struct(F.lit(t).alias("metric"), F.col(t).alias("estimate")) for t in terms])).alias("r")).select("r.*")
    return point.join(bounds, "metric").withColumns({"iterations": F.lit(iterations), "seed": F.lit(seed)})


def metric_gap(train: DataFrame, outer: DataFrame) -> DataFrame:
    """Training minus out-of-time accuracy, log loss and Brier."""
    names = ["accuracy", "log_loss", "brier"]
    a, b = metrics(train).first(), metrics(outer).first()
    return train.sparkSession.createDataFrame([tuple(a[n] - b[n] for n in names)], ", ".join(f"{n} double" for n in names))


def fit_platt(df: DataFrame, c: float, eps: float = 1e-6, max_iter: int = 100) -> tuple[float, float]:
    """(slope, intercept) of a logistic fit on logit(p) with penalty slope^2 / (2 c)."""
    rows = cut(df.select(logit(F.col("p"), eps).alias("x"), F.col("y").cast("double").alias("label")))
    vec = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows)
    n = rows.count()
    model = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-10).fit(vec)
    return float(model.coefficients[0]), float(model.intercept)


def apply_platt(p: Column, slope: float, intercept: float, eps: float = 1e-6) -> Column:
    return 1 / (1 + F.exp(-(slope * logit(p, eps) + intercept)))


def temperature_losses(df: DataFrame, low: float, high: float, step: float, strength: float, eps: float = 1e-6) -> DataFrame:
    """Objective per grid temperature: mean NLL of the tempered p plus strength * ln(T)^2; one aggregate."""
    grid = [low + i * step for i in range(int(round((high - low) / step)) + 1)]
    x = logit(F.col("p"), eps)
    rows = df.select(x.alias("x"), F.col("y").cast("double").alias("y"))
    losses = rows.agg(*[F.avg(log_loss(1 / (1 + F.exp(-F.col("x") / t)), F.col("y"), eps)).alias(f"t{i}") for i, t in enumerate(grid)])
    cells = [F.struct(F.lit(t).alias("temperature"), (F.col(f"t{i}") + strength * math.log(t) ** 2).alias("objective")) for i, t in enumerate(grid)]
    return losses.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def fit_temperature(losses: DataFrame) -> DataFrame:
    """The grid point with the lowest objective, the smaller temperature on ties."""
    return losses.agg(F.min_by(F.struct("temperature", "objective"), F.struct("objective", "temperature")).alias("r")).select("r.*")


def fit_isotonic(df: DataFrame, min_support: int, min_class: int, min_unique: int, piece: int = PIECE) -> tuple[DataFrame | None, str | None]:
    """Blocks of the isotonic fit of the label on p, or the reason why support is too thin."""
    n, ones, unique = df.agg(F.count(F.lit(1)), F.sum(F.col("y").cast("bigint")), F.approx_count_distinct("p", 0.02)).first()
    if unique < 2 * min_unique:
        unique = df.select("p").distinct().limit(min_unique).count()
    for bad, why in ((n < min_support, "minimum_support"), (min(ones or 0, n - (ones or 0)) < min_class, "minimum_class_support"), (unique < min_unique, "minimum_unique_probabilities")):
        if bad:
            return None, why
    # ties are merged first: one weighted point per distinct p
    return isotonic_blocks(df.groupBy("p").agg(F.sum(F.col("y").cast("double")).alias("s"), F.count(F.lit(1)).alias("w")), piece=piece), None


def apply_isotonic(df: DataFrame, blocks: DataFrame | None, weight: float) -> DataFrame:
    """p moved towards the isotonic value by ``weight``; unchanged without a fit or a p."""
    if blocks is None:
        return df
    fit = interpolated(df, blocks).select(F.col("p").alias("__p"), F.greatest(F.least("value", F.lit(1.0)), F.lit(0.0)).alias("__fit"))
    out = df.join(fit, F.col("p") == F.col("__p"), "left")
    return out.select(*[F.coalesce((1 - weight) * F.col("p") + weight * F.col("__fit"), F.col("p")).alias("p") if c == "p" else F.col(c) for c in df.columns])


def isotonic_ensemble(df: DataFrame, key: str, folds: int, seed: int, low: float = 0.01, high: float = 0.99, piece: int = PIECE) -> DataFrame:
    """Mean of isotonic fits, each leaving one hash fold out, values kept in [low, high].

    All folds are fitted in one pass: points per (fold, p) are the whole's without the fold's own.
    """
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("bigint")
    own = df.groupBy("p", (h % folds).cast("int").alias("fold")).agg(F.sum(F.col("y").cast("double")).alias("s"), F.count(F.lit(1)).alias("w"))
    whole = own.groupBy("p").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.collect_list(F.struct("fold", "s", "w")).alias("parts"))
    each = whole.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    part = F.get(F.filter("parts", lambda a: a["fold"] == F.col("fold")), F.lit(0))
    points = stored(each.select("fold", "p", (F.col("s") - F.coalesce(part["s"], F.lit(0.0))).alias("s"), (F.col("w") - F.coalesce(part["w"], F.lit(0))).alias("w")), "points")
    fits = interpolated(points, isotonic_blocks(points, ["fold"], piece=piece), ["fold"])
    mean = fits.groupBy(F.col("p").alias("__p")).agg(F.avg(F.greatest(F.least("value", F.lit(high)), F.lit(low))).alias("calibrated"))
    return df.join(mean, F.col("p") == F.col("__p"), "left").select(*df.columns, "calibrated")


def calibration_effect(df: DataFrame, before: str, after: str, bins: int = 10) -> DataFrame:
    """Log loss, Brier and ECE before and after, with the improvements (one row)."""
    rows = cut(df.select(F.col(before).alias("before"), F.col(after).alias("after"), "y"))
    out = {}
    for k in ("before", "after"):
        v = rows.select(F.col(k).alias("p"), "y")
        loss, brier = v.agg(F.avg(log_loss(F.col("p"), F.col("y"))), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).first()
        out |= {f"log_loss_{k}": loss, f"brier_{k}": brier, f"ece_{k}": ece(v, bins).first()[0]}
    out |= {f"{m}_gain": out[f"{m}_before"] - out[f"{m}_after"] for m in ("log_loss", "brier", "ece")}
    return df.sparkSession.createDataFrame([tuple(out.values())], ", ".join(f"{n} double" for n in out))


def swap_check(df: DataFrame, p: str, p_swapped: str) -> DataFrame:
    """Per row: residual of complementarity and the averaged probability."""
    a, b = F.col(p), F.col(p_swapped)
    return df.withColumns({"residual": F.abs(a + b - 1), "p_avg": (a + (1 - b)) / 2})


def compare_market(df: DataFrame, market1: str, market2: str, eps: float = 1e-15) -> DataFrame:
    """Model against the market-implied winner on rows with closing prices for both sides."""
    rows = df.filter(F.col(market1).isNotNull() & F.col(market2).isNotNull())
    pick = (F.col(market1) > F.col(market2)).cast("int")
    y = F.col("y")
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.avg((pick == y).cast("double")).alias("market_accuracy"), F.avg(log_loss(F.col(market1), y, eps)).alias("market_log_loss"),
        F.avg(((F.col("p") >= 0.5).cast("int") == y).cast("double")).alias("model_accuracy"), F.avg(log_loss(F.col("p"), y, eps)).alias("model_log_loss"))
