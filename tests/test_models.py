"""Metrics, calibration, blending and tuning against direct computation."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.operators import blend, metrics, tune


@pytest.fixture(scope="module")
def preds(spark):
    rng = np.random.default_rng(2)
    p = np.round(rng.uniform(0.02, 0.98, 1500), 3)
    y = (rng.random(1500) < 1 / (1 + np.exp(-(0.2 + 0.8 * np.log(p / (1 - p)))))).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "id bigint, p double, y int")
    df.cache().count()
    return df, p, y


def test_metrics_and_auc(preds):
    df, p, y = preds
    r = metrics.metrics(df).first()
    assert r["row_count"] == 1500 and r["accuracy"] == pytest.approx(((p >= 0.5) == y).mean())
    assert r["log_loss"] == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    assert metrics.auc(df).first()["auc"] == pytest.approx(((a > b) + 0.5 * (a == b)).mean())


def test_calibration_fits(preds):
    df, p, y = preds
    a, b = metrics.calibration_line(df)
    x = np.log(p / (1 - p))
    fit = 1 / (1 + np.exp(-(a + b * x)))
    assert abs((y - fit).sum()) < 1e-6 and abs(((y - fit) * x).sum()) < 1e-6
    slope, icept = metrics.fit_platt(df, 1e6)
    assert (icept, slope) == pytest.approx((a, b), abs=1e-4)
    model, why = metrics.fit_isotonic(df.select("p", "y"), 100, 20, 10)
    assert why is None
    out = metrics.apply_isotonic(df.select("id", "p", "y"), model, 1.0).orderBy("id").toPandas()
    order = np.argsort(p)
    assert (np.diff(out.p.to_numpy()[order]) >= -1e-12).all()
    assert metrics.fit_isotonic(df.limit(5).select("p", "y"), 100, 20, 10) == (None, "minimum_support")
    ens = metrics.isotonic_ensemble(df, "id", 5, 1).agg(F.min("calibrated"), F.max("calibrated")).first()
    assert 0.01 <= ens[0] <= ens[1] <= 0.99


def test_blend_weights_prefer_the_better_model(preds):
    df, p, _ = preds
    noise = df.withColumn("p", F.lit(0.5) + (F.col("id") % 7 - 3) / 20)
    w = blend.fit_blend_weights({"good": df, "noise": noise}, ["id"], 0.0, rate=0.5, iterations=60)
    assert sum(w.values()) == pytest.approx(1.0) and w["good"] > 0.7
    capped = blend.fit_blend_weights({"good": df, "noise": noise}, ["id"], 0.0, capped=["good"], cap=0.3, rate=0.5, iterations=20)
    assert capped["good"] <= 0.3 + 1e-9


def test_misaligned_predictions_fail(preds):
    df, _, _ = preds
    with pytest.raises(Exception, match="not aligned"):
        metrics.paired_delta(df, df.filter("id > 3"), ["id"]).collect()


def test_log_gamma_expression(spark):
    xs = [1e-6, 0.01, 0.5, 1.0, 2.0, 3.7, 10.0, 250.25, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tune.lgamma(F.col("x"))).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_tau_recovers_the_simulated_strength(spark):
    rng = np.random.default_rng(0)
    n = rng.integers(3, 30, 6000)
    k = rng.binomial(n, rng.beta(0.3 * 8, 0.7 * 8, 6000))
    df = spark.createDataFrame([("a" if i % 2 else "b", int(a), int(b), bool(i < 3000)) for i, (a, b) in enumerate(zip(k, n))], "g string, k int, n int, tr boolean")
    out = {r["grp"]: r for r in tune.tune_tau(df, "k", "n", "g", F.col("tr"), "binomial", 1.0, 20.0).collect()}
    assert 5.5 < out["*"]["tau"] < 11 and not out["a"]["use_group"]
