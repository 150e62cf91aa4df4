"""Isotonic blocks over many small pieces against pooling in one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contestlab.operators import isotonic, metrics


def plain(x, y, w):
    """Fitted value of each distinct x."""
    blocks = []
    for v, k in zip(y, w):
        blocks.append([v * k, k, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, b, c = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + b, blocks[-1][2] + c]
    return np.concatenate([[s / k] * n for s, k, n in blocks])


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "steps"])
def test_pieces_meet_until_no_neighbour_falls(spark, shape):
    rng = np.random.default_rng(3)
    x = np.sort(rng.choice(10_000, 150, replace=False)) / 10_000
    trend = {"noise": 0.5 + 0 * x, "falling": 1 - x, "rising": x, "steps": np.floor(x * 5) / 5}[shape]
    w = rng.integers(1, 6, len(x))
    y = np.array([rng.binomial(n, p) for n, p in zip(w, trend)]) / w if shape != "falling" else trend
    df = spark.createDataFrame([("k", float(a), float(b * c), int(c)) for a, b, c in zip(x, y, w)] + [(None, 0.5, 1.0, 2)], "key string, p double, s double, w long")
    blocks = isotonic.isotonic_blocks(df, ["key"], piece=8)
    asked = df.select("key", "p").unionByName(spark.createDataFrame([("k", -1.0), ("k", 2.0), ("k", float(x[0] + x[1]) / 2), (None, 0.1)], "key string, p double"))
    got = {(r["key"], r["p"]): r["value"] for r in isotonic.interpolated(asked.filter("key IS NOT NULL"), blocks.filter("key IS NOT NULL"), ["key"]).collect()}
    want = plain(x, y, w)
    np.testing.assert_allclose([got["k", float(a)] for a in x], want, atol=1e-12)
    assert got["k", -1.0] == pytest.approx(want[0]) and got["k", 2.0] == pytest.approx(want[-1])
    assert got["k", float(x[0] + x[1]) / 2] == pytest.approx((want[0] + want[1]) / 2)
    values = [r["value"] for r in blocks.filter("key = 'k'").orderBy("lo").collect()]
    assert values == sorted(values) and blocks.filter("key IS NULL").first()["value"] == 0.5


def test_no_points_no_blocks(spark):
    none = spark.createDataFrame([], "p double, s double, w long")
    assert isotonic.isotonic_blocks(none).count() == 0


def test_ensemble_equals_single_fits(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(np.round(rng.random(), 2)), int(rng.random() < 0.4)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, p double, y int")
    got = {r["id"]: r["calibrated"] for r in metrics.isotonic_ensemble(df, "id", 3, 5, piece=16).collect()}
    fold = {r["id"]: r["f"] for r in df.select("id", (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit("5"), F.col("id").cast("string"))), 1, 8), 16, 10).cast("bigint") % 3).alias("f")).collect()}
    total = np.zeros(len(rows))
    for f in range(3):
        kept = [(p, y) for i, p, y in rows if fold[i] != f]
        xs = np.array(sorted({p for p, _ in kept}))
        w = np.array([sum(p == x for p, _ in kept) for x in xs])
        s = np.array([sum(y for p, y in kept if p == x) for x in xs])
        total += np.clip(np.interp([p for _, p, _ in rows], xs, plain(xs, s / w, w)), 0.01, 0.99)
    np.testing.assert_allclose([got[i] for i, _, _ in rows], total / 3, atol=1e-12)
