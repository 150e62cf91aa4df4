"""Running statistics: carry form against plain windows, chunked against one pass, both against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from contestlab.operators import history as hst
from contestlab.operators import ordertree as ot
from contestlab.operators import percentiles as pct
from contestlab.operators import ranking
from contestlab.operators import windows as win

KEY, DATE, TIE = ["entity_id"], "event_date", ["contest_id"]


def table(df):
    return df.toPandas().sort_values(["entity_id", "contest_id"]).reset_index(drop=True)


@pytest.mark.parametrize("current", [True, False])
def test_running_equals_plain_window(skewed, current):
    w = Window.partitionBy("entity_id").orderBy("event_date", "contest_id").rowsBetween(Window.unboundedPreceding, 0 if current else -1)
    got = table(win.running(skewed, KEY, DATE, TIE, {"s": F.coalesce("x", F.lit(0.0))}, current, {"m": F.col("x")}))
    want = table(skewed.withColumn("s", F.coalesce(F.sum("x").over(w), F.lit(0.0))).withColumn("m", F.max("x").over(w)))
    np.testing.assert_allclose(got["s"], want["s"], atol=1e-9)
    np.testing.assert_allclose(got["m"].astype(float), want["m"].astype(float), atol=0)


def test_sdev_equals_plain_window(skewed):
    w = Window.partitionBy("entity_id").orderBy("event_date", "contest_id").rowsBetween(Window.unboundedPreceding, 0)
    got = table(win.running_sdev(skewed, ["x"], KEY, DATE, TIE))
    want = table(skewed.withColumn("v", F.stddev_samp("x").over(w)).withColumn("rn", F.row_number().over(Window.partitionBy("entity_id").orderBy("event_date", "contest_id"))))
    rest = want["rn"] > 1
    np.testing.assert_allclose(got.loc[rest, "x_sdev"], want.loc[rest, "v"].fillna(0.0), atol=1e-9)


def test_first_decayed_value_is_the_value_itself(spark):
    df = spark.createDataFrame([(1, 1, "2020-01-01", 20.0), (1, 2, "2021-01-01", 10.0)], "entity_id int, contest_id int, d string, x double").withColumn("event_date", F.to_date("d"))
    got = [r["x_dec_avg"] for r in win.decayed_avg(df, ["x"], KEY, DATE, 1.0).orderBy("contest_id").collect()]
    w = math.exp(-math.log(2) * 366 / 365.25)
    assert got[0] == 20.0 and got[1] == pytest.approx((20 * w + 10) / (w + 1))


def test_future_rows_never_change_past_values(skewed):
    early = skewed.filter("event_date < DATE '2000-07-01'")
    for make in (lambda d: win.decayed_avg(d, ["x"], KEY, DATE), lambda d: win.shift_prev(d, ["x"], KEY, DATE, TIE), lambda d: hst.running_order_stats(d, ["x"], KEY, DATE, TIE)):
        full = table(make(skewed).filter("event_date < DATE '2000-07-01'"))
        part = table(make(early))
        col = part.columns[-1]
        np.testing.assert_allclose(full[col].astype(float), part[col].astype(float), atol=1e-9)


@pytest.mark.parametrize("strict", [True, False])
def test_order_stats_chunked_and_brute_force(skewed, strict):
    one = table(hst.running_order_stats(skewed, ["x", "y"], KEY, DATE, TIE, strict, 0.3))
    many = table(hst.running_order_stats(skewed, ["x", "y"], KEY, DATE, TIE, strict, 0.3, block=30))
    for c in ("x", "y"):
        for k in ("median", "mad"):
            np.testing.assert_array_equal(one[f"{c}_{k}"], many[f"{c}_{k}"])
        np.testing.assert_allclose(one[f"{c}_dmad"], many[f"{c}_dmad"], atol=1e-9)
    h = one[one.entity_id == 2].sort_values(["event_date", "contest_id"]).reset_index(drop=True)
    for t in range(len(h)):
        v = h.x[: t if strict else t + 1].dropna().to_numpy()
        if len(v):
            assert h.x_median[t] == pytest.approx(np.median(v), abs=1e-12)
            assert h.x_mad[t] == pytest.approx(np.median(np.abs(v - np.median(v))), abs=1e-12)


def test_clipped_location_chunked_and_brute_force(skewed):
    rate = math.log(2) * 365.25 / 365
    one = table(hst.clipped_location(skewed, ["x"], KEY, DATE, rate))
    many = table(hst.clipped_location(skewed, ["x"], KEY, DATE, rate, block=30))
    for k in ("mean", "variance", "weight"):
        np.testing.assert_allclose(one[f"x_{k}"].astype(float), many[f"x_{k}"].astype(float), atol=1e-8)
    h = one[one.entity_id == 2].sort_values(["event_date", "contest_id"]).reset_index(drop=True)
    for t in range(len(h)):
        past = h[(h.event_date < h.event_date[t]) & h.x.notna()]
        if len(past):
            s = np.sort(past.x)
            v = np.clip(past.x, s[int((len(s) - 1) * 0.1)], s[int((len(s) - 1) * 0.9)])
            w = np.exp(-math.log(2) * np.array([(h.event_date[t] - d).days for d in past.event_date]) / 365.0)
            assert h.x_mean[t] == pytest.approx((v * w).sum() / w.sum(), abs=1e-9)
            assert h.x_weight[t] == pytest.approx(w.sum(), abs=1e-9)


@pytest.mark.parametrize("strict", [True, False])
def test_counting_tree_equals_brute_force(strict):
    rng = np.random.default_rng(1)
    history = np.unique(np.sort(rng.integers(0, 9, 500)), return_inverse=True)[1]
    value = np.where(rng.random(500) < 0.5, rng.integers(-3, 4, 500), rng.normal(size=500) * 5.0)
    used, asked, w = rng.random(500) < 0.9, rng.random(500) < 0.8, np.exp(-rng.random(500) * 3)
    shifted = value - 0.7
    past = ot.stretches(history, value, used, asked, strict, sums=(w, w * shifted, w * shifted**2))
    two = ot.stretches(history, value, used, asked, strict, sums=(w, w * shifted))
    for row, t in enumerate(np.flatnonzero(asked)):
        seen = np.flatnonzero((history == history[t]) & used & (np.arange(500) < (t if strict else t + 1)))
        assert past.n[row] == len(seen)
        if not len(seen):
            continue
        one, v, g = np.array([row]), value[seen], w[seen]
        mid, mad, upper = ot.median_and_mad(past.only(one))
        assert mid[0] == np.median(v) and mad[0] == np.median(np.abs(v - np.median(v)))
        assert ot.weighted_deviation(two.only(one), mid, upper, np.array([0.7]))[0] == pytest.approx((np.abs(v - mid) * g).sum() / g.sum(), abs=1e-12)
        s = np.sort(v)
        c = np.clip(v, s[int((len(s) - 1) * 0.1)], s[int((len(s) - 1) * 0.9)])
        mean = (c * g).sum() / g.sum()
        assert [x[0] for x in ot.clipped_moments(past.only(one), 0.1, 0.9, np.array([0.7]))] == pytest.approx([mean, ((c - mean) ** 2 * g).sum() / g.sum(), g.sum()], abs=1e-12)


def test_nulls_and_ties_keep_their_rows_in_any_block_size(spark):
    rows = [(None, 1, "2020-01-01", 3.0), (None, None, "2020-01-01", 5.0), (7, 1, None, 1.0), (7, 2, "2020-01-02", None), (7, 2, "2020-01-02", 4.0), (7, 2, "2020-01-02", 4.0), (7, None, "2020-01-03", 0.0)]
    df = spark.createDataFrame(rows * 6, "entity_id int, contest_id int, d string, x double").withColumn("event_date", F.to_date("d"))
    one = hst.running_order_stats(df, ["x"], KEY, DATE, TIE).drop("d")
    many = hst.running_order_stats(df, ["x"], KEY, DATE, TIE, block=5).drop("d")
    assert one.count() == many.count() == len(rows) * 6
    hot = lambda d: sorted(map(repr, d.groupBy("entity_id", "event_date").agg(F.max("x_median"), F.min("x_median")).collect()))
    assert hot(one.filter("x IS NOT NULL AND entity_id IS NULL")) == hot(many.filter("x IS NOT NULL AND entity_id IS NULL"))
    assert hst.clipped_location(df, ["x"], KEY, DATE, 0.5).count() == len(rows) * 6


def test_percentiles_by_buckets_equal_builtin(skewed):
    qs = [0.0, 0.005, 0.25, 0.5, 0.93, 1.0]
    a = {r["entity_id"]: r for r in pct.group_percentiles(skewed, KEY, ["x", "y"], qs).collect()}
    b = {r["entity_id"]: r for r in pct.group_percentiles(skewed, KEY, ["x", "y"], qs, max_distinct=5).collect()}
    for e in a:
        for c in ("x_p", "y_p"):
            if a[e][c] is None:
                assert b[e][c] is None
            else:
                np.testing.assert_allclose(a[e][c], b[e][c], atol=1e-9)


def test_ranks_across_many_buckets(spark, skewed, monkeypatch):
    got = ranking.global_rank(skewed, ["event_date", "entity_id", "contest_id"], "r", parts=16).orderBy("r").collect()
    want = skewed.orderBy("event_date", "entity_id", "contest_id").collect()
    assert [r["r"] for r in got] == list(range(1, len(want) + 1))
    assert [(r["entity_id"], r["contest_id"]) for r in got] == [(r["entity_id"], r["contest_id"]) for r in want]
    y = skewed.filter("x IS NOT NULL")
    r1 = {(r["entity_id"], r["contest_id"]): r["rank01"] for r in ranking.avg_rank01(y, ["entity_id"], "x").collect()}
    pdf = y.toPandas()
    for e, g in pdf.groupby("entity_id"):
        want = (g.x.rank() - 1) / (len(g) - 1) if len(g) > 1 else g.x * 0 + 0.5
        for cid, v in zip(g.contest_id, want):
            assert r1[e, cid] == pytest.approx(v)


def test_buckets_by_halving(spark):
    df = spark.createDataFrame([(float(i % 97), [float(x) for x in sorted([*range(0, 90, 3), 3, 3, 90])][:31]) for i in range(97)] + [(float("nan"), [0.0] * 31)], "v double, s array<double>")
    out = pct.in_bucket(df, "s", "v", "b", 32)
    assert all(r["b"] == sum(1 for x in r["s"] if x < r["v"] or r["v"] != r["v"]) for r in out.collect())
    assert "LambdaFunction" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_read_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.range(60).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v").mapInPandas(passed, "g bigint, v double")
    got = {r["g"]: r["v_p"][0] for r in pct.group_percentiles(df, ["g"], ["v"], [0.5], max_distinct=5).collect()}
    assert got == {0: 28.5, 1: 29.5, 2: 30.5} and seen.value == 60
