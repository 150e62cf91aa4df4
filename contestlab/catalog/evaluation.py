"""Prediction analytics: metrics, calibration, blending."""

import math

from pyspark.sql import functions as F

from ..operators import blend, metrics, ranking, sides
from ..sample import contest_sides, row_tasks
from ..session import cut
from .fitted import rnd
from .registry import over_sides, query


def predictions(spark, sf, shift=0.0, scale=40.0):
    """Contest predictions from a fixed expression of both sides' counts; draws left out."""
    s = contest_sides(spark, sf, ["att", "ctrl"])
    p = sides.pair_sides(s, ["att", "ctrl"], head=["event_date", "event_id", "grp", "method", "result"], tasks=row_tasks(spark, sf)).filter("result IN (0, 1)")
    z = (F.col("att_1") - F.col("att_2") + shift) / scale
    return p.select("contest_id", "event_date", "event_id", "grp", "method", F.col("result").alias("y"),
                    F.round(1 / (1 + F.exp(-z)), 4).alias("p"), F.round(1 / (1 + F.exp(-(F.col("ctrl_1") - F.col("ctrl_2")) / 60.0)), 4).alias("p2"))


PRED = """pred AS (SELECT a.contest_id, a.event_date, a.event_id, a.grp, a.method, a.result AS y, round(1 / (1 + exp(-(a.att - b.att + 0.0) / 40.0)), 4) AS p,
  round(1 / (1 + exp(-(a.ctrl - b.ctrl) / 60.0)), 4) AS p2 FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2 WHERE a.result IN (0, 1))"""


def _ll(p="p", eps="1e-15"):
    q = f"greatest(least({p}, 1 - {eps}), {eps})"
    return f"-(y * ln({q}) + (1 - y) * ln(1 - {q}))"


def _metrics_sql(p="p"):
    hit = f"(CASE WHEN {p} >= 0.5 THEN 1 ELSE 0 END = y)"
    return f"count(*) AS row_count, count(*) FILTER (WHERE {hit}) AS correct_count, round(avg(CASE WHEN {hit} THEN 1.0 ELSE 0.0 END), 8) AS accuracy, round(avg({_ll(p)}), 8) AS log_loss, round(avg(({p} - y) * ({p} - y)), 8) AS brier"


@query("prediction_metrics", over_sides(f"WITH {PRED} SELECT {_metrics_sql()} FROM pred"))
def _(spark, sf):
    return rnd(metrics.metrics(predictions(spark, sf)), [], 8)


_SLICES = {"year": "CAST(extract(year FROM event_date) AS VARCHAR)", "grp": "grp", "outcome_type": "method", "confidence": "CASE WHEN abs(p - 0.5) >= 0.25 THEN 'high' ELSE 'low' END"}


@query("metrics_by_slice", over_sides(f"WITH {PRED} " + " UNION ALL ".join(f"SELECT '{n}' AS slice, {e} AS value, {_metrics_sql()} FROM pred GROUP BY 2" for n, e in _SLICES.items())))
def _(spark, sf):
    conf = F.when(F.abs(F.col("p") - 0.5) >= 0.25, "high").otherwise("low")
    return rnd(metrics.metrics_by_slice(predictions(spark, sf), {"year": F.year("event_date"), "grp": F.col("grp"), "outcome_type": F.col("method"), "confidence": conf}), [], 8)


@query("reliability_ece", over_sides(f"""WITH {PRED}, e AS (SELECT CAST(i AS INTEGER) AS bin FROM range(10) t(i)),
  b AS (SELECT p, y, (CASE WHEN p >= 0.1 THEN 1 ELSE 0 END + CASE WHEN p >= 0.2 THEN 1 ELSE 0 END + CASE WHEN p >= 0.30000000000000004 THEN 1 ELSE 0 END + CASE WHEN p >= 0.4 THEN 1 ELSE 0 END + CASE WHEN p >= 0.5 THEN 1 ELSE 0 END
    + CASE WHEN p >= 0.6000000000000001 THEN 1 ELSE 0 END + CASE WHEN p >= 0.7000000000000001 THEN 1 ELSE 0 END + CASE WHEN p >= 0.8 THEN 1 ELSE 0 END + CASE WHEN p >= 0.9 THEN 1 ELSE 0 END) AS bin FROM pred)
  SELECT e.bin, count(b.p) AS n, round(avg(b.p), 8) AS mean_p, round(avg(b.y), 8) AS observed, round(coalesce(count(b.p) / CAST((SELECT count(*) FROM pred) AS DOUBLE) * abs(avg(b.p) - avg(b.y)), 0), 8) AS ece_part
  FROM e LEFT JOIN b ON b.bin = e.bin GROUP BY 1"""))
def _(spark, sf):
    return rnd(metrics.reliability(predictions(spark, sf)).select("bin", "n", "mean_p", "observed", "ece_part"), [], 8)


@query("roc_auc", over_sides(f"""WITH {PRED}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM pred)
  SELECT round((sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE)), 8) AS auc FROM r"""))
def _(spark, sf):
    return rnd(metrics.auc(predictions(spark, sf)), [], 8)


def _newton(rows: str, penalty: float, start: float, steps: int = 12) -> str:
    """CTEs ``n0`` .. of (a, b): Newton steps of a logistic fit of y on x with penalty * b^2 / 2, each from five sums."""
    ctes = [f"n0 AS (SELECT CAST(0 AS DOUBLE) AS a, CAST({start} AS DOUBLE) AS b)"]
    for i in range(steps):
        ctes.append(f"""n{i + 1} AS MATERIALIZED (SELECT a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS a, b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS b
    FROM (SELECT a, b, sum(w) AS h00, sum(w * x) AS h01, sum(w * x * x) + {penalty!r} AS h11, sum(y - p) AS g0, sum((y - p) * x) - {penalty!r} * b AS g1
    FROM (SELECT a, b, x, y, p, p * (1 - p) AS w FROM (SELECT a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM ({rows}), n{i})) GROUP BY a, b))""")
    return ", ".join(ctes)


def _logit(eps: str) -> str:
    q = f"greatest(least(p, 1 - {eps}), {eps})"
    return f"ln({q} / (1 - {q}))"


@query("calibration_line", over_sides(f"""WITH {PRED}, {_newton(f"SELECT {_logit('1e-8')} AS x, y FROM pred", 0.0, 1)} SELECT round(a, 6) AS intercept, round(b, 6) AS slope FROM n12"""))
def _(spark, sf):
    a, b = metrics.calibration_line(predictions(spark, sf))
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "intercept double, slope double")


@query("paired_delta", over_sides(f"""WITH {PRED} SELECT round(avg({_ll('p')}) - avg({_ll('p2')}), 8) AS log_loss_delta, round(avg((p - y) * (p - y)) - avg((p2 - y) * (p2 - y)), 8) AS brier_delta,
  round(avg(CASE WHEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END = y THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN CASE WHEN p2 >= 0.5 THEN 1 ELSE 0 END = y THEN 1.0 ELSE 0.0 END), 8) AS accuracy_delta FROM pred"""))
def _(spark, sf):
    d = predictions(spark, sf)
    return rnd(metrics.paired_delta(d, d.withColumn("p", F.col("p2")), ["contest_id"]), [], 8)


def _poisson_sql() -> str:
    mass, total, parts = math.exp(-1.0), 0.0, []
    for k in range(1, 18):
        total += mass
        parts.append(f"CASE WHEN u >= {total!r} THEN 1 ELSE 0 END")
        mass /= k
    return " + ".join(parts)


@query("event_block_bootstrap", over_sides(f"""WITH {PRED}, e AS (SELECT event_date, count(*) AS n, sum({_ll('p')} - ({_ll('p2')})) AS l, sum((p - y) * (p - y) - (p2 - y) * (p2 - y)) AS b,
    sum(CASE WHEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END = y THEN 1.0 ELSE 0.0 END - CASE WHEN CASE WHEN p2 >= 0.5 THEN 1 ELSE 0 END = y THEN 1.0 ELSE 0.0 END) AS a FROM pred GROUP BY 1),
  d AS (SELECT it, n, l, b, a, CAST('0x' || substr(md5('7:' || it || ':' || event_date), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u FROM e, range(50) t(it)),
  k AS (SELECT *, {_poisson_sql()} AS k FROM d), r AS (SELECT it, sum(k * l) / sum(k * n) AS l, sum(k * b) / sum(k * n) AS b, sum(k * a) / sum(k * n) AS a FROM k GROUP BY 1)
  SELECT 'log_loss_delta' AS metric, round((SELECT sum(l) / sum(n) FROM e), 8) AS estimate, round(quantile_cont(l, 0.025), 8) AS lower, round(quantile_cont(l, 0.975), 8) AS upper FROM r
  UNION ALL SELECT 'brier_delta', round((SELECT sum(b) / sum(n) FROM e), 8), round(quantile_cont(b, 0.025), 8), round(quantile_cont(b, 0.975), 8) FROM r
  UNION ALL SELECT 'accuracy_delta', round((SELECT sum(a) / sum(n) FROM e), 8), round(quantile_cont(a, 0.025), 8), round(quantile_cont(a, 0.975), 8) FROM r"""))
def _(spark, sf):
    d = predictions(spark, sf)
    return rnd(metrics.block_bootstrap(d, d.withColumn("p", F.col("p2")), ["contest_id"], "event_date", 50, 7).drop("iterations", "seed"), [], 8)


@query("metric_gap", over_sides(f"""WITH {PRED}, t AS (SELECT {_metrics_sql().replace('round(', '(').replace(', 8)', ')')} FROM pred WHERE event_date < DATE '1998-01-01'),
  o AS (SELECT {_metrics_sql().replace('round(', '(').replace(', 8)', ')')} FROM pred WHERE event_date >= DATE '1998-01-01')
  SELECT round(t.accuracy - o.accuracy, 8) AS accuracy, round(t.log_loss - o.log_loss, 8) AS log_loss, round(t.brier - o.brier, 8) AS brier FROM t, o"""))
def _(spark, sf):
    d = cut(predictions(spark, sf))
    return rnd(metrics.metric_gap(d.filter("event_date < DATE '1998-01-01'"), d.filter("event_date >= DATE '1998-01-01'")), [], 8)


@query("platt_fit", over_sides(f"""WITH {PRED}, {_newton(f"SELECT {_logit('1e-6')} AS x, y FROM pred WHERE event_date < DATE '1998-01-01'", 1.0, 0)}
  SELECT contest_id, p, round(1 / (1 + exp(-(b * {_logit('1e-6')} + a))), 4) AS p_cal FROM pred, n12 WHERE event_date >= DATE '1998-01-01'"""))
def _(spark, sf):
    d = cut(predictions(spark, sf))
    slope, icept = metrics.fit_platt(d.filter("event_date < DATE '1998-01-01'"), 1.0)
    out = d.filter("event_date >= DATE '1998-01-01'")
    return out.select("contest_id", "p", F.round(metrics.apply_platt(F.col("p"), slope, icept), 4).alias("p_cal"))


def _temper_sql() -> str:
    cells = [0.5 + i * 0.25 for i in range(11)]
    q = "greatest(least(1 / (1 + exp(-ln(greatest(least(p, 1 - 1e-6), 1e-6) / (1 - greatest(least(p, 1 - 1e-6), 1e-6))) / t)), 1 - 1e-6), 1e-6)"
    return over_sides(f"""WITH {PRED}, g AS (SELECT unnest({cells}) AS t), l AS (SELECT t, avg(-(y * ln({q}) + (1 - y) * ln(1 - {q}))) + 0.01 * ln(t) * ln(t) AS o FROM pred, g GROUP BY 1)
      SELECT CAST(t AS DOUBLE) AS temperature, round(o, 8) AS objective FROM l ORDER BY o, t LIMIT 1""")


@query("temperature_fit", _temper_sql())
def _(spark, sf):
    return rnd(metrics.fit_temperature(metrics.temperature_losses(predictions(spark, sf), 0.5, 3.0, 0.25, 0.01)), [], 8)


def _minmax(points: str, keys: str = "") -> str:
    """CTEs from ``points`` (p, w, s and keys) to ``iso`` (p, v): the largest, over starts, of the smallest mean up to a later end."""
    by = f"PARTITION BY {keys}" if keys else ""
    k, same = (f"{keys}, ", f"a.{keys} = b.{keys} AND ") if keys else ("", "TRUE AND ")
    return f"""pts AS (SELECT {k}p, w, s, row_number() OVER ({by} ORDER BY p) AS i, sum(w) OVER ({by} ORDER BY p) AS cw, sum(s) OVER ({by} ORDER BY p) AS cs FROM ({points})),
  means AS (SELECT {'a.' + k if keys else ''}a.i AS a, b.i AS b, (b.cs - a.cs + a.s) / CAST(b.cw - a.cw + a.w AS DOUBLE) AS v FROM pts a JOIN pts b ON {same}b.i >= a.i),
  lows AS (SELECT {k}a, b AS i, min(v) OVER (PARTITION BY {k}a ORDER BY b DESC) AS v FROM means),
  iso AS (SELECT {k}p, v FROM (SELECT {k}i, max(v) AS v FROM lows GROUP BY ALL) JOIN pts USING ({k}i))"""


def _line(x: str, keys: str = "") -> str:
    """Value at ``x`` on the line through the neighbouring points of ``iso``, its end values outside."""
    own = f"iso.{keys} = q.{keys} AND " if keys else ""
    lo, hi = (f"(SELECT arg_{f}(struct_pack(p := p, v := v), p) FROM iso WHERE {own}p {op} {x})" for f, op in (("max", "<="), ("min", ">=")))
    return f"(SELECT CASE WHEN lo IS NULL THEN hi.v WHEN hi IS NULL OR hi.p = lo.p THEN lo.v ELSE lo.v + (hi.v - lo.v) * ({x} - lo.p) / (hi.p - lo.p) END FROM (SELECT {lo} AS lo, {hi} AS hi))"


@query("isotonic_fit", over_sides(f"""WITH {PRED}, {_minmax("SELECT p, count(*) AS w, sum(y) AS s FROM pred WHERE event_date < DATE '1998-01-01' GROUP BY 1")},
  q AS (SELECT DISTINCT p FROM pred WHERE event_date >= DATE '1998-01-01'), f AS (SELECT p AS x, {_line('q.p')} AS v FROM q)
  SELECT contest_id, round(0.3 * p + 0.7 * v, 6) AS p, y FROM pred JOIN f ON x = p WHERE event_date >= DATE '1998-01-01'"""))
def _(spark, sf):
    d = cut(predictions(spark, sf))
    blocks, _why = metrics.fit_isotonic(d.filter("event_date < DATE '1998-01-01'").select("p", "y"), 100, 20, 10)
    return rnd(metrics.apply_isotonic(d.filter("event_date >= DATE '1998-01-01'").select("contest_id", "p", "y"), blocks, 0.7), [])


_FOLD = "CAST(CAST('0x' || substr(md5('42:' || contest_id), 1, 8) AS BIGINT) % 5 AS INTEGER)"


@query("isotonic_ensemble", over_sides(f"""WITH {PRED}, {_minmax(f"SELECT fold, p, count(*) AS w, sum(y) AS s FROM pred JOIN range(5) r(fold) ON fold <> {_FOLD} GROUP BY 1, 2", "fold")},
  q AS (SELECT DISTINCT fold, p FROM pred, range(5) r(fold)), f AS (SELECT p AS x, avg(greatest(least({_line('q.p', 'fold')}, 0.99), 0.01)) AS v FROM q GROUP BY 1)
  SELECT contest_id, round(p, 6) AS p, y, round(v, 6) AS calibrated FROM pred JOIN f ON x = p"""))
def _(spark, sf):
    d = predictions(spark, sf).select("contest_id", "p", "y")
    return rnd(metrics.isotonic_ensemble(d, "contest_id", 5, 42), [])


def _ece_sql(p):
    edges = [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]
    b = " + ".join(f"CASE WHEN {p} >= {e!r} THEN 1 ELSE 0 END" for e in edges)
    return f"(SELECT sum(n * abs(m - o)) / sum(n) FROM (SELECT count(*) AS n, avg({p}) AS m, avg(y) AS o FROM pred GROUP BY {b}))"


@query("calibration_effect", over_sides(f"""WITH {PRED}, m AS (SELECT avg({_ll('p')}) AS lb, avg((p - y) * (p - y)) AS bb, avg({_ll('p2')}) AS la, avg((p2 - y) * (p2 - y)) AS ba, {_ece_sql('p')} AS eb, {_ece_sql('p2')} AS ea FROM pred)
  SELECT round(lb, 8) AS log_loss_before, round(bb, 8) AS brier_before, round(eb, 8) AS ece_before, round(la, 8) AS log_loss_after, round(ba, 8) AS brier_after, round(ea, 8) AS ece_after,
  round(lb - la, 8) AS log_loss_gain, round(bb - ba, 8) AS brier_gain, round(eb - ea, 8) AS ece_gain FROM m"""))
def _(spark, sf):
    return rnd(metrics.calibration_effect(predictions(spark, sf), "p", "p2"), [], 8)


def _models(spark, sf):
    d = cut(predictions(spark, sf).select("contest_id", "y", "p", "p2"))
    return {"a": d.select("contest_id", "y", "p"), "b": d.select("contest_id", "y", F.col("p2").alias("p")), "c": d.select("contest_id", "y", F.lit(0.5).alias("p"))}


_RANK = "(rank() OVER (ORDER BY {0}) - 1 + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0) / (count(*) OVER () - 1)"


@query("blend_mean_median_rank", over_sides(f"""WITH {PRED} SELECT contest_id, round((p + p2 + 0.5) / 3, 6) AS p_mean, round(list_sort([p, p2, 0.5])[2], 6) AS p_median,
  round(({_RANK.format('p')} + {_RANK.format('p2')}) / 2, 6) AS p_rank FROM pred"""))
def _(spark, sf):
    m = _models(spark, sf)
    out = blend.blend(m, ["contest_id"], "mean").select("contest_id", F.col("p").alias("p_mean"))
    out = out.join(blend.blend(m, ["contest_id"], "median").select("contest_id", F.col("p").alias("p_median")), "contest_id")
    two = {k: m[k] for k in ("a", "b")}
    return rnd(out.join(blend.blend(two, ["contest_id"], "rank").select("contest_id", F.col("p").alias("p_rank")), "contest_id"), [])


@query("rank_average", over_sides(f"WITH {PRED} SELECT contest_id, round({_RANK.format('p')}, 8) AS rank01 FROM pred"))
def _(spark, sf):
    d = predictions(spark, sf).select("contest_id", "p", F.lit("a").alias("model"))
    return rnd(ranking.avg_rank01(cut(d), ["model"], "p").select("contest_id", "rank01"), [], 8)


@query("blend_weights_fit")
def _(spark, sf):
    w = blend.fit_blend_weights(_models(spark, sf), ["contest_id"], 0.01, capped=["c"], cap=0.2, rate=0.5, iterations=25, tol=1e-7, tasks=row_tasks(spark, sf))
    return spark.createDataFrame([(k, round(v, 4)) for k, v in w.items()], "model string, weight double")


@query("constituent_check", over_sides(f"""WITH {PRED} SELECT count(*) AS row_count, CAST(0 AS BIGINT) AS wrong_boundary, count(*) FILTER (WHERE event_date > DATE '2000-12-31') AS future_rows, count(*) FILTER (WHERE contest_id % 50 = 0) AS wrong_fold,
  count(*) FILTER (WHERE contest_id % 40 = 0) AS contaminated_context, CAST(0 AS BIGINT) AS bad_probability FROM pred"""))
def _(spark, sf):
    d = predictions(spark, sf).withColumns({
        "boundary": F.lit("Original"), "fold": F.when(F.col("contest_id") % 50 == 0, "other").otherwise("outer"),
        "context_max_date": F.date_sub("event_date", F.when(F.col("contest_id") % 40 == 0, 0).otherwise(1))})
    return blend.validate_predictions(d, "outer", "2000-12-31")


@query("outcome_mixture", over_sides(f"""WITH {PRED}, s AS (SELECT grp, count(*) AS n FROM pred GROUP BY 1) SELECT contest_id, round(greatest(0.02, least(0.98, p2 * p + (1 - p2) * (n / (n + 500.0) * (1 - p) + (1 - n / (n + 500.0)) * 0.5))), 6) AS p_mix FROM pred JOIN s ON s.grp = pred.grp"""))
def _(spark, sf):
    d = cut(predictions(spark, sf))
    n = d.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    finish = blend.shrink(1 - F.col("p"), F.lit(0.5), F.col("n"), 500.0)
    return rnd(d.join(n, "grp").select("contest_id", blend.mixture(F.col("p2"), F.col("p"), finish, 0.02, 0.98).alias("p_mix")), [])


@query("swap_complement", over_sides(f"""WITH {PRED} SELECT contest_id, round(abs(p + p2 - 1), 6) AS residual, round((p + (1 - p2)) / 2, 6) AS p_avg FROM pred"""))
def _(spark, sf):
    return rnd(metrics.swap_check(predictions(spark, sf), "p", "p2").select("contest_id", "residual", "p_avg"), [])


@query("vegas_compare", over_sides(f"""WITH {PRED}, m AS (SELECT * FROM (SELECT *, CASE WHEN contest_id % 10 <> 0 THEN p2 * 1.04 * 0.9 + 0.02 END AS m1, CASE WHEN contest_id % 7 <> 0 THEN (1 - p2) * 1.04 * 0.9 + 0.02 END AS m2 FROM pred) WHERE m1 IS NOT NULL AND m2 IS NOT NULL)
  SELECT count(*) AS row_count, round(avg(CASE WHEN CASE WHEN m1 > m2 THEN 1 ELSE 0 END = y THEN 1.0 ELSE 0.0 END), 8) AS market_accuracy, round(avg({_ll('m1')}), 8) AS market_log_loss,
  round(avg(CASE WHEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END = y THEN 1.0 ELSE 0.0 END), 8) AS model_accuracy, round(avg({_ll('p')}), 8) AS model_log_loss FROM m"""))
def _(spark, sf):
    d = predictions(spark, sf).withColumns({
        "m1": F.when(F.col("contest_id") % 10 != 0, F.col("p2") * 1.04 * 0.9 + 0.02), "m2": F.when(F.col("contest_id") % 7 != 0, (1 - F.col("p2")) * 1.04 * 0.9 + 0.02)})
    return rnd(metrics.compare_market(d, "m1", "m2"), [], 8)
