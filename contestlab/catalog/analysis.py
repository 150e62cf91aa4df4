"""Sources, parameter search and ad-hoc analytics."""

from pyspark.sql import functions as F

from ..operators import explore, smooth, tune
from ..sample import contest_headers, contest_sides, row_tasks, table
from ..session import cut, scratch
from ..sources import contests as src
from .fitted import _rates, _tau, rnd
from .history import DATE, ID
from .registry import over_sides, query

# --- sources ---------------------------------------------------------------------------


def _raw_contests(spark, sf):
    """Contest rows as raw text, the way they are scraped."""
    s = contest_sides(spark, sf, [f"{c}_rd{r}" for c in ("land", "att", "secs") for r in (1, 2, 3)])
    cells = {}
    for p in (1, 2):
        for r in (1, 2, 3):
            cells[f"p{p}_rd{r}_Sig_str"] = F.max(F.when(F.col("side") == p, F.concat_ws(" of ", F.col(f"land_rd{r}").cast("string"), F.col(f"att_rd{r}").cast("string"))))
            cells[f"p{p}_rd{r}_Ctrl"] = F.max(F.when(F.col("side") == p, F.format_string("%d:%02d", F.floor(F.col(f"secs_rd{r}") / 60).cast("int"), (F.col(f"secs_rd{r}") % 60).cast("int"))))
    out = s.groupBy(F.col("contest_id").cast("string").alias("event_url"), F.col("event_date").cast("string").alias("event_date"), "method").agg(*[c.alias(n) for n, c in cells.items()])
    schema = src.contest_schema()
    have = set(out.columns)
    return out.select(*[(F.col(f.name) if f.name in have else F.lit(None).cast("string")).alias(f.name) for f in schema.fields])


@query("scan_contests", over_sides("""SELECT CAST(a.contest_id AS VARCHAR) AS event_url, a.event_date, a.method, CAST(a.land_rd1 AS INTEGER) AS land_1, CAST(b.att_rd2 AS INTEGER) AS att_2, CAST(b.secs_rd1 AS INTEGER) AS ctrl_2, CAST(a.land_rd3 AS INTEGER) AS land_3, CAST(b.secs_rd3 AS INTEGER) AS ctrl_3
  FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2"""))
def _(spark, sf):
    from ..functions.parse import clock_to_sec, split_of

    path = scratch(spark, "contests")
    _raw_contests(spark, sf).write.option("header", True).csv(path)
    raw = src.read_contests(spark, path)
    return raw.select("event_url", F.to_date("event_date").alias("event_date"), "method", split_of(F.col("p1_rd1_Sig_str"))[0].alias("land_1"),
                      split_of(F.col("p2_rd2_Sig_str"))[1].alias("att_2"), clock_to_sec(F.col("p2_rd1_Ctrl")).alias("ctrl_2"),
                      split_of(F.col("p1_rd3_Sig_str"))[0].alias("land_3"), clock_to_sec(F.col("p2_rd3_Ctrl")).alias("ctrl_3"))


@query("merge_incremental", """WITH u AS (SELECT c_nationkey AS k, c_custkey AS seq, c_name AS name, 0 AS s FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey <> 3
    UNION ALL SELECT c_nationkey, c_custkey, upper(c_name), 1 FROM customer WHERE c_custkey % 2 = 1)
  SELECT CAST(k AS VARCHAR) AS k, seq, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, seq) AS rn FROM u WHERE k <> 7) WHERE rn = 1""")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.when(F.col("c_nationkey") == 7, F.lit(" ")).otherwise(F.col("c_nationkey").cast("string")).alias("k"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("name"))
    old = c.filter("seq % 2 = 0 AND k <> '3'")
    new = c.filter("seq % 2 = 1").withColumn("name", F.upper("name"))
    return src.merge_incremental(old, new, ["k"], "seq")


@query("write_feature_table", over_sides("SELECT half, contest_id, entity_id, land, att FROM sides, (VALUES ('parquet'), ('csv')) h(half)"))
def _(spark, sf):
    base = scratch(spark, "publish")
    s = contest_sides(spark, sf, ["land", "att"]).select(*ID, "land", "att")
    src.publish(spark, {"training_data": s, "prediction_data": s}, base, {"prediction_data": "csv"})
    halves = [src.read_published(spark, base, n).select(F.lit(kind).alias("half"), *ID, "land", "att") for kind, n in (("parquet", "training_data"), ("csv", "prediction_data"))]
    return halves[0].unionByName(halves[1])


# --- parameter search -------------------------------------------------------------------

_TRAIN = "event_date < DATE '1998-01-01'"
_BB = """(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + lgamma(k + mu * tau) + lgamma(n - k + (1 - mu) * tau) - lgamma(n + tau)
  - lgamma(mu * tau) - lgamma((1 - mu) * tau) + lgamma(tau))"""


@query("bb_loglik", over_sides(f"""WITH t AS (SELECT contest_id, entity_id, land AS k, CAST(att AS DOUBLE) AS n, 0.33 AS mu, 7.5 AS tau FROM sides) SELECT contest_id, entity_id, round({_BB}, 6) AS loglik FROM t"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"])
    return s.select(*ID, F.round(tune.bb_loglik(F.col("land"), F.col("att"), F.lit(0.33), F.lit(7.5)), 6).alias("loglik"))


@query("nb_loglik", over_sides("""WITH t AS (SELECT contest_id, entity_id, kd AS k, secs / 60.0 AS e, 0.11 * 9.5 AS r, 9.5 AS tau FROM sides)
  SELECT contest_id, entity_id, round(lgamma(k + r) - lgamma(r) - lgamma(k + 1) + r * ln(tau / (tau + e)) + k * ln(1 - tau / (tau + e)), 6) AS loglik FROM t"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["kd", "secs"])
    return s.select(*ID, F.round(tune.nb_loglik(F.col("kd"), F.col("secs") / 60.0, F.lit(0.11), F.lit(9.5)), 6).alias("loglik"))


def _tune_rows(spark, sf):
    return contest_sides(spark, sf, ["sub_att", "secs"]).select("grp", F.col("sub_att").alias("k"), (F.col("secs") / 60).alias("n"), (F.col(DATE) < F.lit("1998-01-01").cast("date")).alias("tr"))


def _tune_sql(low: float, high: float) -> str:
    """A fixed ladder of grids: every group climbs a step while its best strength lies at an end of its range."""
    loss = f"sum(-{_BB} * c) / sum(c)"
    even = lambda lo, hi, n: f"list_transform(range({n}), lambda i: {lo} + ({hi} - {lo}) * i / {n - 1}.0)"
    grid = f"CASE WHEN hi - lo > 50 THEN list_transform({even('ln(lo)', 'ln(hi)', 30)}, lambda x: exp(x)) WHEN hi - lo > 20 THEN list_concat({even('lo', '(lo + 10)', 15)}, {even('(lo + 10)', 'hi', 10)}) ELSE {even('lo', 'hi', 25)} END"
    steps = [f"t0 AS (SELECT g, CAST({low} AS DOUBLE) AS lo, CAST({high} AS DOUBLE) AS hi, true AS open, false AS hit, CAST(NULL AS DOUBLE) AS tau, CAST(NULL AS DOUBLE) AS nll FROM prior WHERE g IN (SELECT g FROM v))"]
    for i in range(tune.MAX_WIDENINGS + 1):
        steps.append(f"""g{i} AS MATERIALIZED (SELECT g, {grid} AS grid FROM t{i} WHERE open),
  l{i} AS (SELECT g, tau, {loss} AS nll, max(points) AS points, max(place) AS place FROM (SELECT v.*, mu, len(grid) AS points, unnest(grid) AS tau, unnest(range(len(grid))) AS place FROM v JOIN prior ON prior.g = v.g JOIN g{i} ON g{i}.g = v.g) GROUP BY 1, 2),
  b{i} AS (SELECT * FROM l{i} QUALIFY row_number() OVER (PARTITION BY g ORDER BY nll, tau) = 1),
  t{i + 1} AS MATERIALIZED (SELECT t.g, CASE WHEN place = 0 THEN greatest(0.1, lo / 2) ELSE lo END AS lo, CASE WHEN place > 0 AND place = points - 1 THEN hi * 2 ELSE hi END AS hi, coalesce(place = 0 OR place = points - 1, false) AS open,
    t.hit OR coalesce(place = 0 OR place = points - 1, false) AS hit, coalesce(b.tau, t.tau) AS tau, coalesce(b.nll, t.nll) AS nll FROM t{i} t LEFT JOIN b{i} b ON b.g = t.g)""")
    last = f"t{tune.MAX_WIDENINGS + 1}"
    return over_sides(f"""WITH r AS (SELECT unnest([grp, '*']) AS g, sub_att AS k, secs / 60.0 AS n, {_TRAIN} AS tr FROM sides),
  prior AS MATERIALIZED (SELECT g, sum(k) / sum(n) AS mu, count(*) AS train_rows FROM r WHERE tr GROUP BY 1), v AS MATERIALIZED (SELECT g, least(k, greatest(n, 1)) AS k, greatest(n, 1) AS n, count(*) AS c FROM r WHERE NOT tr GROUP BY 1, 2, 3),
  {', '.join(steps)}, o AS (SELECT t.tau, mu FROM {last} t JOIN prior ON prior.g = t.g WHERE t.g = '*'),
  base AS (SELECT g, {loss} AS base_nll FROM (SELECT v.*, o.mu, o.tau FROM v, o) GROUP BY 1),
  f AS (SELECT t.g, t.tau, t.nll, o.tau AS all_tau, base_nll, CASE WHEN base_nll > 0 THEN (base_nll - t.nll) / base_nll * 100 ELSE 0 END AS gain, hit, train_rows FROM {last} t JOIN base ON base.g = t.g JOIN prior ON prior.g = t.g, o)
  SELECT g AS grp, round(tau, 6) AS tau, round(nll, 6) AS nll, round(all_tau, 6) AS all_tau, round(base_nll, 6) AS base_nll, round(gain, 6) AS gain_pct, hit AS boundary, g <> '*' AND gain >= {tune.MIN_GAIN_PCT} AND NOT hit AND train_rows >= {tune.MIN_GROUP_ROWS} AS use_group,
    round(CASE WHEN g <> '*' AND gain >= {tune.MIN_GAIN_PCT} AND NOT hit AND train_rows >= {tune.MIN_GROUP_ROWS} THEN tau ELSE all_tau END, 6) AS final_tau FROM f""")


@query("tune_tau", _tune_sql(1.0, 12.0))
def _(spark, sf):
    rows = cut(_tune_rows(spark, sf))
    return rnd(tune.tune_tau(rows, "k", "n", "grp", F.col("tr"), "binomial", 1.0, 12.0), [])


_GRID = [1.0, 2.0, 4.0, 8.0, 16.0]


@query("tau_losses", over_sides(f"""WITH p AS (SELECT grp, sum(sub_att) / CAST(sum(secs / 60) AS DOUBLE) AS mu FROM sides WHERE {_TRAIN} GROUP BY 1),
  c AS (SELECT s.grp, sub_att AS k, secs / 60.0 AS n, mu, tau FROM sides s JOIN p ON p.grp = s.grp, (SELECT unnest({_GRID}) AS tau) WHERE NOT ({_TRAIN}))
  SELECT grp AS g, CAST(tau AS DOUBLE) AS tau, round(-avg({_BB}), 6) AS nll, count(*) AS "rows" FROM c GROUP BY 1, 2"""))
def _(spark, sf):
    prior, val = tune._cells(_tune_rows(spark, sf), "k", "n", "grp", F.col("tr"))
    grids = prior.filter("g <> '*'").select("g", F.array(*map(F.lit, _GRID)).alias("grid"))
    return rnd(tune.tau_losses(prior, val, grids, "binomial").drop("place"), [])


@query("shrinkage_report", over_sides(f"""WITH p AS (SELECT grp, sum(sub_att) / CAST(sum(secs / 60) AS DOUBLE) AS mu FROM sides WHERE {_TRAIN} GROUP BY 1), a AS (SELECT grp, sum(secs / 60.0) AS t FROM sides GROUP BY 1),
  v AS (SELECT s.grp, avg(pow(mu - sub_att / (secs / 60.0), 2)) AS brier, abs(any_value(mu) - avg(sub_att / (secs / 60.0))) AS gap FROM sides s JOIN p ON p.grp = s.grp WHERE NOT ({_TRAIN}) GROUP BY 1)
  SELECT a.grp, CAST(8.0 AS DOUBLE) AS tau, round(t / (1 + t / 8.0), 6) AS effective_n, round(8.0 / (8.0 + t), 8) AS shrink, round(brier, 6) AS brier, round(gap, 6) AS calibration_gap FROM a JOIN v ON v.grp = a.grp"""))
def _(spark, sf):
    rows = _tune_rows(spark, sf)
    out = tune.shrinkage_report(rows, "k", "n", "grp", F.col("tr"), rows.select("grp").distinct().withColumn("tau", F.lit(8.0)))
    return out.select("grp", "tau", F.round("effective_n", 6).alias("effective_n"), F.round("shrink", 8).alias("shrink"), F.round("brier", 6).alias("brier"), F.round("calibration_gap", 6).alias("calibration_gap"))


@query("tune_half_life")
def _(spark, sf):
    s = contest_sides(spark, sf, ["att", "land"])
    win_flag = F.when(F.col("result") == 2, None).otherwise(((F.col("result") == 1) == (F.col("side") == 1)).cast("int"))
    rows = cut(s.select(*ID, DATE, "side", "att", "land", win_flag.alias("win")))
    return rnd(tune.tune_half_life(rows, ["att", "land"], [0.5, 1.0, 2.0, 4.0], "1997-01-01"), [])


_HL = "ln(2) / {h} * (c.event_date - p.event_date) / 365.25"


@query("half_life_features", over_sides("""SELECT c.contest_id, c.entity_id, """ + ", ".join(
    f"round(CASE WHEN count(p.contest_id) >= 3 THEN sum(p.att * exp(-{_HL.format(h=h)})) / sum(exp(-{_HL.format(h=h)})) END, 6) AS att_h{i}" for i, h in enumerate((0.5, 2.0))) + """
  FROM sides c LEFT JOIN sides p ON p.entity_id = c.entity_id AND (p.event_date < c.event_date OR (p.event_date = c.event_date AND p.contest_id < c.contest_id)) GROUP BY 1, 2"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["att"]).select(*ID, DATE, "att")
    return rnd(tune.half_life_features(s, ["att"], [0.5, 2.0]).select(*ID, "att_h0", "att_h1"), [])


# --- ad-hoc analytics --------------------------------------------------------------------


@query("read_only_sql", over_sides("SELECT grp, count(*) AS n, sum(CASE WHEN result = 2 THEN 1 ELSE 0 END)::BIGINT AS draws FROM headers GROUP BY 1 ORDER BY n DESC, grp LIMIT 3"))
def _(spark, sf):
    h = contest_headers(spark, sf)
    return explore.safe_sql(spark, "SELECT grp, count(*) AS n, sum(CASE WHEN result = 2 THEN 1L ELSE 0L END) AS draws FROM contests GROUP BY grp ORDER BY n DESC, grp;", {"contests": h}, 3)


@query("topn_by_metric", over_sides("SELECT entity_id, count(*) AS rows, round(avg(land), 6) AS mean_land FROM sides GROUP BY 1 HAVING count(*) >= 3 ORDER BY round(avg(land), 6) DESC, entity_id LIMIT 10".replace("AS rows", 'AS "rows"')))
def _(spark, sf):
    return explore.topn_by_metric(contest_sides(spark, sf, ["land"]), ["entity_id"], F.round(F.avg("land"), 6), "mean_land", 10)


def _career(spark, sf):
    return contest_sides(spark, sf, ["land", "ctrl"]).groupBy("entity_id").agg(F.round(F.avg("land"), 6).alias("land"), F.round(F.avg("ctrl"), 6).alias("ctrl"))


_CAREER = "career AS (SELECT entity_id, round(avg(land), 6) AS land, round(avg(ctrl), 6) AS ctrl FROM sides GROUP BY 1), lg AS (SELECT entity_id, 'land' AS stat, land AS value FROM career UNION ALL SELECT entity_id, 'ctrl', ctrl FROM career)"


@query("extreme_entities", over_sides(f"""WITH {_CAREER} SELECT stat, (array_agg(entity_id ORDER BY value DESC, entity_id))[1] AS highest, max(value) AS highest_value, (array_agg(entity_id ORDER BY value, entity_id))[1] AS lowest, min(value) AS lowest_value,
  round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sdev, count(*) AS n, round(max(value) - min(value), 6) AS value_range FROM lg GROUP BY 1"""))
def _(spark, sf):
    return rnd(explore.extremes(_career(spark, sf), "entity_id", ["land", "ctrl"]), [])


@query("extreme_contests", over_sides("""WITH r AS (SELECT entity_id, contest_id, opponent_id, land, row_number() OVER (PARTITION BY entity_id ORDER BY land DESC, contest_id) AS t, row_number() OVER (PARTITION BY entity_id ORDER BY land, contest_id) AS b FROM sides)
  SELECT entity_id, contest_id, opponent_id, land, CAST(t AS INTEGER) AS position, 'top' AS extreme FROM r WHERE t <= 2 UNION ALL SELECT entity_id, contest_id, opponent_id, land, CAST(b AS INTEGER), 'bottom' FROM r WHERE b <= 2"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land"]).select("entity_id", "contest_id", "opponent_id", "land")
    return explore.extreme_rows(s, ["entity_id"], "land", ["contest_id"], 2)


@query("category_outliers", over_sides(f"""WITH {_CAREER}, r AS (SELECT *, row_number() OVER (PARTITION BY stat ORDER BY value DESC, entity_id) AS t, row_number() OVER (PARTITION BY stat ORDER BY value, entity_id) AS b, max(abs(value)) OVER (PARTITION BY stat) AS max_abs FROM lg)
  SELECT stat, entity_id, value, CAST(t AS INTEGER) AS position, 'top' AS extreme, max_abs FROM r WHERE t <= 5 UNION ALL SELECT stat, entity_id, value, CAST(b AS INTEGER), 'bottom', max_abs FROM r WHERE b <= 5"""))
def _(spark, sf):
    return explore.outliers(_career(spark, sf), "entity_id", ["land", "ctrl"])


@query("cohort_averages", over_sides("""WITH m AS (SELECT entity_id FROM sides GROUP BY 1 HAVING count(DISTINCT contest_id) >= 260 AND max(CASE WHEN event_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' THEN 1 ELSE 0 END) = 1)
  SELECT 'land' AS stat, round(avg(land), 6) AS avg_value FROM sides WHERE entity_id IN (SELECT entity_id FROM m) AND event_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'
  UNION ALL SELECT 'ctrl', round(avg(ctrl), 6) FROM sides WHERE entity_id IN (SELECT entity_id FROM m) AND event_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "ctrl"])
    m = explore.cohort(s, "entity_id", "contest_id", DATE, "1999-01-01", "2000-01-01", 260)
    return rnd(explore.cohort_avg(s, m, "entity_id", ["land", "ctrl"], DATE, "1999-01-01", "2000-01-01"), [])


@query("prefight_value", over_sides("""SELECT c.contest_id, c.entity_id, (SELECT p.kd FROM (SELECT *, CASE WHEN kd > 0 THEN kd END AS v FROM sides) p WHERE p.entity_id = c.opponent_id AND p.event_date < c.event_date AND v IS NOT NULL ORDER BY p.event_date DESC, p.contest_id DESC LIMIT 1) AS opp_prior_v FROM sides c"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["kd"]).withColumn("v", F.when(F.col("kd") > 0, F.col("kd")))
    return explore.prefight_value(s.select(*ID, "opponent_id", DATE, "v"), "v", tasks=row_tasks(spark, sf)).select(*ID, "opp_prior_v")


@query("smoothing_audit", over_sides("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('0:' || contest_id || ':' || entity_id), contest_id, entity_id) AS rn FROM sides)
  SELECT contest_id, entity_id, true AS ok FROM r WHERE rn <= 20"""))
def _(spark, sf):
    s, spec, p = _rates(spark, sf)
    stored = smooth.poisson_gamma(s, spec, p, "grp", _tau(["land", "kd"])).select(*ID, F.col("land_smooth").alias("v"))
    sample = explore.stratified_sample(s, ["grp"], ID, 20)
    prior = p.filter("level = 'group'").select("grp", "land_rate")
    t, m = _tau(["land"])["land"], F.col("secs") / 60
    again = sample.join(prior, "grp").select(*ID, (m * (F.col("land_rate") * t + F.col("land")) / (t + m)).alias("v"))
    return explore.audit(stored, again, ID, "v", 1e-9).select(*ID, "ok")


@query("status_deltas", """SELECT 'customer' AS name, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS rows_before, (SELECT count(*) FROM customer) AS rows_after, (SELECT count(*) FROM customer WHERE c_custkey % 2 <> 0) AS delta
  UNION ALL SELECT 'supplier', NULL, (SELECT count(*) FROM supplier), NULL""")
def _(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return explore.status_deltas({"customer": c.filter("c_custkey % 2 = 0")}, {"customer": c, "supplier": s})
