"""Opponent-adjusted scores, training and scoring rows, splits and weights."""

import math

from pyspark.sql import functions as F

from ..operators import adjust, assemble, priors, quality, sides, splits, standing
from ..operators import windows as win
from ..plans import scoring
from ..sample import contest_headers, contest_sides, entities
from ..session import cut
from .fitted import ALL, FIT, IN_FIT, rnd
from .history import DATE, ID, KEY, RATE, TIE, rounded
from .registry import ENTITIES, over_sides, query

# --- opponent-adjusted performance ---------------------------------------------

STATS = ["att", "pos"]  # pos is null without control, so null handling is exercised
_BEFORE = "(p.event_date < c.event_date OR (p.event_date = c.event_date AND p.event_id < c.event_id) OR (p.event_date = c.event_date AND p.event_id = c.event_id AND p.contest_id < c.contest_id))"


def _adj_ctes(weight: str = "1.0", clip: str = "7.0") -> str:
    """Quadratic form: join every row to all earlier rows of its opponent; ends in the CTE ``adj``."""
    per = []
    for c in STATS:
        per.append(f"""r_{c} AS (SELECT c.contest_id, c.entity_id, q.{c} AS val, {weight} AS w FROM s c JOIN s p ON p.entity_id = c.opponent_id AND {_BEFORE}
            JOIN s q ON q.contest_id = p.contest_id AND q.entity_id = p.opponent_id WHERE q.{c} IS NOT NULL),
          m_{c} AS (SELECT contest_id, entity_id, quantile_cont(val, 0.5) AS med, sum(w * val) / sum(w) AS mean, count(*) AS cnt, pow(sum(w), 2) / sum(w * w) AS kish FROM r_{c} GROUP BY 1, 2),
          d_{c} AS (SELECT r.contest_id, r.entity_id, quantile_cont(abs(val - med), 0.5) AS mad FROM r_{c} r JOIN m_{c} m ON m.contest_id = r.contest_id AND m.entity_id = r.entity_id GROUP BY 1, 2)""")
    n = "coalesce(m_att.kish, 0)"
    cols = []
    for c in STATS:
        mean = f"({n} / ({n} + 4.0)) * coalesce(m_{c}.mean, 0) + (1 - {n} / ({n} + 4.0)) * coalesce(pr.{c}_mean, 0)"
        spread = f"greatest(({n} / ({n} + 4.0)) * coalesce(d_{c}.mad, 0) + (1 - {n} / ({n} + 4.0)) * coalesce(pr.{c}_mad, 0), coalesce(pr.{c}_floor, 0.001))"
        z = f"(coalesce(s.{c}, 0) - ({mean})) / ({spread})"
        cols.append(f"{z if clip == 'none' else f'greatest(least({z}, {clip}), -({clip}))'} AS {c}_adjperf")
    joins = " ".join(f"LEFT JOIN m_{c} ON m_{c}.contest_id = s.contest_id AND m_{c}.entity_id = s.entity_id LEFT JOIN d_{c} ON d_{c}.contest_id = s.contest_id AND d_{c}.entity_id = s.entity_id" for c in STATS)
    return f"""WITH s AS MATERIALIZED (SELECT *, CASE WHEN ctrl > 0 THEN ctrl END AS pos FROM sides), fit AS (SELECT * FROM s WHERE {IN_FIT}),
      gm AS (SELECT grp, avg(att) AS att_mean, avg(pos) AS pos_mean, quantile_cont(att, 0.5) AS am, quantile_cont(pos, 0.5) AS pm FROM fit GROUP BY 1 HAVING count(*) >= 10),
      pr AS (SELECT f.grp, any_value(att_mean) AS att_mean, any_value(pos_mean) AS pos_mean, quantile_cont(abs(att - am), 0.5) AS att_mad, quantile_cont(abs(pos - pm), 0.5) AS pos_mad,
        0.5 AS att_floor, 0.001 AS pos_floor FROM fit f JOIN gm ON gm.grp = f.grp GROUP BY 1), {", ".join(per)},
      adj AS (SELECT s.contest_id, s.entity_id, s.event_date, {", ".join(cols)} FROM s LEFT JOIN pr ON pr.grp = s.grp {joins})"""


def _adj_sql(**kw) -> str:
    return over_sides(f"{_adj_ctes(**kw)} SELECT contest_id, entity_id, round(att_adjperf, 8) AS att_adjperf, round(pos_adjperf, 8) AS pos_adjperf FROM adj")


def adj_inputs(spark, sf, stats=("att", "ctrl")):
    """Side rows written once, and the group priors of both stats."""
    s = contest_sides(spark, sf, list(stats)).withColumn("pos", F.expr("CASE WHEN ctrl > 0 THEN ctrl END"))
    s = cut(s.select(*ID, "event_id", DATE, "grp", *STATS))
    floors = s.select("grp").distinct().withColumn("att_min_mad", F.lit(0.5))
    p = priors.join_priors([priors.group_mean(s, STATS, "grp", DATE, FIT), priors.group_mad(s, STATS, "grp", DATE, FIT), floors], "grp")
    return s, p.withColumn("pos_min_mad", F.lit(0.001))


_ADJ = [f"{c}_adjperf" for c in STATS]


@query("adjperf", _adj_sql())
def _(spark, sf):
    s, p = adj_inputs(spark, sf)
    return rounded(adjust.adjusted_performance(s, STATS, p), _ADJ, 8)


_DECAY = adjust.decay_rate(2.0)


@query("adjperf_decayed", _adj_sql(weight=f"exp(-{_DECAY!r} * (c.event_date - p.event_date) / 365.25)"))
def _(spark, sf):
    s, p = adj_inputs(spark, sf)
    return rounded(adjust.adjusted_performance(s, STATS, p, half_life=2.0), _ADJ, 8)


@query("adjperf_no_winsor", _adj_sql(clip="none"))
def _(spark, sf):
    s, p = adj_inputs(spark, sf)
    return rounded(adjust.adjusted_performance(s, STATS, p, clip=None), _ADJ, 8)


@query("adjperf_winsor_adaptive", _adj_sql(clip="CASE WHEN s.grp = '1-URGENT' THEN 2.5 ELSE 7.0 END"))
def _(spark, sf):
    s, p = adj_inputs(spark, sf)
    q = quality.stat_quality(priors.between(s, DATE, FIT), STATS, "grp").select("grp", "stat", F.when(F.col("grp") == "1-URGENT", 0.0).otherwise(F.col("mad")).alias("mad"), "mode_frequency")
    tiers = q.withColumn("limit", quality.winsor_limit(quality.tier(F.col("mad"), F.col("mode_frequency")), F.col("mad")))
    limits = tiers.groupBy("grp").agg(*[F.max(F.when(F.col("stat") == c, F.col("limit"))).alias(f"{c}_limit") for c in STATS])
    clip = {c: F.col(f"{c}_limit") for c in STATS}
    return rounded(adjust.adjusted_performance(s, STATS, p.join(limits, "grp", "left"), clip=clip), _ADJ, 8)


@query("winsor_share", over_sides(f"""{_adj_ctes()} SELECT 'att_adjperf' AS stat, round(avg(CASE WHEN abs(att_adjperf) >= 7 THEN 1.0 ELSE 0.0 END), 6) AS clipped FROM adj
  UNION ALL SELECT 'pos_adjperf', round(avg(CASE WHEN abs(pos_adjperf) >= 7 THEN 1.0 ELSE 0.0 END), 6) FROM adj"""))
def _(spark, sf):
    s, p = adj_inputs(spark, sf)
    return rnd(quality.clipped_share(adjust.adjusted_performance(s, STATS, p), _ADJ, 7.0), [])


_LW = f"exp(-{RATE!r} * (c.event_date - p.event_date) / 365.25)"


@query("layered_features", over_sides(f"""{_adj_ctes()},
  av AS (SELECT contest_id, entity_id, avg(att_adjperf) OVER w AS a, avg(pos_adjperf) OVER w AS p FROM adj WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, contest_id ROWS UNBOUNDED PRECEDING)),
  dv AS (SELECT c.contest_id, c.entity_id, sum(p.att_adjperf * {_LW}) / sum({_LW}) AS a, sum(p.pos_adjperf * {_LW}) / sum({_LW}) AS p FROM adj c JOIN adj p ON p.entity_id = c.entity_id AND p.event_date <= c.event_date GROUP BY 1, 2)
  SELECT adj.contest_id, adj.entity_id, round(att_adjperf, 8) AS att_adjperf, round(pos_adjperf, 8) AS pos_adjperf, round(av.a, 8) AS att_adjperf_avg, round(av.p, 8) AS pos_adjperf_avg,
  round(dv.a, 8) AS att_adjperf_dec_avg, round(dv.p, 8) AS pos_adjperf_dec_avg FROM adj JOIN av ON av.contest_id = adj.contest_id AND av.entity_id = adj.entity_id JOIN dv ON dv.contest_id = adj.contest_id AND dv.entity_id = adj.entity_id"""))
def _(spark, sf):
    s, p = adj_inputs(spark, sf)
    return rnd(scoring.layered_features(s, STATS, p, {"att": ["*_adjperf"], "pos": ["*_adjperf"]}), ID, 8)


# --- assembly --------------------------------------------------------------------

@query("upsert_features", over_sides("SELECT contest_id, entity_id, land, CASE WHEN kd > 0 THEN att * 2 END AS att FROM sides"))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att", "kd"]).select(*ID, "land", "att", "kd")
    return assemble.add_features(s.drop("kd"), s.filter("kd > 0").select(*ID, (F.col("att") * 2).alias("att")), ID)


@query("delete_insert_contest", over_sides("""SELECT contest_id, entity_id, land FROM sides WHERE contest_id % 3 <> 0 UNION ALL SELECT contest_id, entity_id, land + 1 FROM sides WHERE contest_id % 3 = 0 AND side = 1"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land"]).select(*ID, "side", "land")
    new = s.filter("contest_id % 3 = 0 AND side = 1").withColumn("land", F.col("land") + 1)
    return assemble.replace_partitions(s, new, ["contest_id"]).select(*ID, "land")


@query("wide_assembly", over_sides("""SELECT contest_id, entity_id, event_id, land, att, CASE WHEN kd > 0 THEN kd END AS kd, ctrl FROM sides"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att", "kd", "ctrl"])
    keys = [*ID, "event_id"]
    fam = [s.select(*keys, "land", "att"), s.filter("kd > 0").select(*keys, "kd"), s.select(*keys, "ctrl")]
    return assemble.assemble(s.select(*keys), fam, keys)


@query("attach_odds", over_sides("""SELECT h.contest_id, a.land / CAST(a.att AS DOUBLE) AS f1_ip, b.land / CAST(b.att AS DOUBLE) AS f2_ip FROM headers h
  LEFT JOIN (SELECT * FROM sides WHERE kd > 0) a ON a.contest_id = h.contest_id AND a.entity_id = h.entity1_id
  LEFT JOIN (SELECT * FROM sides WHERE kd > 0) b ON b.contest_id = h.contest_id AND b.entity_id = h.entity2_id"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att", "kd"]).filter("kd > 0").select(*ID, (F.col("land") / F.col("att")).alias("ip"))
    return assemble.attach_both(contest_headers(spark, sf), s, ["ip"]).select("contest_id", "f1_ip", "f2_ip")


@query("diff_features", over_sides("""WITH l AS (SELECT *, lag(land) OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) AS lp, lag(att) OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) AS ap FROM sides)
  SELECT a.contest_id, a.event_date, a.result AS y_true, a.lp AS land, a.ap AS att, b.lp AS land_2, b.ap AS att_2, a.lp - b.lp AS land_diff, a.ap - b.ap AS att_diff
  FROM l a JOIN l b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"])
    prev = win.shift_prev(s, ["land", "att"], KEY, DATE, TIE)
    return assemble.contest_diffs(prev, ["land_prev", "att_prev"], "win_loss", [DATE])


@query("diff_features_decision", over_sides("""SELECT a.contest_id, CAST(CASE WHEN lower(a.method) LIKE '%decision%' THEN 1 ELSE 0 END AS INTEGER) AS y_true, a.land AS side1_land, b.land AS side2_land, a.land - b.land AS land_diff
  FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2"""))
def _(spark, sf):
    return assemble.contest_diffs(contest_sides(spark, sf, ["land"]), ["land"], "decision", [])


def _training(spark, sf):
    """Contest rows with differences and a label, as a model would see them."""
    s = contest_sides(spark, sf, ["land", "att", "ctrl", "kd"])
    out = assemble.contest_diffs(s, ["land", "att", "ctrl", "kd"], "win_loss", [DATE, "event_id", "method", "grp"])
    ids = contest_headers(spark, sf).select("contest_id", "entity1_id", "entity2_id")
    return out.join(ids, "contest_id")


_TRAIN = """tr AS (SELECT a.contest_id, a.event_date, a.event_id, a.method, a.grp, a.result AS y_true, a.entity_id AS entity1_id, b.entity_id AS entity2_id,
  a.land - b.land AS land_diff, a.att - b.att AS att_diff, a.ctrl - b.ctrl AS ctrl_diff, a.kd - b.kd AS kd_diff
  FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2)"""
DIFFS = ["land_diff", "att_diff", "ctrl_diff", "kd_diff"]


@query("corr_with_target", over_sides(f"WITH {_TRAIN} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, y_true), 6) AS r FROM tr WHERE event_date >= DATE '1996-01-01'" for c in DIFFS)))
def _(spark, sf):
    t = _training(spark, sf).filter("event_date >= DATE '1996-01-01'")
    return rnd(assemble.corr_target(t, DIFFS, "y_true"), [])


@query("drop_correlated", over_sides("SELECT contest_id, entity_id, land, att FROM sides"))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att", "ctrl"]).withColumns({"land_rd1x": F.col("land") * 2 + 1, "att_slope": -3 * F.col("att"), "half": F.col("land") / 4})
    cols = ["half", "land", "land_rd1x", "att", "att_slope"]
    drop = assemble.drop_correlated(s, cols, 0.95)
    return s.select(*ID, *[c for c in cols if c not in drop])


@query("filter_contests", over_sides(f"""WITH {_TRAIN}, l AS (SELECT contest_id, event_date, entity1_id AS e FROM tr UNION ALL SELECT contest_id, event_date, entity2_id FROM tr),
  n AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY event_date, contest_id) AS no FROM l)
  SELECT tr.contest_id, tr.event_date, n1.no AS entity1_id_no, n2.no AS entity2_id_no FROM tr JOIN n n1 ON n1.contest_id = tr.contest_id AND n1.e = entity1_id JOIN n n2 ON n2.contest_id = tr.contest_id AND n2.e = entity2_id
  WHERE n1.no > 20 AND n2.no > 20 AND lower(method) NOT LIKE '%submission%' AND y_true IN (0, 1) AND tr.event_date BETWEEN DATE '1995-06-01' AND DATE '1999-06-30'"""))
def _(spark, sf):
    t = _training(spark, sf).withColumn("method", F.when(F.col("method") == "Submission", "DQ").otherwise(F.col("method")))
    out = assemble.filter_contests(t, 20, start="1995-06-01", end="1999-06-30", required=DIFFS)
    return out.select("contest_id", DATE, "entity1_id_no", "entity2_id_no")


@query("balance_roles", over_sides(f"""WITH {_TRAIN}, b AS (SELECT *, CASE WHEN land_diff > -10 THEN 1 ELSE 0 END AS y FROM tr), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = 1) AS ones FROM b),
  r AS (SELECT b.*, row_number() OVER (PARTITION BY y ORDER BY md5('42:' || CAST(contest_id AS VARCHAR)), contest_id) AS rn, CAST(floor(n * 0.5) AS BIGINT) AS want, ones FROM b, c),
  s AS (SELECT *, (y = 1 AND ones > want AND rn <= ones - want) OR (y = 0 AND ones <= want AND rn <= want - ones) AS sw FROM r)
  SELECT contest_id, CASE WHEN sw THEN entity2_id ELSE entity1_id END AS entity1_id, CASE WHEN sw THEN entity1_id ELSE entity2_id END AS entity2_id,
  CAST(CASE WHEN sw THEN 1 - y ELSE y END AS INTEGER) AS y, CASE WHEN sw THEN -land_diff ELSE land_diff END AS land_diff FROM s"""))
def _(spark, sf):
    t = _training(spark, sf).withColumn("y", F.when(F.col("land_diff") > -10, 1).otherwise(0)).select("contest_id", "entity1_id", "entity2_id", "y", "land_diff")
    return assemble.balance(t, "contest_id", "y", [("entity1_id", "entity2_id")])


@query("experience_counts", over_sides("""WITH n AS (SELECT entity_id, count(DISTINCT contest_id) AS n FROM sides GROUP BY 1) SELECT contest_id, a.n AS side1_total, b.n AS side2_total, a.n + b.n AS combined_total
  FROM headers h JOIN n a ON a.entity_id = h.entity1_id JOIN n b ON b.entity_id = h.entity2_id"""))
def _(spark, sf):
    h = contest_headers(spark, sf)
    long = sides.side_ids(h)
    return assemble.experience(long, h.select("contest_id", "entity1_id", "entity2_id"), "entity_id").select("contest_id", "side1_total", "side2_total", "combined_total")


@query("inference_columns", over_sides("""SELECT a.contest_id, a.land AS side1_land, a.land - b.land AS land_diff, b.att AS side2_att, a.ctrl / CAST(a.att AS DOUBLE) AS side1_ctrl_odds
  FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att", "ctrl"]).withColumn("ctrl_odds", F.col("ctrl") / F.col("att"))
    wide = assemble.inference_features(sides.pair_sides(s, ["land", "att", "ctrl_odds"]), ["land", "att", "ctrl_odds"], ["contest_id"])
    return assemble.model_columns(wide, ["land", "land_diff", "side2_att", "ctrl_odds", "ctrl_odds_diff", "unknown"], ["contest_id"])


@query("matchup_cross_diff", over_sides("""SELECT a.contest_id, CASE WHEN a.secs >= 120 AND b.secs >= 120 THEN a.land + b.ctrl - b.land - a.ctrl END AS land_vs_ctrl
  FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2"""))
def _(spark, sf):
    p = sides.pair_sides(contest_sides(spark, sf, ["land", "ctrl", "secs"]), ["land", "ctrl", "secs"])
    return assemble.cross_difference(p, {"land_vs_ctrl": ("land", "ctrl", 120.0)}, ("secs_1", "secs_2")).select("contest_id", "land_vs_ctrl")


@query("context_window", over_sides("""WITH e AS (SELECT event_id, max(event_date) AS d, count(*) AS n FROM sides WHERE event_date < DATE '1998-03-01' GROUP BY 1),
  r AS (SELECT *, sum(n) OVER (ORDER BY d DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS run FROM e)
  SELECT contest_id, entity_id, event_id FROM sides WHERE event_id IN (SELECT event_id FROM r WHERE run <= 500) AND event_date < DATE '1998-03-01'"""))
def _(spark, sf):
    s = contest_sides(spark, sf, []).select(*ID, "event_id", DATE)
    return assemble.prior_context(s, "1998-03-01", 500).select(*ID, "event_id")


_EVID = """ev AS (SELECT 'f' || (entity_id % 12) AS feature, extract(year FROM event_date) AS fold, CASE WHEN avg(land) > 23.5 THEN 1 ELSE -1 END AS direction, avg(land - ctrl) / 100 + 0.05 AS delta FROM sides GROUP BY 1, 2),
  cand AS (SELECT 'f' || i AS feature, i AS position, 'g' || (i % 3) AS grp FROM range(12) t(i))"""


@query("stable_feature_select", over_sides(f"""WITH {_EVID}, p AS (SELECT c.feature, c.position, c.grp, count(ev.fold) AS support, coalesce(count(*) FILTER (WHERE direction > 0), 0) AS positive, coalesce(avg(delta), 0) AS m FROM cand c LEFT JOIN ev ON ev.feature = c.feature GROUP BY 1, 2, 3),
  q AS (SELECT *, support >= 3 AND greatest(positive, support - positive) / CAST(support AS DOUBLE) >= 0.6 AND m > 0.0 AS eligible FROM p)
  SELECT feature, support, positive, round(m, 6) AS mean_delta, eligible, eligible AND row_number() OVER (PARTITION BY grp, eligible ORDER BY m DESC, position) <= 2 AS selected FROM q"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "ctrl"])
    ev = s.groupBy(F.concat(F.lit("f"), (F.col("entity_id") % 12).cast("string")).alias("feature"), F.year(DATE).alias("fold")).agg(
        F.when(F.avg("land") > 23.5, 1).otherwise(-1).alias("direction"), (F.avg(F.col("land") - F.col("ctrl")) / 100 + 0.05).alias("delta"))
    cand = spark.createDataFrame([(f"f{i}", i, f"g{i % 3}") for i in range(12)], "feature string, position int, grp string")
    out = assemble.select_stable(ev, cand, 3, 0.6, 0.0, 2)
    return rnd(out.select("feature", "support", "positive", "mean_delta", "eligible", "selected"), [])


@query("select_profile", over_sides("""WITH e AS (SELECT 'p' || (entity_id % 3) AS profile, extract(year FROM event_date) AS y, avg(land) / 100 AS loss FROM sides WHERE event_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1, 2),
  m AS (SELECT profile, avg(loss) AS ml FROM e GROUP BY 1) SELECT profile, round(ml, 8) AS mean_loss, row_number() OVER (ORDER BY ml, profile) = 1 AS selected FROM m"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land"]).filter("event_date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'")
    ev = s.groupBy(F.concat(F.lit("p"), (F.col("entity_id") % 3).cast("string")).alias("profile"), F.year(DATE).alias("year")).agg((F.avg("land") / 100).alias("loss"))
    return rnd(assemble.select_profile(ev, ["p0", "p1", "p2"], 4), [], 8)


_NEW = "DATE '2002-01-01'"


@query("upcoming_row", over_sides(f"""WITH last AS (SELECT entity_id, max(event_date) AS d, min(event_date) AS f, count(*) AS n FROM sides GROUP BY 1),
  ages AS (SELECT s.entity_id, s.event_date, round((s.event_date - e.dob) / 365.25, 3) AS age FROM sides s JOIN entities e ON e.entity_id = s.entity_id),
  sched AS (SELECT s_suppkey AS entity_id, e.dob FROM supplier JOIN entities e ON e.entity_id = s_suppkey)
  SELECT -1 - CAST(floor(h.entity_id / 2) AS BIGINT) AS contest_id, h.entity_id, round(({_NEW} - h.dob) / 365.25, 3) AS age, CAST(coalesce({_NEW} - l.d, 120) AS INTEGER) AS days_since_last,
  round(coalesce({_NEW} - l.f, 0) / 365.25, 3) AS career_age,
  round((SELECT (coalesce(sum(a.age), 0) + coalesce(round(({_NEW} - h.dob) / 365.25, 3), 0)) / nullif(count(a.age) + CASE WHEN h.dob IS NOT NULL THEN 1 ELSE 0 END, 0) FROM ages a WHERE a.entity_id = h.entity_id), 6) AS age_avg,
  round((SELECT sum(a.age * exp(-ln(2) / 2.0 * ({_NEW} - a.event_date) / 365.25)) / sum(CASE WHEN a.age IS NOT NULL THEN exp(-ln(2) / 2.0 * ({_NEW} - a.event_date) / 365.25) END) FROM ages a WHERE a.entity_id = h.entity_id), 6) AS age_dec_avg
  FROM sched h LEFT JOIN last l ON l.entity_id = h.entity_id""", ENTITIES))
def _(spark, sf):
    e = entities(spark, sf).select("entity_id", "dob")
    hist = contest_sides(spark, sf, []).select(*ID, DATE).join(e, "entity_id")
    plan = e.select((-1 - F.floor(F.col("entity_id") / 2)).alias("contest_id"), "entity_id", F.lit("2002-01-01").cast("date").alias(DATE), "dob")
    return rnd(scoring.inference_rows(hist, plan, 2.0), ID)


_STATIC, _CUT = ["age", "days_since_last", "reach", "height", "career_age"], "DATE '1998-06-01'"
_MEANS = [*_STATIC, *[f"{c}_ratio" for c in _STATIC]]
_SCORE_RATE = math.log(2) / 1.25


def _score_sql() -> str:
    """History path: every scheduled side meets all of its earlier rows."""
    new = {"age": "coalesce(round((h.event_date - e.dob) / 365.25, 3), l.age)", "days_since_last": "h.event_date - l.event_date", "reach": "e.reach", "height": "e.height", "career_age": "round((h.event_date - g.f) / 365.25, 3)"}
    w = f"exp(-{_SCORE_RATE!r} * (n.event_date - p.event_date) / 365.25)"
    means = ", ".join(f"avg(p.{c}) AS {c}_mean, count(p.{c}) AS {c}_n, sum(p.{c} * {w}) / sum(CASE WHEN p.{c} IS NOT NULL THEN {w} END) AS {c}_dec_avg" for c in _MEANS)
    avg = lambda c: f"CASE WHEN s.{c} IS NULL THEN m.{c}_mean ELSE (coalesce(m.{c}_mean, 0) * m.{c}_n + s.{c}) / (m.{c}_n + 1) END AS {c}_avg"
    features = [*_MEANS, *[f"{c}_avg" for c in _MEANS], *[f"{c}_dec_avg" for c in _MEANS], "land", "att"]
    return over_sides(f"""WITH own AS (SELECT s.contest_id, s.entity_id, s.event_date, s.land, s.att, round((s.event_date - e.dob) / 365.25, 3) AS age, e.reach, e.height,
      coalesce(s.event_date - lag(s.event_date) OVER w, 120) AS days_since_last, round((s.event_date - min(s.event_date) OVER (PARTITION BY s.entity_id)) / 365.25, 3) AS career_age
      FROM sides s JOIN entities e ON e.entity_id = s.entity_id WINDOW w AS (PARTITION BY s.entity_id ORDER BY s.event_date, s.contest_id)),
    past AS MATERIALIZED (SELECT a.*, {', '.join(f'a.{c} / CAST(nullif(a.{c} + b.{c}, 0) AS DOUBLE) AS {c}_ratio' for c in _STATIC)} FROM own a JOIN own b ON b.contest_id = a.contest_id AND b.entity_id <> a.entity_id WHERE a.event_date < {_CUT}),
    g AS (SELECT entity_id, min(event_date) AS f, count(*) AS total FROM past GROUP BY 1 HAVING count(*) >= 2),
    l AS (SELECT * FROM past QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY event_date DESC, contest_id DESC) = 1),
    plan AS (SELECT contest_id, event_date, entity1_id, entity2_id FROM headers WHERE event_date >= {_CUT}),
    new0 AS (SELECT h.contest_id, h.event_date, no, g.entity_id, g.total, l.land, l.att, {', '.join(f'{x} AS {c}' for c, x in new.items())}
      FROM plan h, range(1, 3) r(no) JOIN g ON g.entity_id = CASE no WHEN 1 THEN h.entity1_id ELSE h.entity2_id END JOIN l ON l.entity_id = g.entity_id JOIN entities e ON e.entity_id = g.entity_id),
    n AS MATERIALIZED (SELECT a.*, {', '.join(f'a.{c} / CAST(nullif(a.{c} + b.{c}, 0) AS DOUBLE) AS {c}_ratio' for c in _STATIC)} FROM new0 a JOIN new0 b ON b.contest_id = a.contest_id AND b.no <> a.no),
    m AS (SELECT n.contest_id, n.no, {means} FROM n JOIN past p ON p.entity_id = n.entity_id GROUP BY 1, 2),
    s AS (SELECT s.*, {', '.join(avg(c) for c in _MEANS)}, {', '.join(f'm.{c}_dec_avg' for c in _MEANS)} FROM n s JOIN m ON m.contest_id = s.contest_id AND m.no = s.no)
    SELECT a.contest_id, a.event_date, round(a.age, 6) AS side1_age, round(b.career_age_dec_avg, 6) AS side2_career_age_dec_avg, {', '.join(f'round(a.{c} - b.{c} + 1e-9, 6) AS {c}_diff' for c in features)},
      a.total AS side1_total, a.total + b.total AS combined_total, round(CASE a.contest_id % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 100 / 230.0 END, 6) AS implied_prob FROM s a JOIN s b ON b.contest_id = a.contest_id AND a.no = 1 AND b.no = 2""", ENTITIES)


@query("score_from_states", _score_sql())
def _(spark, sf):
    played = cut(contest_sides(spark, sf, ["land", "att"]).select(*ID, "opponent_id", "side", DATE, "land", "att"))
    h = played.drop("opponent_id", "side").join(entities(spark, sf).select("entity_id", "dob", "reach", "height"), "entity_id")
    h.is_cut = True  # days are read from the cut rows, what is joined to them is made once
    h = win.gap_days(h, KEY, DATE, TIE)
    h.is_cut = True
    h = win.tenure_years(h, KEY, DATE).withColumn("age", F.round(F.datediff(DATE, "dob") / 365.25, 3))
    h = cut(sides.opponent(h, _STATIC)).withColumns({f"{c}_ratio": F.try_divide(F.col(c).cast("double"), F.col(c) + F.col(f"{c}_opp")) for c in _STATIC})
    # two tables of states, as a later refresh would leave them, merged
    state = lambda rows: standing.entity_states(rows, _MEANS, ["dob", *_STATIC, "land", "att"], _SCORE_RATE, "1995-01-01")
    states = standing.merge_states([state(h.filter(f"{DATE} < DATE '1996-01-01'")), state(h.filter(f"{DATE} >= DATE '1996-01-01' AND {DATE} < {_CUT}"))])
    american = F.when(F.col("contest_id") % 3 == 0, -150).when(F.col("contest_id") % 3 == 1, 130)
    first = played.filter(f"side = 1 AND {DATE} >= {_CUT}")
    plan = first.select("contest_id", DATE, F.col("entity_id").alias("entity1_id"), F.col("opponent_id").alias("entity2_id"), american.alias("odds"))
    features = [*_MEANS, *[f"{c}_avg" for c in _MEANS], *[f"{c}_dec_avg" for c in _MEANS], "land", "att"]
    wanted = ["age", "side2_career_age_dec_avg", *[f"{c}_diff" for c in features], "side1_total", "combined_total", "implied_prob", "unknown"]
    out = scoring.score_schedule(states, plan, _STATIC, ["land", "att"], wanted, odds="odds")
    return rnd(out.withColumns({f"{c}_diff": F.col(f"{c}_diff").cast("double") + 1e-9 for c in features}), [])  # means of whole thousandths tie at six digits


# --- splits and weights --------------------------------------------------------------

@query("chrono_split", over_sides("""WITH r AS (SELECT contest_id, row_number() OVER (ORDER BY event_date, contest_id) AS rn, count(*) OVER () AS n FROM headers)
  SELECT contest_id, CASE WHEN rn <= CAST(floor(n * 0.7) AS BIGINT) THEN 'train' WHEN rn <= CAST(floor(n * (0.7 + 0.15)) AS BIGINT) THEN 'validation' ELSE 'test' END AS split FROM r"""))
def _(spark, sf):
    h = contest_headers(spark, sf).select("contest_id", DATE)
    return splits.chrono_split(h, [DATE, "contest_id"], [0.7, 0.15], ["train", "validation", "test"]).select("contest_id", "split")


@query("chrono_groups", over_sides("""WITH r AS (SELECT contest_id, row_number() OVER (ORDER BY event_date, contest_id) AS rn, count(*) OVER () AS n FROM headers)
  SELECT contest_id, CAST(least((rn - 1) // (n // 4), 3) AS INTEGER) AS time_group FROM r"""))
def _(spark, sf):
    h = contest_headers(spark, sf).select("contest_id", DATE)
    return splits.time_groups(h, [DATE, "contest_id"], 4).select("contest_id", "time_group")


@query("holdout_by_date", over_sides("SELECT contest_id, event_date FROM headers WHERE event_date > DATE '1999-06-30'"))
def _(spark, sf):
    return splits.holdout_by_date(contest_headers(spark, sf).select("contest_id", DATE), DATE, "1999-06-30")


@query("walk_forward_folds", over_sides("""WITH y AS (SELECT min(extract(year FROM event_date)) AS lo, max(extract(year FROM event_date)) AS hi FROM headers),
  f AS (SELECT CAST(i AS INTEGER) AS fold, greatest(lo, lo + 2 + i - 2) AS tr_lo, lo + 1 + i AS tr_hi, lo + 2 + i AS te FROM y, range(0, 20) t(i) WHERE lo + 2 + i <= hi),
  b AS (SELECT f.*, (SELECT min(event_date) FROM headers WHERE extract(year FROM event_date) = te) - 30 AS gap FROM f)
  SELECT fold, 'train' AS role, contest_id FROM b JOIN headers ON extract(year FROM event_date) BETWEEN tr_lo AND tr_hi AND event_date <= gap
  UNION ALL SELECT fold, 'test', contest_id FROM b JOIN headers ON extract(year FROM event_date) = te"""))
def _(spark, sf):
    return splits.walk_forward(contest_headers(spark, sf).select("contest_id", DATE), "contest_id", DATE, 2, 1, rolling_years=2, gap_days=30)


@query("nested_embargo_folds", over_sides("""WITH y AS (SELECT unnest([1996, 1997, 1998]) AS ty), b AS (SELECT CAST(ty AS INTEGER) AS test_year, (SELECT min(event_date) FROM headers WHERE extract(year FROM event_date) = ty) - 7 AS oc,
  (SELECT min(event_date) FROM headers WHERE extract(year FROM event_date) = ty - 1) - 7 AS ic FROM y)
  SELECT test_year, 'test' AS role, contest_id FROM b JOIN headers ON extract(year FROM event_date) = test_year
  UNION ALL SELECT test_year, 'train', contest_id FROM b JOIN headers ON event_date <= oc
  UNION ALL SELECT test_year, 'inner_validation', contest_id FROM b JOIN headers ON event_date <= oc AND extract(year FROM event_date) = test_year - 1
  UNION ALL SELECT test_year, 'inner_train', contest_id FROM b JOIN headers ON event_date <= oc AND event_date <= ic"""))
def _(spark, sf):
    return splits.nested_folds(contest_headers(spark, sf).select("contest_id", DATE), "contest_id", DATE, [1996, 1997, 1998])


@query("fold_checks", "SELECT CAST(y AS INTEGER) AS test_year, CAST(0 AS BIGINT) AS contest_id_outer, CAST(0 AS BIGINT) AS contest_id_inner, CAST(0 AS BIGINT) AS event_date_outer, CAST(0 AS BIGINT) AS event_date_inner, 0 AS outer_embargo, 0 AS inner_embargo, 0 AS inner_reaches_test FROM (SELECT unnest([1997, 1998]) AS y) WHERE (SELECT count(*) FROM orders) > 0")
def _(spark, sf):
    h = cut(contest_headers(spark, sf).select("contest_id", "event_date"))
    folds = splits.nested_folds(h, "contest_id", DATE, [1997, 1998])
    return splits.fold_violations(folds, h.withColumn("day", F.col(DATE)), "contest_id", "day", DATE).withColumnsRenamed({"day_outer": "event_date_outer", "day_inner": "event_date_inner"})


@query("date_partition_split", over_sides("""SELECT contest_id, CASE WHEN event_date <= DATE '1998-12-31' THEN 'train' WHEN event_date <= DATE '1999-12-31' THEN 'tune' ELSE 'test' END AS partition FROM headers"""))
def _(spark, sf):
    bounds = {"train": ("1900-01-01", "1998-12-31"), "tune": ("1999-01-01", "1999-12-31"), "test": ("2000-01-01", "2100-12-31")}
    return splits.event_split(contest_headers(spark, sf).select("contest_id", DATE), DATE, bounds).select("contest_id", "partition")


@query("recency_weights", over_sides("""WITH w AS (SELECT contest_id, exp(-0.1 * ((SELECT max(event_date) FROM headers) - event_date) / 365.25) AS w FROM headers) SELECT contest_id, round(w / avg(w) OVER (), 6) AS weight FROM w"""))
def _(spark, sf):
    out = splits.recency_weights(cut(contest_headers(spark, sf).select("contest_id", DATE)), DATE, 0.1)
    return out.select("contest_id", F.round("weight", 6).alias("weight"))


@query("weight_schemes", over_sides("""WITH e AS (SELECT event_id, row_number() OVER (ORDER BY max(event_date) DESC, CAST(event_id AS VARCHAR) DESC) AS rk FROM headers GROUP BY 1)
  SELECT contest_id, round(CASE WHEN event_date >= DATE '1997-01-01' THEN exp(-0.3 * (DATE '2002-01-01' - event_date) / 365.25) ELSE 0.0 END, 6) AS by_date,
  CASE WHEN event_date >= DATE '1997-01-01' THEN CAST(CASE WHEN rk <= 50 THEN 1.0 WHEN rk <= 400 THEN 0.5 ELSE 0.25 END AS DOUBLE) ELSE 0.0 END AS by_rank FROM headers h JOIN e ON e.event_id = h.event_id"""))
def _(spark, sf):
    h = cut(contest_headers(spark, sf).select("contest_id", "event_id", DATE))
    a = splits.horizon_weights(h, DATE, "event_id", "2002-01-01", "exponential", 5, 0.3, name="by_date")
    b = splits.horizon_weights(a, DATE, "event_id", "2002-01-01", "piecewise", 5, rank_cutoffs=[50, 400], rank_weights=[1.0, 0.5, 0.25], name="by_rank")
    return b.select("contest_id", F.round("by_date", 6).alias("by_date"), "by_rank")


def _scaled_sql(expr: str) -> str:
    return over_sides(f"""WITH t AS (SELECT * FROM sides WHERE event_date < DATE '1999-01-01'), p AS (SELECT {expr} FROM t)
      SELECT contest_id, entity_id, round((land - lc) / ls, 6) AS land, round((att - ac) / a_s, 6) AS att FROM sides, p WHERE event_date >= DATE '1999-01-01'""")


@query("zscore_scale", _scaled_sql("avg(land) AS lc, stddev_pop(land) AS ls, avg(att) AS ac, stddev_pop(att) AS a_s"))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"]).select(*ID, DATE, "land", "att")
    _, out = splits.zscore_scale(s.filter("event_date < DATE '1999-01-01'"), [s.filter("event_date >= DATE '1999-01-01'")], ["land", "att"])
    return rounded(out, ["land", "att"])


@query("robust_scale", _scaled_sql("quantile_cont(ctrl + land, 0.5) AS lc0, quantile_cont(land, 0.5) AS lc, quantile_cont(land, 0.75) - quantile_cont(land, 0.25) AS ls, quantile_cont(att, 0.5) AS ac, quantile_cont(att, 0.75) - quantile_cont(att, 0.25) AS a_s"))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"]).select(*ID, DATE, "land", "att")
    _, out = splits.robust_scale(s.filter("event_date < DATE '1999-01-01'"), [s.filter("event_date >= DATE '1999-01-01'")], ["land", "att"])
    return rounded(out, ["land", "att"])
