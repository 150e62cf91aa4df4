"""Priors, smoothing, first-order rates and the history features that need priors."""

from pyspark.sql import functions as F

from ..operators import history as hst
from ..operators import percentiles as pct
from ..operators import priors, quality, rates, select, sides, smooth
from ..operators import windows as win
from ..sample import contest_headers, contest_sides, entities
from ..session import constants, cut, small_join
from .history import DATE, ID, KEY, RATE, TIE, rounded
from .registry import ENTITIES, over_sides, query

FIT = ("1995-01-01", "1999-12-31")
ALL = ("1995-01-01", "2000-06-30")
IN_FIT = "event_date BETWEEN DATE '1995-01-01' AND DATE '1999-12-31'"
IN_ALL = "event_date BETWEEN DATE '1995-01-01' AND DATE '2000-06-30'"


def rnd(df, keys, digits=6):
    """Round every double column for comparison."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


# --- other side of the contest -------------------------------------------------

@query("opponent_value", over_sides("""SELECT a.contest_id, a.entity_id, b.land AS land_opp, b.ctrl AS ctrl_opp FROM sides a JOIN sides b
  ON a.contest_id = b.contest_id AND a.entity_id <> b.entity_id"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "ctrl"]).select(*ID, "land", "ctrl")
    return sides.opponent(s, ["land", "ctrl"]).select(*ID, "land_opp", "ctrl_opp")


@query("defense", over_sides("""SELECT a.contest_id, a.entity_id, round(b.land / CAST(b.att AS DOUBLE), 6) AS sig_def FROM sides a JOIN sides b
  ON a.contest_id = b.contest_id AND a.entity_id <> b.entity_id"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"]).select(*ID, (F.col("land") / F.col("att")).alias("sig_acc"))
    return rounded(sides.defense(s, ["sig_acc"]), ["sig_def"])


@query("contest_share", over_sides("""SELECT a.contest_id, a.entity_id,
  CASE WHEN a.land + b.land > 0 THEN CAST(round(CAST(a.land AS DECIMAL(18,6)) / (a.land + b.land), 3) AS DOUBLE) ELSE 0.0 END AS land_ratio,
  CASE WHEN a.ctrl + b.ctrl > 0 THEN CAST(round(CAST(a.ctrl AS DECIMAL(18,6)) / (a.ctrl + b.ctrl), 3) AS DOUBLE) ELSE 0.0 END AS ctrl_ratio
  FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.entity_id <> b.entity_id"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "ctrl"]).select(*ID, "land", "ctrl")
    return sides.share_ratio(s, ["land", "ctrl"]).select(*ID, "land_ratio", "ctrl_ratio")


@query("fight_total_normalise", over_sides("""SELECT contest_id, entity_id, round(CASE WHEN sum(land) OVER (PARTITION BY contest_id) > 0
  THEN land / CAST(sum(land) OVER (PARTITION BY contest_id) AS DOUBLE) ELSE 0.5 END, 6) AS land_share FROM sides"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land"]).select(*ID, "land")
    return rounded(sides.share_of_total(s, ["land"], ["contest_id"], "_share"), ["land_share"])


@query("pair_sides", over_sides("""SELECT a.contest_id, a.event_date, a.land AS land_1, a.att AS att_1, b.land AS land_2, b.att AS att_2
  FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"])
    return sides.pair_sides(s, ["land", "att"], head=["event_date"])


@query("head_to_head_or_join", over_sides("""SELECT h.grp, round(avg(e.height), 6) AS mean_height, count(*) AS n FROM headers h JOIN entities e
  ON h.entity1_id = e.entity_id OR h.entity2_id = e.entity_id WHERE e.height IS NOT NULL GROUP BY 1""", ENTITIES))
def _(spark, sf):
    ids = contest_headers(spark, sf).select("grp", F.explode(F.array("entity1_id", "entity2_id")).alias("entity_id"))
    out = ids.join(entities(spark, sf).filter("height IS NOT NULL").select("entity_id", "height"), "entity_id")
    return out.groupBy("grp").agg(F.round(F.avg("height"), 6).alias("mean_height"), F.count(F.lit(1)).alias("n"))


@query("anti_existing", """SELECT s_suppkey AS entity_id FROM supplier WHERE s_suppkey NOT IN (SELECT c_nationkey FROM customer)""")
def _(spark, sf):
    from ..sample import table

    known = table(spark, sf, "customer").select(F.col("c_nationkey").cast("bigint").alias("entity_id"))
    return select.anti_existing(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id")), known, ["entity_id"])


@query("exists_semi", over_sides("""SELECT o_orderkey AS contest_id FROM orders WHERE EXISTS (SELECT 1 FROM sides WHERE contest_id // 1009 = o_orderkey)"""))
def _(spark, sf):
    from ..sample import table

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest_id"))
    h = contest_headers(spark, sf, "order_id").select(F.col("order_id").alias("contest_id"))
    return select.exists_semi(o, h, ["contest_id"])


@query("one_row_per_entity_alias", over_sides("""WITH a AS (SELECT 'n' || (entity_id % 40) AS name, entity_id, max(event_date) AS d, count(*) AS n FROM sides GROUP BY 1, 2)
  SELECT name, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d DESC, n DESC, CAST(entity_id AS VARCHAR) DESC) AS rn FROM a) WHERE rn = 1"""))
def _(spark, sf):
    s = contest_sides(spark, sf, []).select("entity_id", "event_date", F.concat(F.lit("n"), (F.col("entity_id") % 40).cast("string")).alias("name"))
    return select.pick_canonical_id(s, "name", "entity_id", "event_date")


# --- priors ---------------------------------------------------------------------

def _fit_rows(spark, sf, stats):
    return contest_sides(spark, sf, stats).select(*ID, DATE, "event_id", "grp", *stats)


def _layer(spark, sf, stats):
    """The side rows written once, for features that read them several times."""
    return cut(_fit_rows(spark, sf, stats))


@query("group_mean_prior", over_sides(f"""SELECT grp, round(avg(land), 6) AS land_wc_mean, round(avg(att), 6) AS att_wc_mean FROM sides
  WHERE {IN_FIT} GROUP BY 1 HAVING count(*) >= 10"""))
def _(spark, sf):
    return rnd(priors.group_mean(_fit_rows(spark, sf, ["land", "att"]), ["land", "att"], "grp", DATE, FIT), ["grp"])


_MAD = """m AS (SELECT grp, quantile_cont(att, 0.5) AS am, quantile_cont(land, 0.5) AS lm FROM {src} GROUP BY 1 {having})
  SELECT s.grp, round(quantile_cont(abs(att - am), 0.5), 6) AS att_wc_mad, round(quantile_cont(abs(land - lm), 0.5), 6) AS land_wc_mad
  FROM {src} s JOIN m ON m.grp = s.grp GROUP BY 1"""


@query("group_mad_prior", over_sides(f"WITH f AS (SELECT * FROM sides WHERE {IN_FIT}), " + _MAD.format(src="f", having="HAVING count(*) >= 10")))
def _(spark, sf):
    return rnd(priors.group_mad(_fit_rows(spark, sf, ["land", "att"]), ["land", "att"], "grp", DATE, FIT), ["grp"])


HIST_ORDER = "(p.event_date < c.event_date OR (p.event_date = c.event_date AND p.contest_id <= c.contest_id))"
_DEBUT = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) AS rn FROM sides),
  db AS (SELECT * FROM rk WHERE rn = 1 AND {IN_FIT}), dm AS (SELECT grp, quantile_cont(att, 0.5) AS am FROM db GROUP BY 1),
  debut AS (SELECT d.grp, quantile_cont(abs(att - am), 0.5) AS att_wc_mad FROM db d JOIN dm ON dm.grp = d.grp GROUP BY 1)"""
_RUNMAD = f"""{_DEBUT},
  med AS (SELECT c.contest_id, c.entity_id, quantile_cont(p.att, 0.5) AS m FROM sides c JOIN sides p ON p.entity_id = c.entity_id AND {HIST_ORDER} GROUP BY 1, 2),
  runmad AS (SELECT c.contest_id, c.entity_id, c.event_date, c.grp, quantile_cont(abs(p.att - m.m), 0.5) AS raw_mad, max(m.m) AS m, count(*) AS n
    FROM sides c JOIN med m ON m.contest_id = c.contest_id AND m.entity_id = c.entity_id
    JOIN sides p ON p.entity_id = c.entity_id AND {HIST_ORDER} GROUP BY 1, 2, 3, 4),
  mads AS (SELECT r.*, CASE WHEN n = 1 THEN coalesce(d.att_wc_mad, 0) ELSE raw_mad END AS att_mad FROM runmad r LEFT JOIN debut d ON d.grp = r.grp)"""


def running_mads(spark, sf, stats=("att",)):
    """Running MAD with the group's debut MAD on each first row."""
    s = _layer(spark, sf, list(stats))
    debut = priors.debut_mad(s, list(stats), "grp", DATE, FIT, [DATE, "contest_id"])
    out = hst.running_order_stats(win.contest_no(s, KEY, DATE, TIE), list(stats), KEY, DATE, TIE)
    out = small_join(out, debut, ["grp"], "left")
    return out.withColumns({
        f"{c}_mad": F.when(F.col("contest_no") == 1, F.coalesce(f"{c}_wc_mad", F.lit(0.0))).otherwise(F.col(f"{c}_mad")) for c in stats})


@query("running_mad", over_sides(f"WITH {_RUNMAD} SELECT contest_id, entity_id, round(att_mad, 6) AS att_mad FROM mads"))
def _(spark, sf):
    return rounded(running_mads(spark, sf), ["att_mad"])


_LONG = "ORDER BY o_orderdate, o_orderkey"


@query("running_mad_long", f"""WITH x AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_custkey % 3 = 0 THEN round(o_totalprice) ELSE 0 END AS price FROM orders)
  SELECT o_orderkey, round(quantile_cont(price, 0.5) OVER w, 6) AS price_median, round(mad(price) OVER w, 6) AS price_mad FROM x WINDOW w AS ({_LONG} ROWS UNBOUNDED PRECEDING)""")
def _(spark, sf):
    # all orders are one history, two thirds of it zeros, cut into blocks of 4,096 rows
    o = spark.read.parquet(f"{sf}/orders.parquet")
    price = F.when(F.col("o_custkey") % 3 == 0, F.round("o_totalprice")).otherwise(0.0)
    x = o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), F.lit("all").alias("history"), price.alias("price"))
    out = hst.running_order_stats(x, ["price"], ["history"], "day", ["o_orderkey"], block=4096)
    return rnd(out.select("o_orderkey", "price_median", "price_mad"), [])


@query("min_mad_floor", over_sides(f"""WITH {_RUNMAD} SELECT grp, round(quantile_cont(CASE WHEN att_mad > 0 THEN att_mad END, 0.005), 6) AS att_min_mad
  FROM mads WHERE {IN_FIT} GROUP BY 1"""))
def _(spark, sf):
    return rnd(priors.mad_floor(running_mads(spark, sf), ["att"], "grp", DATE, FIT), ["grp"])


_SDEV = f"""fk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) AS rn FROM sides WHERE {IN_FIT}),
  ds AS (SELECT grp, stddev_samp(att) AS att_wc_sdev FROM fk WHERE rn = 1 GROUP BY 1),
  sd AS (SELECT s.contest_id, s.entity_id, s.event_date, s.grp, CASE WHEN row_number() OVER w = 1 THEN d.att_wc_sdev
    ELSE coalesce(stddev_samp(att) OVER w, 0) END AS att_sdev FROM sides s LEFT JOIN ds d ON d.grp = s.grp
    WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, contest_id ROWS UNBOUNDED PRECEDING))"""


def _with_debut_sdev(spark, sf, stats):
    s = _layer(spark, sf, stats)
    debut = priors.debut_sdev(s, stats, "grp", DATE, FIT, [DATE, "contest_id"])
    return small_join(s, debut, ["grp"], "left")


@query("running_sdev", over_sides(f"WITH {_SDEV} SELECT contest_id, entity_id, round(att_sdev, 5) AS att_sdev FROM sd"))
def _(spark, sf):
    out = win.running_sdev(_with_debut_sdev(spark, sf, ["att"]), ["att"], KEY, DATE, TIE, {"att": F.col("att_wc_sdev")})
    return rounded(out, ["att_sdev"], 5)


@query("min_sdev_floor", over_sides(f"WITH {_SDEV} SELECT grp, round(quantile_cont(att_sdev, 0.05), 5) AS att_min_sdev FROM sd WHERE {IN_FIT} GROUP BY 1"))
def _(spark, sf):
    out = win.running_sdev(_with_debut_sdev(spark, sf, ["att"]), ["att"], KEY, DATE, TIE, {"att": F.col("att_wc_sdev")})
    return rnd(priors.sdev_floor(out, ["att"], "grp", DATE, FIT), ["grp"], 5)


@query("group_median_of_sdev", over_sides(f"WITH {_SDEV} SELECT grp, round(quantile_cont(att_sdev, 0.5), 5) AS att_sdev_median FROM sd GROUP BY 1"))
def _(spark, sf):
    out = win.running_sdev(_with_debut_sdev(spark, sf, ["att"]), ["att"], KEY, DATE, TIE, {"att": F.col("att_wc_sdev")})
    return rnd(pct.group_median(out, ["grp"], ["att_sdev"]), ["grp"], 5)


_W = f"exp(-{RATE!r} * (c.event_date - p.event_date) / 365.25)"


@query("decayed_sdev", over_sides(f"""WITH {_SDEV}, agg AS (SELECT c.contest_id, c.entity_id, c.grp, sum({_W}) AS w, sum(p.att * {_W}) AS wx,
    sum(p.att * p.att * {_W}) AS wx2, count(*) AS n FROM sides c JOIN sides p ON p.entity_id = c.entity_id AND {HIST_ORDER} GROUP BY 1, 2, 3)
  SELECT contest_id, entity_id, round(CASE WHEN n <= 1 THEN coalesce(att_wc_sdev, 0) ELSE sqrt(greatest(wx2 / w - (wx / w) * (wx / w), 0)) END, 4) AS att_dec_sdev
  FROM agg LEFT JOIN ds ON ds.grp = agg.grp"""))
def _(spark, sf):
    out = win.decayed_sdev(_with_debut_sdev(spark, sf, ["att"]), ["att"], KEY, DATE, TIE, 2.0, {"att": F.col("att_wc_sdev")})
    return rounded(out, ["att_dec_sdev"], 4)


@query("decayed_mad", over_sides(f"""WITH {_RUNMAD}, wm AS (SELECT c.contest_id, c.entity_id, sum(abs(p.att - m.m) * {_W}) / sum({_W}) AS v
    FROM sides c JOIN med m ON m.contest_id = c.contest_id AND m.entity_id = c.entity_id JOIN sides p ON p.entity_id = c.entity_id AND {HIST_ORDER} GROUP BY 1, 2)
  SELECT r.contest_id, r.entity_id, round(CASE WHEN n <= 1 THEN coalesce(d.att_wc_mad, 0) ELSE v END, 6) AS att_dec_mad
  FROM runmad r JOIN wm ON wm.contest_id = r.contest_id AND wm.entity_id = r.entity_id LEFT JOIN debut d ON d.grp = r.grp"""))
def _(spark, sf):
    s = _layer(spark, sf, ["att"])
    debut = priors.debut_mad(s, ["att"], "grp", DATE, FIT, [DATE, "contest_id"])
    out = hst.running_order_stats(win.contest_no(s, KEY, DATE, TIE), ["att"], KEY, DATE, TIE, rate=RATE)
    out = small_join(out, debut, ["grp"], "left")
    v = F.when(F.col("contest_no") <= 1, F.coalesce("att_wc_mad", F.lit(0.0))).otherwise(F.coalesce("att_dmad", F.lit(0.0)))
    return rounded(out.withColumn("att_dec_mad", v), ["att_dec_mad"])


@query("first_time_avg", over_sides(f"""WITH f AS (SELECT entity_id, min(event_id) AS event_id FROM sides GROUP BY 1)
  SELECT s.grp, round(avg(land), 6) AS land_wc_avg, round(avg(att), 6) AS att_wc_avg FROM sides s JOIN f ON f.entity_id = s.entity_id AND f.event_id = s.event_id
  WHERE {IN_FIT} GROUP BY 1"""))
def _(spark, sf):
    return rnd(priors.first_event_avg(_fit_rows(spark, sf, ["land", "att"]), ["land", "att"], "grp", DATE, FIT), ["grp"])


@query("first_time_sdev", over_sides(f"""SELECT grp, round(stddev_samp(land), 6) AS land_wc_sdev, round(stddev_samp(att), 6) AS att_wc_sdev FROM (SELECT *, row_number() OVER
  (PARTITION BY entity_id ORDER BY event_date, contest_id) AS rn FROM sides WHERE {IN_FIT}) WHERE rn = 1 GROUP BY 1"""))
def _(spark, sf):
    return rnd(priors.debut_sdev(_fit_rows(spark, sf, ["land", "att"]), ["land", "att"], "grp", DATE, FIT, [DATE, "contest_id"]), ["grp"])


@query("first_time_mad", over_sides(f"""WITH rk AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) AS rn FROM sides),
  f AS (SELECT * FROM rk WHERE rn = 1 AND {IN_FIT}), """ + _MAD.format(src="f", having="")))
def _(spark, sf):
    return rnd(priors.debut_mad(_fit_rows(spark, sf, ["land", "att"]), ["land", "att"], "grp", DATE, FIT, [DATE, "contest_id"]), ["grp"])


def _rates(spark, sf):
    s = _layer(spark, sf, ["land", "att", "kd", "secs"])
    spec = {"land": (F.col("land"), F.col("secs") / 60.0), "kd": (F.col("kd"), F.col("secs") / 60.0)}
    return s, spec, priors.ratio_priors(s, spec, "grp", DATE, FIT, ALL, 10, F.col("secs") > 0)


@query("rate_prior", over_sides(f"""SELECT 'group' AS level, grp, round(sum(land) / (sum(secs) / 60.0), 8) AS land_rate, round(sum(kd) / (sum(secs) / 60.0), 8) AS kd_rate
  FROM sides WHERE secs > 0 AND {IN_FIT} GROUP BY 2 HAVING count(*) >= 10
  UNION ALL SELECT 'all', NULL, round(sum(land) / (sum(secs) / 60.0), 8), round(sum(kd) / (sum(secs) / 60.0), 8) FROM sides WHERE secs > 0 AND {IN_ALL}"""))
def _(spark, sf):
    return rnd(_rates(spark, sf)[2].select("level", "grp", "land_rate", "kd_rate"), [], 8)


@query("success_prior", over_sides(f"""SELECT 'group' AS level, grp, round(sum(kd) / CAST(count(*) AS DOUBLE), 8) AS kd_rate, round(sum(ctrl) / CAST(sum(att) AS DOUBLE), 8) AS ctrl_rate
  FROM sides WHERE {IN_FIT} GROUP BY 2 HAVING count(*) >= 10
  UNION ALL SELECT 'all', NULL, round(sum(kd) / CAST(count(*) AS DOUBLE), 8), round(sum(ctrl) / CAST(sum(att) AS DOUBLE), 8) FROM sides WHERE {IN_FIT}"""))
def _(spark, sf):
    s = _fit_rows(spark, sf, ["kd", "ctrl", "att"])
    spec = {"kd": (F.col("kd"), F.lit(1)), "ctrl": (F.col("ctrl"), F.col("att"))}
    return rnd(priors.ratio_priors(s, spec, "grp", DATE, FIT, FIT, 10).select("level", "grp", "kd_rate", "ctrl_rate"), [], 8)


@query("accuracy_prior", over_sides(f"""SELECT 'group' AS level, grp, round(sum(land) / CAST(sum(att) AS DOUBLE), 8) AS sig_rate, round(sum(land_rd1) / CAST(sum(att_rd1) AS DOUBLE), 8) AS sig_rd1_rate
  FROM sides WHERE {IN_FIT} GROUP BY 2
  UNION ALL SELECT 'all', NULL, round(sum(land) / CAST(sum(att) AS DOUBLE), 8), round(sum(land_rd1) / CAST(sum(att_rd1) AS DOUBLE), 8) FROM sides WHERE {IN_ALL}"""))
def _(spark, sf):
    s = _fit_rows(spark, sf, ["land", "att", "land_rd1", "att_rd1"])
    spec = {"sig": (F.col("land"), F.col("att")), "sig_rd1": (F.col("land_rd1"), F.col("att_rd1"))}
    return rnd(priors.ratio_priors(s, spec, "grp", DATE, FIT, ALL, 1).select("level", "grp", "sig_rate", "sig_rd1_rate"), [], 8)


@query("league_average", over_sides("""SELECT contest_id, entity_id, round(avg(land) OVER (PARTITION BY grp), 6) AS land_league FROM sides WHERE event_date >= DATE '1997-01-01'"""))
def _(spark, sf):
    return rounded(priors.league_average(_fit_rows(spark, sf, ["land"]), ["land"], "grp", DATE, "1997-01-01"), ["land_league"])


@query("zero_frequency", over_sides(" UNION ALL ".join(
    f"SELECT '{c}' AS stat, round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 8) AS zero_freq, count({c}) AS total_rows FROM sides" for c in ("land", "ctrl", "kd"))))
def _(spark, sf):
    return rnd(priors.zero_freq(contest_sides(spark, sf, ["land", "ctrl", "kd"]), ["land", "ctrl", "kd"]), [], 8)


_POWER = """pw AS (SELECT grp, avg(kd / CAST(att AS DOUBLE)) AS m, 1 + 59 * avg(CASE WHEN kd = 0 THEN 1.0 ELSE 0.0 END) AS s FROM sides WHERE att > 0 GROUP BY 1),
  pp AS (SELECT grp, CASE WHEN m > 0 THEN m * s ELSE 0.1 END AS alpha, CASE WHEN m < 1 THEN (1 - m) * s ELSE 0.1 END AS beta FROM pw)"""


@query("power_prior", over_sides(f"WITH {_POWER} SELECT grp, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM pp"))
def _(spark, sf):
    return rnd(priors.zero_inflated_beta(contest_sides(spark, sf, ["kd", "att"]), F.col("kd"), F.col("att"), "grp"), [])


@query("power_score", over_sides(f"WITH {_POWER} SELECT contest_id, entity_id, round((alpha + kd) / (alpha + beta + att) * 1000.0, 3) AS power_score FROM sides s JOIN pp ON pp.grp = s.grp"))
def _(spark, sf):
    s = contest_sides(spark, sf, ["kd", "att"])
    prior = priors.zero_inflated_beta(s, F.col("kd"), F.col("att"), "grp")
    return rates.power_score(s, prior, F.col("kd"), F.col("att"), "grp").select(*ID, "power_score")


@query("gamma_rate_prior", over_sides("""WITH r AS (SELECT grp, avg(kd / CAST(secs AS DOUBLE)) AS r, avg(CASE WHEN kd = 0 THEN 1.0 ELSE 0.0 END) AS z, avg(kd) AS m FROM sides GROUP BY 1),
  s AS (SELECT grp, r, greatest(1.0, least(60.0, (1 + 59 * z) / (1 + ln(1 + m)))) AS s FROM r) SELECT grp, round(r * 60 * s, 6) AS alpha, round(s, 6) AS beta FROM s"""))
def _(spark, sf):
    return rnd(priors.gamma_rate(contest_sides(spark, sf, ["kd", "secs"]), "kd", "secs", "grp"), [])


@query("accuracy_zero_prior", over_sides("""WITH g AS (SELECT avg(land / CAST(att AS DOUBLE)) AS acc, avg(CASE WHEN land = 0 THEN 1.0 ELSE 0.0 END) AS zero, greatest(avg(att), 0.1) AS att, avg(land) AS land FROM sides),
  k AS (SELECT *, land < 0.2 AND zero > 0.8 AS vr, (0.70 + CASE WHEN zero > 0.9 AND land < 0.2 THEN 0.2 WHEN zero > 0.8 THEN 0.15 WHEN zero > 0.5 THEN 0.1 WHEN zero > 0.3 THEN 0.05 ELSE 0 END)
    * CASE WHEN att < 3 THEN 0.5 ELSE 1 END AS k FROM g),
  w AS (SELECT *, least(2.0, k / pow(att, CASE WHEN vr THEN 1/2 WHEN land < 1 OR zero > 0.5 OR (acc > 0.75 AND land > 5) THEN 1/3 WHEN att > 50 AND acc < 0.4 THEN 1/8 WHEN att > 50 THEN 1/6 WHEN land > 5 THEN 1/5 ELSE 1/4 END)) AS w,
    CASE WHEN att > 50 THEN 0.03 ELSE 0.07 END AS s FROM k)
  SELECT 'sig' AS stat, round(acc, 6) AS acc, round(zero, 6) AS zero, round(att, 6) AS att, round(land, 6) AS land, round(w * acc + s, 6) AS alpha, round(w * (1 - acc) + s, 6) AS beta FROM w"""))
def _(spark, sf):
    return rnd(priors.accuracy_prior(contest_sides(spark, sf, ["land", "att"]), {"sig": ("land", "att")}), [])


@query("global_averages", over_sides(" UNION ALL ".join(f"SELECT '{c}' AS stat, round(avg(CASE WHEN {c} <> 0 THEN {c} END), 6) AS avg_value FROM sides" for c in ("land", "ctrl"))))
def _(spark, sf):
    return rnd(priors.global_averages(contest_sides(spark, sf, ["land", "ctrl"]), ["land", "ctrl"], exclude_zeros=True), [])


_SNAP = """sn AS (SELECT make_date(y, 1, 1) AS snapshot_date FROM range(1994, 2001) t(y)),
  sp AS (SELECT s.grp, sn.snapshot_date, avg(land / CAST(att AS DOUBLE)) AS acc, avg(CASE WHEN land = 0 THEN 1.0 ELSE 0.0 END) AS zero, count(*) AS n
    FROM sn JOIN sides s ON s.event_date < sn.snapshot_date AND s.event_date >= sn.snapshot_date - 730 GROUP BY 1, 2)"""


@query("asof_snapshot_prior", over_sides(f"""WITH {_SNAP} SELECT s.contest_id, s.entity_id, sp.snapshot_date, round(acc, 8) AS sig_global_acc, round(zero, 8) AS sig_zero_land_freq, n AS sig_total_rows,
  round(acc * 10 + 1, 6) AS sig_alpha, round((1 - acc) * 10 + 1, 6) AS sig_beta FROM sides s LEFT JOIN sp ON sp.grp = s.grp AND sp.snapshot_date <= s.event_date AND s.event_date < sp.snapshot_date + INTERVAL 1 YEAR"""))
def _(spark, sf):
    s = _fit_rows(spark, sf, ["land", "att"])
    snaps = priors.asof_snapshots(s, {"sig": ("land", "att")}, "grp", DATE, "1994-01-01", "2000-01-01")
    out = priors.pick_snapshot(s, snaps.drop("valid_until").withColumn("seen", F.col("snapshot_date")), "grp", DATE)
    return out.select(*ID, F.col("seen").alias("snapshot_date"), *[F.round(f"sig_{c}", d).alias(f"sig_{c}") for c, d in (("global_acc", 8), ("zero_land_freq", 8), ("alpha", 6), ("beta", 6))], "sig_total_rows")


@query("full_outer_priors", over_sides(f"""WITH a AS (SELECT grp, avg(land) AS land_wc_mean FROM sides WHERE {IN_FIT} AND grp <> '1-URGENT' GROUP BY 1 HAVING count(*) >= 10),
  b AS (SELECT grp, stddev_samp(land) AS land_wc_sdev FROM sides WHERE {IN_FIT} AND grp <> '5-LOW' GROUP BY 1)
  SELECT coalesce(a.grp, b.grp) AS grp, round(land_wc_mean, 6) AS land_wc_mean, round(land_wc_sdev, 6) AS land_wc_sdev FROM a FULL OUTER JOIN b ON a.grp = b.grp"""))
def _(spark, sf):
    s = _fit_rows(spark, sf, ["land"])
    a = priors.group_mean(s.filter("grp <> '1-URGENT'"), ["land"], "grp", DATE, FIT)
    b = priors.between(s, DATE, FIT).filter("grp <> '5-LOW'").groupBy("grp").agg(F.stddev_samp("land").alias("land_wc_sdev"))
    return rnd(priors.join_priors([a, b], "grp"), [])


@query("cross_join_global", over_sides(f"SELECT contest_id, entity_id, round(land - (SELECT avg(land) FROM sides WHERE {IN_ALL}), 6) AS land_above FROM sides"))
def _(spark, sf):
    s = _fit_rows(spark, sf, ["land"])
    mean = constants(priors.between(s, DATE, ALL).agg(F.avg("land").alias("m")))["m"]
    return s.select(*ID, F.round(F.col("land") - mean, 6).alias("land_above"))


@query("outcome_counts", over_sides("""SELECT count(*) FILTER (WHERE result = 1) AS wins, count(*) FILTER (WHERE result = 0) AS losses, count(*) FILTER (WHERE result IN (0, 1)) AS decisive,
  count(*) FILTER (WHERE result IN (2, 3)) AS undecided, count(*) AS total, round(count(*) FILTER (WHERE result = 1) / CAST(count(*) FILTER (WHERE result IN (0, 1)) AS DOUBLE), 8) AS win_rate FROM headers"""))
def _(spark, sf):
    return rnd(quality.outcome_counts(contest_headers(spark, sf), "result"), [], 8)


@query("sparsity_profile", over_sides("""SELECT grp, count(*) AS total, count(*) FILTER (WHERE att_rd3 = 0) AS zero_attempt, count(*) FILTER (WHERE att_rd3 > 0) AS measurable,
  round(avg(CASE WHEN att_rd3 > 0 THEN land_rd3 / CAST(att_rd3 AS DOUBLE) END), 6) AS mean, round(stddev_samp(CASE WHEN att_rd3 > 0 THEN land_rd3 / CAST(att_rd3 AS DOUBLE) END), 6) AS sdev,
  round(quantile_cont(CASE WHEN att_rd3 > 0 THEN land_rd3 / CAST(att_rd3 AS DOUBLE) END, 0.5), 6) AS median,
  count(DISTINCT CASE WHEN att_rd3 > 0 THEN land_rd3 / CAST(att_rd3 AS DOUBLE) END) AS n_values FROM sides GROUP BY 1"""))
def _(spark, sf):
    return rnd(quality.sparsity_profile(contest_sides(spark, sf, ["land_rd3", "att_rd3"]), "land_rd3", "att_rd3", ["grp"]), [])


def _quality_sql(stat: str) -> str:
    return f"""SELECT '{stat}' AS stat, s.grp, count(DISTINCT v) AS unique_values, count(*) AS total_values, any_value(p.med) AS median_val, any_value(p.p05) AS p05, any_value(p.p95) AS p95,
      quantile_cont(abs(v - p.med), 0.5) AS mad, avg(CASE WHEN abs(v - p.med) < 0.001 THEN 1.0 ELSE 0.0 END) AS pct_at_median, any_value(md.mode_value) AS mode_value,
      avg(CASE WHEN abs(v - md.mode_value) < 0.0001 THEN 1.0 ELSE 0.0 END) AS mode_frequency
      FROM (SELECT grp, {stat} AS v FROM sides WHERE {IN_FIT}) s
      JOIN (SELECT grp, quantile_cont({stat}, 0.5) AS med, quantile_cont({stat}, 0.05) AS p05, quantile_cont({stat}, 0.95) AS p95 FROM sides WHERE {IN_FIT} GROUP BY 1) p ON p.grp = s.grp
      JOIN (SELECT grp, mode_value FROM (SELECT grp, {stat} AS mode_value, row_number() OVER (PARTITION BY grp ORDER BY count(*) DESC, {stat}) AS rn FROM sides WHERE {IN_FIT} GROUP BY 1, 2) WHERE rn = 1) md ON md.grp = s.grp
      GROUP BY 1, 2"""


_TIER = """t AS (SELECT *, CASE WHEN mad < 0.010 OR mode_frequency > 0.45 THEN 'degenerate' WHEN mad < 0.030 THEN 'sparse' ELSE 'healthy' END AS quality_tier FROM q)"""


@query("distribution_quality", over_sides(f"""WITH q AS ({_quality_sql('att')} UNION ALL {_quality_sql('ctrl')} UNION ALL {_quality_sql('land')}), {_TIER}
  SELECT stat, grp, unique_values, total_values, round(median_val, 6) AS median_val, round(p05, 6) AS p05, round(p95, 6) AS p95, round(mad, 6) AS mad, round(pct_at_median, 6) AS pct_at_median,
  CAST(mode_value AS DOUBLE) AS mode_value, round(mode_frequency, 6) AS mode_frequency, quality_tier,
  round(CASE quality_tier WHEN 'degenerate' THEN 2.5 WHEN 'sparse' THEN 3 + mad / 0.030 * 2 ELSE 7.0 END, 6) AS winsor_limit,
  CAST(CASE quality_tier WHEN 'degenerate' THEN 0.3 WHEN 'sparse' THEN 0.6 ELSE 1.0 END AS DOUBLE) AS reliability,
  CAST(floor(unique_values * CASE quality_tier WHEN 'degenerate' THEN 0.3 WHEN 'sparse' THEN 0.6 ELSE 1.0 END) AS BIGINT) AS effective_n FROM t"""))
def _(spark, sf):
    s = priors.between(_fit_rows(spark, sf, ["att", "ctrl", "land"]), DATE, FIT)
    return rnd(quality.stat_quality(s, ["att", "ctrl", "land"], "grp"), [])


@query("mad_percentile_report", over_sides(f"""WITH {_RUNMAD} SELECT round(quantile_cont(att_mad, 0.05), 6) AS p5, round(quantile_cont(att_mad, 0.10), 6) AS p10, round(quantile_cont(att_mad, 0.15), 6) AS p15,
  round(quantile_cont(att_mad, 0.20), 6) AS p20, round(quantile_cont(att_mad, 0.25), 6) AS p25 FROM mads WHERE att_mad > 0"""))
def _(spark, sf):
    return rnd(quality.mad_percentiles(running_mads(spark, sf), "att_mad", [5, 10, 15, 20, 25]), [])


# --- smoothing -------------------------------------------------------------------

PARAMS = {
    "baseline": {"default": 12.0, "kd": 9.5, "land": 6.0},
    "tuned": {"land": 4.25, "ctrl": 30.0},
    "group": {"1-URGENT": {"land": 2.5, "kd": 20.0}, "5-LOW": {"ctrl": 55.0}},
}
GROUPS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_TAU = {
    "land": "CASE grp WHEN '1-URGENT' THEN 2.5 ELSE 4.25 END", "kd": "CASE grp WHEN '1-URGENT' THEN 20.0 ELSE 9.5 END",
    "ctrl": "CASE grp WHEN '5-LOW' THEN 55.0 ELSE 30.0 END",
}


def _tau(stats):
    return {s: smooth.tau_column(s, GROUPS, PARAMS, F.col("grp")) for s in stats}


@query("resolve_tau", "WITH g(grp) AS (SELECT DISTINCT o_orderpriority FROM orders) " + " UNION ALL ".join(f"SELECT grp, '{s}' AS stat, CAST({_TAU[s]} AS DOUBLE) AS tau FROM g" for s in _TAU))
def _(spark, sf):
    from ..sample import table

    g = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp")).distinct()
    taus = _tau(_TAU)
    return g.select("grp", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), taus[s].cast("double").alias("tau")) for s in _TAU])).alias("t")).select("grp", "t.*")


@query("beta_binomial_smooth", over_sides(f"""WITH p AS (SELECT grp, sum(kd) / CAST(count(*) AS DOUBLE) AS kr, sum(ctrl) / CAST(sum(att) AS DOUBLE) AS cr FROM sides WHERE {IN_FIT} GROUP BY 1 HAVING count(*) >= 10)
  SELECT contest_id, entity_id, round((kr * ({_TAU['kd']}) + kd) / (({_TAU['kd']}) + 1), 6) AS kd_smooth, round((cr * ({_TAU['ctrl']}) + ctrl) / (({_TAU['ctrl']}) + att) * att, 6) AS ctrl_smooth
  FROM (SELECT s.*, kr, cr FROM sides s JOIN p ON p.grp = s.grp)"""))
def _(spark, sf):
    s = _layer(spark, sf, ["kd", "ctrl", "att"])
    spec = {"kd": (F.col("kd"), F.lit(1)), "ctrl": (F.col("ctrl"), F.col("att"))}
    p = priors.ratio_priors(s, spec, "grp", DATE, FIT, FIT, 10)
    out = smooth.beta_binomial(s, spec, p, "grp", _tau(["kd", "ctrl"]), frozenset(["ctrl"]))
    return rounded(out, ["kd_smooth", "ctrl_smooth"])


@query("poisson_gamma_smooth", over_sides(f"""WITH p AS (SELECT grp, sum(land) / (sum(secs) / 60.0) AS lr, sum(kd) / (sum(secs) / 60.0) AS kr FROM sides WHERE secs > 0 AND {IN_FIT} GROUP BY 1 HAVING count(*) >= 10)
  SELECT contest_id, entity_id, round(secs / 60.0 * (lr * ({_TAU['land']}) + land) / (({_TAU['land']}) + secs / 60.0), 6) AS land_smooth,
  round(secs / 60.0 * (kr * ({_TAU['kd']}) + kd) / (({_TAU['kd']}) + secs / 60.0), 6) AS kd_smooth FROM (SELECT s.*, lr, kr FROM sides s JOIN p ON p.grp = s.grp)"""))
def _(spark, sf):
    s, spec, p = _rates(spark, sf)
    return rounded(smooth.poisson_gamma(s, spec, p, "grp", _tau(["land", "kd"])), ["land_smooth", "kd_smooth"])


@query("smoothed_accuracy", over_sides(f"""WITH p AS (SELECT grp, sum(land_rd3) / CAST(sum(att_rd3) AS DOUBLE) AS r FROM sides WHERE {IN_FIT} GROUP BY 1)
  SELECT contest_id, entity_id, round(CASE WHEN att_rd3 = 0 THEN r ELSE least(1.0, greatest(0.0, (r * 16.78 + land_rd3) / (16.78 + att_rd3))) END, 6) AS sig_str_rd1_acc FROM sides s JOIN p ON p.grp = s.grp"""))
def _(spark, sf):
    s = _layer(spark, sf, ["land_rd3", "att_rd3"])
    pairs = {"sig_str_rd1": ("land_rd3", "att_rd3")}
    p = priors.ratio_priors(s, {n: (F.col(a), F.col(b)) for n, (a, b) in pairs.items()}, "grp", DATE, FIT, ALL, 1)
    tau = {n: smooth.tau_column(n, GROUPS, {"baseline": smooth.ACCURACY_TAU}, F.col("grp")) for n in pairs}
    return rounded(smooth.smoothed_accuracy(s, pairs, p, "grp", tau), ["sig_str_rd1_acc"])


@query("swap_smoothed", over_sides("SELECT contest_id, entity_id, land * 2 AS land, land AS land_raw FROM sides"))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land"]).select(*ID, "land", (F.col("land") * 2).alias("land_smooth"))
    return smooth.promote_smoothed(s)


# --- first-order rates -------------------------------------------------------------

@query("round_totals", over_sides("""SELECT contest_id, entity_id, land_rd1 + land_rd2 + land_rd3 AS land_sum,
  att_rd1 + att_rd2 + att_rd3 + CASE WHEN kd = 1 AND sub_att = 0 THEN 1 ELSE 0 END AS att_sum FROM sides"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land_rd1", "land_rd2", "land_rd3", "att_rd1", "att_rd2", "att_rd3", "kd", "sub_att"])
    s = s.withColumnsRenamed({f"{c}_rd{r}": f"{c}_sum_rd{r}" for c in ("land", "att") for r in (1, 2, 3)})
    s = s.withColumns({"hit_rd1": F.col("kd"), "try_rd1": F.col("sub_att")})
    out = rates.round_totals(rates.round_totals(s, [], [1], {"hit": "try"}), ["land_sum", "att_sum"], [1, 2, 3])
    return out.select(*ID, "land_sum", (F.col("att_sum") + F.col("try_rd1") - F.col("sub_att")).alias("att_sum"))


@query("per_minute", over_sides("""SELECT contest_id, entity_id, CAST(round(CAST(land AS DECIMAL(18,8)) / (secs / 60), 4) AS DOUBLE) AS land_per_min,
  CAST(round(CAST(land_rd1 AS DECIMAL(18,8)) / nullif(secs_rd1 / 60, 0), 4) AS DOUBLE) AS land_rd1_per_min FROM sides"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "land_rd1", "secs", "secs_rd1"])
    return rates.per_minute(s, ["land", "land_rd1"], "secs", "secs_rd1").select(*ID, "land_per_min", "land_rd1_per_min")


#: Columns that the quotients read, from those of the contest view.
_PARTS = {
    "ko": "kd", "sig_str_land": "land", "sig_str_att": "att", "strikes_att": "att + 3", "distance_land": "land_rd1", "clinch_land": "land_rd2", "ground_land": "land_rd3", "head_land": "att_rd1 % 7", "body_land": "att_rd2 % 5", "leg_land": "att_rd3 % 5",
    "td_att": "sub_att + kd", "td_land": "kd", "ctrl": "ctrl", "sub_att": "sub_att", "rev": "land % 3", "ko_rd1": "kd % 2", "sub_land_rd1": "sub_att % 2", "sub_land": "sub_att % 3", "win": "CASE WHEN (result = 1) = (side = 1) THEN 1 ELSE 0 END"}


def _quotient_sql(name: str) -> str:
    num, den = ("(" + " + ".join(f"b.{t[4:]}" if t.startswith("opp.") else f"a.{t}" for t in part) + ")" for part in rates.QUOTIENTS[name])
    return f"round(CASE WHEN {den} > 0 THEN {num} / CAST({den} AS DOUBLE) ELSE 0 END, 6) AS {name}"


@query("per_features", over_sides(f"""WITH q AS (SELECT contest_id, entity_id, {', '.join(f'{x} AS {c}' for c, x in _PARTS.items())} FROM sides)
  SELECT a.contest_id, a.entity_id, {', '.join(map(_quotient_sql, rates.QUOTIENTS))} FROM q a JOIN q b ON a.contest_id = b.contest_id AND a.entity_id <> b.entity_id"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "kd", "ctrl", "sub_att", "att", *[f"{c}_rd{r}" for c in ("land", "att") for r in (1, 2, 3)]])
    s = sides.opponent(s.select(*ID, *[F.expr(x).alias(c) for c, x in _PARTS.items()]), ["ctrl"])
    return rounded(rates.quotients(s, rates.QUOTIENTS), list(rates.QUOTIENTS))


@query("pressure", over_sides("""SELECT contest_id, entity_id, round(CASE WHEN land > 0 THEN land_rd1 / CAST(land AS DOUBLE) ELSE 0.0 END, 6) AS land_pressure FROM sides"""))
def _(spark, sf):
    return rounded(rates.pressure(contest_sides(spark, sf, ["land", "land_rd1"]), "land", "land_rd1"), ["land_pressure"])


_WON = "((result = 1 AND side = 1) OR (result = 0 AND side = 2))"


@query("outcome_flags", over_sides("SELECT contest_id, entity_id, " + ", ".join(
    f"CAST({_WON} AND {cond} AS INTEGER) AS {n}" + "".join(f", CAST({_WON} AND {cond} AND end_round = {r} AS INTEGER) AS {n}_rd{r}" for r in (1, 2, 3) if not (n == "decision" and r == 1))
    for n, cond in (("win", "true"), ("ko", "method = 'KO/TKO'"), ("sub_land", "method LIKE '%Submission%'"), ("decision", "lower(method) LIKE '%decision%'"))) + " FROM sides"))
def _(spark, sf):
    out = rates.outcome_flags(contest_sides(spark, sf, []), [1, 2, 3])
    names = [c for c in out.columns if c.split("_rd")[0] in ("win", "ko", "sub_land", "decision")]
    return out.select(*ID, *names)


@query("round_seconds", over_sides("""SELECT contest_id, entity_id, """ + ", ".join(
    f"CAST(CASE WHEN end_round > {r} THEN CASE WHEN contest_id % 2 = 0 THEN 300 ELSE {w} END WHEN end_round = {r} THEN end_time ELSE 0 END AS INTEGER) AS time_sec_rd{r}" for r, w in ((1, 600), (2, 300), (3, 300))) + " FROM sides"))
def _(spark, sf):
    from ..functions.parse import round_lengths

    s = contest_sides(spark, sf, [])
    text = F.when(F.col("contest_id") % 2 == 0, "3 Rnd (5-5-5)").otherwise("3 Rnd (10-5-5)")
    s = s.withColumn("fmt", text).withColumn("lengths", round_lengths(F.col("fmt"), F.col("end_time")))
    return rates.round_seconds(s, "lengths", "end_round", "end_time", 3).select(*ID, *[f"time_sec_rd{r}" for r in (1, 2, 3)])


def _bio(spark, sf):
    s = contest_sides(spark, sf, []).select(*ID, "grp", DATE)
    return s.join(entities(spark, sf), "entity_id")


@query("age_at_contest", over_sides("""WITH a AS (SELECT s.contest_id, s.entity_id, grp, age(CAST(event_date AS TIMESTAMP), CAST(dob AS TIMESTAMP)) AS g FROM sides s JOIN entities e ON e.entity_id = s.entity_id),
  y AS (SELECT *, round((date_part('year', g) * 365.25 + date_part('month', g) * 30 + date_part('day', g)) / 365.25, 3) AS own FROM a)
  SELECT contest_id, entity_id, round(coalesce(own, avg(own) OVER (PARTITION BY grp)), 6) AS age FROM y""", ENTITIES))
def _(spark, sf):
    s = _bio(spark, sf).withColumn("own", rates.age_years(F.col(DATE), F.col("dob")))
    return rounded(rates.impute_group_mean(s, "own", "grp", "age"), ["age"])


@query("impute_group_int", over_sides("""SELECT contest_id, entity_id, coalesce(reach, CAST(round(avg(reach) OVER (PARTITION BY grp)) AS INTEGER)) AS reach_full,
  coalesce(height, CAST(round(avg(height) OVER (PARTITION BY grp)) AS INTEGER)) AS height_full FROM (SELECT s.contest_id, s.entity_id, grp, reach, height FROM sides s JOIN entities e ON e.entity_id = s.entity_id)""", ENTITIES))
def _(spark, sf):
    s = rates.impute_group_mean(_bio(spark, sf), "reach", "grp", "reach_full", whole=True)
    return rates.impute_group_mean(s, "height", "grp", "height_full", whole=True).select(*ID, "reach_full", "height_full")


@query("ape_ratio", over_sides("""SELECT contest_id, s.entity_id, round(reach / CAST(height AS DOUBLE), 3) AS ape FROM sides s JOIN entities e ON e.entity_id = s.entity_id""", ENTITIES))
def _(spark, sf):
    return rates.ape_ratio(_bio(spark, sf)).select(*ID, "ape")


@query("style_shares", over_sides("""WITH b AS (SELECT *, land_rd1 / CAST(nullif(land, 0) AS DOUBLE) AS s1, land_rd2 / CAST(nullif(land, 0) AS DOUBLE) AS s2, land_rd3 / CAST(nullif(land, 0) AS DOUBLE) AS s3 FROM sides)
  SELECT contest_id, entity_id, round(coalesce(s1, 0), 6) AS share_1, round(coalesce(s2, 0), 6) AS share_2, round(coalesce(s3, 0), 6) AS share_3,
  round(coalesce(-(s1 * ln(greatest(s1, 1e-10)) + s2 * ln(greatest(s2, 1e-10)) + s3 * ln(greatest(s3, 1e-10))) / ln(3), 0), 6) AS entropy,
  round(coalesce(ctrl / CAST(nullif(kd, 0) AS DOUBLE), 0), 6) AS ctrl_per_kd,
  round(CASE WHEN att * secs > 0 THEN least(1, greatest(0, att_rd1 * least(secs_rd1, 300) / CAST(att * secs AS DOUBLE))) ELSE 0 END, 6) AS early_bias FROM b""" ))
def _(spark, sf):
    from ..operators import style

    cols = ["land", "land_rd1", "land_rd2", "land_rd3", "ctrl", "kd", "att", "att_rd1", "secs", "secs_rd1"]
    s = contest_sides(spark, sf, cols)
    out = s.select(
        *ID, *[style.share(F.col(f"land_rd{r}"), F.col("land")).alias(f"share_{r}") for r in (1, 2, 3)],
        style.efficiency(F.col("ctrl"), F.col("kd")).alias("ctrl_per_kd"),
        style.round_one_bias(F.col("att_rd1"), F.col("secs_rd1"), F.col("att"), F.col("secs")).alias("early_bias"))
    out = out.withColumn("entropy", style.entropy3(F.col("share_1"), F.col("share_2"), F.col("share_3")))
    return rounded(out, ["share_1", "share_2", "share_3", "entropy", "ctrl_per_kd", "early_bias"])
