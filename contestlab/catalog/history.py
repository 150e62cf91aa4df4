"""Time-ordered history of an entity: running, decayed and shifted values."""

import math

from pyspark.sql import functions as F

from ..operators import windows as win
from ..sample import contest_sides
from .registry import over_sides, query

KEY, DATE, TIE = ["entity_id"], "event_date", ["contest_id"]
ID = ["contest_id", "entity_id"]
RATE = math.log(2) / 2.0


def hist(spark, sf, stats=(), *more):
    """Keys, date, the named stats and further expressions over them."""
    return contest_sides(spark, sf, list(stats)).select(*ID, DATE, *stats, *more)


def pos_ctrl():
    """Control, null when there was none, so that null handling is exercised."""
    return F.when(F.col("ctrl") > 0, F.col("ctrl")).alias("pos_ctrl")


def rounded(df, cols, digits=6):
    return df.select(*ID, *[F.round(c, digits).alias(c) for c in cols])


@query("running_total", over_sides("""SELECT contest_id, entity_id,
  CAST(sum(land) OVER w AS BIGINT) AS land_total, CAST(sum(att) OVER w AS BIGINT) AS att_total FROM sides
  WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, contest_id ROWS UNBOUNDED PRECEDING)"""))
def _(spark, sf):
    return win.running_total(hist(spark, sf, ["land", "att"]), ["land", "att"], KEY, DATE, TIE).select(*ID, "land_total", "att_total")


@query("running_avg", over_sides("""SELECT contest_id, entity_id, round(avg(land) OVER w, 6) AS land_avg,
  round(avg(CASE WHEN ctrl > 0 THEN ctrl END) OVER w, 6) AS pos_ctrl_avg FROM sides
  WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, contest_id ROWS UNBOUNDED PRECEDING)"""))
def _(spark, sf):
    df = hist(spark, sf, ["land", "ctrl"], pos_ctrl())
    return rounded(win.running_avg(df, ["land", "pos_ctrl"], KEY, DATE, TIE), ["land_avg", "pos_ctrl_avg"])


@query("decayed_avg", over_sides(f"""SELECT c.contest_id, c.entity_id,
  round(sum(b.land * exp(-{RATE!r} * (c.event_date - b.event_date) / 365.25)) / sum(exp(-{RATE!r} * (c.event_date - b.event_date) / 365.25)), 6) AS land_dec_avg,
  round(sum(b.pos * exp(-{RATE!r} * (c.event_date - b.event_date) / 365.25))
    / sum(CASE WHEN b.pos IS NOT NULL THEN exp(-{RATE!r} * (c.event_date - b.event_date) / 365.25) END), 6) AS pos_ctrl_dec_avg
  FROM sides c JOIN (SELECT *, CASE WHEN ctrl > 0 THEN ctrl END AS pos FROM sides) b
  ON b.entity_id = c.entity_id AND b.event_date <= c.event_date GROUP BY 1, 2"""))
def _(spark, sf):
    df = hist(spark, sf, ["land", "ctrl"], pos_ctrl())
    return rounded(win.decayed_avg(df, ["land", "pos_ctrl"], KEY, DATE, 2.0), ["land_dec_avg", "pos_ctrl_dec_avg"])


@query("decayed_slope", over_sides("""WITH p AS (SELECT *, lag(land) OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) AS prev FROM sides)
  SELECT contest_id, entity_id, round(coalesce(avg(land - prev) OVER (PARTITION BY entity_id ORDER BY event_date, contest_id
    ROWS UNBOUNDED PRECEDING), 0.0), 6) AS land_dec_slope FROM p"""))
def _(spark, sf):
    return rounded(win.mean_step(hist(spark, sf, ["land"]), ["land"], KEY, DATE, TIE), ["land_dec_slope"])


@query("days_since_last", over_sides("""SELECT contest_id, entity_id, CAST(coalesce(event_date - lag(event_date) OVER
  (PARTITION BY entity_id ORDER BY event_date, contest_id), 120) AS INTEGER) AS days_since_last FROM sides"""))
def _(spark, sf):
    return win.gap_days(hist(spark, sf), KEY, DATE, TIE).select(*ID, "days_since_last")


@query("career_age", over_sides("""SELECT contest_id, entity_id, round((event_date - min(event_date) OVER (PARTITION BY entity_id)) / 365.25, 3) AS career_age FROM sides"""))
def _(spark, sf):
    return win.tenure_years(hist(spark, sf), KEY, DATE).select(*ID, "career_age")


@query("contest_number", over_sides("""SELECT contest_id, entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY event_date, contest_id) AS contest_no FROM sides"""))
def _(spark, sf):
    return win.contest_no(hist(spark, sf), KEY, DATE, TIE).select(*ID, "contest_no")


@query("shift_one", over_sides("""SELECT contest_id, entity_id, lag(land) OVER w AS land_prev, lag(att) OVER w AS att_prev, lag(grp) OVER w AS grp_prev
  FROM sides WINDOW w AS (PARTITION BY entity_id ORDER BY event_date, contest_id)"""))
def _(spark, sf):
    cols = ["land", "att", "grp"]
    return win.shift_prev(hist(spark, sf, ["land", "att"], "grp"), cols, KEY, DATE, TIE).select(*ID, *[f"{c}_prev" for c in cols])
