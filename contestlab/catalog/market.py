"""Price ticks and staking strategies."""

from pyspark.sql import functions as F

from ..operators import bets, ticks
from ..sample import contest_headers, contest_sides, table
from ..session import cut, stored
from .fitted import rnd
from .registry import over_sides, query

# --- ticks ---------------------------------------------------------------------------


@query("open_close_week", """WITH t AS (SELECT user_id, event_type, strftime(ts, '%Y-%m') AS month, ts, value FROM events),
  c AS (SELECT user_id, event_type, month, min_by(value, ts) AS opening, max_by(value, ts) AS closing, min(ts) AS opening_ts, max(ts) AS closing_ts FROM t GROUP BY 1, 2, 3),
  w AS (SELECT t.user_id, t.event_type, t.month, t.value, t.ts, row_number() OVER (PARTITION BY t.user_id, t.event_type, t.month ORDER BY abs(epoch_us(t.ts) - (epoch_us(c.closing_ts) - 604800000000)), t.ts DESC) AS rn
    FROM t JOIN c ON c.user_id = t.user_id AND c.event_type = t.event_type AND c.month = t.month)
  SELECT c.user_id, c.event_type, c.month, c.opening, c.closing, w.value AS week FROM c JOIN w ON c.user_id = w.user_id AND c.event_type = w.event_type AND c.month = w.month AND rn = 1""")
def _(spark, sf):
    t = table(spark, sf, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return ticks.line_points(t, ["user_id", "event_type", "month"], "ts", "value").select("user_id", "event_type", "month", "opening", "closing", "week")


def _named(spark, sf):
    """Contests with both names; names combine nation and key."""
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    names = s.select(F.col("s_suppkey").alias("id"), F.concat_ws(" ", F.initcap("n_name"), F.col("s_suppkey").cast("string")).alias("name"))
    h = contest_headers(spark, sf, "order_id").select("order_id", "contest_id", "event_id", "event_date", "entity1_id", "entity2_id")
    for i in (1, 2):
        h = h.join(names.select(F.col("id").alias(f"entity{i}_id"), F.col("name").alias(f"name{i}")), f"entity{i}_id")
    return h


def _ticks(spark, sf, h):
    """Prices per side and contest, up to twelve days before the event; some contests are priced from one side only."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), "l_suppkey", (F.col("l_linenumber") * (47 * 60) + F.col("l_partkey") % 60).cast("int").alias("minutes"), "l_quantity", "l_returnflag")
    side = lambda i, j, flag: F.struct(F.col(f"entity{i}_id").alias("l_suppkey"), F.col(f"name{i}").alias("fighter"), F.col(f"name{j}").alias("opponent"), F.lit(flag).alias("unpriced"))
    sides = h.select("order_id", "event_date", F.explode(F.array(side(1, 2, "R"), side(2, 1, "N"))).alias("s")).select("order_id", "event_date", "s.*")
    j = sides.join(li, ["order_id", "l_suppkey"]).filter("l_returnflag <> unpriced")
    at = F.to_timestamp(F.col("event_date")) + F.make_dt_interval(days=F.lit(2), mins=-F.col("minutes"))
    return j.select("fighter", "opponent", at.cast("timestamp_ntz").alias("ts"), (1.05 + F.col("l_quantity") / 16).alias("odds"))


_NAMED = """nm AS (SELECT s_suppkey AS id, concat(upper(n_name[1]), lower(n_name[2:]), ' ', s_suppkey) AS name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  hn AS (SELECT h.contest_id, h.event_id, h.event_date, h.entity1_id, h.entity2_id, a.name AS name1, b.name AS name2 FROM headers h JOIN nm a ON a.id = entity1_id JOIN nm b ON b.id = entity2_id)"""
_TICKS = f"""{_NAMED},
  tk AS (SELECT DISTINCT ON (fighter, opponent, ts) * FROM (SELECT CASE WHEN l_suppkey = entity1_id THEN name1 ELSE name2 END AS fighter, CASE WHEN l_suppkey = entity1_id THEN name2 ELSE name1 END AS opponent,
    CAST(event_date AS TIMESTAMP) + INTERVAL 2 DAY - to_hours(CAST(l_linenumber * 47 AS BIGINT)) - to_minutes(CAST(l_partkey % 60 AS BIGINT)) AS ts, 1.05 + l_quantity / 16 AS odds
    FROM hn JOIN lineitem ON l_orderkey = contest_id // 1009 WHERE (l_suppkey = entity1_id AND l_returnflag <> 'R') OR (l_suppkey = entity2_id AND l_returnflag <> 'N')) ORDER BY fighter, opponent, ts, odds),
  tm AS (SELECT *, strftime(ts, '%Y-%m') AS month FROM tk),
  c0 AS (SELECT fighter, opponent, month, min_by(odds, ts) AS opening, max_by(odds, ts) AS closing, max(ts) AS closing_ts FROM tm GROUP BY 1, 2, 3),
  w0 AS (SELECT tm.fighter, tm.opponent, tm.month, tm.odds AS week, row_number() OVER (PARTITION BY tm.fighter, tm.opponent, tm.month ORDER BY abs(epoch_us(ts) - (epoch_us(closing_ts) - 604800000000)), ts DESC) AS rn
    FROM tm JOIN c0 ON c0.fighter = tm.fighter AND c0.opponent = tm.opponent AND c0.month = tm.month),
  ln AS (SELECT c0.*, week, CAST(closing_ts AS DATE) AS closing_date FROM c0 JOIN w0 ON c0.fighter = w0.fighter AND c0.opponent = w0.opponent AND c0.month = w0.month AND rn = 1),
  ht AS (SELECT ln.*, hn.contest_id, hn.event_id, hn.event_date, hn.entity1_id, hn.entity2_id, CASE WHEN lower(ln.fighter) = lower(hn.name1) THEN 1 ELSE 2 END AS orientation,
    row_number() OVER (PARTITION BY ln.fighter, ln.opponent, ln.month ORDER BY abs(event_date - closing_date), event_date, event_id, contest_id) AS pick
    FROM ln JOIN hn ON abs(event_date - closing_date) <= 4 AND ((lower(fighter) = lower(name1) AND lower(opponent) = lower(name2)) OR (lower(fighter) = lower(name2) AND lower(opponent) = lower(name1)))),
  mt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contest_id, event_id ORDER BY fighter, opponent, month) AS claim FROM ht WHERE pick = 1) WHERE claim = 1)"""


def _tick_tables(spark, sf):
    """The tick table (one price per line and instant) and the named contests, each written once."""
    h = stored(_named(spark, sf), "named")
    return stored(_ticks(spark, sf, h).groupBy("fighter", "opponent", "ts").agg(F.min("odds").alias("odds")), "ticks"), h


def _lines(spark, sf):
    t, h = _tick_tables(spark, sf)
    return ticks.monthly_lines(t), h


@query("interval_name_match", over_sides("SELECT contest_id, event_id, fighter, opponent, month, CAST(orientation AS INTEGER) AS orientation FROM mt", _TICKS))
def _(spark, sf):
    out = ticks.match_contests(*_lines(spark, sf))
    return out.select("contest_id", "event_id", "fighter", "opponent", "month", "orientation")


_SIDE_SQL = """sp AS (SELECT mt.*, coalesce(o.opening, 1 + 1 / (mt.opening - 1)) AS oo, coalesce(o.closing, 1 + 1 / (mt.closing - 1)) AS oc, coalesce(o.week, o.opening, 1 + 1 / (mt.opening - 1)) AS ow
    FROM mt LEFT JOIN ln o ON o.fighter = mt.opponent AND o.opponent = mt.fighter AND o.month = mt.month),
  pr AS (SELECT contest_id, event_id, CASE WHEN orientation = 1 THEN entity1_id ELSE entity2_id END AS entity_id, opening, closing, week FROM sp
    UNION ALL SELECT contest_id, event_id, CASE WHEN orientation = 1 THEN entity2_id ELSE entity1_id END, oo, oc, ow FROM sp)"""


@query("implied_prob", over_sides("SELECT contest_id, entity_id, round(1 / opening, 6) AS ip_opening, round(1 / closing, 6) AS ip_closing, round(1 / week, 6) AS ip_week FROM pr", _TICKS, _SIDE_SQL))
def _(spark, sf):
    lines, contests = _lines(spark, sf)
    out = ticks.side_prices(ticks.match_contests(lines, contests), lines)
    return rnd(out.select("contest_id", "entity_id", "ip_opening", "ip_closing", "ip_week"), [])


_FAIR = ", ".join(f"round((1 / {c}) / sum(1 / {c}) OVER (PARTITION BY contest_id, event_id), 6) AS ip_{c}" for c in ("opening", "closing", "week"))


@query("vig_free", over_sides(f"SELECT contest_id, entity_id, {_FAIR} FROM pr", _TICKS, _SIDE_SQL))
def _(spark, sf):
    lines, contests = _lines(spark, sf)
    out = ticks.vig_free(ticks.side_prices(ticks.match_contests(lines, contests), lines))
    return rnd(out.select("contest_id", "entity_id", "ip_opening", "ip_closing", "ip_week"), [])


@query("odds_full", over_sides(f"SELECT contest_id, entity_id, round(opening, 6) AS opening, round(closing, 6) AS closing, round(week, 6) AS week, {_FAIR} FROM pr", _TICKS, _SIDE_SQL))
def _(spark, sf):
    out = ticks.odds_features(*_tick_tables(spark, sf))
    return rnd(out.select("contest_id", "entity_id", "opening", "closing", "week", "ip_opening", "ip_closing", "ip_week"), [])


_SIM = "100.0 * (1 - levenshtein({0}, {1}) / CAST(greatest(length({0}), length({1})) AS DOUBLE))"


@query("fuzzy_pair_match", over_sides(f"""WITH l AS (SELECT contest_id AS line_id, event_date AS day, CASE WHEN contest_id % 2 = 0 THEN name1 ELSE name2 END || 'x' AS fighter, replace(CASE WHEN contest_id % 2 = 0 THEN name2 ELSE name1 END, 'an', 'on') AS opponent FROM hn),
  s AS (SELECT l.*, hn.contest_id, {_SIM.format('lower(fighter)', 'lower(name1)')} + {_SIM.format('lower(opponent)', 'lower(name2)')} AS s1, {_SIM.format('lower(fighter)', 'lower(name2)')} + {_SIM.format('lower(opponent)', 'lower(name1)')} AS s2
    FROM l JOIN hn ON abs(hn.event_date - l.day) <= 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY greatest(s1, s2) DESC, contest_id) AS rn FROM s WHERE greatest(s1, s2) >= 140)
  SELECT line_id, contest_id, CASE WHEN s1 >= s2 THEN 1 ELSE 2 END AS orientation, round(greatest(s1, s2), 6) AS score FROM r WHERE rn = 1""", _NAMED))
def _(spark, sf):
    h = cut(_named(spark, sf))
    even = F.col("contest_id") % 2 == 0
    lines = h.select(F.col("contest_id").alias("line_id"), F.col("event_date").alias("day"), F.concat(F.when(even, F.col("name1")).otherwise(F.col("name2")), F.lit("x")).alias("fighter"),
                     F.replace(F.when(even, F.col("name2")).otherwise(F.col("name1")), F.lit("an"), F.lit("on")).alias("opponent"))
    out = ticks.fuzzy_pairs(lines, h, "day")
    return rnd(out.select("line_id", "contest_id", "orientation", "score"), [])


@query("fuzzy_name_map", f"""WITH s AS (SELECT concat(lower(n_name), ' ', s_suppkey * 37) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
  l AS (SELECT name AS left_name, name AS k FROM (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN concat(s_suppkey * 37, ' ', lower(n_name)) ELSE concat(replace(lower(n_name), 'a', 'aa'), ' ', s_suppkey * 37) END AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey)),
  lk AS (SELECT left_name, array_to_string(list_sort(string_split_regex(trim(lower(k)), '\\s+')), ' ') AS lk FROM l), rk AS (SELECT DISTINCT name AS right_name, array_to_string(list_sort(string_split_regex(trim(lower(name)), '\\s+')), ' ') AS rk FROM s),
  p AS (SELECT *, {_SIM.format('lk', 'rk')} AS score FROM lk CROSS JOIN rk),
  r AS (SELECT *, row_number() OVER (PARTITION BY left_name ORDER BY score DESC, right_name) AS rn FROM p WHERE score >= 65) SELECT left_name, right_name, round(score, 6) AS score FROM r WHERE rn = 1""")
def _(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    n, k = F.lower("n_name"), (F.col("s_suppkey") * 37).cast("string")
    left = s.select(F.when(F.col("s_suppkey") % 3 == 0, F.concat_ws(" ", k, n)).otherwise(F.concat_ws(" ", F.replace(n, F.lit("a"), F.lit("aa")), k)).alias("name"))
    return rnd(ticks.name_map(left, s.select(F.concat_ws(" ", n, k).alias("name"))), [])


# --- strategies -----------------------------------------------------------------------

STAKE = 7.35
TYPES = {"closing": ("o1c", "o2c"), "sevenday": ("o1s", "o2s")}


def bet_rows(spark, sf):
    """Contests with model probabilities and two pairs of decimal prices, long by odds type."""
    from ..operators.sides import pair_sides

    s = contest_sides(spark, sf, ["att", "ctrl", "land"])
    p = pair_sides(s, ["att", "ctrl", "land", "entity_id"], head=["event_date", "result"]).filter("result IN (0, 1)")
    model = F.round(1 / (1 + F.exp(-(F.col("att_1") - F.col("att_2")) / 40.0)), 4)

    def price(c, i):
        share = (F.col(f"{c}_{i}") + 20) / (F.col(f"{c}_1") + F.col(f"{c}_2") + 40)
        return F.round(0.950037 / share, 2)

    out = p.select(
        "contest_id", "event_date", F.col("entity_id_1").alias("entity1_id"), F.col("entity_id_2").alias("entity2_id"), F.col("result").alias("y"), model.alias("p1"), F.round(1 - model, 4).alias("p2"),
        price("ctrl", 1).alias("o1c"), price("ctrl", 2).alias("o2c"), price("land", 1).alias("o1s"), price("land", 2).alias("o2s"))
    return bets.by_odds_type(out, TYPES)


def _bet_sql() -> str:
    cols = "contest_id, event_date, entity1_id, entity2_id, y, p1, p2"

    def price(c, i):
        return f"round(0.950037 / (({c}_{i} + 20) / CAST({c}_1 + {c}_2 + 40 AS DOUBLE)), 2)"

    return f"""br0 AS (SELECT a.contest_id, a.event_date, a.entity_id AS entity1_id, b.entity_id AS entity2_id, a.result AS y, round(1 / (1 + exp(-(a.att - b.att) / 40.0)), 4) AS p1,
        round(1 - round(1 / (1 + exp(-(a.att - b.att) / 40.0)), 4), 4) AS p2, a.ctrl AS ctrl_1, b.ctrl AS ctrl_2, a.land AS land_1, b.land AS land_2
        FROM sides a JOIN sides b ON a.contest_id = b.contest_id AND a.side = 1 AND b.side = 2 WHERE a.result IN (0, 1)),
      br AS (SELECT {cols}, 'closing' AS odds_type, {price('ctrl', 1)} AS o1, {price('ctrl', 2)} AS o2 FROM br0 UNION ALL SELECT {cols}, 'sevenday', {price('land', 1)}, {price('land', 2)} FROM br0),
      bs AS MATERIALIZED (SELECT *, CASE WHEN p2 > p1 THEN 2 ELSE 1 END AS pick, CASE WHEN o1 > 1 AND o2 > 1 THEN CASE WHEN o1 < o2 THEN 1 WHEN o2 < o1 THEN 2 END END AS fav,
        CASE WHEN p2 > p1 THEN p2 ELSE p1 END AS p, CASE WHEN p2 > p1 THEN p1 ELSE p2 END AS q, CASE WHEN p2 > p1 THEN o2 ELSE o1 END AS po, CASE WHEN p2 > p1 THEN o1 ELSE o2 END AS qo,
        CASE WHEN o1 > 1 THEN 1 / o1 ELSE 0 END AS i1, CASE WHEN o2 > 1 THEN 1 / o2 ELSE 0 END AS i2 FROM br),
      bt AS MATERIALIZED (SELECT *, CASE WHEN pick = 1 THEN i1 ELSE i2 END AS ip, CASE WHEN pick = 1 THEN i2 ELSE i1 END AS iq, o1 > 1 AND p1 > i1 AS ev1, o2 > 1 AND p2 > i2 AS ev2 FROM bs)"""


def _rule_sql(kind: str, t: float) -> str:
    share = f"({t!r} / 100)"
    return {
        "picked_favorite": "CASE WHEN pick = fav THEN pick END", "picked_underdog": "CASE WHEN pick = 3 - fav THEN pick END",
        "picked_positive_ev": "CASE WHEN po > 1 AND p > ip THEN pick END", "any_positive_ev": "CASE WHEN ev1 AND ev2 THEN pick WHEN ev1 THEN 1 WHEN ev2 THEN 2 END", "all_picks": "pick",
        "against_if_opponent_edge": f"CASE WHEN qo > 1 THEN CASE WHEN q > iq + {share} THEN 3 - pick ELSE pick END WHEN po > 1 THEN pick END",
        "ev_or_within": f"CASE WHEN (po > 1 AND p > ip) OR (ip - p > 0 AND ip - p <= {share}) THEN pick END",
        "fade_negative_ev": f"CASE WHEN ip - p >= {share} AND qo > 1 THEN 3 - pick END",
        "edge": f"CASE WHEN p * 100 - 100 * ip >= {t!r} THEN pick WHEN q * 100 - 100 * iq >= {t!r} THEN 3 - pick END",
    }[kind]


_SETTLE = "CASE WHEN won THEN round(CAST(7.35 AS DECIMAL(18,4)) * (CAST(odds AS DECIMAL(18,4)) - 1), 2) ELSE -7.35 END"
_RULES = " UNION ALL ".join(f"SELECT '{n}' AS strategy, odds_type, contest_id, event_date, y, o1, o2, {_rule_sql(k, t)} AS bet_side FROM bt" for n, k, t in bets.CONTEST_RULES)
_SINGLE = f"""{_bet_sql()}, sg AS (SELECT *, CASE WHEN bet_side = 1 THEN o1 ELSE o2 END AS odds, (bet_side = 1 AND y = 1) OR (bet_side = 2 AND y = 0) AS won FROM ({_RULES}) WHERE bet_side IS NOT NULL),
  single AS (SELECT strategy, odds_type, contest_id, event_date, CAST(bet_side AS INTEGER) AS bet_side, odds, won, CAST({_SETTLE} AS DOUBLE) AS profit FROM sg)"""


def _as_double(df):
    return df.withColumns({c: F.col(c).cast("double") for c in ("profit", "stake") if c in df.columns})


@query("single_bets", over_sides("SELECT * FROM single", _SINGLE))
def _(spark, sf):
    return _as_double(bets.single_bets(bet_rows(spark, sf), stake=STAKE).drop("stake"))


@query("pick_and_sides", over_sides("SELECT contest_id, odds_type, CAST(pick AS INTEGER) AS pick, CAST(fav AS INTEGER) AS fav, CAST(3 - fav AS INTEGER) AS dog FROM bs", _bet_sql()))
def _(spark, sf):
    return bets.with_sides(bet_rows(spark, sf)).select("contest_id", "odds_type", "pick", "fav", "dog")


@query("settle_bets", over_sides("SELECT contest_id, odds_type, profit FROM single WHERE strategy = 'all_picks'", _SINGLE))
def _(spark, sf):
    rows = bets.with_sides(bet_rows(spark, sf))
    odds = F.when(F.col("pick") == 1, F.col("o1")).otherwise(F.col("o2"))
    return rows.select("contest_id", "odds_type", bets.settle(F.lit(STAKE), odds, bets.won(F.col("pick"))).cast("double").alias("profit"))


_EVENT = f"""{_bet_sql()}, ec AS (SELECT 'best_pick_favorite' AS strategy, *, pick AS side, p AS score FROM bt WHERE pick = fav
    UNION ALL SELECT 'best_positive_ev_favorite', *, fav, CASE WHEN fav = 1 THEN p1 - i1 ELSE p2 - i2 END FROM bt WHERE (fav = 1 AND ev1) OR (fav = 2 AND ev2)
    UNION ALL SELECT 'best_positive_ev_underdog_pick', *, pick, p - ip FROM bt WHERE pick = 3 - fav AND po > 1 AND p > ip
    UNION ALL SELECT 'best_positive_ev_any', *, 1, p1 - i1 FROM bt WHERE ev1 UNION ALL SELECT 'best_positive_ev_any', *, 2, p2 - i2 FROM bt WHERE ev2),
  eb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_date, odds_type, strategy ORDER BY score DESC, contest_id, side) AS rn FROM ec) WHERE rn = 1),
  es AS (SELECT *, CASE WHEN side = 1 THEN o1 ELSE o2 END AS odds, (side = 1 AND y = 1) OR (side = 2 AND y = 0) AS won FROM eb)"""


@query("event_best_bet", over_sides(f"SELECT strategy, odds_type, contest_id, event_date, CAST(side AS INTEGER) AS bet_side, odds, won, CAST({_SETTLE} AS DOUBLE) AS profit FROM es", _EVENT))
def _(spark, sf):
    return _as_double(bets.event_bets(bet_rows(spark, sf), stake=STAKE).drop("stake"))


@query("strategy_summary", over_sides("""SELECT strategy, odds_type, round(count(*) * 7.35, 2) AS wagered, round(sum(profit), 2) AS profit, count(*) AS bets, count(*) FILTER (WHERE won) AS wins,
  round(count(*) FILTER (WHERE won) / CAST(count(*) AS DOUBLE) * 100, 6) AS win_rate, round(sum(profit) / (count(*) * 7.35) * 100, 6) AS roi,
  round(CASE WHEN count(*) FILTER (WHERE profit < 0) > 0 THEN coalesce(sum(profit) FILTER (WHERE profit > 0), 0) / -sum(profit) FILTER (WHERE profit < 0) WHEN count(*) FILTER (WHERE profit > 0) > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END, 6) AS profit_factor
  FROM single GROUP BY 1, 2""".replace("round(count(*) * 7.35, 2)", "CAST(round(count(*) * 7.35, 2) AS DOUBLE)"), _SINGLE))
def _(spark, sf):
    out = rnd(bets.summary(bets.single_bets(bet_rows(spark, sf), stake=STAKE)), [])
    return out.withColumns({"wagered": F.round("wagered", 2), "profit": F.round("profit", 2)})


@query("bankroll_curve", over_sides("""WITH c AS (SELECT strategy, odds_type, contest_id, event_date, 1000 + sum(profit) OVER w AS bankroll FROM single
    WINDOW w AS (PARTITION BY strategy, odds_type ORDER BY event_date, contest_id ROWS UNBOUNDED PRECEDING)),
  k AS (SELECT *, greatest(1000.0, max(bankroll) OVER (PARTITION BY strategy, odds_type ORDER BY event_date, contest_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c)
  SELECT strategy, odds_type, contest_id, round(bankroll, 2) AS bankroll, round(peak, 2) AS peak, round((peak - bankroll) / peak + 1e-9, 6) AS drawdown FROM k""", _SINGLE))
def _(spark, sf):
    # contests are written, packed; the many more bets are made from them where they are needed
    rows = stored(bet_rows(spark, sf), "bet_rows")
    b = bets.single_bets(rows, stake=STAKE, layout=("odds_type", "event_date"))
    out = bets.equity_curve(b, ["strategy", "odds_type"], 1000.0)
    # none of these lies halfway between two rounded values, and they are many
    rounded = lambda c, unit: F.rint(c * unit) / unit
    return out.select("strategy", "odds_type", "contest_id", rounded(F.col("bankroll"), 1e2).alias("bankroll"), rounded(F.col("peak"), 1e2).alias("peak"), rounded(F.col("drawdown") + 1e-9, 1e6).alias("drawdown"))


def _risk_sql() -> str:
    def scaled(n, mean, sd):
        return f"CASE WHEN {n} > 1 THEN CASE WHEN {sd} > 1e-12 THEN {mean} / {sd} * coalesce(sqrt({n} / yrs), 1) WHEN {mean} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {mean} < 0 THEN CAST('-Infinity' AS DOUBLE) ELSE 0 END END"

    return over_sides(f"""WITH ev AS (SELECT strategy, odds_type, event_date, CAST(sum(CAST(round(profit * 100) AS BIGINT)) AS BIGINT) AS c, count(*) * 7.35 AS w FROM single GROUP BY 1, 2, 3),
      r0 AS (SELECT *, CAST(100000 + sum(c) OVER (PARTITION BY strategy, odds_type ORDER BY event_date) AS BIGINT) AS ec FROM ev),
      r1 AS (SELECT *, c / 100.0 AS p, ec / 100.0 AS e, CASE WHEN ec - c > 0 THEN CAST(c AS DOUBLE) / (ec - c) END AS r, c / 100.0 / w AS roi, greatest(100000, max(ec) OVER (PARTITION BY strategy, odds_type ORDER BY event_date)) / 100.0 AS peak FROM r0),
      a AS (SELECT strategy, odds_type, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, count(*) AS nr, avg(roi) AS mr, stddev_samp(roi) AS sr, count(r) FILTER (WHERE r < 0) AS nn, stddev_samp(r) FILTER (WHERE r < 0) AS sn0,
        max_by(e, event_date) AS last, max((peak - e) / peak) AS dd, CASE WHEN max(event_date) > min(event_date) THEN (max(event_date) - min(event_date)) / 365.25 END AS yrs, coalesce(sum(p) FILTER (WHERE p > 0), 0) AS g, -coalesce(sum(p) FILTER (WHERE p < 0), 0) AS l FROM r1 GROUP BY 1, 2),
      b AS (SELECT *, CASE WHEN nn >= 2 THEN sn0 ELSE 0 END AS sn, CASE WHEN last > 0 AND yrs IS NOT NULL THEN (pow(last / 1000.0, 1 / yrs) - 1) * 100 ELSE 0 END AS cagr FROM a)
      SELECT strategy, odds_type, nr AS events, round({scaled('n', 'm', 's')}, 5) AS sharpe, round({scaled('nr', 'mr', 'sr')}, 5) AS roi_sharpe, round({scaled('n', 'm', 'sn')}, 5) AS sortino, round(cagr, 5) AS cagr, round(dd * 100, 5) AS max_drawdown,
      round(CASE WHEN cagr > 0 AND dd > 0 THEN cagr / (dd * 100) END, 5) AS calmar, round(CASE WHEN l > 0 THEN g / l WHEN g > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0 END, 5) AS event_profit_factor FROM b""", _SINGLE)


@query("sharpe_sortino", _risk_sql())
def _(spark, sf):
    out = bets.risk_metrics(bets.single_bets(bet_rows(spark, sf), stake=STAKE), ["strategy", "odds_type"], 1000.0)
    return rnd(out, [], 5)


@query("parlays")
def _(spark, sf):
    legs = bets.parlay_legs(bet_rows(spark, sf), "picked_positive_ev")
    out = bets.parlays(legs, 2, stake=STAKE).withColumn("legs", F.lit(2)).unionByName(bets.parlays(bets.parlay_legs(bet_rows(spark, sf), "top_confidence"), 3, stake=STAKE).withColumn("legs", F.lit(3)))
    return out.select("legs", "odds_type", "event_date", F.array_join(F.transform("contests", lambda c: c.cast("string")), "+").alias("contests"), "odds", "won", "profit")


STAKE_KEYS = ["strategy", "odds_type"]
_STAKED = f"""{_bet_sql()}, sz AS (SELECT * FROM (VALUES ('fixed10', 'fixed', 10.0, 1.0), ('percent1', 'percent', 1.0, 1.0), ('kelly10', 'kelly', 0.1, 0.05)) v(strategy, method, amount, most)),
  s0 AS (SELECT strategy, odds_type, event_date, contest_id, method, CAST(amount AS DOUBLE) AS amount, CASE method WHEN 'percent' THEN CAST(amount AS DOUBLE) / 100 WHEN 'kelly' THEN least(((po - 1) * p - (1 - p)) / (po - 1) * CAST(amount AS DOUBLE), CAST(most AS DOUBLE)) END AS f,
    CASE WHEN (pick = 1 AND y = 1) OR (pick = 2 AND y = 0) THEN po - 1 ELSE -1 END AS r FROM bt, sz WHERE po > 1),
  s1 AS (SELECT *, CASE WHEN method = 'fixed' THEN 1000 + coalesce(sum(amount * r) OVER w, 0) ELSE 1000 * exp(coalesce(sum(ln(1 + f * r)) OVER w, 0)) END AS before FROM s0 WHERE method = 'fixed' OR f > 0
    WINDOW w AS (PARTITION BY strategy, odds_type ORDER BY event_date, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  s2 AS (SELECT *, min(before) OVER (PARTITION BY strategy, odds_type ORDER BY event_date, contest_id ROWS UNBOUNDED PRECEDING) AS low, CASE WHEN method = 'fixed' THEN amount ELSE f * before END AS stake FROM s1),
  sl AS (SELECT strategy, odds_type, event_date, contest_id, stake, stake * r AS profit, before + stake * r AS bankroll FROM s2 WHERE method <> 'fixed' OR low >= amount)"""


def _picked(spark, sf):
    """The model's pick of every contest and odds type, and the three ways to stake it."""
    rows = bets.with_sides(bet_rows(spark, sf)).filter("pick IS NOT NULL")
    one = F.col("pick") == 1
    base = rows.select("odds_type", "event_date", "contest_id", F.when(one, F.col("p1")).otherwise(F.col("p2")).alias("p"), F.when(one, F.col("o1")).otherwise(F.col("o2")).alias("odds"), bets.won(F.col("pick")).alias("won"))
    return base, spark.createDataFrame([("fixed10", "fixed", 10.0, 1.0), ("percent1", "percent", 1.0, 1.0), ("kelly10", "kelly", 0.1, 0.05)], "strategy string, method string, amount double, most double")


def _staked(spark, sf):
    base, sizing = _picked(spark, sf)
    base = base.withColumn("strategy", F.explode(F.array(F.lit("fixed10"), F.lit("percent1"), F.lit("kelly10"))))
    return bets.compounded_backtest(base, sizing, 1000.0, STAKE_KEYS), base


# money in whole cents, bet after bet: a recursion over stretches of a strategy's bets, a fold inside each
_CENTS = "CASE WHEN x.fixed THEN least(x.a, a.m) WHEN a.m * x.f >= 1 THEN round(a.m * x.f) ELSE 0 END"
_GAIN = f"round(({_CENTS}) * x.b / 100)"
_EMPTY = "'fixed': false, 'f': 0.0::DOUBLE, 'a': 0.0::DOUBLE, 'b': 0.0::DOUBLE, 't': []::DOUBLE[][]"
_PURSE = f"""{_STAKED},
  cb AS MATERIALIZED (SELECT strategy, odds_type, event_date, contest_id, n // 250 AS c, n % 250 + 1 AS i, method = 'fixed' AS fixed, coalesce(f, 0.0) AS f, round(amount * 100) AS a, round(r * 100) AS b
    FROM (SELECT *, row_number() OVER (PARTITION BY strategy, odds_type ORDER BY event_date, contest_id) - 1 AS n FROM s0)),
  cl AS MATERIALIZED (SELECT strategy, odds_type, c, list({{'m': 0.0::DOUBLE, 'fixed': fixed, 'f': f, 'a': a, 'b': b, 't': []::DOUBLE[][]}} ORDER BY i) AS l FROM cb GROUP BY ALL),
  cf AS (SELECT DISTINCT strategy, odds_type, -1::BIGINT AS c, 100000.0::DOUBLE AS m, []::DOUBLE[][] AS t FROM cb
    UNION ALL SELECT strategy, odds_type, c, z.m, z.t FROM (SELECT cl.strategy, cl.odds_type, cl.c, list_reduce(cl.l, lambda a, x:
        {{'m': a.m + {_GAIN}, 'fixed': x.fixed, 'f': x.f, 'a': x.a, 'b': x.b, 't': list_append(a.t, [{_CENTS}, {_GAIN}, a.m + {_GAIN}])}}, {{'m': cf.m, {_EMPTY}}}) AS z
      FROM cf JOIN cl ON cl.strategy = cf.strategy AND cl.odds_type = cf.odds_type AND cl.c = cf.c + 1)),
  cs AS (SELECT cb.strategy, cb.odds_type, contest_id, event_date, cf.t[cb.i][1] AS stake, cf.t[cb.i][2] AS profit, cf.t[cb.i][3] AS bankroll FROM cb JOIN cf ON cf.strategy = cb.strategy AND cf.odds_type = cb.odds_type AND cf.c = cb.c)"""


@query("fixed_and_percent_stakes", over_sides("""SELECT strategy, odds_type, contest_id, event_date, round(ln(stake / 100), 5) AS log_stake, round(profit / stake + 1e-9, 5) AS gain, round(ln(CASE WHEN bankroll > 0 THEN bankroll / 100 END), 5) AS log_bankroll
  FROM cs WHERE stake > 0""", _PURSE).replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, sf):
    base, sizing = _picked(spark, sf)
    log = bets.staked_backtest(base, sizing, 1000.0, STAKE_KEYS)
    # a Kelly bankroll grows over many powers of ten, so money is reported by its logarithm; shares of cents end in a 5 often
    return log.select(*STAKE_KEYS, "contest_id", "event_date", F.round("log_stake", 5).alias("log_stake"), F.round(F.col("gain") + 1e-9, 5).alias("gain"), F.round("log_bankroll", 5).alias("log_bankroll"))


@query("daily_states", over_sides("""WITH dd AS (SELECT DISTINCT strategy, odds_type, event_date FROM sl UNION SELECT DISTINCT strategy, odds_type, event_date FROM s0),
  dp AS (SELECT strategy, odds_type, event_date, sum(profit) AS p FROM sl GROUP BY 1, 2, 3),
  db AS (SELECT dd.*, 1000 + sum(coalesce(p, 0)) OVER (PARTITION BY dd.strategy, dd.odds_type ORDER BY dd.event_date) AS b FROM dd LEFT JOIN dp ON dp.strategy = dd.strategy AND dp.odds_type = dd.odds_type AND dp.event_date = dd.event_date),
  dr AS (SELECT *, coalesce(lag(b) OVER w, 1000) AS prev, greatest(1000, max(b) OVER w) AS peak FROM db WINDOW w AS (PARTITION BY strategy, odds_type ORDER BY event_date))
  SELECT strategy, odds_type, event_date, round(ln(CASE WHEN b > 0 THEN b END), 5) AS log_bankroll, round(CASE WHEN prev > 0 THEN b / prev - 1 ELSE 0 END + 1e-9, 5) AS day_return, round(CASE WHEN peak > 0 THEN (peak - b) / peak ELSE 0 END + 1e-9, 5) AS drawdown FROM dr""", _STAKED))
def _(spark, sf):
    log, base = _staked(spark, sf)
    days = base.filter("odds > 1").select(*STAKE_KEYS, "event_date").distinct()
    out = bets.daily_states(log, days, 1000.0, STAKE_KEYS)
    # shares of cents end in a 5 often; the nudge keeps their rounding off the edge
    return out.select(*STAKE_KEYS, "event_date", F.round(F.log(F.when(F.col("bankroll") > 0, F.col("bankroll"))), 5).alias("log_bankroll"), F.round(F.col("day_return") + 1e-9, 5).alias("day_return"), F.round(F.col("drawdown") + 1e-9, 5).alias("drawdown"))
