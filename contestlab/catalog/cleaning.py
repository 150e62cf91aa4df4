"""Cleaning, projection and scalar functions."""

from pyspark.sql import functions as F

from ..functions import odds, parse
from ..operators import select, sides
from ..sample import contest_headers, contest_sides, entities, table
from .registry import ENTITIES, over_sides, query

ID = ["contest_id", "entity_id"]


@query("parse_of_pair", over_sides("""SELECT contest_id, entity_id,
  CAST(CASE WHEN side = 2 AND kd > 0 THEN 0 ELSE land END AS INTEGER) AS land, CAST(CASE WHEN side = 2 AND kd > 0 THEN 0 ELSE att END AS INTEGER) AS att FROM sides"""))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att", "kd"])
    text = F.when((F.col("side") == 2) & (F.col("kd") > 1), None).when((F.col("side") == 2) & (F.col("kd") == 1), "--").otherwise(
        F.concat_ws(" of ", F.col("land").cast("string"), F.col("att").cast("string")))
    land, att = parse.split_of(F.col("text"))
    return s.select(*ID, text.alias("text")).select(*ID, land.alias("land"), att.alias("att"))


@query("parse_clock", over_sides("""SELECT contest_id, CAST(CASE WHEN contest_id % 11 = 0 THEN NULL WHEN contest_id % 7 = 0 THEN 0 ELSE end_time END AS INTEGER) AS end_sec FROM headers"""))
def _(spark, sf):
    h = contest_headers(spark, sf)
    t = F.col("end_time")
    text = F.when(F.col("contest_id") % 11 == 0, None).when(F.col("contest_id") % 7 == 0, "n/a").otherwise(
        F.format_string("%d:%02d", F.floor(t / 60).cast("int"), (t % 60).cast("int")))
    return h.select("contest_id", text.alias("text")).select("contest_id", parse.clock_to_sec(F.col("text")).alias("end_sec"))


@query("parse_time_format", over_sides("""SELECT contest_id, CASE WHEN contest_id % 5 = 0 THEN CAST(end_time AS VARCHAR)
  WHEN contest_id % 5 = 1 THEN NULL WHEN contest_id % 2 = 0 THEN '300,300,300' ELSE '300,300,300,300,300' END AS lengths FROM headers"""))
def _(spark, sf):
    h = contest_headers(spark, sf)
    k = F.col("contest_id")
    text = F.when(k % 5 == 0, "No Time Limit").when(k % 5 == 1, "unknown").when(k % 2 == 0, "3 Rnd (5-5-5)").otherwise("5 Rnd (5-5-5-5-5)")
    out = h.select("contest_id", "end_time", text.alias("text"))
    lengths = parse.round_lengths(F.col("text"), F.col("end_time"))
    return out.select("contest_id", F.array_join(F.transform(lengths, lambda x: x.cast("string")), ",").alias("lengths"))


@query("parse_height_reach", """SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE CAST(60 + s_suppkey % 24 AS INTEGER) END AS height_in,
  CASE WHEN s_suppkey % 8 = 0 THEN NULL ELSE CAST(62 + s_suppkey % 20 AS INTEGER) END AS reach_in FROM supplier""")
def _(spark, sf):
    k = F.col("s_suppkey")
    h = 60 + k % 24
    htext = F.when(k % 9 == 0, "--").otherwise(F.format_string("%d' %d\"", F.floor(h / 12).cast("int"), (h % 12).cast("int")))
    rtext = F.when(k % 8 == 0, "n/a").otherwise(F.concat((62 + k % 20).cast("string"), F.lit('"')))
    s = table(spark, sf, "supplier").select(k.alias("entity_id"), htext.alias("h"), rtext.alias("r"))
    return s.select("entity_id", parse.feet_inches(F.col("h")).alias("height_in"), parse.inches(F.col("r")).alias("reach_in"))


RAW_GROUPS = [
    "Light Heavyweight Title Bout", "Heavyweight Bout", "Women's Strawweight Bout", "Catch Weight Bout", "Lightweight Bout", "Super Fight",
    "Women's Bantamweight Title Bout", "Open Weight Bout",
]
CLEAN_GROUPS = [
    "light heavyweight", "heavyweight", "women's strawweight", "catchweight", "lightweight", "open weight", "women's bantamweight", "open weight",
]
GROUP_CODES = [8, 9, 1, 0, 5, 9, 3, 9]


def _cases(key: str, values: list) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(values)} = {i} THEN " + (str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)) + " END"


@query("normalize_group", f"SELECT o_orderkey AS contest_id, {_cases('o_orderkey', CLEAN_GROUPS)} AS grp_clean FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest_id"))
    raw = F.element_at(F.array(*[F.lit(g) for g in RAW_GROUPS]), (F.col("contest_id") % len(RAW_GROUPS) + 1).cast("int"))
    return o.select("contest_id", parse.normalize_group(raw).alias("grp_clean"))


@query("encode_group", f"SELECT o_orderkey AS contest_id, CAST({_cases('o_orderkey', GROUP_CODES)} AS INTEGER) AS grp_code FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest_id"))
    raw = F.element_at(F.array(*[F.lit(g) for g in CLEAN_GROUPS]), (F.col("contest_id") % len(CLEAN_GROUPS) + 1).cast("int"))
    return o.select("contest_id", parse.encode_group(raw).alias("grp_code"))


@query("map_result", """SELECT o_orderkey AS contest_id, CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END AS INTEGER) AS result FROM orders""")
def _(spark, sf):
    letter = F.expr("CASE o_orderstatus WHEN 'F' THEN 'W' WHEN 'P' THEN 'd' ELSE 'NC' END")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("contest_id"), parse.map_values(letter, parse.RESULT_CODES).alias("result"))


@query("contest_filters", over_sides("""SELECT contest_id, event_date, grp FROM headers
  WHERE grp NOT IN ('5-LOW') AND event_date >= DATE '1995-01-01' AND event_date < DATE '1998-01-01'"""))
def _(spark, sf):
    out = select.contest_filters(contest_headers(spark, sf), "grp", ["5-LOW"], "event_date", "1995-01-01", "1998-01-01")
    return out.select("contest_id", "event_date", "grp")


@query("dedupe_dim", """SELECT c_nationkey AS nation_key, lower(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END) AS name, c_custkey AS seq
  FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS rn FROM customer) WHERE rn = 1""")
def _(spark, sf):
    raw = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation_key"), F.col("c_custkey").alias("seq"),
        F.when(F.col("c_custkey") % 8 == 0, "--").when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("name"))
    return select.build_dim(raw, ["nation_key"], ["seq"], ["name"])


@query("assign_ids", """WITH d AS (SELECT DISTINCT s_name AS url FROM supplier)
  SELECT url, dense_rank() OVER (ORDER BY url) AS id FROM d""")
def _(spark, sf):
    names = table(spark, sf, "supplier").select(F.col("s_name").alias("url"))
    return select.assign_ids(names, "url", "id")


@query("unpivot_sides", over_sides("""SELECT contest_id, CAST(side AS INTEGER) AS side, entity_id, land, att, land_rd1, land_rd2, land_rd3, att_rd1, att_rd2, att_rd3 FROM sides"""))
def _(spark, sf):
    from ..sample import contest_pairs

    cols = ["land", "att", *[f"{s}_rd{r}" for s in ("land", "att") for r in (1, 2, 3)]]
    p = contest_pairs(spark, sf, cols)
    wide = p.select("contest_id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "ab" for c in ["entity_id", *cols]])
    one, two = ({c: f"{s}_{c}" for c in ["entity_id", *cols]} for s in "ab")
    return sides.to_sides(wide, ["contest_id"], one, two)


@query("feature_pattern_select", over_sides("""SELECT contest_id, entity_id, land, land_rd1, land_rd2, land_rd3, att_rd1 FROM sides"""))
def _(spark, sf):
    s = contest_sides(spark, sf)
    cols = select.select_features(s.columns, {"land": ["*"], "att_": ["att*_rd1"]})
    return s.select(*ID, *cols)


@query("include_exclude_filter", over_sides("""SELECT contest_id, entity_id, att, att_rd2, att_rd3, land_rd1 FROM sides"""))
def _(spark, sf):
    s = contest_sides(spark, sf)
    cols = select.filter_columns(s.columns, include=["att"], exclude=["sub", "_rd1"], required=["land_rd1"])
    return s.select(*ID, *cols)


# four price formats derived from the two sides of a contest
def _price():
    return F.expr("""CASE contest_id % 4 WHEN 0 THEN 0.05 + land_share * 0.9 WHEN 1 THEN 1.05 + att % 40
      WHEN 2 THEN -100.0 - att ELSE 100.0 + att END""").cast("double")


_PRICE_SQL = """prices AS (SELECT contest_id, entity_id, CASE contest_id % 4 WHEN 0 THEN 0.05 + land / CAST(att AS DOUBLE) * 0.9 WHEN 1 THEN 1.05 + att % 40
  WHEN 2 THEN -100.0 - att ELSE 100.0 + att END AS price FROM sides),
dec AS (SELECT contest_id, entity_id, CASE contest_id % 4 WHEN 0 THEN 1 / price WHEN 1 THEN price WHEN 2 THEN 1 - 100 / price ELSE price / 100 + 1 END AS d FROM prices)"""


def _prices(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"]).withColumn("land_share", F.col("land") / F.col("att"))
    return s.select(*ID, _price().alias("price"))


@query("odds_convert", over_sides("""SELECT contest_id, entity_id, round(d, 4) AS dec_odds, round(1 / d, 4) AS prob,
  round(CASE WHEN d >= 2 THEN (d - 1) * 100 ELSE -100 / (d - 1) END, 4) AS american,
  CAST(CASE WHEN 1 / d > 0.5 THEN trunc(-100 * (1 / d) / (1 - 1 / d)) ELSE trunc(100 * (1 - 1 / d) / (1 / d)) END AS INTEGER) AS american_whole FROM dec""", _PRICE_SQL))
def _(spark, sf):
    p = _prices(spark, sf)
    c = F.col("price")
    return p.select(*ID, odds.convert_odds(c, "decimal").alias("dec_odds"), odds.convert_odds(c, "probability").alias("prob"),
                    odds.convert_odds(c, "american").alias("american"), odds.american_from_prob(1 / odds.to_decimal(c)).alias("american_whole"))


@query("opponent_odds", over_sides("""SELECT contest_id, entity_id, round(CASE WHEN d > 1 THEN 1 + 1 / (d - 1) ELSE 2.0 END, 6) AS opp_odds FROM dec""", _PRICE_SQL))
def _(spark, sf):
    d = odds.to_decimal(F.col("price"))
    return _prices(spark, sf).select(*ID, F.round(odds.complement_odds(d), 6).alias("opp_odds"))


@query("expected_value_edge", over_sides("""SELECT d.contest_id, d.entity_id, round(s.land / CAST(s.att AS DOUBLE) * 100 - CASE WHEN d > 1 THEN 100 / d ELSE 0 END, 4) AS edge,
  coalesce(d > 1 AND s.land / CAST(s.att AS DOUBLE) > 1 / d, false) AS plus_ev FROM dec d JOIN sides s ON s.contest_id = d.contest_id AND s.entity_id = d.entity_id""", _PRICE_SQL))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land", "att"]).withColumn("land_share", F.col("land") / F.col("att"))
    out = s.select(*ID, F.col("land_share").alias("p"), odds.to_decimal(_price()).alias("d"))
    p, d = F.col("p"), F.col("d")
    return out.select(*ID, F.round(odds.edge_points(p, d), 4).alias("edge"), odds.positive_ev(p, d).alias("plus_ev"))


@query("union_distinct_sides", over_sides("SELECT contest_id, entity1_id AS entity_id FROM headers UNION SELECT contest_id, entity2_id FROM headers"))
def _(spark, sf):
    return sides.side_ids(contest_headers(spark, sf))


@query("union_all_sides", over_sides("SELECT contest_id, entity1_id AS entity_id FROM headers UNION ALL SELECT contest_id, entity2_id FROM headers"))
def _(spark, sf):
    h = contest_headers(spark, sf)
    return sides.stack_sides(h.select("contest_id", F.col("entity1_id").alias("entity_id")), h.select("contest_id", F.col("entity2_id").alias("entity_id")))


@query("distinct_pairs", "SELECT DISTINCT l_orderkey AS contest_id, l_suppkey AS entity_id FROM lineitem")
def _(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("contest_id"), F.col("l_suppkey").alias("entity_id"))
    return sides.dedupe(li, ["contest_id", "entity_id"])


@query("order_limit", over_sides("SELECT contest_id, entity_id, land FROM sides ORDER BY land DESC, contest_id, entity_id LIMIT 25"))
def _(spark, sf):
    s = contest_sides(spark, sf, ["land"]).select(*ID, "land")
    return select.top_rows(s, [F.desc("land"), F.asc("contest_id"), F.asc("entity_id")], 25)


@query("dim_joins", over_sides("""SELECT s.contest_id, s.entity_id, e.name, n.n_name AS nation_name FROM sides s JOIN entities e ON e.entity_id = s.entity_id
  LEFT JOIN nation n ON n.n_nationkey = e.nation""", ENTITIES))
def _(spark, sf):
    s = contest_sides(spark, sf, []).select(*ID)
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"))
    dims = entities(spark, sf).select("entity_id", "name", "nation")
    return s.join(dims, "entity_id").join(n, "nation", "left").select(*ID, "name", "nation_name")
