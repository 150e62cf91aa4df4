from pyspark.sql import functions as F

from contestlab.functions import odds, parse
from contestlab.operators import select


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["o"] for r in df.select("i", expr(F.col("c")).alias("o")).orderBy("i").collect()]


def test_text_parsers(spark):
    assert one(spark, ["3 of 7", "--", None], lambda c: parse.split_of(c)[0]) == [3, 0, 0]
    assert one(spark, ["3 of 7", "--", None], lambda c: parse.split_of(c)[1]) == [7, 0, 0]
    assert one(spark, ["5:00", "3:30", None, "--", "x:y"], parse.clock_to_sec) == [300, 210, None, 0, 0]
    assert one(spark, ["3 Rnd (5-5-5)", "No Time Limit", "?", None], lambda c: parse.round_lengths(c, F.lit(77))) == [[300, 300, 300], [77], None, None]
    assert one(spark, ["5' 10\"", "6'", "--", None], parse.feet_inches) == [70, None, None, None]
    assert one(spark, ['72"', "--", None], parse.inches) == [72, None, None]


def test_groups_keep_their_order(spark):
    raw = ["Light Heavyweight Title Bout", "Women's Strawweight Bout", "Catch Weight Bout", "Super Fight", None]
    clean = ["light heavyweight", "women's strawweight", "catchweight", "open weight", None]
    assert one(spark, raw, parse.normalize_group) == clean
    assert one(spark, clean, parse.encode_group) == [8, 1, 0, 9, None]
    assert one(spark, ["W", "l", "D", "nc", "x"], lambda c: parse.map_values(c, parse.RESULT_CODES)) == [1, 0, 2, 3, None]


def test_odds_round_trip(spark):
    vals = [0.4, 2.5, 150.0, -200.0]
    assert one(spark, vals, lambda c: odds.convert_odds(c, "decimal"), "double") == [2.5, 2.5, 2.5, 1.5]
    assert one(spark, vals, lambda c: odds.convert_odds(c, "american"), "double") == [150.0, 150.0, 150.0, -200.0]
    assert one(spark, [150.0, -200.0], odds.prob_from_american, "double") == [0.4, 200 / 300]
    assert one(spark, [1.5, 1.0], odds.complement_odds, "double") == [3.0, 2.0]


def test_column_selection():
    cols = ["ctrl", "ctrl_per_min", "ctrl_per_min_avg", "ko", "ko_rd1"]
    assert select.select_features(cols, {"ctrl": ["ctrl_*per_min*"], "ko": ["*"]}) == ["ctrl_per_min", "ctrl_per_min_avg", "ko", "ko_rd1"]
    assert select.select_features(cols, {"ko": ["ko"]}) == ["ko"]
    assert select.filter_columns(cols, include=["ctrl"], exclude=["avg"], required=["ko"]) == ["ctrl", "ctrl_per_min", "ko"]
