"""Entity states: parts merge to the whole, and scores equal those of the history."""

import math

import pytest
from pyspark.sql import functions as F

from contestlab.operators import standing
from contestlab.plans import scoring

RATE = math.log(2)
STATS = ["age", "days_since_last"]


@pytest.fixture(scope="module")
def history(spark):
    rows = [(1, 10, "2020-01-01", 25.0, 120.0, 3), (1, 11, "2021-01-01", 26.0, 366.0, 5), (1, 12, "2021-06-01", None, 151.0, 4), (2, 10, "2020-01-01", 30.0, 120.0, 7), (2, 13, "2020-07-01", 30.5, 182.0, 1), (3, 14, "2021-01-01", 20.0, 120.0, 9)]
    df = spark.createDataFrame(rows, "entity_id int, contest_id int, d string, age double, days_since_last double, land int")
    return df.withColumn("event_date", F.to_date("d")).withColumn("dob", F.when(F.col("entity_id") == 1, F.to_date(F.lit("1995-01-01")))).drop("d")


def states(df):
    return standing.entity_states(df, [*STATS, *[f"{s}_ratio" for s in STATS]], ["dob", *STATS, "land"], RATE, "2000-01-01")


def with_ratios(df):
    return df.withColumns({f"{s}_ratio": F.lit(0.5) for s in STATS})


def test_merged_parts_equal_the_whole(history):
    df = with_ratios(history)
    whole = {r["entity_id"]: r.asDict(True) for r in states(df).collect()}
    parts = [states(df.filter(f"contest_id % 3 = {i}")) for i in range(3)]
    merged = {r["entity_id"]: r.asDict(True) for r in standing.merge_states(parts).collect()}
    assert set(whole) == set(merged)
    for e, row in whole.items():
        for c, v in row.items():
            assert merged[e][c] == (pytest.approx(v, rel=1e-12) if isinstance(v, float) else v), (e, c)


def test_scores_from_states(spark, history):
    plan = spark.createDataFrame([(99, "2022-01-01", 1, 2, -200), (98, "2022-01-01", 1, 3, 100), (97, "2022-01-01", 2, 7, None)], "contest_id int, d string, entity1_id int, entity2_id int, odds int").withColumn("event_date", F.to_date("d"))
    got = scoring.score_schedule(states(with_ratios(history)), plan, STATS, ["land"], odds="odds").collect()
    assert [r["contest_id"] for r in got] == [99]  # the others lack two earlier contests of a side
    r = got[0]
    age = round(9862 / 365.25, 3)
    assert r["side1_age"] == pytest.approx(age) and r["side2_age"] == 30.5 and r["age_diff"] == pytest.approx(age - 30.5)
    assert r["side1_days_since_last"] == 214.0 and r["side2_days_since_last"] == 549.0
    assert r["side1_age_ratio"] == pytest.approx(age / (age + 30.5)) and r["side1_age_avg"] == pytest.approx((25 + 26 + age) / 3)
    w = [math.exp(-RATE * d / 365.25) for d in (731, 365)]
    assert r["side1_age_dec_avg"] == pytest.approx((25 * w[0] + 26 * w[1]) / sum(w))
    assert (r["side1_land"], r["side2_land"], r["land_diff"]) == (4, 1, 3) and (r["side1_total"], r["combined_total"]) == (3, 5)
    assert r["implied_prob"] == pytest.approx(2 / 3)


def test_a_state_from_the_future_is_an_error(spark, history):
    plan = spark.createDataFrame([(99, "2020-07-01", 1, 2)], "contest_id int, d string, entity1_id int, entity2_id int").withColumn("event_date", F.to_date("d"))
    with pytest.raises(Exception, match="newer than the scheduled contest"):
        scoring.score_schedule(states(with_ratios(history)), plan, STATS, ["land"]).collect()
