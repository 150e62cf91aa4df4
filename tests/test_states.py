import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from contestlab.operators import history as hst
from contestlab.operators import states

SCHEMA = "contest_id bigint, entity_id bigint, opponent_id bigint, event_id bigint, event_date date, won int, ko int, submission int, striking double, head double, age double"


@pytest.fixture(scope="module")
def fights(spark):
    """Three histories: many rows a day, gaps longer than the trailing window, and a single row."""
    rows = []
    for e, days in ((1, [0, 0, 0, 5, 5, 200, 700, 1300, 1301, 1301, 1900]), (2, [3, 553, 554, 1103]), (3, [7])):
        for i, d in enumerate(days):
            won = (i * 7 + e) % 3 > 0
            rows.append((e * 100 + i, e, 9, i % 4, dt.date(2000, 1, 1) + dt.timedelta(days=d), int(won), int(won and i % 2), 0, float(i * 5 % 7), None if i == 2 else float(i * 3 % 4), 20 + e + d / 365.25))
    df = spark.createDataFrame(rows, SCHEMA)
    df.cache().count()
    return df


def test_states_against_all_earlier_rows(fights):
    rows = [r.asDict() for r in fights.collect()]
    got = {(r["contest_id"], r["entity_id"]): r for r in states.state_columns(fights, 2.0, 2.0).collect()}
    assert len(got) == len(rows)
    for c in rows:
        past = sorted((p for p in rows if p["entity_id"] == c["entity_id"] and p["event_date"] < c["event_date"]), key=lambda p: (p["event_date"], p["event_id"], p["contest_id"]))
        r = got[c["contest_id"], c["entity_id"]]
        assert r["source_count"] == len(past)
        assert r["recent_contests"] == [p["contest_id"] for p in past[-2:]]
        assert r["recent_win_rate"]["effective_support"] == len(past[-2:])
        near = [(p, math.exp(-math.log(2) / 180 * (c["event_date"] - p["event_date"]).days)) for p in past if (c["event_date"] - p["event_date"]).days <= 548]
        assert r["decay18_ko_rate"]["effective_support"] == pytest.approx(sum(w for _, w in near), abs=1e-12)
        assert (r["decay18_ko_rate"]["effective_support"] > 0) == bool(near)
        assert r["decay18_ko_rate"]["numerator"] == pytest.approx(2 + sum(w * p["ko"] for p, w in near), abs=1e-12)
        weight = sum(math.exp(-math.log(2) / 365 * (c["event_date"] - p["event_date"]).days) for p in past if p["head"] is not None)
        assert r["high_count_head_state"]["effective_support"] == pytest.approx(weight, abs=1e-9)


def shuffles(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_rows_of_lineage_are_shuffled_twice_and_windows_only_grow(fights):
    plan, n = shuffles(states.state_columns(fights, 2.0, 2.0))
    # rows for the day table, day table, its result, rows, histories, their result
    assert n <= 6
    assert "RangeFrame, -548" not in plan and "collect_list" not in plan


def test_lineage_rows_are_not_sorted_for_their_proof(spark, fights):
    out = states.lineage_violations(states.entity_states(fights, 2.0, 2.0, "p"), fights, ["p"])
    row = out.first()
    assert row["row_count"] == fights.count() * len(states.FEATURES) and row["feature_count"] == len(states.FEATURES)
    assert not any(row[c] for c in out.columns[2:])
    assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1 << 16, 4])
def test_columns_of_a_location_are_answered_together(fights, block):
    key, cols = ["entity_id"], ["striking", "head"]

    def table(df):
        return {(r["entity_id"], r["contest_id"]): [round(r[f"{c}_{k}"], 9) if r[f"{c}_{k}"] is not None else None for c in cols for k in ("mean", "variance", "weight")] for r in df.collect()}

    both = table(hst.clipped_location(fights, cols, key, "event_date", 0.5, block=block))
    alone = [table(hst.clipped_location(fights, [c], key, "event_date", 0.5).withColumns({f"{o}_{k}": F.lit(None).cast("double") for o in cols if o != c for k in ("mean", "variance", "weight")})) for c in cols]
    for k, v in both.items():
        assert v[:3] == pytest.approx(alone[0][k][:3], abs=1e-8) and v[3:] == pytest.approx(alone[1][k][3:], abs=1e-8)


def test_short_histories_need_no_table_of_days(fights):
    """No window over (entity, date) and no join where all histories are one block."""
    out = hst.running_order_stats(fights, ["striking"], ["entity_id"], "event_date", ["event_id", "contest_id"], strict=True)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_adjusted_scores_are_written_once_before_the_python_step(spark, fights, monkeypatch):
    from contestlab import session
    from contestlab.operators import adjust, windows
    from contestlab.plans import scoring

    calls = []

    def counted(df):
        calls.append(1)
        return session.cut(df)

    pairs = spark.createDataFrame([(c, e, dt.date(2000, 1, 1) + dt.timedelta(days=c * 9), c, "a", float((c * e) % 5)) for c in range(12) for e in (1 + c % 3, 4)], "contest_id bigint, entity_id bigint, event_date date, event_id bigint, grp string, x double")
    priors = spark.createDataFrame([("a", 1.0, 1.0, 0.5)], "grp string, x_wc_mean double, x_wc_mad double, x_min_mad double")
    for m in (adjust, scoring):
        monkeypatch.setattr(m, "cut", counted)
    for m in (hst, windows):
        monkeypatch.setattr(m, "once", lambda df: df if getattr(df, "is_cut", False) else counted(df))
    got = scoring.layered_features(pairs, ["x"], priors, {"x": ["*_adjperf"]})
    whole = {(r["contest_id"], r["entity_id"]): r["x_adjperf"] for r in got.collect()}
    # what was conceded, and the scores; the averages read the scores as they stand
    assert len(calls) == 2
    cut_up = {(r["contest_id"], r["entity_id"]): r["x_adjperf"] for r in adjust.adjusted_performance(pairs, ["x"], priors, block=2).collect()}
    assert cut_up == pytest.approx(whole)
