import datetime as dt

import pytest
from pyspark.sql import functions as F

from contestlab.operators import ticks


def at(day, hour, minute=0):
    return dt.datetime(2020, 1, day, hour, minute)


def plain_lines(rows, days=7):
    """All ticks of a key side by side: first, last, nearest to ``days`` before the last, the later one on ties."""
    out = {}
    for k in {r[0] for r in rows if r[0] is not None}:
        mine = sorted(r[1:] for r in rows if r[0] == k)
        target = mine[-1][0] - dt.timedelta(days=days)
        week = min(mine, key=lambda t: (abs(t[0] - target), -t[0].timestamp()))
        out[k] = (mine[0][1], mine[-1][1], week[0], week[1])
    return out


@pytest.mark.parametrize("points", [ticks.POINTS, ("opening", "closing", "week_ts", "week")])
def test_line_points_against_all_ticks(spark, points):
    rows = [("one", at(1, 5), 1.5), (None, at(1, 5), 9.0)]
    # the target, the 10th at 12:30, lies inside an hour whose first and last tick are not the nearest
    rows += [("deep", at(10, 12, m), 2.0 + m / 100) for m in (1, 20, 28, 33, 59)] + [("deep", at(17, 12, 30), 1.1), ("deep", at(2, 1), 3.0)]
    # equally far on both sides: the later one
    rows += [("tie", at(17, 12, 30), 1.2), ("tie", at(10, 12, 20), 4.0), ("tie", at(10, 12, 40), 5.0)]
    # in the hours around the target's own
    rows += [("near", at(17, 12, 1), 1.3), ("near", at(10, 11, 58), 6.0), ("near", at(10, 12, 50), 7.0), ("near", at(10, 13, 1), 8.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, odds double")
    got = {r["k"]: (r["opening"], r["closing"], r["week_ts"], r["week"]) for r in ticks.line_points(df, ["k"], points=points).collect()}
    assert got == plain_lines(rows)


def test_match_contests_against_all_pairs_and_joins_on_stretches(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i)
    contests = [(i, i * 7 % 5, 10, 20, "Ann A", "Bob B", day(d)) for i, d in enumerate((0, 3, 35, 36, 40, 71, 72, 73, 140))]
    contests += [(100, 1, 30, 40, "Bob B", "Cat C", day(36)), (101, 1, 30, 40, "Bob B", "Cat C", None)]
    lines = [("Ann A", "Bob B", f"m{d:03}", day(d), 1.5) for d in (-4, 2, 31, 39, 44, 68, 76, 77, 136, 145)] + [("bob b", "ANN A", "m038", day(38), 2.0), ("Cat C", "Bob B", "m032", day(32), 3.0), ("Ann A", "Cat C", "m036", day(36), 4.0)]
    c = spark.createDataFrame(contests, "contest_id bigint, event_id bigint, entity1_id bigint, entity2_id bigint, name1 string, name2 string, event_date date")
    ln = spark.createDataFrame(lines, "fighter string, opponent string, month string, closing_date date, opening double")
    out = ticks.match_contests(ln, c)
    got = {(r["contest_id"], r["fighter"], r["opponent"], r["month"], r["orientation"]) for r in out.collect()}
    claims = {}
    for f, o, m, d, _ in lines:
        near = []
        for cid, ev, _, _, a, b, e in contests:
            if e is not None and abs((e - d).days) <= 4 and {f.lower(), o.lower()} == {a.lower(), b.lower()}:
                near.append((abs((e - d).days), e, ev, cid, 1 if f.lower() == a.lower() else 2))
        if near:
            best = min(near)
            claims.setdefault(best[3], []).append((f, o, m, best[4]))
    assert got == {(cid, *min(v)) for cid, v in claims.items()}
    # a contest travels at most twice, not once a day
    text = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in text and text.count("explode") == 1


def test_vig_free_reads_its_prices_once(spark):
    df = spark.createDataFrame([(1, 1, 0.6, 0.5, 0.4), (1, 1, 0.6, 0.3, 0.0), (2, 1, 0.0, 0.0, 0.5), (None, 1, 0.5, 0.5, 0.5)], "contest_id int, event_id int, ip_opening double, ip_closing double, ip_week double")
    out = ticks.vig_free(df)
    got = sorted((r["contest_id"], round(r["ip_opening"], 6), round(r["ip_closing"], 6), round(r["ip_week"], 6)) for r in out.collect())
    assert got == [(1, 0.5, 0.375, 0.0), (1, 0.5, 0.625, 1.0), (2, 0.5, 0.5, 1.0)]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
