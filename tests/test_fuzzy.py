import datetime as dt
import random

import pytest

from contestlab.operators import ticks


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sim(a, b):
    return 100.0 if not max(len(a), len(b)) else 100.0 * (1 - distance(a, b) / max(len(a), len(b)))


@pytest.mark.parametrize("threshold", [65.0, 70.0, 90.0])
def test_no_similar_pair_is_lost(spark, threshold):
    rng = random.Random(3)
    words = ["".join(rng.choice("abc ") for _ in range(rng.randrange(0, 11))) for _ in range(220)]
    left, right = words[:110], words[110:]
    l, r = (spark.createDataFrame([(w,) for w in x], "k string") for x in (left, right))
    got = {(x["a"], x["b"]): x["score"] for x in ticks.alike(l, r, threshold).collect()}
    want = {(a, b): sim(a, b) for a in left for b in right if sim(a, b) >= threshold}
    assert got == pytest.approx(want)


def test_other_initials_and_neighbouring_days(spark):
    day = dt.date(2020, 1, 5)
    lines = spark.createDataFrame([(1, day, "Kaleb Harris", "Jon Stone"), (2, day, "Nobody Known", "Else Where")], "line bigint, day date, fighter string, opponent string")
    contests = spark.createDataFrame([(7, day + dt.timedelta(days=1), "Jon Stone", "Caleb Harris"), (8, day, "Caleb Harris", "Jon Stones"), (9, day + dt.timedelta(days=2), "Kaleb Harris", "Jon Stone")], "contest_id bigint, event_date date, name1 string, name2 string")
    best = ticks.fuzzy_pairs(lines, contests, "day").collect()
    assert [(r["line"], r["contest_id"], r["orientation"]) for r in best] == [(1, 7, 2)]
    assert {(r["line"], r["contest_id"]) for r in ticks.fuzzy_pairs(lines, contests, "day", every=True).collect()} == {(1, 7), (1, 8)}


def test_names_without_common_runs(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {r["left_name"]: (r["right_name"], round(r["score"], 1)) for r in ticks.name_map(names("ana li", "x"), names("ane la", "y")).collect()}
    assert got == {"ana li": ("ane la", 66.7)}


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_no_pair_of_few_edits_is_lost(spark, edits):
    rng = random.Random(4)
    words = ["".join(rng.choice("ab ") for _ in range(rng.randrange(0, 9))) for _ in range(160)] + ["a" * (ticks.LONG + 1)]
    frame = spark.createDataFrame([(w,) for w in words], "k string")
    got = {tuple(r) for r in ticks.within(frame, frame, edits).collect()}
    assert got == {(a, b) for a in words for b in words if len(a) <= ticks.LONG and distance(a, b) <= edits}


def test_rows_with_a_near_match_do_not_meet_names_that_are_somewhat_alike(spark, monkeypatch):
    """All names are alike at the threshold; only rows without a near match may be compared that far."""
    seen, alike = [], ticks.alike
    monkeypatch.setattr(ticks, "alike", lambda left, right, t: seen.append((t, {r["k"] for r in left.distinct().collect()})) or alike(left, right, t))
    rights = [f"united kingdom {i}" for i in range(1000, 1080)]
    lefts = [f"united kingdom {i}x" for i in range(1000, 1080)] + ["unitedkin m 10", "nothing else"]
    got = {r["left_name"]: (r["right_name"], r["score"]) for r in ticks.name_map(*(spark.createDataFrame([(n,) for n in x], "name string") for x in (lefts, rights))).collect()}
    key = lambda n: " ".join(sorted(n.split()))
    want = {a: min((-sim(key(a), key(b)), b) for b in rights) for a in lefts}
    assert got == {a: (b, pytest.approx(-s)) for a, (s, b) in want.items() if -s >= 65}
    assert seen and all(names <= {"10 m unitedkin", "else nothing"} for _, names in seen)


def test_best_contest_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(0, 8)))
    day = dt.date(2020, 1, 5)
    lines = [(i, day, name(), name()) for i in range(60)] + [(60, day, None, "zzzzzzzz"), (61, day, "a" * 50, "b" * 50)]
    contests = [(i, day + dt.timedelta(days=rng.randrange(0, 3)), name(), name()) for i in range(60)] + [(60, day, "a" * 49 + "b", "b" * 50)]
    got = ticks.fuzzy_pairs(spark.createDataFrame(lines, "line bigint, day date, fighter string, opponent string"), spark.createDataFrame(contests, "contest_id bigint, event_date date, name1 string, name2 string"), "day").collect()
    want = {}
    for i, d, f, o in lines:
        if f is None:
            continue
        hits = [(max(sim(f, a) + sim(o, b), sim(f, b) + sim(o, a)), -c) for c, e, a, b in contests if abs((e - d).days) <= 1]
        best = max(hits)
        if best[0] >= 140 - 1e-9:
            want[i] = (-best[1], pytest.approx(best[0]))
    assert len(want) > 10 and {r["line"]: (r["contest_id"], r["score"]) for r in got} == want
