import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from contestlab.operators import assemble, explore, sides, splits, style
from contestlab.operators.adjust import adjusted_performance
from contestlab.sources import contests as src


@pytest.fixture(scope="module")
def both(spark):
    rows = []
    for c in range(40):
        d = dt.date(2020, 1, 1) + dt.timedelta(days=c)
        a, b = c % 5, 5 + (c * 3) % 4
        for s, e, o in ((1, a, b), (2, b, a)):
            rows.append((c, e, o, s, c, d, "g", float((c * 7 + e) % 11), 1 if c % 3 else 0))
    return spark.createDataFrame(rows, "contest_id int, entity_id int, opponent_id int, side int, event_id int, event_date date, grp string, x double, result int")


def test_swapping_sides_negates_differences(both):
    flipped = both.withColumn("side", 3 - F.col("side"))
    a, b = ({r["contest_id"]: r["x_diff"] for r in assemble.contest_diffs(d.withColumn("method", F.lit("")), ["x"], "win_loss", []).collect()} for d in (both, flipped))
    assert all(a[c] == -b[c] for c in a)


def test_shares_sum_to_one_and_third_side_fails(spark, both):
    out = sides.share_of_total(both, ["x"], ["contest_id"], "_s").groupBy("contest_id").agg(F.sum("x_s").alias("t")).collect()
    assert all(r["t"] == pytest.approx(1.0) for r in out)
    bad = both.unionByName(both.filter("side = 1").withColumn("entity_id", F.lit(99)))
    with pytest.raises(Exception, match="more than two sides"):
        sides.opponent(bad, ["x"]).collect()
    lone = both.filter("NOT (contest_id = 3 AND side = 2)")
    assert sides.opponent(lone, ["x"], how="left").filter("x_opp IS NULL").count() == 1
    assert sides.opponent(lone, ["x"]).count() == 78


def test_adjusted_score_without_history_uses_the_prior(spark, both):
    prior = spark.createDataFrame([("g", 4.0, 2.0, 0.5)], "grp string, x_wc_mean double, x_wc_mad double, x_min_mad double")
    out = {(r["contest_id"], r["entity_id"]): r for r in adjusted_performance(both, ["x"], prior).collect()}
    first = out[0, 0]
    assert first["x_adjperf"] == pytest.approx((first["x"] - 4.0) / 2.0)
    chunked = {(r["contest_id"], r["entity_id"]): r["x_adjperf"] for r in adjusted_performance(both, ["x"], prior, block=3).collect()}
    assert all(chunked[k] == pytest.approx(out[k]["x_adjperf"]) for k in out)


def test_balance_reaches_the_target(spark):
    df = spark.createDataFrame([(i, i, 100 + i, 1 if i < 80 else 0, 2.0) for i in range(100)], "contest_id int, a int, b int, y int, v_diff double")
    out = assemble.balance(df, "contest_id", "y", [("a", "b")]).toPandas()
    assert out.y.sum() == 50
    moved = out[out.a >= 100]
    assert len(moved) == 30 and (moved.v_diff == -2.0).all() and (moved.y == 0).all() and (moved.b == moved.contest_id).all()


def test_context_keeps_whole_events(spark):
    rows = [(e * 10 + i, e, dt.date(2020, 1, 1) + dt.timedelta(days=e // 2)) for e, n in enumerate([3, 4, 2, 5, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "contest_id int, event_id int, event_date date")
    def got(n, **kw):
        return sorted({r["event_id"] for r in assemble.prior_context(df, "2021-01-01", n, **kw).collect()})
    assert got(1) == [4] and got(6) == [3, 4] and got(7) == [3, 4] and got(8) == [2, 3, 4] and got(100) == [0, 1, 2, 3, 4]
    assert got(2, exclude_event=4) == [3]


def test_duplicate_keys_and_columns_fail(both):
    with pytest.raises(Exception, match="not unique"):
        assemble.assemble(both.select("contest_id"), [], ["contest_id"]).collect()
    keys = ["contest_id", "entity_id"]
    twice = both.select(*keys, "x").unionByName(both.select(*keys, "x"))
    with pytest.raises(Exception, match="not unique"):
        assemble.assemble(both.select(*keys), [twice], keys).collect()
    assert assemble.assemble(both.select(*keys), [both.select(*keys, "x")], keys).count() == both.count()
    with pytest.raises(ValueError, match="duplicate feature"):
        assemble.assemble(both.select("contest_id", "entity_id", "x"), [both.select("contest_id", "entity_id", "x")], ["contest_id", "entity_id"])


def test_profiles_and_partitions_must_be_complete(spark):
    ev = spark.createDataFrame([("a", 2000, 0.6), ("b", 2000, 0.5), ("a", 2001, 0.6)], "profile string, year int, loss double")
    with pytest.raises(ValueError, match="incomplete"):
        assemble.select_profile(ev, ["a", "b"], 2)
    with pytest.raises(Exception, match="outside the partition"):
        splits.event_split(spark.createDataFrame([(dt.date(2030, 1, 1),)], "d date"), "d", {"t": ("2000-01-01", "2010-01-01")}).collect()


def test_style_metrics(spark):
    need = {c for c in style.COPIES.values()} | {c for ab in style.SHARES.values() for c in ab} | {c for a, b in style.EFFICIENCIES.values() for c in [*a, b]}
    need |= {"sig_str_land_rd1_per_min_dec_avg", "td_att_rd1_per_min_dec_avg", "sub_att_rd1_per_min_dec_avg", "time_sec_rd1_dec_avg", "time_sec_dec_avg", "td_att_per_min_dec_avg", "decision_per_min_dec_avg", "ko_per_min_dec_avg", "sub_land_per_min_dec_avg"}
    vals = {c: 1.0 for c in need} | {"ko_per_min_dec_avg": 3.0, "ctrl_per_min_dec_avg": 0.0, "time_sec_dec_avg": 900.0, "time_sec_rd1_dec_avg": 400.0}
    cols = sorted(vals)
    df = spark.createDataFrame([(1, *[vals[c] for c in cols])], "id int, " + ", ".join(f"{c} double" for c in cols))
    r = style.style(df, ["id"]).first()
    assert r["style_td_per_ctrl_raw"] == 0.0 and r["style_finish_channel_ko_share_raw"] == pytest.approx(0.6)
    assert r["style_rd1_striking_bias_raw"] == pytest.approx(300 / 900) and r["style_range_entropy_raw"] == pytest.approx(1.0)
    assert len(r) == 1 + 27 + 6 + 8 + 1 + 2 + 1 + 3 + 2 + 2


def test_files(spark, tmp_path):
    raw = spark.createDataFrame([("u1", "A", "Jan 15, 1990"), ("u2", 'say "hi", ok', None)], "url string, name string, dob string")
    full = raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None).cast("string")).alias(f.name) for f in src.entity_schema()])
    full.write.option("header", True).option("escape", '"').csv(str(tmp_path / "e"))
    back = {r["url"]: r["name"] for r in src.read_entities(spark, str(tmp_path / "e")).collect()}
    assert back == {"u1": "A", "u2": 'say "hi", ok'}
    base = str(tmp_path / "pub")
    src.publish(spark, {"t": spark.range(3)}, base)
    src.publish(spark, {"t": spark.range(5)}, base, {"t": "csv"})
    assert src.read_published(spark, base, "t").count() == 5
    with pytest.raises(Exception):
        src.publish(spark, {"t": spark.range(7), "bad": spark.range(1).select(F.raise_error(F.lit("boom")).alias("x"))}, base)
    assert src.read_published(spark, base, "t").count() == 5


def test_incremental_merge_keeps_first_or_last(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("", 2, "blank")], "k string, seq int, v string")
    new = spark.createDataFrame([("a", 3, "new", 1), ("b", 4, "x", 2), ("b", 5, "y", 3)], "k string, seq int, v string, extra int")
    first = {r["k"]: (r["v"], r["extra"]) for r in src.merge_incremental(old, new, ["k"], "seq").collect()}
    assert first == {"a": ("old", None), "b": ("x", 2)}
    last = {r["k"]: r["v"] for r in src.merge_incremental(old, new, ["k"], "seq", replace=True).collect()}
    assert last == {"a": "new", "b": "y"}


def test_read_only_sql():
    ok = explore.is_read_only
    assert ok("SELECT 1;") and ok("with a as (select 1) select * from a")
    assert not ok("DROP TABLE x") and not ok("select 1; select 2") and not ok("select * from t where update = 1") and not ok("")


def test_style_metrics_compile(spark):
    """No generated method may pass the 8,000 bytes beyond which the JVM only interprets."""
    need = [*style.COPIES.values(), *[c for ab in style.SHARES.values() for c in ab], *[c for a, b in style.EFFICIENCIES.values() for c in [*a, b]]]
    need += ["td_att_per_min_dec_avg", "sub_land_per_min_dec_avg", "sig_str_land_rd1_per_min_dec_avg", "td_att_rd1_per_min_dec_avg", "sub_att_rd1_per_min_dec_avg", "time_sec_rd1_dec_avg", "decision_per_min_dec_avg", "ko_per_min_dec_avg", "time_sec_dec_avg"]
    rows = spark.range(3).select("id", *[(F.col("id") % 5 + i).cast("double").alias(c) for i, c in enumerate(dict.fromkeys(need))])
    text = spark._jvm.PythonSQLUtils.explainString(style.style(rows, ["id"])._jdf.queryExecution(), "codegen")
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", text))
