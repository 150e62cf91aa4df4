import datetime as dt

from pyspark.sql import functions as F

from contestlab.catalog.market import _ticks
from contestlab.operators import explore, sides
from contestlab.sample import PAIRS, contest_headers, contest_sides


def test_contests_of_a_hot_order_have_ids_of_their_own(spark, tmp_path):
    """Order 1 has more pairs than fit between its ids and those of order 2."""
    hot = 2 * PAIRS + 60
    lines = [(1, s, 1) for s in range(hot)] + [(2, s, 1) for s in range(120)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_linenumber int").selectExpr(
        "*", "5.0D AS l_quantity", "10.0D AS l_extendedprice", "'A' AS l_returnflag", "'O' AS l_linestatus", "7L AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, dt.datetime(1996, 1, o), o, "1-URGENT", "F") for o in (1, 2)], "o_orderkey bigint, o_orderdate timestamp, o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    h = contest_headers(spark, str(tmp_path))
    assert h.count() == h.select("contest_id").distinct().count() == hot // 2 + 60
    assert h.agg(F.min("contest_id")).first()[0] == PAIRS
    sides = contest_sides(spark, str(tmp_path), []).groupBy("contest_id").agg(F.countDistinct("event_date").alias("days"), F.count("*").alias("n"))
    assert sides.filter("days <> 1 OR n <> 2").count() == 0
    kept = contest_headers(spark, str(tmp_path), "order_id").groupBy("order_id").count()
    assert {tuple(r) for r in kept.collect()} == {(1, hot // 2), (2, 60)}
    named = contest_headers(spark, str(tmp_path), "order_id").withColumns({f"name{i}": F.col(f"entity{i}_id").cast("string") for i in (1, 2)})
    assert _ticks(spark, str(tmp_path), named).count() == hot + 120


def test_tasks_of_the_pairing_grow_with_the_line_items(spark, sf_dir, monkeypatch):
    from contestlab import sample

    want = {tuple(r) for r in contest_headers(spark, sf_dir).collect()}
    monkeypatch.setattr(sample, "TASK_ROWS", 500)
    many = sample.contest_pairs(spark, sf_dir, [])
    # 6,000 line items: the session's 4 tasks would hold three times the rows allowed
    assert many.rdd.getNumPartitions() == 12
    assert {tuple(r) for r in contest_headers(spark, sf_dir).collect()} == want


def test_pairs_and_prior_values_in_tasks_of_their_own(spark):
    """The number of tasks follows the rows, not the session's partition count."""
    rows = [(c, e, 3 - e, dt.date(2000, 1, 1 + c % 9), side, float(c * e)) for c in range(40) for side, e in ((1, 1), (2, 2))]
    df = spark.createDataFrame(rows, "contest_id bigint, entity_id bigint, opponent_id bigint, event_date date, side int, v double")
    for make in (lambda t: sides.pair_sides(df, ["v"], tasks=t), lambda t: explore.prefight_value(df, "v", tasks=t)):
        plain, dealt = make(None), make(7)
        assert dealt.rdd.getNumPartitions() == 7
        assert sorted(map(str, plain.collect())) == sorted(map(str, dealt.collect()))


def test_scoring_from_states_makes_contests_once(spark, tmp_path, monkeypatch):
    """Histories and schedule are read from one written table, and no step writes the whole history in between."""
    from contestlab import sample, session
    from contestlab.catalog import assembly, load

    lines = [(o, s, n) for o in range(1, 13) for s in range(1, 5) for n in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint, l_linenumber int").selectExpr(
        "*", "cast(l_suppkey as double) AS l_quantity", "l_orderkey * 10.0D AS l_extendedprice", "'R' AS l_returnflag", "'O' AS l_linestatus", "7L AS l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o, dt.datetime(1996, o, 3) if o < 7 else dt.datetime(1998, o, 3), o, "1-URGENT", "F") for o in range(1, 13)], "o_orderkey bigint, o_orderdate timestamp, o_custkey bigint, o_orderpriority string, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(s, f"s{s}", s) for s in range(1, 4)], "s_suppkey bigint, s_name string, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    made, cuts, pairs, cut = [], [], sample.contest_pairs, session.cut
    counted = lambda df: cuts.append(1) or cut(df)
    monkeypatch.setattr(sample, "contest_pairs", lambda *a: made.append(1) or pairs(*a))
    monkeypatch.setattr(session, "cut", counted)
    monkeypatch.setattr(assembly, "cut", counted)
    out = load()[0]["score_from_states"](spark, str(tmp_path)).collect()
    # the contests of suppliers 1 and 2 after the cut; supplier 4 has no row of its own
    assert sorted(r["contest_id"] for r in out) == sorted(o * PAIRS for o in range(7, 13))
    assert {(r["side1_total"], r["combined_total"]) for r in out} == {(6, 12)} and {r["land_diff"] for r in out} == {-2.0}
    assert len(made) == 1 and len(cuts) == 2
