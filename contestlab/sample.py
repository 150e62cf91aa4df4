"""The contest view over the star-schema tables (suppliers of an order meet two by two).

The suppliers of an order, by key, form pairs: the first with the second, the third with the fourth
and so on; only the last of an odd number has no opponent. contest = pair, entity = supplier,
group = order priority, event = order date and customer parity. Everything is derived with one
shuffle of the line items, by order: the side aggregate and the pairing both run on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROUNDS = (1, 2, 3)
#: contest id = order key * PAIRS + number of the pair; further pairs of an order have ids of their own above all these.
PAIRS, FURTHER, BITS = 1009, 1 << 62, 24
STATS = ["att", "land", "ctrl", "kd", "sub_att", "secs"]
ROUND_STATS = [f"{s}_rd{r}" for s in ("att", "land", "secs") for r in ROUNDS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ALL_STATS = [*STATS, *ROUND_STATS]
#: Line items a task of the side aggregate takes at most, on average.
TASK_ROWS = 400_000


def _stat_exprs() -> dict:
    q = F.col("l_quantity").cast("bigint")
    hit = F.col("l_returnflag") == "R"
    rd = (F.col("l_linenumber") - 1) % 3 + 1

    def tot(cond, x):
        return F.sum(F.when(cond, x).otherwise(F.lit(0).cast("bigint")))

    made = {
        "att": F.sum(q),
        "land": tot(hit, q),
        "ctrl": tot(F.col("l_linestatus") == "O", q),
        "kd": tot(hit & (q >= 40), F.lit(1)),
        "sub_att": tot(F.col("l_returnflag") == "A", F.lit(1)),
        "secs": F.sum(F.lit(60)),
        "cents": F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")),
    }
    for r in ROUNDS:
        made[f"att_rd{r}"] = tot(rd == r, q)
        made[f"land_rd{r}"] = tot((rd == r) & hit, q)
        made[f"secs_rd{r}"] = tot(rd == r, F.lit(60))
    return made


def row_tasks(spark: SparkSession, sf_dir: str) -> int:
    """As many tasks as bound the rows of one, whatever the session's partition count; further shuffles of the sides take as many."""
    return max(-(-table(spark, sf_dir, "lineitem").count() // TASK_ROWS), spark.sparkContext.defaultParallelism)


def _side_totals(spark: SparkSession, sf_dir: str, stats: list[str]) -> DataFrame:
    """One row per (order, supplier); the line items are shuffled once, by order, which the pairing needs anyway."""
    exprs = _stat_exprs()
    li = table(spark, sf_dir, "lineitem")
    # as many tasks as bound the rows of one, a number that adaptive execution keeps; few rows are left to it
    tasks = -(-li.count() // TASK_ROWS)
    by_order = li.repartition(max(tasks, spark.sparkContext.defaultParallelism), "l_orderkey") if tasks > 1 else li.repartition("l_orderkey")
    return by_order.groupBy(F.col("l_orderkey").alias("order_id"), F.col("l_suppkey").alias("entity_id")).agg(
        *[exprs[s].alias(s) for s in dict.fromkeys(["cents", *stats])]
    )


def contest_ids() -> Column:
    """A different id for every (order_id, __pair); what has no room in a bigint is an error, never another pair's id."""
    order, pair = F.col("order_id"), F.col("__pair") - PAIRS
    further = F.lit(FURTHER) + F.shiftleft(order.cast("bigint"), BITS) + pair
    fits = order.between(0, (1 << (62 - BITS)) - 1) & (pair < 1 << BITS)
    ids = F.when(F.col("__pair") < PAIRS, order * PAIRS + F.col("__pair")).when(fits, further)
    return ids.otherwise(F.raise_error(F.lit("contest id does not fit: order key or number of pairs"))).cast("bigint")


def contest_pairs(spark: SparkSession, sf_dir: str, stats: list[str] = ALL_STATS) -> DataFrame:
    """One row per contest: its order, header columns and the structs ``a`` (side 1) and ``b`` (side 2)."""
    sides = _side_totals(spark, sf_dir, stats)
    # the next supplier of the order is read beside its own row: one sort, no aggregate of pairs
    w = Window.partitionBy("order_id").orderBy("entity_id")
    me = F.struct(*[c for c in sides.columns if c != "order_id"])
    pairs = sides.select("order_id", (F.row_number().over(w) - 1).alias("__n"), me.alias("a"), F.lead(me).over(w).alias("b"))
    pairs = pairs.filter("__n % 2 = 0 AND b IS NOT NULL").withColumn("__pair", F.expr("__n div 2"))
    pairs = pairs.select("order_id", contest_ids().alias("contest_id"), "a", "b")
    o = table(spark, sf_dir, "orders")
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date"))
    head = o.select(
        F.col("o_orderkey").alias("order_id"),
        F.to_date("o_orderdate").alias("event_date"),
        (((day * 2 + F.col("o_custkey") % 2) * 7919) % 100003).cast("bigint").alias("event_id"),
        F.col("o_orderpriority").alias("grp"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'KO/TKO' WHEN 'P' THEN 'Submission' ELSE 'Decision - Unanimous' END").alias("method"),
        (F.col("o_custkey") % 3 + 1).cast("int").alias("end_round"),
        (F.col("o_custkey") % 270 + 30).cast("int").alias("end_time"),
    )
    res = F.when(F.col("a.cents") > F.col("b.cents"), 1).when(F.col("a.cents") < F.col("b.cents"), 0).otherwise(2)
    return pairs.join(head, "order_id").withColumn("result", res)


def contest_headers(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """One row per contest: ids of both sides, date, group, method, result; ``order_id`` if asked for."""
    return contest_pairs(spark, sf_dir, []).select(
        *more,
        "contest_id", F.col("a.entity_id").alias("entity1_id"), F.col("b.entity_id").alias("entity2_id"),
        "event_id", "event_date", "grp", "method", "end_round", "end_time", "result",
    )


def contest_sides(spark: SparkSession, sf_dir: str, stats: list[str] = ALL_STATS) -> DataFrame:
    """One row per entity per contest with the wanted stat columns.

    The stats travel inside a struct, which column pruning cannot look into, so
    the caller names them.
    """
    stats = list(dict.fromkeys(["cents", *stats]))
    p = contest_pairs(spark, sf_dir, stats)

    def side(me: str, other: str, no: int):
        return F.struct(
            F.lit(no).alias("side"), F.col(f"{me}.entity_id").alias("entity_id"),
            F.col(f"{other}.entity_id").alias("opponent_id"), *[F.col(f"{me}.{c}").alias(c) for c in stats],
        )

    head = ["contest_id", "event_id", "event_date", "grp", "method", "end_round", "end_time", "result"]
    return p.select(*head, F.explode(F.array(side("a", "b", 1), side("b", "a", 2))).alias("s")).select(*head, "s.*")


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity dimension with biography columns derived from the supplier row."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return s.select(
        k.alias("entity_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"),
        F.when(k % 7 == 0, None).otherwise(F.date_add(F.lit("1960-01-31").cast("date"), ((k * 131) % 9000).cast("int"))).alias("dob"),
        F.when(k % 5 == 0, None).otherwise((65 + k % 18).cast("int")).alias("reach"),
        F.when(k % 6 == 0, None).otherwise((62 + (k * 5) % 17).cast("int")).alias("height"),
    )
