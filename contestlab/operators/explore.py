"""Ad-hoc analytics: guarded SQL, extremes, outliers, cohorts, audits."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_join
from .quality import to_long

# Statements a read-only question may not contain.
FORBIDDEN = [
    "alter", "analyze", "attach", "checkpoint", "comment", "copy", "create", "delete", "detach", "drop", "execute", "grant",
    "insert", "merge", "refresh", "reindex", "replace", "reset", "revoke", "set", "truncate", "update", "vacuum",
]
_FORBIDDEN = re.compile(r"\b(" + "|".join(FORBIDDEN) + r")\b", re.IGNORECASE)


def is_read_only(sql: str) -> bool:
    """A single SELECT or WITH statement without any mutating word."""
    text = sql.strip().rstrip(";")
    return bool(re.match(r"(select|with)\b", text, re.IGNORECASE)) and ";" not in text and not _FORBIDDEN.search(text)


def safe_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of a read-only query over the named tables."""
    if not is_read_only(sql):
        raise ValueError("only a single read-only SELECT or WITH query is allowed")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(f"SELECT * FROM ({sql.strip().rstrip(';')}) AS question LIMIT {int(max_rows)}")


def topn_by_metric(df: DataFrame, by: list[str], metric: Column, name: str, n: int, min_rows: int = 3) -> DataFrame:
    """Groups with enough rows, highest metric first (ties by key), limited to ``n``."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), metric.alias(name)).filter(F.col("rows") >= min_rows)
    return out.orderBy(F.desc(name), *by).limit(n)


def extremes(df: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    """Per feature: highest and lowest entity, mean, deviation, count and range, in one grouped pass."""
    long = to_long(df, [entity], cols)
    v = F.col("value")
    return long.groupBy("stat").agg(
        F.min_by(entity, F.struct(-v, F.col(entity))).alias("highest"), F.max("value").alias("highest_value"),
        F.min_by(entity, F.struct(v, F.col(entity))).alias("lowest"), F.min("value").alias("lowest_value"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sdev"), F.count(F.lit(1)).alias("n"), (F.max("value") - F.min("value")).alias("value_range"))


def extreme_rows(df: DataFrame, by: list[str], value: str, tie: list[str], k: int) -> DataFrame:
    """Top and bottom ``k`` rows per key, ranked both ways.

    Each direction keeps only its k best per partition before the shuffle.
    """
    rows = df.filter(F.col(value).isNotNull())

    def end(name: str, order: Column) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(order, *tie)
        return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k).withColumn("extreme", F.lit(name))

    return end("top", F.desc(value)).unionByName(end("bottom", F.asc(value)))


def outliers(df: DataFrame, entity: str, cols: list[str], k: int = 5) -> DataFrame:
    """``k`` highest and lowest rows per column in long form, with the column's largest absolute value."""
    long = to_long(df, [entity], cols)
    ends = extreme_rows(long, ["stat"], "value", [entity], k)
    return small_join(ends, long.groupBy("stat").agg(F.max(F.abs("value")).alias("max_abs")), ["stat"])


def cohort(df: DataFrame, entity: str, contest: str, date: str, start: str, before: str, min_contests: int = 3) -> DataFrame:
    """Entities with enough contests overall and at least one inside [start, before)."""
    inside = (F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(before).cast("date"))
    per = df.select(entity, contest, inside.cast("int").alias("i")).groupBy(entity, contest).agg(F.max("i").alias("i"))
    return per.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("i")).filter((F.col("n") >= min_contests) & (F.col("i") == 1)).select(entity)


def cohort_avg(df: DataFrame, members: DataFrame, entity: str, cols: list[str], date: str, start: str, before: str) -> DataFrame:
    """Long table (stat, avg_value) over the members' rows inside the window."""
    inside = (F.col(date) >= F.lit(start).cast("date")) & (F.col(date) < F.lit(before).cast("date"))
    agg = df.filter(inside).join(members, entity, "left_semi").agg(*[F.avg(c).alias(c) for c in cols])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("avg_value")) for c in cols])).alias("r")).select("r.*")


def prefight_value(df: DataFrame, value: str, entity: str = "entity_id", opponent: str = "opponent_id", date: str = "event_date", contest: str = "contest_id", tasks: int | None = None) -> DataFrame:
    """The opponent's latest non-null value before the contest's date.

    Latest-per-day values are carried forward on the (entity, date) table, then
    looked up by equi-join from the other side of the contest. ``tasks`` sets how many
    tasks share the rows of each step, in place of the session's partition count.
    """

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(tasks, *keys) if tasks else rows

    day = dealt(df, entity, date).groupBy(entity, date).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(contest))).alias("__v"))
    w = Window.partitionBy(entity).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    seen = dealt(day, entity).select(F.col(entity).alias(opponent), date, F.last("__v", ignorenulls=True).over(w).alias(f"opp_prior_{value}"))
    return dealt(df, opponent, date).join(dealt(seen, opponent, date), [opponent, date], "left")


def stratified_sample(df: DataFrame, by: list[str], key: list[str], per_group: int, seed: int = 0) -> DataFrame:
    """``per_group`` rows of each group with the smallest seeded key hashes."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    w = Window.partitionBy(*by).orderBy("__h", *key)
    return df.withColumn("__h", h).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_group).drop("__h", "__r")


def audit(stored: DataFrame, expected: DataFrame, keys: list[str], col: str, tol: float) -> DataFrame:
    """Stored against recomputed values on the sampled keys: difference and pass flag."""
    both = expected.withColumnRenamed(col, "expected").join(stored.select(*keys, F.col(col).alias("stored")), keys, "left")
    gap = F.abs(F.col("stored") - F.col("expected"))
    return both.withColumn("gap", gap).withColumn("ok", F.coalesce(F.col("gap") <= tol, F.lit(False)))


def status_deltas(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Row counts of named tables before and after a refresh; null when a table is missing."""
    parts = []
    for tables, at in ((before, 0), (after, 1)):
        for name, df in tables.items():
            n = F.count(F.lit(1))
            cols = [n if i == at else F.lit(None).cast("bigint") for i in (0, 1)]
            parts.append(df.agg(cols[0].alias("b"), cols[1].alias("a")).withColumn("name", F.lit(name)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    out = both.groupBy("name").agg(F.max("b").alias("rows_before"), F.max("a").alias("rows_after"))
    return out.withColumn("delta", F.col("rows_after") - F.col("rows_before"))
