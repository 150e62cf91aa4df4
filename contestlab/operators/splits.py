"""Chronological splits, folds, weights and scaling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import constants
from . import percentiles as pct
from .ranking import ranked


def chrono_split(df: DataFrame, order: list[str], fractions: list[float], names: list[str]) -> DataFrame:
    """Label rows by position in time: the first ``fractions[0]`` of the rows, and so on; the rest last."""
    rows, n = ranked(df, order, "__r")
    out, total = F.lit(names[-1]), 0.0
    ends = []
    for f in fractions:
        total += f
        ends.append(int(n * total))
    for name, end in reversed(list(zip(names, ends))):
        out = F.when(F.col("__r") <= end, name).otherwise(out)
    return rows.withColumn("split", out).drop("__r")


def time_groups(df: DataFrame, order: list[str], n: int, name: str = "time_group") -> DataFrame:
    """``n`` contiguous groups in time order; the remainder goes to the last."""
    rows, total = ranked(df, order, "__r")
    return rows.withColumn(name, F.least(F.floor((F.col("__r") - 1) / max(total // n, 1)), F.lit(n - 1)).cast("int")).drop("__r")


def holdout_by_date(df: DataFrame, date: str, cutoff: str) -> DataFrame:
    return df.filter(F.col(date) > F.lit(cutoff).cast("date"))


def walk_forward(df: DataFrame, key: str, date: str, initial_years: int, test_years: int = 1, rolling_years: int = 0, gap_days: int = 0, max_folds: int = 10) -> DataFrame:
    """Long (fold, role, key) rows of yearly expanding or rolling folds.

    Fold bounds come from a table of dates per year, which the calendar bounds;
    every row is then placed by comparison, one narrow pass per fold set.
    """
    per_year = {r["y"]: r for r in df.groupBy(F.year(date).alias("y")).agg(F.min(date).alias("lo"), F.max(date).alias("hi")).collect()}
    first, last = min(per_year, default=0), max(per_year, default=-1)
    folds, train_end = [], first + initial_years - 1
    while train_end + test_years <= last and len(folds) < max_folds:
        start = max(first, train_end - rolling_years + 1) if rolling_years else first
        test = [per_year[y] for y in range(train_end + 1, train_end + test_years + 1) if y in per_year]
        train = [per_year[y] for y in range(start, train_end + 1) if y in per_year]
        if test:
            folds.append((start, train_end, min(r["lo"] for r in test), max(r["hi"] for r in test), max((r["hi"] for r in train), default=None)))
        train_end += 1
    if not folds:
        return df.select(F.lit(0).alias("fold"), F.lit("train").alias("role"), key).filter("false")
    y = F.year(date)
    roles = []
    for i, (start, end, lo, hi, train_hi) in enumerate(folds):
        cond = y.between(start, end)
        if gap_days and train_hi is not None and (lo - train_hi).days < gap_days:
            cond = cond & (F.col(date) <= F.date_sub(F.lit(lo), gap_days))
        roles.append(F.struct(F.lit(i).alias("fold"), F.when(cond, "train").when(F.col(date).between(F.lit(lo), F.lit(hi)), "test").alias("role")))
    return df.select(key, F.explode(F.array(*roles)).alias("f")).select(F.col("f.fold").alias("fold"), F.col("f.role").alias("role"), key).filter("role IS NOT NULL")


def nested_folds(df: DataFrame, key: str, date: str, years: list[int], embargo_days: int = 7) -> DataFrame:
    """Long (test_year, role, key): outer test year, embargoed outer train, and the inner split of that train.

    Roles overlap by design: ``train`` holds both ``inner_train`` and ``inner_validation``.
    """
    per_year = {r["y"]: r["lo"] for r in df.groupBy(F.year(date).alias("y")).agg(F.min(date).alias("lo")).collect()}
    d, y = F.col(date), F.year(date)
    roles = []
    for year in years:
        if year not in per_year or year - 1 not in per_year:
            raise ValueError(f"no whole events for outer year {year} or the year before")
        outer = d <= F.date_sub(F.lit(per_year[year]), embargo_days)
        inner = d <= F.date_sub(F.lit(per_year[year - 1]), embargo_days)
        for role, cond in (("test", y == year), ("train", outer), ("inner_validation", outer & (y == year - 1)), ("inner_train", outer & inner)):
            roles.append(F.when(cond, F.struct(F.lit(year).alias("test_year"), F.lit(role).alias("role"))))
    return df.select(key, F.explode(F.array_compact(F.array(*roles))).alias("f")).select("f.test_year", "f.role", key)


def fold_violations(folds: DataFrame, df: DataFrame, key: str, event: str, date: str, embargo_days: int = 7) -> DataFrame:
    """Per test year: keys or events on both sides of a boundary and embargo breaches (all should be 0)."""
    rows = folds.join(df.select(key, event, date), key)
    has = {r: F.max((F.col("role") == r).cast("int")) for r in ("test", "train", "inner_train", "inner_validation")}

    def crossing(on: str):
        per = rows.groupBy("test_year", on).agg(*[c.alias(r) for r, c in has.items()])
        return per.groupBy("test_year").agg(
            F.count_if((F.col("test") + F.col("train")) == 2).alias(f"{on}_outer"),
            F.count_if((F.col("inner_train") + F.col("inner_validation")) == 2).alias(f"{on}_inner"))

    ends = rows.groupBy("test_year").agg(
        *[F.max(F.when(F.col("role") == r, F.col(date))).alias(f"{r}_max") for r in has], *[F.min(F.when(F.col("role") == r, F.col(date))).alias(f"{r}_min") for r in has])
    late = ends.select(
        "test_year", (F.col("train_max") > F.date_sub("test_min", embargo_days)).cast("int").alias("outer_embargo"),
        (F.col("inner_train_max") > F.date_sub("inner_validation_min", embargo_days)).cast("int").alias("inner_embargo"),
        (F.col("inner_validation_max") >= F.col("test_min")).cast("int").alias("inner_reaches_test"))
    return crossing(key).join(crossing(event), "test_year").join(late, "test_year")


def event_split(df: DataFrame, date: str, bounds: dict[str, tuple[str, str]]) -> DataFrame:
    """Partition name by fixed date bounds; a row outside all of them is an error."""
    out = None
    for name, (lo, hi) in bounds.items():
        hit = F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    fail = F.raise_error(F.concat(F.lit("row outside the partition dates: "), F.col(date).cast("string"))).cast("string")
    return df.withColumn("partition", out.otherwise(fail))


def recency_weights(df: DataFrame, date: str, rate: float, name: str = "weight") -> DataFrame:
    """e^(-rate * years before the newest row), scaled to a mean of 1."""
    newest = constants(df.agg(F.max(date).alias("m")))["m"]
    raw = F.exp(-rate * F.datediff(newest, F.col(date)) / 365.25)
    mean = constants(df.agg(F.avg(raw).alias("m")))["m"]
    return df.withColumn(name, raw / mean)


def horizon_weights(
    df: DataFrame, date: str, event: str, as_of: str, scheme: str, horizon_years: int | None = None, rate: float = 0.0,
    rank_cutoffs: list[int] = (), rank_weights: list[float] = (), name: str = "weight",
) -> DataFrame:
    """Training weights: calendar-year horizon, then decay by date or steps by event rank (newest first).

    An event has one date, so its rank class follows from comparing a row's own
    (date, event) with the few boundary events; no join is needed.
    """
    now = F.lit(as_of).cast("date")
    keep = F.lit(True) if horizon_years is None else F.col(date) >= F.add_months(now, -12 * horizon_years)
    if scheme == "exponential":
        w = F.exp(-rate * F.datediff(now, F.col(date)) / 365.25)
        return df.withColumn(name, F.when(keep, w).otherwise(0.0))
    events = df.select(F.col(date).alias("__d"), F.col(event).cast("string").alias("__e")).distinct()
    edges = events.orderBy(F.desc("__d"), F.desc("__e")).limit(max(rank_cutoffs)).collect()
    me = F.struct(F.col(date).alias("__d"), F.col(event).cast("string").alias("__e"))
    w = F.lit(float(rank_weights[len(rank_cutoffs)]))
    for i in reversed(range(len(rank_cutoffs))):
        if len(edges) < rank_cutoffs[i]:
            w = F.lit(float(rank_weights[i]))
            continue
        last = edges[rank_cutoffs[i] - 1]
        w = F.when(me >= F.struct(F.lit(last["__d"]), F.lit(last["__e"])), float(rank_weights[i])).otherwise(w)
    return df.withColumn(name, F.when(keep, w).otherwise(0.0))


def zscore_scale(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Centre and scale by the training mean and population deviation (1 when constant)."""
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return [_scaled(d, {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}) for d in [train, *others]]


def robust_scale(train: DataFrame, others: list[DataFrame], cols: list[str]) -> list[DataFrame]:
    """Centre by the training median and scale by the interquartile range (1 when zero)."""
    row = pct.group_percentiles(train.select(*cols), [], cols, [0.25, 0.5, 0.75]).first()
    return [_scaled(d, {c: (row[f"{c}_p"][1], row[f"{c}_p"][2] - row[f"{c}_p"][0]) for c in cols}) for d in [train, *others]]


def _scaled(df: DataFrame, by: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - m) / (s if s and math.isfinite(s) else 1.0) for c, (m, s) in by.items()})
