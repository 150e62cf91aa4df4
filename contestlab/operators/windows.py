"""Running statistics over an entity's history, safe when one entity is huge.

A plain ``Window.partitionBy(entity)`` puts a whole history into one task.
Here each running value is split in two exact parts:

* the *carry*: everything on earlier dates. Rows are first summed per
  (entity, date) with map-side combining, and the window runs over that day
  table, whose length per entity is bounded by the calendar, not by the data;
* the *inside* part: rows of the same date up to the current one, a window over
  (entity, date).

Both meet in an equi-join on (entity, date), so a hot entity is spread over its
dates. The rows are computed once and cut, as both parts read them.

Every row stays. Nulls of a tie column come first. Rows with a null entity or date have no earlier
dates: they see the rows of their own (entity, date) at most, and values that need a date are null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import once

DAYS_PER_YEAR = 365.25


def _w_days(key: list[str], date: str, upto: int):
    return Window.partitionBy(*key).orderBy(date).rowsBetween(Window.unboundedPreceding, upto)


def _w_inside(key: list[str], date: str, tie: list[str], upto: int):
    return Window.partitionBy(*key, date).orderBy(*tie).rowsBetween(Window.unboundedPreceding, upto)


def years(days: Column) -> Column:
    return days / F.lit(DAYS_PER_YEAR)


def _growth(key: list[str], date: str, rate: float) -> Column:
    """e^(rate * years since the entity's first date), on the day table."""
    since = years(F.datediff(F.col(date), F.min(date).over(Window.partitionBy(*key))))
    return F.when(
        rate * since > 600, F.raise_error(F.lit("half-life too short for the length of this history")).cast("double")
    ).otherwise(F.exp(rate * since))


def running(
    df: DataFrame, key: list[str], date: str, tie: list[str], sums: dict[str, Column],
    include_current: bool = True, maxima: dict[str, Column] | None = None, rates: dict[str, float] | None = None,
) -> DataFrame:
    """Add running sums (and maxima) in (date, tie) order, with or without the current row.

    A sum named in ``rates`` decays: each earlier row weighs e^(-rate * years) at the
    current row's date.
    """
    maxima, rates, df = maxima or {}, rates or {}, once(df)
    upto = 0 if include_current else -1
    day = df.groupBy(*key, date).agg(
        *[F.sum(e).alias(f"__d_{n}") for n, e in sums.items()], *[F.max(e).alias(f"__d_{n}") for n, e in maxima.items()]
    )
    before = _w_days(key, date, -1)
    grow = {r: f"__g{i}" for i, r in enumerate(sorted(set(rates.values())))}
    day = day.withColumns({c: _growth(key, date, r) for r, c in grow.items()}) if grow else day

    def carried(n: str) -> Column:
        if n not in rates:
            return F.sum(f"__d_{n}").over(before)
        g = F.col(grow[rates[n]])
        return F.sum(F.col(f"__d_{n}") * g).over(before) / g

    carry = day.select(
        *key, date, *[carried(n).alias(f"__c_{n}") for n in sums], *[F.max(f"__d_{n}").over(before).alias(f"__c_{n}") for n in maxima])
    w = _w_inside(key, date, tie, upto)
    names = [*sums, *maxima]
    out = df.select("*", *[e.alias(f"__x_{n}") for n, e in {**sums, **maxima}.items()]).join(carry, [*key, date], "left")
    cols = [(F.coalesce(f"__c_{n}", F.lit(0)) + F.coalesce(F.sum(f"__x_{n}").over(w), F.lit(0))).alias(n) for n in sums]
    cols += [F.greatest(F.col(f"__c_{n}"), F.max(f"__x_{n}").over(w)).alias(n) for n in maxima]
    keep = [c for c in df.columns if c not in names]
    return out.select(*keep, *cols)


def running_total(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str]) -> DataFrame:
    """Sum of non-null values so far, current row included."""
    return running(df, key, date, tie, {f"{c}_total": F.coalesce(F.col(c), F.lit(0)) for c in cols})


def running_avg(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str]) -> DataFrame:
    """Mean of non-null values so far, current row included."""
    parts = {}
    for c in cols:
        parts[f"__s_{c}"] = F.col(c)
        parts[f"__n_{c}"] = F.when(F.col(c).isNotNull(), 1).otherwise(0)
    out = running(df, key, date, tie, parts)
    return out.select(*df.columns, *[F.try_divide(F.col(f"__s_{c}"), F.col(f"__n_{c}")).alias(f"{c}_avg") for c in cols])


def contest_no(df: DataFrame, key: list[str], date: str, tie: list[str], name: str = "contest_no", base: int = 1) -> DataFrame:
    """Position of the row in the entity's history, counted from ``base``."""
    out = running(df, key, date, tie, {name: F.lit(1)})
    return out.withColumn(name, (F.col(name) - (1 - base)).cast("bigint"))


def _moments(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str], rate: float) -> DataFrame:
    """Weighted running moments around the first day's mean.

    Per column: ``__v`` weight of non-null rows, ``__a`` and ``__b`` first and second
    moment of the shifted value; ``__w`` weight and ``__n`` count of all rows. Weights
    are relative to any common scale, which every user of these sums divides out.
    """
    df, wkey = once(df), Window.partitionBy(*key).orderBy(date)
    before = _w_days(key, date, -1)
    aggs = [F.count(F.lit(1)).alias("__dn")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"__dc_{c}"), F.avg(x).alias(f"__dm_{c}"), F.var_pop(x).alias(f"__dv_{c}")]
    day = df.groupBy(*key, date).agg(*aggs).withColumn("__g", _growth(key, date, rate) if rate else F.lit(1.0))
    day = day.select("*", *[F.first(f"__dm_{c}", ignorenulls=True).over(
        wkey.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias(f"__o_{c}") for c in cols])
    carry = [F.sum(F.col("__dn") * F.col("__g")).over(before).alias("__cw"), F.sum("__dn").over(before).alias("__cn")]
    for c in cols:
        n, m, v, o = (F.col(f"__{k}_{c}") for k in ("dc", "dm", "dv", "o"))
        shift = m - o
        carry += [
            F.sum(n * F.col("__g")).over(before).alias(f"__cv_{c}"),
            F.sum(n * shift * F.col("__g")).over(before).alias(f"__ca_{c}"),
            F.sum(n * (v + shift * shift) * F.col("__g")).over(before).alias(f"__cb_{c}"),
        ]
    out = df.join(day.select(*key, date, "__g", *[f"__o_{c}" for c in cols], *carry), [*key, date], "left")
    w = _w_inside(key, date, tie, 0)
    zero = F.lit(0.0)
    made = [
        (F.coalesce("__cw", zero) + F.count(F.lit(1)).over(w) * F.col("__g")).alias("__w"),
        (F.coalesce("__cn", F.lit(0)) + F.count(F.lit(1)).over(w)).alias("__n"),
    ]
    for c in cols:
        x = F.col(c).cast("double") - F.col(f"__o_{c}")
        g = F.col("__g")
        made += [
            (F.coalesce(f"__cv_{c}", zero) + F.count(x).over(w) * g).alias(f"__v_{c}"),
            (F.coalesce(f"__ca_{c}", zero) + F.coalesce(F.sum(x).over(w), zero) * g).alias(f"__a_{c}"),
            (F.coalesce(f"__cb_{c}", zero) + F.coalesce(F.sum(x * x).over(w), zero) * g).alias(f"__b_{c}"),
            F.col(f"__o_{c}").alias(f"__shift_{c}"),
        ]
    return out.select(*df.columns, *made)


def running_sdev(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str], first: dict[str, Column] | None = None) -> DataFrame:
    """Sample standard deviation so far. ``first`` gives the value of each history's first row."""
    first = first or {}
    m = _moments(df, cols, key, date, tie, 0.0)
    made = []
    for c in cols:
        n, a, b = F.col(f"__v_{c}"), F.col(f"__a_{c}"), F.col(f"__b_{c}")
        var = F.greatest((b - a * a / n) / (n - 1), F.lit(0.0))
        made.append(
            F.when(F.col("__n") == 1, first.get(c, F.lit(None).cast("double")))
            .when(n >= 2, F.sqrt(var)).otherwise(0.0).alias(f"{c}_sdev")
        )
    return m.select(*df.columns, *made)


def decayed_avg(df: DataFrame, cols: list[str], key: list[str], date: str, half_life_years: float = 2.0) -> DataFrame:
    """Exponentially weighted mean over all rows dated up to the current date (peers count)."""
    df, rate = once(df), math.log(2) / half_life_years
    day = df.groupBy(*key, date).agg(
        *[F.sum(F.col(c).cast("double")).alias(f"__s_{c}") for c in cols], *[F.count(c).alias(f"__k_{c}") for c in cols]
    ).withColumn("__g", _growth(key, date, rate))
    w = _w_days(key, date, 0)
    dec = [
        F.try_divide(F.sum(F.col(f"__s_{c}") * F.col("__g")).over(w), F.sum(F.col(f"__k_{c}") * F.col("__g")).over(w)).alias(f"{c}_dec_avg")
        for c in cols
    ]
    return df.join(day.select(*key, date, *dec), [*key, date], "left")


def decayed_sdev(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str], half_life_years: float = 2.0, first: dict[str, Column] | None = None) -> DataFrame:
    """Square root of the weighted variance so far; the first row takes the debut value or 0.

    The total weight counts rows with a null value too, as the operator is defined.
    """
    first = first or {}
    m = _moments(df, cols, key, date, tie, math.log(2) / half_life_years)
    made = []
    for c in cols:
        w, a, b, o = F.col("__w"), F.col(f"__a_{c}") / F.col("__w"), F.col(f"__b_{c}") / F.col("__w"), F.col(f"__shift_{c}")
        u = F.col(f"__v_{c}") / w
        var = b - a * a + (1 - u) * (2 * o * a + o * o * u)
        seen = F.col(f"__v_{c}") > 0
        made.append(
            F.when(F.col("__n") <= 1, F.coalesce(first.get(c, F.lit(None).cast("double")), F.lit(0.0)))
            .when(seen, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0).alias(f"{c}_dec_sdev")
        )
    return m.select(*df.columns, *made)


def shift_prev(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str], suffix: str = "_prev") -> DataFrame:
    """Value of each column in the entity's previous row (null on the first)."""
    df = once(df)
    body = F.struct(*[F.col(c) for c in cols])
    order = F.struct(*[F.col(c) for c in tie])
    day = df.groupBy(*key, date).agg(F.max_by(body, order).alias("__last"))
    carry = day.select(*key, date, F.lag("__last").over(Window.partitionBy(*key).orderBy(date)).alias("__carry"))
    w = Window.partitionBy(*key, date).orderBy(*tie)
    out = df.join(carry, [*key, date], "left").withColumn("__prev", F.when(F.row_number().over(w) == 1, F.col("__carry")).otherwise(F.lag(body).over(w)))
    return out.select(*df.columns, *[F.col(f"__prev.{c}").alias(f"{c}{suffix}") for c in cols])


def gap_days(df: DataFrame, key: list[str], date: str, tie: list[str], default: int = 120, name: str = "days_since_last") -> DataFrame:
    """Days since the entity's previous row; ``default`` on its first."""
    df = once(df)
    w = Window.partitionBy(*key, date).orderBy(*tie)
    day = df.select(*key, date).distinct()
    carry = day.select(*key, date, F.lag(date).over(Window.partitionBy(*key).orderBy(date)).alias("__pd"))
    out = df.join(carry, [*key, date], "left")
    gap = F.when(F.col(date).isNull(), None).when(F.row_number().over(w) > 1, 0).when(F.col("__pd").isNull(), default).otherwise(F.datediff(F.col(date), F.col("__pd")))
    return out.select(*df.columns, gap.alias(name))


def tenure_years(df: DataFrame, key: list[str], date: str, name: str = "career_age") -> DataFrame:
    """Years since the entity's first date, plain days over 365.25, three decimals."""
    df = once(df)
    day = df.select(*key, date).distinct()  # needs no column or join that was only added to the rows
    first = F.min(date).over(Window.partitionBy(*key))
    made = day.select(*key, date, F.round(years(F.datediff(F.col(date), first)), 3).alias(name))
    return df.join(made, [*key, date], "left")


def mean_step(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str]) -> DataFrame:
    """Average change between consecutive rows so far; 0 on the first row.

    Every step weighs the same: the decay weight of the operator is taken at the
    row's own date and is always 1.
    """
    prev = shift_prev(df, cols, key, date, tie, "__p")
    parts = {}
    for c in cols:
        has = F.col(f"{c}__p").isNotNull()
        parts[f"__s_{c}"] = F.when(has, F.col(c) - F.col(f"{c}__p"))
        parts[f"__k_{c}"] = F.when(has, 1).otherwise(0)
    out = running(prev, key, date, tie, parts)
    return out.select(*df.columns, *[
        F.when(F.col(f"__k_{c}") == 0, 0.0).otherwise(F.col(f"__s_{c}") / F.col(f"__k_{c}")).alias(f"{c}_dec_slope") for c in cols
    ])
