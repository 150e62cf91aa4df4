"""Entity states: one mergeable row per entity, from which scheduled contests are scored without its history.

A state holds counts, sums, exponentially weighted sums and the latest values. Weights grow from a fixed
anchor date, so states of any two sets of rows add up, and a weighted mean needs no rescaling: the
factor of the scoring date cancels. New contests are folded in by building their state and merging.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import years

PARTS = ("n", "sum", "weight", "weighted")
MOST_GROWTH = 600.0


def entity_states(history: DataFrame, stats: list[str], latest: list[str], rate: float, anchor: str, entity: str = "entity_id", contest: str = "contest_id", date: str = "event_date") -> DataFrame:
    """(entity, rows, first_date, last_date, per stat PARTS, latest struct of (date, contest, values)).

    ``stats`` are averaged, ``latest`` are kept from the newest row (by date, then contest). Rows are
    unique by (entity, contest); null values of a stat do not count; rows without a date are left out.
    """
    since = rate * years(F.datediff(F.col(date), F.lit(anchor).cast("date")))
    w = F.when(F.abs(since) > MOST_GROWTH, F.raise_error(F.lit("dates too far from the anchor for this rate")).cast("double")).otherwise(F.exp(since))
    rows = history.filter(F.col(date).isNotNull()).withColumn("__w", w)
    made = []
    for s in stats:
        x, has = F.col(s).cast("double"), F.col(s).isNotNull()
        values = (F.count(s), F.sum(x), F.sum(F.when(has, F.col("__w"))), F.sum(x * F.col("__w")))
        made += [F.coalesce(v, F.lit(0)).alias(f"{s}_{p}") for v, p in zip(values, PARTS)]
    newest = F.max(F.struct(F.col(date).alias("date"), F.col(contest).alias("contest"), *[F.col(c).alias(c) for c in latest]))
    return rows.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *made, newest.alias("latest"))


def merge_states(states: list[DataFrame], entity: str = "entity_id") -> DataFrame:
    """The states of all rows that stand behind several state tables with the same stats, rate and anchor."""
    both = reduce(DataFrame.unionByName, states)
    sums = [c for c in both.columns if c not in (entity, "first_date", "last_date", "latest")]
    return both.groupBy(entity).agg(*[F.sum(c).alias(c) for c in sums], F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.max("latest").alias("latest")).select(*states[0].columns)


def scored_pairs(
    states: DataFrame, schedule: DataFrame, static: list[str], dynamic: list[str], *, entity: str = "entity_id", ids: tuple[str, str] = ("entity1_id", "entity2_id"),
    date: str = "event_date", dob: str = "dob", least_rows: int = 2,
) -> tuple[DataFrame, list[str]]:
    """``schedule`` with ``<feature>_1`` and ``<feature>_2`` of both sides, and the names of the features.

    Age, days since the last contest and tenure are those of the scheduled date; other static
    values are the latest known. Each has a share of both sides' sum, an average with the new value, and a decayed
    average without it; dynamic values are the latest. Contests of an entity with fewer than
    ``least_rows`` rows are left out, and a state with rows from the scheduled date on is an error.
    """
    out = schedule
    for no, key in enumerate(ids, 1):
        out = out.join(states.select(F.col(entity).alias(key), F.struct(*[c for c in states.columns if c != entity]).alias(f"__{no}")), key)
    out = out.filter(" AND ".join(f"__{no}.rows >= {least_rows}" for no in (1, 2)))
    late = (F.col("__1.last_date") >= F.col(date)) | (F.col("__2.last_date") >= F.col(date))
    out = out.withColumn("__1", F.when(late, F.raise_error(F.lit("a state is newer than the scheduled contest")).cast(out.schema["__1"].dataType)).otherwise(F.col("__1")))
    now = {no: {s: _now(s, f"__{no}", date, dob) for s in static} for no in (1, 2)}
    out = out.withColumns({f"{s}_{no}": now[no][s] for no in now for s in static})
    share = {f"{s}_ratio_{no}": F.try_divide(F.col(f"{s}_{no}"), F.col(f"{s}_1") + F.col(f"{s}_2")) for s in static for no in (1, 2)}
    out = out.withColumns(share)
    averaged = [*static, *[f"{s}_ratio" for s in static]]
    means = {}
    for no in (1, 2):
        for s in averaged:
            new, n, total = F.col(f"{s}_{no}"), F.col(f"__{no}.{s}_n"), F.col(f"__{no}.{s}_sum")
            means[f"{s}_avg_{no}"] = F.try_divide(total + F.coalesce(new, F.lit(0.0)), n + F.when(new.isNotNull(), 1).otherwise(0))
            means[f"{s}_dec_avg_{no}"] = F.try_divide(F.col(f"__{no}.{s}_weighted"), F.col(f"__{no}.{s}_weight"))
        means |= {f"{c}_{no}": F.col(f"__{no}.latest.{c}") for c in dynamic}
        means[f"total_{no}"] = F.col(f"__{no}.rows")
    names = [*averaged, *[f"{s}_avg" for s in averaged], *[f"{s}_dec_avg" for s in averaged], *dynamic]
    return out.withColumns(means).drop("__1", "__2"), names


def _now(stat: str, state: str, date: str, dob: str) -> Column:
    """The value of a static stat on the scheduled date."""
    latest, when = F.col(f"{state}.latest"), F.col(date)
    tenth = lambda since: F.round(years(F.datediff(when, since)), 3)
    if stat == "age":
        return F.coalesce(tenth(latest[dob]), latest[stat].cast("double"))
    if stat == "days_since_last":
        return F.datediff(when, F.col(f"{state}.last_date")).cast("double")
    if stat == "career_age":
        return tenth(F.col(f"{state}.first_date"))
    return latest[stat].cast("double")
