"""Group and global priors: small tables fitted on a training window of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import constants, small_join
from . import percentiles as pct


def between(df: DataFrame, date: str, window: tuple[str, str]) -> DataFrame:
    lo, hi = (F.lit(d).cast("date") for d in window)
    return df.filter(F.col(date).between(lo, hi))


def group_mean(df: DataFrame, cols: list[str], group: str, date: str, window: tuple[str, str], min_n: int = 10) -> DataFrame:
    out = between(df, date, window).groupBy(group).agg(F.count(F.lit(1)).alias("__n"), *[F.avg(c).alias(f"{c}_wc_mean") for c in cols])
    return out.filter(F.col("__n") >= min_n).drop("__n")


def group_mad(df: DataFrame, cols: list[str], group: str, date: str, window: tuple[str, str], min_n: int = 10) -> DataFrame:
    rows = between(df, date, window)
    enough = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= min_n).select(group)
    return pct.group_mad(rows.select(group, *cols), [group], cols, "_wc_mad").join(enough, group, "left_semi")


def mad_floor(df: DataFrame, cols: list[str], group: str, date: str, window: tuple[str, str], q: float = 0.005) -> DataFrame:
    """Low percentile of the positive running MADs; output ``<c>_min_mad``."""
    rows = between(df, date, window).select(group, *[F.when(F.col(f"{c}_mad") > 0, F.col(f"{c}_mad")).alias(c) for c in cols])
    out = pct.group_percentiles(rows, [group], cols, [q])
    return out.select(group, *[F.element_at(f"{c}_p", 1).alias(f"{c}_min_mad") for c in cols])


def sdev_floor(df: DataFrame, cols: list[str], group: str, date: str, window: tuple[str, str], q: float = 0.05) -> DataFrame:
    """Low percentile of the running standard deviations; output ``<c>_min_sdev``."""
    rows = between(df, date, window).select(group, *[F.col(f"{c}_sdev").alias(c) for c in cols])
    out = pct.group_percentiles(rows, [group], cols, [q])
    return out.select(group, *[F.element_at(f"{c}_p", 1).alias(f"{c}_min_sdev") for c in cols])


def debut_rows(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each entity's first row in the given order (a grouped minimum, no per-entity sort)."""
    rest = [c for c in df.columns if c != key]
    first = df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select(key, "__r.*")


def first_event_avg(df: DataFrame, cols: list[str], group: str, date: str, window: tuple[str, str], key: str = "entity_id", event: str = "event_id") -> DataFrame:
    """Mean over all rows of each entity's lowest event id, dated inside the window.

    An entity can have several rows at that event, so sums and counts are kept
    per (entity, event, group) and the lowest event is chosen from those.
    """
    parts = df.groupBy(key, event, group).agg(
        F.min(date).alias("__d"), *[F.sum(c).alias(f"__s_{c}") for c in cols], *[F.count(c).alias(f"__k_{c}") for c in cols]
    )
    least = parts.groupBy(key).agg(F.min(event).alias(event))
    first = between(parts.join(least, [key, event], "left_semi"), "__d", window)
    return first.groupBy(group).agg(
        *[F.try_divide(F.sum(f"__s_{c}"), F.sum(f"__k_{c}")).alias(f"{c}_wc_avg") for c in cols]
    )


def debut_sdev(df: DataFrame, cols: list[str], group: str, date: str, window: tuple[str, str], order: list[str], key: str = "entity_id") -> DataFrame:
    """Sample deviation over first rows inside the window (the window applies before ranking)."""
    first = debut_rows(between(df, date, window).select(key, group, *dict.fromkeys([date, *order, *cols])), key, order)
    return first.groupBy(group).agg(*[F.stddev_samp(c).alias(f"{c}_wc_sdev") for c in cols])


def debut_mad(df: DataFrame, cols: list[str], group: str, date: str, window: tuple[str, str], order: list[str], key: str = "entity_id") -> DataFrame:
    """MAD over first rows of the whole history, kept when dated inside the window."""
    first = between(debut_rows(df.select(key, group, *dict.fromkeys([date, *order, *cols])), key, order), date, window)
    return pct.group_mad(first, [group], cols, "_wc_mad")


def ratio_priors(
    df: DataFrame, specs: dict[str, tuple[Column, Column]], group: str, date: str,
    group_window: tuple[str, str], global_window: tuple[str, str], min_n: int = 10, where: Column | None = None,
) -> DataFrame:
    """Sum of successes over sum of exposures, per group and overall, in one scan.

    ``specs`` maps a name to (numerator, denominator). Rows of the result: one per
    group plus one with a null group and ``level = 'all'``; per name the rate and
    the exposure. Groups under ``min_n`` rows carry null rates.
    """
    rows = df if where is None else df.filter(where)
    lo = [F.lit(w).cast("date") for w in (group_window[0], global_window[0])]
    hi = [F.lit(w).cast("date") for w in (group_window[1], global_window[1])]
    in_group, in_all = (F.col(date).between(lo[i], hi[i]) for i in (0, 1))
    parts = rows.groupBy(group).agg(
        F.count_if(in_group).alias("__n"),
        *[F.sum(F.when(flag, x.cast("double"))).alias(f"__{lv}_{k}_{n}")
          for n, (num, den) in specs.items() for lv, flag in (("g", in_group), ("a", in_all)) for k, x in (("x", num), ("t", den))],
    )

    def rates(lv: str):
        return [c for n in specs for c in (
            F.try_divide(F.col(f"__{lv}_x_{n}"), F.col(f"__{lv}_t_{n}")).alias(f"{n}_rate"), F.col(f"__{lv}_t_{n}").alias(f"{n}_exposure"))]

    per_group = parts.filter(F.col("__n") >= min_n).select(F.lit("group").alias("level"), group, *rates("g"))
    total = parts.agg(*[F.sum(c).alias(c) for c in parts.columns if c.startswith("__a_")]).select(
        F.lit("all").alias("level"), F.lit(None).cast(dict(df.dtypes)[group]).alias(group), *rates("a"))
    return per_group.unionByName(total)


def attach_ratio_priors(df: DataFrame, priors: DataFrame, names: list[str], group: str) -> DataFrame:
    """Put group rates beside each row (``<n>_wc_rate``) and overall rates as literals (``<n>_all_rate``)."""
    per_group = priors.filter("level = 'group'").select(
        group, *[F.col(f"{n}_{k}").alias(f"{n}_wc_{k}") for n in names for k in ("rate", "exposure")])
    overall = constants(priors.filter("level = 'all'").select(*[f"{n}_{k}" for n in names for k in ("rate", "exposure")]))
    out = small_join(df, per_group, [group], "left")
    return out.withColumns({f"{n}_all_{k}": overall[f"{n}_{k}"].cast("double") for n in names for k in ("rate", "exposure")})


def league_average(df: DataFrame, cols: list[str], group: str, date: str, since: str) -> DataFrame:
    """Group mean over all rows since a date, attached to each of those rows."""
    rows = df.filter(F.col(date) >= F.lit(since).cast("date"))
    return small_join(rows, rows.groupBy(group).agg(*[F.avg(c).alias(f"{c}_league") for c in cols]), [group], "inner")


def join_priors(parts: list[DataFrame], group: str) -> DataFrame:
    """Full outer join of prior tables on the group."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, [group], "full_outer")
    return out


def zero_freq(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table (stat, zero_freq, total_rows) from one aggregate over all columns."""
    agg = df.agg(*[F.coalesce(F.avg(F.when(F.col(c) == 0, 1.0).when(F.col(c).isNotNull(), 0.0)), F.lit(0.0)).alias(f"__z_{c}") for c in cols],
                 *[F.count(c).alias(f"__n_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(f"__z_{c}").alias("zero_freq"), F.col(f"__n_{c}").alias("total_rows")) for c in cols])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def global_averages(df: DataFrame, cols: list[str], exclude_zeros: bool = False) -> DataFrame:
    """Long table (stat, avg_value) of plain means, optionally without zeros; 0 when nothing is left."""
    agg = df.agg(*[F.coalesce(F.avg(F.when(F.col(c) != 0, F.col(c)) if exclude_zeros else F.col(c)), F.lit(0.0)).alias(c) for c in cols])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("avg_value")) for c in cols])).alias("r")).select("r.*")


def zero_inflated_beta(df: DataFrame, successes: Column, attempts: Column, group: str) -> DataFrame:
    """Per group: alpha and beta from the mean ratio, strength 1 + 59 * share of zeros."""
    rows = df.select(group, successes.alias("x"), attempts.alias("t")).filter("t > 0")
    per = rows.groupBy(group).agg(F.avg(F.col("x") / F.col("t")).alias("m"), F.avg(F.when(F.col("x") == 0, 1.0).otherwise(0.0)).alias("z"))
    s = 1.0 + 59.0 * F.col("z")
    return per.select(
        group, F.when(F.col("m") > 0, F.col("m") * s).otherwise(0.1).alias("alpha"),
        F.when(F.col("m") < 1, (1 - F.col("m")) * s).otherwise(0.1).alias("beta"),
    )


def gamma_rate(df: DataFrame, count: str, seconds: str, group: str) -> DataFrame:
    """Per group Gamma prior of the per-minute rate; the strength falls with log volume, kept in 1..60."""
    per = df.filter(F.col(seconds).isNotNull()).groupBy(group).agg(
        F.coalesce(F.avg(F.when(F.col(seconds) > 0, F.col(count) / F.col(seconds))), F.lit(0.0)).alias("r"),
        F.avg(F.when(F.col(count) == 0, 1.0).otherwise(0.0)).alias("z"), F.coalesce(F.avg(count), F.lit(0.0)).alias("m"),
    )
    s = F.greatest(F.lit(1.0), F.least(F.lit(60.0), (1.0 + 59.0 * F.col("z")) / (1.0 + F.log1p("m"))))
    return per.select(group, (F.col("r") * 60 * s).alias("alpha"), s.alias("beta"))


# Fixed values of the accuracy prior: base weight, additions by share of zeros, volume exponents, smoothing.
ACCURACY_WEIGHT = 0.70
ACCURACY_CAP = 2.0
ACCURACY_SMOOTH, ACCURACY_SMOOTH_BUSY = 0.07, 0.03


def accuracy_prior(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Per family (name -> land, att columns): mean accuracy, zero share, volume, then alpha and beta.

    The prior weight grows with the share of zeros and falls with a root of the
    attempt volume. It does not depend on the family's name.
    """
    aggs = []
    for n, (land, att) in pairs.items():
        has = F.col(att).isNotNull()
        aggs += [
            F.avg(F.when(F.col(att) > 0, F.col(land) / F.col(att))).alias(f"acc_{n}"),
            F.avg(F.when(has, F.when(F.col(land) == 0, 1.0).otherwise(0.0))).alias(f"zero_{n}"),
            F.avg(F.when(F.col(att) > 0, F.col(att))).alias(f"att_{n}"),
            F.avg(F.when(has, F.col(land))).alias(f"land_{n}"),
        ]
    keys = ("acc", "zero", "att", "land")
    rows = F.array(*[F.struct(F.lit(n).alias("stat"), *[F.col(f"{k}_{n}").alias(k) for k in keys]) for n in pairs])
    long = df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
    long = long.select(
        "stat", F.coalesce("acc", F.lit(0.5)).alias("acc"), F.coalesce("zero", F.lit(0.0)).alias("zero"),
        F.greatest(F.coalesce("att", F.lit(0.1)), F.lit(0.1)).alias("att"), F.coalesce("land", F.lit(0.0)).alias("land"))
    acc, zero, att, land = (F.col(k) for k in keys)
    scarce = (land < 0.2) & (zero > 0.8)
    busy = att > 50
    bonus = F.when(scarce & (zero > 0.9), 0.2).when(zero > 0.8, 0.15).when(zero > 0.5, 0.1).when(zero > 0.3, 0.05).otherwise(0.0)
    exponent = (
        F.when(scarce, 1 / 2).when((land < 1.0) | (zero > 0.5) | ((acc > 0.75) & (land > 5)), 1 / 3)
        .when(busy, F.when(acc < 0.40, 1 / 8).otherwise(1 / 6)).when(land > 5, 1 / 5).otherwise(1 / 4)
    )
    k = (ACCURACY_WEIGHT + bonus) * F.when(att < 3, 0.5).otherwise(1.0)
    weight = F.least(F.lit(ACCURACY_CAP), k / F.pow(att, exponent))
    s = F.when(busy, ACCURACY_SMOOTH_BUSY).otherwise(ACCURACY_SMOOTH)
    return long.withColumns({"alpha": weight * acc + s, "beta": weight * (1 - acc) + s})


def asof_snapshots(df: DataFrame, pairs: dict[str, tuple[str, str]], group: str, date: str, first: str, last: str, window_days: int = 730) -> DataFrame:
    """Per group and yearly snapshot date: accuracy priors over the rows of the preceding window.

    Every row is sent to the few snapshots that see it, then one grouped
    aggregate does the rest; there is no range join.
    """
    month_day = F.lit(first[4:])
    lo, hi = int(first[:4]), int(last[:4])
    years = F.sequence(F.year(date), F.year(date) + (window_days // 365 + 1))
    snaps = F.transform(years, lambda y: F.to_date(F.concat(y.cast("string"), month_day)))
    seen = F.filter(snaps, lambda s: (s > F.col(date)) & (F.datediff(s, F.col(date)) <= window_days) & F.year(s).between(lo, hi) & (s <= F.lit(last).cast("date")))
    rows = df.withColumn("snapshot_date", F.explode(seen))
    aggs = []
    for n, (land, att) in pairs.items():
        aggs += [
            F.avg(F.when(F.col(att) > 0, F.col(land) / F.col(att))).alias(f"{n}_global_acc"),
            F.avg(F.when(F.col(land) == 0, 1.0).otherwise(0.0)).alias(f"{n}_zero_land_freq"),
            F.count(F.lit(1)).alias(f"{n}_total_rows"),
        ]
    out = rows.groupBy(group, "snapshot_date").agg(*aggs)
    made = {"valid_until": F.to_date(F.add_months("snapshot_date", 12))}
    for n in pairs:
        made[f"{n}_alpha"] = F.col(f"{n}_global_acc") * 10 + 1
        made[f"{n}_beta"] = (1 - F.col(f"{n}_global_acc")) * 10 + 1
    return out.withColumns(made)


def pick_snapshot(df: DataFrame, snapshots: DataFrame, group: str, date: str, month_day: str = "-01-01") -> DataFrame:
    """The snapshot valid at each row's date: the latest one on or before it, at most a year old.

    Snapshots lie one year apart, so the pick is an equi-join on the computed date.
    """
    this_year = F.to_date(F.concat(F.year(date).cast("string"), F.lit(month_day)))
    at = F.when(this_year <= F.col(date), this_year).otherwise(F.add_months(this_year, -12))
    return small_join(df.withColumn("snapshot_date", at), snapshots, [group, "snapshot_date"], "left")
