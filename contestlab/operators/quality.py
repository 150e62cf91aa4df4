"""Distribution reports: sparsity, quality tiers, percentiles, outcome counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_join
from . import percentiles as pct

# Quality thresholds, clip limits and reliability by tier.
MAD_DEGENERATE, MAD_SPARSE, MODE_DEGENERATE = 0.010, 0.030, 0.45
LIMIT_DEGENERATE, LIMIT_SPARSE, LIMIT_HEALTHY = 2.5, (3.0, 5.0), 7.0
RELIABILITY = {"degenerate": 0.3, "sparse": 0.6, "healthy": 1.0}


def outcome_counts(df: DataFrame, result: str) -> DataFrame:
    r = F.col(result)
    out = df.agg(
        F.count_if(r == 1).alias("wins"), F.count_if(r == 0).alias("losses"), F.count_if(r.isin(0, 1)).alias("decisive"),
        F.count_if(r.isin(2, 3)).alias("undecided"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("win_rate", F.coalesce(F.try_divide(F.col("wins"), F.col("decisive")), F.lit(0.0)))


def sparsity_profile(df: DataFrame, land: str, att: str, keys: list[str]) -> DataFrame:
    """How often a rate is measurable, and its spread when it is."""
    rows = df.filter(F.col(att).isNotNull()).select(*keys, att, F.when(F.col(att) > 0, F.col(land) / F.col(att)).alias("rate"))
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col(att) == 0).alias("zero_attempt"), F.count_if(F.col(att) > 0).alias("measurable"),
        F.avg("rate").alias("mean"), F.stddev_samp("rate").alias("sdev"))
    distinct = rows.filter("rate IS NOT NULL").select(*keys, "rate").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_values"))
    med = pct.group_median(rows, keys, ["rate"]).withColumnRenamed("rate_median", "median")
    out = small_join(small_join(base, med, keys), distinct, keys)
    return out.withColumn("n_values", F.coalesce("n_values", F.lit(0)))


def tier(mad: Column, mode_frequency: Column) -> Column:
    return F.when((mad < MAD_DEGENERATE) | (mode_frequency > MODE_DEGENERATE), "degenerate").when(mad < MAD_SPARSE, "sparse").otherwise("healthy")


def winsor_limit(quality_tier: Column, mad: Column) -> Column:
    lo, hi = LIMIT_SPARSE
    return F.when(quality_tier == "degenerate", LIMIT_DEGENERATE).when(
        quality_tier == "sparse", lo + mad / MAD_SPARSE * (hi - lo)).otherwise(LIMIT_HEALTHY)


def to_long(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, stat, value) rows with null values left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").filter("value IS NOT NULL")


def stat_quality(df: DataFrame, stats: list[str], group: str) -> DataFrame:
    """One row per (stat, group): distinct values, percentiles, MAD, mode, tier, clip limit, reliability.

    Works on counts per distinct value, so ties cost nothing after the first
    aggregate; the smallest of several modes is taken.
    """
    gk = ["stat", group]
    long = cut(to_long(df, [group], stats))
    counts = long.groupBy(*gk, "value").agg(F.count(F.lit(1)).alias("n"))
    ps = pct.group_percentiles(long, gk, ["value"], [0.5, 0.05, 0.95])
    ps = ps.select(*gk, *[F.element_at("value_p", i + 1).alias(c) for i, c in enumerate(["median_val", "p05", "p95"])])
    mode = counts.groupBy(*gk).agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode_value"), F.count(F.lit(1)).alias("unique_values"),
        F.sum("n").alias("total_values"))
    seen = small_join(small_join(counts, ps, gk, "inner"), mode, gk, "inner")
    near = seen.groupBy(*gk).agg(
        F.sum(F.when(F.abs(F.col("value") - F.col("median_val")) < 0.001, F.col("n")).otherwise(0)).alias("__at"),
        F.sum(F.when(F.abs(F.col("value") - F.col("mode_value")) < 0.0001, F.col("n")).otherwise(0)).alias("__md"))
    mad = pct.group_mad(long, gk, ["value"]).withColumnRenamed("value_mad", "mad")
    out = small_join(small_join(small_join(mode, ps, gk), near, gk), mad, gk)
    out = out.select(
        *gk, "unique_values", "total_values", "median_val", "p05", "p95", "mad", (F.col("__at") / F.col("total_values")).alias("pct_at_median"),
        "mode_value", (F.col("__md") / F.col("total_values")).alias("mode_frequency"))
    t = tier(F.col("mad"), F.col("mode_frequency"))
    rel = F.when(F.col("quality_tier") == "degenerate", RELIABILITY["degenerate"]).when(F.col("quality_tier") == "sparse", RELIABILITY["sparse"]).otherwise(RELIABILITY["healthy"])
    out = out.withColumn("quality_tier", t).withColumn("winsor_limit", winsor_limit(F.col("quality_tier"), F.col("mad"))).withColumn("reliability", rel)
    return out.withColumn("effective_n", F.floor(F.col("unique_values") * F.col("reliability")))


def mad_percentiles(df: DataFrame, col: str, points: list[int]) -> DataFrame:
    """One row of percentiles over the positive values."""
    out = pct.group_percentiles(df.filter(F.col(col) > 0).select(col), [], [col], [p / 100 for p in points])
    return out.select(*[F.element_at(f"{col}_p", i + 1).alias(f"p{p}") for i, p in enumerate(points)])


def clipped_share(df: DataFrame, cols: list[str], limit: float) -> DataFrame:
    """Share of scores at or beyond the clip limit, per column."""
    agg = df.agg(*[F.avg((F.abs(F.col(c)) >= limit).cast("double")).alias(c) for c in cols])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).alias("clipped")) for c in cols])).alias("r")).select("r.*")
