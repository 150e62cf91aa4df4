"""Exact percentiles per group that stay bounded when a group is huge.

Spark's exact ``percentile`` keeps a count per distinct value of a group in one
task. That is used while the (approximately counted) number of distinct values
allows it. Beyond the bound the values are first reduced to counts, split into
value buckets by approximate quantiles, and only the buckets holding a wanted
rank are sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small_join

MAX_DISTINCT = 1_000_000
BUCKETS = 512


def _max_distinct(df: DataFrame, keys: list[str], cols: list[str]) -> int:
    per = df.groupBy(*keys).agg(*[F.approx_count_distinct(c, 0.05).alias(c) for c in cols])
    row = per.agg(F.max(F.greatest(*[F.col(c) for c in cols])) if len(cols) > 1 else F.max(cols[0])).first()
    return row[0] or 0


def in_bucket(df: DataFrame, splits: str, value: str, name: str, most: int) -> DataFrame:
    """Add ``name``: how many of the ascending ``splits``, fewer than ``most``, lie below the value.

    Halving steps, a column each, in place of a look at every split.
    """
    out, step = df.withColumn(name, F.lit(0)), 1 << (most - 1).bit_length()
    while step > 1:
        step //= 2
        at = F.get(splits, F.col(name) + (step - 1))
        out = out.withColumn(name, F.col(name) + F.when(at < F.col(value), step).otherwise(0))
    return out


def group_percentiles(
    df: DataFrame, keys: list[str], cols: list[str], qs: list[float], max_distinct: int = MAX_DISTINCT,
) -> DataFrame:
    """Keys plus, per column, the array ``<c>_p`` of interpolated percentiles (nulls ignored)."""
    probe = keys or ["__all"]
    base = df if keys else df.withColumn("__all", F.lit(1))
    base = base if getattr(base, "is_cut", False) else cut(base.select(*probe, *cols))  # read several times
    if _max_distinct(base, probe, cols) <= max_distinct:
        out = base.groupBy(*probe).agg(*[F.percentile(F.col(c).cast("double"), qs).alias(f"{c}_p") for c in cols])
    else:
        out = _by_buckets(base, probe, cols, qs)
    return out if keys else out.drop("__all")


def _by_buckets(df: DataFrame, keys: list[str], cols: list[str], qs: list[float]) -> DataFrame:
    long = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.col(c).cast("double").alias("value")) for c in cols])).alias("v")
    ).select(*keys, "v.*")
    gk = [*keys, "stat"]
    counts = cut(long.filter("value IS NOT NULL").groupBy(*gk, "value").agg(F.count(F.lit(1)).alias("n")))
    cuts = [i / BUCKETS for i in range(1, BUCKETS)]
    shape = counts.groupBy(*gk).agg(F.percentile_approx("value", cuts, 20 * BUCKETS).alias("splits"), F.sum("n").alias("total"))
    placed = in_bucket(small_join(counts, shape.drop("total"), gk, "inner"), "splits", "value", "bucket", BUCKETS).select(*gk, "value", "n", "bucket")
    upto = Window.partitionBy(*gk).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(*gk, "bucket").agg(F.sum("n").alias("bn"))
    ranges = totals.select(*gk, "bucket", (F.sum("bn").over(upto) - F.col("bn")).alias("lo"), F.sum("bn").over(upto).alias("hi"))
    pos = F.col("q") * (F.col("total") - 1)
    ranks = shape.select(*gk, "total", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("qi", "q"))
    ranks = ranks.select(*gk, "qi", (pos - F.floor(pos)).alias("frac"), F.explode(F.array(F.floor(pos), F.ceil(pos))).alias("k")).distinct()
    wanted = ranks.join(ranges, gk).filter("lo <= k AND k < hi")
    w = Window.partitionBy(*gk, "bucket", "qi", "k").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        placed.join(wanted, [*gk, "bucket"])
        .withColumn("end", F.col("lo") + F.sum("n").over(w))
        .filter("end - n <= k AND k < end")
    )
    per_q = hits.groupBy(*gk, "qi").agg(
        F.min_by("value", "k").alias("v0"), F.max_by("value", "k").alias("v1"), F.max("frac").alias("frac")
    )
    vals = per_q.groupBy(*gk).agg(F.sort_array(F.collect_list(F.struct("qi", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac")).alias("v")))).alias("ps"))
    wide = vals.groupBy(*keys).agg(*[F.max(F.when(F.col("stat") == c, F.col("ps.v"))).alias(f"{c}_p") for c in cols])
    return df.select(*keys).distinct().join(wide, keys, "left")


def group_median(df: DataFrame, keys: list[str], cols: list[str], suffix: str = "_median", **kw) -> DataFrame:
    out = group_percentiles(df, keys, cols, [0.5], **kw)
    return out.select(*keys, *[F.element_at(f"{c}_p", 1).alias(f"{c}{suffix}") for c in cols])


def group_mad(df: DataFrame, keys: list[str], cols: list[str], suffix: str = "_mad", **kw) -> DataFrame:
    """Median absolute deviation from the group's own median."""
    df = cut(df.select(*keys, *cols))
    med = group_median(df, keys, cols, "__med", **kw)
    dev = small_join(df, med, keys, "inner").select(*keys, *[F.abs(F.col(c) - F.col(f"{c}__med")).alias(c) for c in cols])
    return group_median(dev, keys, cols, suffix, **kw)
