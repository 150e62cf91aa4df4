"""Global order without a single-task window.

Rows are range-partitioned by the whole order key, so the number of pieces is that of the
session's shuffles and grows with the cluster's settings. Sizes per piece give exact offsets; the
order inside a piece is a window over that piece. The placed rows are checkpointed, since range
bounds are sampled anew whenever a plan runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def placed(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` with ``__b``, the number of its range piece; ``parts`` pieces, or as many as shuffles have."""
    ranges = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    return cut(ranges.withColumn("__b", F.spark_partition_id()))


def ranked(df: DataFrame, order: list[str], name: str = "rank", parts: int | None = None) -> tuple[DataFrame, int]:
    """Number the rows 1.. in the given ascending order, which should be unique; also the row count."""
    rows = placed(df, order, parts)
    sizes = {r["__b"]: r["count"] for r in rows.groupBy("__b").count().collect()}  # one row a piece
    before, total = [(-1, 0)], 0
    for b in sorted(sizes):
        before.append((b, total))
        total += sizes[b]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__b int, __before bigint"))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return rows.join(offsets, "__b").withColumn(name, rank.cast("bigint")).drop("__b", "__before"), total


def global_rank(df: DataFrame, order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    return ranked(df, order, name, parts)[0]


def cumulate(dist: DataFrame, keys: list[str], value: str, sums: list[str]) -> DataFrame:
    """Add ``<s>_before`` (sum over smaller values) and ``<s>_all`` per key to a table of distinct values.

    ``dist`` has one row per (keys, value), so ties are already merged.
    """
    rows = placed(dist, [*keys, value])
    upto = Window.partitionBy(*keys, F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, F.lit(0))
    per = rows.groupBy(*keys, "__b").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    per = per.select(
        *keys, "__b", *[F.coalesce(F.sum(f"__t_{s}").over(upto), F.lit(0)).alias(f"__o_{s}") for s in sums],
        *[F.sum(f"__t_{s}").over(whole).alias(f"{s}_all") for s in sums],
    )
    w = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(per, [*keys, "__b"])
    return out.withColumns({f"{s}_before": F.col(f"__o_{s}") + F.coalesce(F.sum(s).over(w), F.lit(0)) for s in sums}).drop(
        "__b", *[f"__o_{s}" for s in sums])


def avg_rank01(df: DataFrame, keys: list[str], value: str, name: str = "rank01") -> DataFrame:
    """Average rank (ties shared) per key, scaled to 0..1; a single row gives 0.5."""
    dist = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    cum = cumulate(dist, keys, value, ["__n"])
    scaled = (F.col("__n_before") + (F.col("__n") - 1) / 2) / (F.col("__n_all") - 1)
    ranks = cum.select(*keys, value, F.when(F.col("__n_all") == 1, 0.5).otherwise(scaled).alias(name))
    return df.join(ranks, [*keys, value])
