"""Helpers shared by the operators: typed inputs, rows keyed null-safely, scratch tables, global offsets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, scratch

#: Stands for a null id where rows are keyed: a null counts as the smallest id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id bigint, text string never null). All other columns go, so none can clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def set_ids(df: DataFrame) -> DataFrame:
    """Null ids as a number on the way into Python, where a null would turn ids into floats."""
    return df.withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))


def null_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NULL_ID)))


def row_key() -> list[Column]:
    """Identity of a row for joins: rows with equal id and equal text are one and the same."""
    return [F.coalesce("doc_id", F.lit(NULL_ID)).alias("rid"), F.xxhash64("text").alias("rth")]


def written(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write to a new table in the shared folder and read it again; cuts lineage, and columns stay compressed."""
    path = scratch(df.sparkSession, label)
    df.write.options(compression="zstd", **(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``fn`` over pandas batches of a partition, none kept longer than its turn."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield fn(b)

    return df.mapInPandas(run, schema)


def with_offsets(df: DataFrame, order: list[str], sums: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Add ``<s>_before``, the sum of ``s`` over all rows before this one in the given order.

    Rows are range-partitioned by the order and written; each partition's totals (one row a
    partition, so bounded by the number of partitions) give the offsets, and a window inside the
    partition gives the rest. Also returns the totals. Rows equal in the whole order are
    interchangeable.
    """
    spark = df.sparkSession
    rows = cut(cut(df).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    totals = {r[0]: r[1:] for r in rows.groupBy("__part").agg(*[F.sum(s) for s in sums]).collect()}
    offsets, upto = [], [0] * len(sums)
    for part in sorted(totals):
        offsets.append((part, *upto))
        upto = [a + b for a, b in zip(upto, totals[part])]
    names = [f"__off_{s}" for s in sums]
    small = spark.createDataFrame(offsets, "__part int, " + ", ".join(f"{n} bigint" for n in names))
    before = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(F.broadcast(small), "__part")
    out = out.withColumns({f"{s}_before": F.col(n) + F.coalesce(F.sum(s).over(before), F.lit(0)) for s, n in zip(sums, names)})
    return out.drop("__part", *names), dict(zip(sums, upto))
