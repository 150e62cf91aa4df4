"""Isotonic regression over range pieces: pools of adjacent violators, merged until no neighbour falls.

Distinct points stand in order of x, cut into pieces of neighbours. Each piece pools its own
violators on a stack of blocks. Where the last block of a piece lies above the first of the next one,
pieces are cut anew over the blocks that are left, half a piece further, so that the two meet within
one piece. A round without such a fall is the fit: blocks that rise everywhere, each the mean of its points. No
task holds more than a piece, and the driver sees only a count.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import ranking

#: Blocks in one piece.
PIECE = 1 << 16


def _pooled(block: list[tuple[float, float, float, float]]) -> list[list[float]]:
    """(lo, hi, weight, sum) blocks in order of lo, merged with the block before them while that one is not lower."""
    stack: list[list[float]] = []
    for lo, hi, w, s in block:
        while stack and stack[-1][3] * w >= s * stack[-1][2]:
            lo, _, w0, s0 = stack.pop()
            w, s = w + w0, s + s0
        stack.append([lo, hi, w, s])
    return stack


def isotonic_blocks(points: DataFrame, keys: list[str] = (), x: str = "p", weight: str = "w", total: str = "s", piece: int = PIECE) -> DataFrame:
    """(keys, lo, hi, value, w): the rising blocks per key of distinct points with weights and weighted sums of the target.

    Points with a null x or without weight are left out; an empty table has no blocks.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    fields = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["lo double", "hi double", "w double", "s double", "__piece bigint"])
    number = lambda c: F.col(c).cast("double")
    blocks = points.filter(F.col(x).isNotNull() & (F.col(weight) > 0)).select(*keys, number(x).alias("lo"), number(x).alias("hi"), number(weight).alias("w"), number(total).alias("s"))

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("lo"), []
        for key, group in pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]:
            merged = pd.DataFrame(_pooled(list(zip(group["lo"], group["hi"], group["w"], group["s"]))), columns=["lo", "hi", "w", "s"])
            for name, value in zip(keys, key):
                merged[name] = value
            out.append(merged)
        return pd.concat(out).assign(__piece=pdf["__piece"].iloc[0])[[*keys, "lo", "hi", "w", "s", "__piece"]]

    shift = 0
    while True:
        placed, count = ranking.ranked(blocks, [*keys, "lo"], "__rank")
        placed = placed.withColumn("__piece", F.floor((F.col("__rank") - 1 + shift) / piece).cast("bigint")).drop("__rank")
        blocks = stored(placed.groupBy("__piece").applyInPandas(pool, fields), "blocks")
        if count + shift <= piece or not _falls(blocks, keys):
            return blocks.select(*keys, "lo", "hi", (F.col("s") / F.col("w")).alias("value"), "w")
        blocks, shift = blocks.drop("__piece"), piece // 2 - shift


def _falls(blocks: DataFrame, keys: list[str]) -> bool:
    """Whether a piece's last block is not below the next piece's first one; one row a piece is compared."""
    ends = blocks.groupBy(*keys, "__piece").agg(F.min_by(F.struct("w", "s"), "lo").alias("first"), F.max_by(F.struct("w", "s"), "lo").alias("last"))
    before = F.lag("last").over(Window.partitionBy(*keys, F.lit(0)).orderBy("__piece"))
    ends = ends.withColumn("before", before)
    return not ends.filter(F.col("before.s") * F.col("first.w") >= F.col("first.s") * F.col("before.w")).isEmpty()


def interpolated(rows: DataFrame, blocks: DataFrame, keys: list[str] = (), x: str = "p", name: str = "value") -> DataFrame:
    """Distinct (keys, x) of ``rows`` with the fitted value: that of the block, a straight line between blocks, the end values outside.

    Rows and blocks are put in one order over range pieces; the nearest block on either side comes from
    the piece, or from the pieces before and after it.
    """
    keys = list(keys)
    block = F.struct("lo", "hi", "value")
    asked = rows.select(*keys, F.col(x).cast("double").alias("__x")).filter("__x IS NOT NULL").distinct()
    both = blocks.select(*keys, F.col("lo").alias("__x"), F.lit(0).alias("__asked"), block.alias("b")).unionByName(asked.withColumns({"__asked": F.lit(1), "b": F.lit(None).cast("struct<lo:double,hi:double,value:double>")}))
    both = ranking.placed(both, [*keys, "__x", "__asked"])
    per = both.groupBy(*keys, "__b").agg(F.max_by("b", F.when(F.col("__asked") == 0, F.col("__x"))).alias("last"), F.min_by("b", F.when(F.col("__asked") == 0, F.col("__x"))).alias("first"))
    pieces = Window.partitionBy(*keys, F.lit(0)).orderBy("__b")
    per = per.select(
        *keys, "__b", F.last("last", ignorenulls=True).over(pieces.rowsBetween(Window.unboundedPreceding, -1)).alias("__left"),
        F.first("first", ignorenulls=True).over(pieces.rowsBetween(1, Window.unboundedFollowing)).alias("__right"))
    inside = Window.partitionBy(*keys, "__b").orderBy("__x", "__asked")
    left = F.last("b", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first("b", ignorenulls=True).over(inside.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"__l": left, "__r": right}).filter("__asked = 1").join(per, [*keys, "__b"])
    out = out.withColumns({"__l": F.coalesce("__l", "__left"), "__r": F.coalesce("__r", "__right")})
    return out.select(*keys, F.col("__x").alias(x), _between(F.col("__x"), F.col("__l"), F.col("__r")).alias(name))


def _between(x: Column, left: Column, right: Column) -> Column:
    line = left["value"] + (right["value"] - left["value"]) * (x - left["hi"]) / (right["lo"] - left["hi"])
    return F.when(left.isNull(), right["value"]).when((x <= left["hi"]) | right.isNull(), left["value"]).otherwise(line)
