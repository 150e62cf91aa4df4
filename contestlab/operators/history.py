"""Running median, median absolute deviation and clipped location over a growing history, exact, on one path.

Rows are shuffled once by (history, block) and stand there in time order; ``ordertree`` answers for
all rows of a batch of histories at once, in a number of steps that grows with the logarithm of a
history. Nearly every history is one block.

A history of more than BLOCK rows is cut into consecutive blocks, each its own group. For a block,
earlier rows matter only near the places its results can come from: the centre and the two edges of
a median and a deviation, or the two clip limits. Value bins with exact cumulative counts tell which
bins can matter; their values travel as cells (value, count, weight), one cell however often a value
occurs, and each other bin as one cell. The results are those of one long pass, and no task sees more than
a few blocks of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import once, spread, stored
from . import ordertree as ot
from .percentiles import in_bucket
from .windows import DAYS_PER_YEAR, years

#: Rows of a history in one block, and the growth exponent of decay weights within it.
BLOCK, SPAN, MOST_GROWTH = 1 << 16, 16.0, 600.0
#: Bins of the values of a history of several blocks, and rows that are answered together.
BINS, BATCH = 256, 1 << 16
LOW, HIGH = 0.1, 0.9
MOMENTS = ("n", "s", "sx", "sxx")


def running_order_stats(df: DataFrame, cols: list[str], key: list[str], date: str, tie: list[str], strict: bool = False, rate: float | None = None, block: int = BLOCK, lengths: DataFrame | None = None) -> DataFrame:
    """Add ``<c>_median`` and ``<c>_mad`` (and ``<c>_dmad``, the decay-weighted mean deviation) per row.

    Order is (date, tie); ``strict`` leaves the current row out. Null values are skipped. Rows with a
    null key, date or tie keep their place, nulls first, and their results; a null date has no weight.
    ``lengths`` is a written table with the keys and dates of the same rows, if there is one: ``df`` is then
    written only where a history is long.
    """
    kinds = ["median", "mad"] + (["dmad"] if rate is not None else [])

    def solve(s: ot.Stretches, centre: np.ndarray, growth: np.ndarray) -> dict[str, np.ndarray]:
        median, mad, upper = ot.median_and_mad(s)
        out = {"median": median, "mad": mad}
        return out | {"dmad": ot.weighted_deviation(s, median, upper, centre)} if rate is not None else out

    return _solved(df, cols, key, date, tie, kinds, solve, _regions, strict, rate, 2, block, lengths=lengths)


def clipped_days(df: DataFrame, cols: list[str], key: list[str], date: str, rate: float, block: int = BLOCK) -> DataFrame:
    """``<c>_mean``, ``<c>_variance`` and ``<c>_weight`` per (key, date): the decayed location of all rows on earlier dates.

    Values are clipped to the elements at 10 and 90 percent of the sorted history. Only the first element
    of a date is answered, for all columns at once; a (key, date) without earlier values is left out.
    """
    kinds = ["mean", "variance", "weight"]

    def solve(s: ot.Stretches, centre: np.ndarray, growth: np.ndarray) -> dict[str, np.ndarray]:
        mean, variance, weight = ot.clipped_moments(s, LOW, HIGH, centre)
        return {"mean": mean, "variance": variance, "weight": weight / growth}

    rows = once(df)
    own = rows.select(*key, date, *[F.col(c).cast("double").alias(c) for c in cols], F.lit(1).cast("bigint").alias("__c"))
    own.is_cut = True  # a projection of a cut table
    if not _long_keys(own, key, date, rate, block).isEmpty():  # equal rows of a long history travel as one
        own = own.groupBy(*key, date, *cols).agg(F.sum("__c").alias("__c"))
    made = _solved(own, cols, key, date, cols, kinds, solve, _clip_regions, True, rate, 3, block, "__c")
    found = [F.col(f"{c}_weight").isNotNull() for c in cols]
    return made.filter(reduce(lambda a, b: a | b, found)).select(*key, date, *[f"{c}_{k}" for c in cols for k in kinds])


def clipped_location(df: DataFrame, cols: list[str], key: list[str], date: str, rate: float, block: int = BLOCK) -> DataFrame:
    """Add ``<c>_mean``, ``<c>_variance`` and ``<c>_weight`` of ``clipped_days`` to every row; the weight is 0 where there is no earlier value."""
    days = clipped_days(df, cols, key, date, rate, block).withColumnsRenamed({c: f"__at_{c}" for c in [*key, date]})
    names = [f"{c}_{k}" for c in cols for k in ("mean", "variance", "weight")]
    wide = df.join(days, _same([*key, date], "__at_"), "left")
    return wide.select(*df.columns, *[F.coalesce(n, F.lit(0.0)).alias(n) if n.endswith("_weight") else n for n in names])


def _same(names: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(prefix + c)) for c in names])


def _solved(df, cols, key, date, tie, kinds, solve, regions, strict, rate, sums, block, count=None, lengths=None) -> DataFrame:
    """``df`` with ``<c>_<kind>``. With ``count``, a row stands for so many and only the first of a date is answered."""
    rows, blocks = _blocks(df, cols, key, date, tie, rate, block, count, lengths)
    own = [f.name for f in df.schema.fields]
    # nothing is cut into blocks where no history is long, which is the rule; what follows from a row is not shuffled then
    if blocks is None:
        both = spread(rows, *key).sortWithinPartitions(*key, date, *tie).withColumns(_parts(cols, date, count) | _whole())
    else:
        both = rows.unionByName(_cells(blocks, cols, key, regions, rate), allowMissingColumns=True)
        both = spread(both, *key, "__block").sortWithinPartitions(*key, "__block", "__kind", date, *tie)
    both = both.withColumn("__history", F.xxhash64(*key, "__block"))
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"{c}_{k}", T.DoubleType()) for c in cols for k in kinds]])
    answer = _answers(own, cols, kinds, solve, strict, rate, sums, count is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BATCH:
                table = pa.Table.from_batches(held)
                history = table["__history"].to_numpy()
                ends = np.flatnonzero(history[1:] != history[:-1])
                if len(ends):  # the last history may go on in the next batch
                    yield from answer(table.slice(0, ends[-1] + 1))
                    table = table.slice(ends[-1] + 1)
                held, size = table.to_batches(), table.num_rows
        if size:
            yield from answer(pa.Table.from_batches(held))

    return both.mapInArrow(run, schema)


def _whole() -> dict[str, Column]:
    """Block and first-of-date flag of a row whose history is one block."""
    return {"__block": F.lit(0).cast("bigint"), "__first": F.lit(None).cast("boolean")}


def _parts(cols, date, count) -> dict[str, Column]:
    """What the answers read of a row."""
    x = {f"__x{i}": F.col(c).cast("double") for i, c in enumerate(cols)}
    return x | {"__day": F.datediff(F.col(date), F.lit("1970-01-01").cast("date")), "__count": (F.col(count) if count else F.lit(1)).cast("bigint"), "__kind": F.lit(1)}


def _long_keys(rows, key, date, rate, block) -> DataFrame:
    """The keys of histories of several blocks, from one aggregate by key; usually there are none."""
    totals = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("__all"), ((rate or 0.0) * years(F.datediff(F.max(date), F.min(date)))).alias("__growth"))
    return totals.filter((F.col("__all") > block) | (F.coalesce("__growth", F.lit(0.0)) > SPAN))


def _blocks(df, cols, key, date, tie, rate, block, count, lengths=None) -> tuple[DataFrame, DataFrame | None]:
    """The rows as they are, where no history is long. Otherwise all rows with their parts and the number of their block,
    and those of histories of several blocks alone.

    The long histories' dates come from one aggregate by (key, date) and are written, so that the
    join's planner knows how few they are.
    """
    rows = once(df) if lengths is None else df
    if _long_keys(rows if lengths is None else lengths, key, date, rate, block).isEmpty():
        return rows, None
    rows = once(rows)
    more = _parts(cols, date, count)
    own = [*df.columns, *more, *_whole()]
    days = rows.groupBy(*key, date).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*key)
    before = whole.orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    growth = (rate or 0.0) * years(F.datediff(F.max(date).over(whole), F.min(date).over(whole)))
    days = days.select(
        *[F.col(c).alias(f"__at_{c}") for c in [*key, date]], F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("__all"),
        F.min(date).over(whole).alias("__start"), F.max(date).over(whole).alias("__end"), F.coalesce(growth, F.lit(0.0)).alias("__growth"))
    long = stored(days.filter((F.col("__all") > block) | (F.col("__growth") > SPAN)), "long")
    placed = rows.join(long, _same([*key, date], "__at_"), "left").withColumns(more)
    short = placed.filter("__before IS NULL").withColumns(_whole()).select(*own)
    nth = F.row_number().over(Window.partitionBy(*key, date).orderBy(*tie))
    late = F.coalesce(F.floor((rate or 0.0) * years(F.datediff(F.col(date), F.col("__start"))) / SPAN), F.lit(0))
    deep = placed.filter("__before IS NOT NULL").withColumn("__first", nth == 1)
    deep = deep.withColumn("__block", (F.floor((F.col("__before") + nth - 1) / block) + late).cast("bigint"))
    deep = deep.withColumn("__block", F.when(F.col("__growth") > MOST_GROWTH, F.raise_error(F.lit("half-life too short for the length of this history")).cast("bigint")).otherwise(F.col("__block")))
    return short.unionByName(deep.select(*own)), deep.select(*own, "__end")


def _cells(rows, cols, key, regions, rate) -> DataFrame:
    """(key, __block, __kind 0, __stat, __value, __known, __count, __s, __sx, __sxx, __day): what a block
    must know of the blocks before it; weights are those of the day ``__day``."""
    stats = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(f"__x{i}").alias("x")) for i in range(len(cols))]))
    age = years(F.datediff(F.date_add(F.lit("1970-01-01").cast("date"), F.col("__day")), F.col("__end")))
    known = rows.select(*key, F.col("__block").alias("block"), "__count", "__end", F.coalesce(F.exp(F.lit(rate or 0.0) * age), F.lit(0.0)).alias("g"), stats.alias("v")).select("*", "v.*").drop("v")
    known = known.filter("x IS NOT NULL AND NOT isnan(x)")
    gk = [*key, "stat"]
    splits = known.groupBy(*gk).agg(F.percentile_approx("x", [i / BINS for i in range(1, BINS)], 10 * BINS).alias("splits"), F.max("block").alias("last"), F.max("__end").alias("end"))
    hold = splits.select(*[F.col(c).alias(f"__at_{c}") for c in gk], "splits", "last", "end")
    binned = in_bucket(known.join(hold, _same(gk, "__at_")), "splits", "x", "bin", BINS)
    cells = binned.groupBy(*gk, "bin", "block", "x", "last", "end").agg(F.sum("__count").alias("n"), F.sum(F.col("g") * F.col("__count")).alias("s"))
    cells = stored(cells.withColumns({"sx": F.col("s") * F.col("x"), "sxx": F.col("s") * F.col("x") * F.col("x")}), "cells")
    per_bin = cells.groupBy(*gk, "bin").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("last").alias("last"), F.max("end").alias("end"))
    grid = per_bin.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last")))).drop("last")
    sums = cells.groupBy(*gk, "bin", "block").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    before = Window.partitionBy(*gk, "bin").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = [*gk, "bin", "block"]
    upto = grid.join(sums.select(*[F.col(c).alias(f"__at_{c}") for c in at], *MOMENTS), _same(at, "__at_"), "left")
    upto = upto.select(*at, "lo", "hi", "end", *[F.sum(c).over(before).alias(c) for c in MOMENTS]).filter("n > 0")
    arriving = cells.groupBy(*gk, "block").agg(F.sum("n").alias("m"))
    upto = upto.join(arriving.select(*[F.col(c).alias(f"__at_{c}") for c in [*gk, "block"]], "m"), _same([*gk, "block"], "__at_"), "left").select(*upto.columns, "m")
    fields = [f for f in upto.schema.fields if f.name != "m"]
    schema = T.StructType([*fields, T.StructField("need", T.BooleanType())])

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin").reset_index(drop=True)
        extra = 0 if pdf["m"].isna().all() else int(pdf["m"].max())
        return pdf.assign(need=regions(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), pdf["n"].to_numpy(dtype=np.int64), extra))[[f.name for f in schema.fields]]

    planned = stored(upto.groupBy(*gk, "block").applyInPandas(plan, schema), "planned")
    wanted = planned.filter("need").select(*[F.col(c).alias(f"__at_{c}") for c in [*gk, "bin"]], F.col("block").alias("__for"))
    exact = cells.join(wanted, _same([*gk, "bin"], "__at_")).filter("block < __for").groupBy(*gk, "__for", "x", "end").agg(*[F.sum(c).alias(c) for c in MOMENTS])
    exact = exact.select(*gk, F.col("__for").alias("block"), F.col("x").alias("value"), F.lit(True).alias("known"), *MOMENTS, "end")
    rest = planned.filter("NOT need").select(*gk, "block", F.col("lo").alias("value"), F.lit(False).alias("known"), *MOMENTS, "end")
    return exact.unionByName(rest).select(
        *key, F.col("block").alias("__block"), F.lit(0).alias("__kind"), F.col("stat").alias("__stat"), F.col("value").alias("__value"), F.col("known").alias("__known"), F.col("n").alias("__count"),
        F.col("s").alias("__s"), F.col("sx").alias("__sx"), F.col("sxx").alias("__sxx"), F.datediff("end", F.lit("1970-01-01").cast("date")).alias("__day"))


def _numbers(table: pa.Table, name: str, null: float = np.nan) -> np.ndarray:
    return table[name].cast(pa.float64()).fill_null(null).to_numpy()


def _answers(own: list[str], cols: list[str], kinds: list[str], solve: Callable, strict: bool, rate: float | None, sums: int, firsts: bool) -> Callable:
    """The statistics of a table of whole blocks: (history, kind, date, tie) order, cells before rows."""

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        seg = table["__history"].to_numpy()
        change = np.concatenate([[True], seg[1:] != seg[:-1]])
        history = np.cumsum(change) - 1
        is_row = table["__kind"].to_numpy() == 1
        cells = "__stat" in table.column_names
        day = _numbers(table, "__day")
        count = table["__count"].to_numpy().astype(np.int64) if cells or firsts else None
        asked = is_row
        if firsts:
            new_day = np.concatenate([[True], (day[1:] != day[:-1]) & ~(np.isnan(day[1:]) & np.isnan(day[:-1]))])
            told = _numbers(table, "__first")
            asked = is_row & np.where(np.isnan(told), change | new_day, told == 1)
        last = np.full(int(history[-1]) + 1, -np.inf)
        dated = is_row & ~np.isnan(day)
        np.maximum.at(last, history[dated], day[dated])
        with np.errstate(invalid="ignore", over="ignore"):
            grown = np.exp((rate or 0.0) * (day - last[history]) / DAYS_PER_YEAR)
        grown = np.where(np.isfinite(grown), grown, 0.0)
        out = table.filter(pa.array(is_row)).select(own)
        for i, c in enumerate(cols):
            x = _numbers(table, f"__x{i}")
            known = None
            if cells:
                mine = ~is_row & (_numbers(table, "__stat") == i)
                x = np.where(mine, _numbers(table, "__value"), x)
                known = np.where(mine, _numbers(table, "__known") == 1, True)
            used = ~np.isnan(x)
            taken, centre = (), None
            if rate is not None:
                total, n = np.zeros(len(last)), np.zeros(len(last))
                np.add.at(total, history[used], x[used])
                np.add.at(n, history[used], 1)
                centre = (total / np.maximum(n, 1))[history]
                w = grown * (1 if count is None else count)
                shifted = np.where(used, x - centre, 0.0)
                taken = tuple(w * shifted**p for p in range(sums))
                if cells:
                    s, sx, sxx = (_numbers(table, k) * grown for k in ("__s", "__sx", "__sxx"))
                    moved = (s, sx - centre * s, sxx - 2 * centre * sx + centre * centre * s)
                    taken = tuple(np.where(mine, m, t) for m, t in zip(moved, taken))
            past = ot.stretches(history, x, used, asked, strict, count, known, taken)
            places = np.flatnonzero(asked)
            some = past.n > 0 if rate is None else (past.n > 0) & (past.totals[0] > 0)
            made = solve(past.only(np.flatnonzero(some)), None if centre is None else centre[places][some], grown[places][some]) if some.any() else {}
            for k in kinds:
                full = np.full(table.num_rows, np.nan)
                full[places[some]] = made.get(k, np.nan)
                full = full[is_row]
                out = out.append_column(f"{c}_{k}", pa.array(full, pa.float64(), mask=np.isnan(full)))
        yield from out.to_batches()

    return answer


def _regions(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, extra: int) -> np.ndarray:
    """Which bins a median or a MAD can touch while ``extra`` more values arrive.

    ``lo``/``hi``/``n`` describe the ordered, non-empty bins of the earlier values.
    """
    total = int(n.sum())
    cum = np.concatenate([[0], np.cumsum(n)])
    half = total // 2
    everything = np.ones(len(n), bool)
    if half - extra - 2 < 0:
        return everything
    m_lo = lo[np.searchsorted(cum, half - extra - 2, "right") - 1]
    m_hi = hi[min(np.searchsorted(cum, min(half + extra + 2, total - 1), "right") - 1, len(n) - 1)]
    radii = np.unique(np.abs(np.concatenate([lo - m_lo, lo - m_hi, hi - m_lo, hi - m_hi])))
    last = np.searchsorted(hi, m_lo + radii, "right")
    first = np.searchsorted(lo, m_hi - radii, "left")
    sure = np.maximum(cum[last] - cum[np.minimum(first, last)], 0)
    ok = np.nonzero(sure >= half + extra + 2)[0]
    if not len(ok):
        return everything
    r_hi = radii[ok[0]]
    last = np.searchsorted(lo, m_hi + radii, "right")
    first = np.searchsorted(hi, m_lo - radii, "left")
    may = cum[last] - cum[np.minimum(first, last)]
    low = np.nonzero(may + extra <= half - 2)[0]
    r_lo = radii[low[-1]] if len(low) else 0.0
    need = np.zeros(len(n), bool)
    for a, b in ((m_lo, m_hi), (m_lo - r_hi, m_hi - r_lo), (m_lo + r_lo, m_hi + r_hi)):
        need |= (hi >= a) & (lo <= b)
    return need


def _clip_regions(lo: np.ndarray, hi: np.ndarray, n: np.ndarray, extra: int) -> np.ndarray:
    """Bins the 10 and 90 percent elements can fall into while ``extra`` more values arrive."""
    total = int(n.sum())
    cum = np.concatenate([[0], np.cumsum(n)])
    need = np.zeros(len(n), bool)
    for q in (LOW, HIGH):
        first, last = int((total - 1) * q) - extra - 1, int((total + extra - 1) * q) + 1
        if first < 0 or last >= total:
            return np.ones(len(n), bool)
        need[np.searchsorted(cum, first, "right") - 1:np.searchsorted(cum, last, "right")] = True
    return need
