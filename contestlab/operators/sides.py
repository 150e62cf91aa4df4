"""Moves between the contest grain (one row) and the side grain (two rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_up(df: DataFrame, cols: list[str], contest: str = "contest_id", entity: str = "entity_id") -> DataFrame:
    """One row per contest: structs ``a`` and ``b`` of the two sides and the side count ``n``.

    One grouped aggregate instead of a self-join: one shuffle, map-side combining,
    and at most two rows kept per contest. More than two sides is an error.
    """
    body = F.struct(F.col(entity), *[F.col(c) for c in cols if c not in (contest, entity)])
    pairs = df.groupBy(contest).agg(
        F.min_by(body, entity).alias("a"), F.max_by(body, entity).alias("b"), F.count(F.lit(1)).alias("n")
    )
    bad = F.concat(F.lit("contest with more than two sides: "), F.col(contest).cast("string"))
    return pairs.withColumn("n", F.when(F.col("n") > 2, F.raise_error(bad).cast("bigint")).otherwise(F.col("n")))


def opponent(
    df: DataFrame, cols: list[str], contest: str = "contest_id", entity: str = "entity_id", suffix: str = "_opp", how: str = "inner",
) -> DataFrame:
    """Add the other side's value of each column as ``<c><suffix>``."""
    rest = [c for c in df.columns if c not in (contest, entity)]
    pairs = pair_up(df, rest, contest, entity)

    def side(me: str, other: str | None) -> Column:
        own = [F.col(f"{me}.{c}").alias(c) for c in [entity, *rest]]
        kind = dict(df.dtypes)
        opp = [(F.col(f"{other}.{c}") if other else F.lit(None).cast(kind[c])).alias(f"{c}{suffix}") for c in cols]
        return F.struct(*own, *opp)

    both = F.array(side("a", "b"), side("b", "a"))
    if how == "inner":
        pairs, rows = pairs.filter("n = 2"), both
    else:
        rows = F.when(F.col("n") == 2, both).otherwise(F.array(side("a", None)))
    return pairs.select(contest, F.explode(rows).alias("s")).select(contest, "s.*")


def defense(df: DataFrame, accuracy_cols: list[str], contest: str = "contest_id", entity: str = "entity_id") -> DataFrame:
    """``<family>_def``: the accuracy the other side reached."""
    out = opponent(df, accuracy_cols, contest, entity, suffix="__o")
    return out.withColumnsRenamed({f"{c}__o": c.replace("_acc", "_def") for c in accuracy_cols})


def share_ratio(df: DataFrame, cols: list[str], contest: str = "contest_id", entity: str = "entity_id") -> DataFrame:
    """``<c>_ratio``: own part of both sides' total, three decimals, 0 when the total is not positive."""
    out = opponent(df, cols, contest, entity)

    def ratio(c: str) -> Column:
        tot = F.col(c) + F.col(f"{c}_opp")
        return F.when(tot > 0, F.round(F.col(c) / tot, 3)).otherwise(0.0).alias(f"{c}_ratio")

    return out.select(*df.columns, *[ratio(c) for c in cols])


def share_of_total(df: DataFrame, cols: list[str], keys: list[str], suffix: str = "") -> DataFrame:
    """Each value over its group total (vig removal); 0.5 when the total is not positive.

    Totals come from a pre-aggregated table, so a hot key only costs its join.
    """
    tot = df.groupBy(*keys).agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    out = df.join(tot, keys)
    made = {f"{c}{suffix}": F.when(F.col(f"__t_{c}") > 0, F.col(c) / F.col(f"__t_{c}")).otherwise(0.5) for c in cols}
    return out.withColumns(made).drop(*[f"__t_{c}" for c in cols])


def to_sides(contests: DataFrame, head: list[str], one: dict[str, str], two: dict[str, str]) -> DataFrame:
    """One contest row -> two side rows in a single scan; ``one``/``two`` map output names to input columns."""
    sides = F.array(*[
        F.struct(F.lit(no).alias("side"), *[F.col(src).alias(out) for out, src in cols.items()])
        for no, cols in ((1, one), (2, two))
    ])
    return contests.select(*head, F.explode(sides).alias("s")).select(*head, "s.*")


def pair_sides(df: DataFrame, cols: list[str], contest: str = "contest_id", side: str = "side", head: list[str] = (), tasks: int | None = None) -> DataFrame:
    """Two side rows -> one contest row with ``<c>_1`` and ``<c>_2``; contests lacking a side drop out.

    ``tasks`` sets how many tasks share the rows, in place of the session's partition count.
    """
    df = df.repartition(tasks, contest) if tasks else df
    body = F.struct(*[F.col(c) for c in cols])
    out = df.groupBy(contest).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in head],
        *[F.max_by(body, F.when(F.col(side) == s, 1)).alias(f"__{s}") for s in (1, 2)],
        F.count_if(F.col(side) == 1).alias("__n1"), F.count_if(F.col(side) == 2).alias("__n2"),
    ).filter("__n1 = 1 AND __n2 = 1")
    return out.select(contest, *head, *[F.col(f"__{s}.{c}").alias(f"{c}_{s}") for s in (1, 2) for c in cols])


def side_ids(contests: DataFrame, contest: str = "contest_id", ids: tuple[str, str] = ("entity1_id", "entity2_id")) -> DataFrame:
    """Distinct (contest, entity) pairs of both sides, from one scan."""
    return contests.select(contest, F.explode(F.array(*ids)).alias("entity_id")).distinct()


def stack_sides(*parts: DataFrame) -> DataFrame:
    """Concatenate side frames by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dedupe(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicates(keys)
