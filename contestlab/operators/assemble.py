"""From feature families to training and scoring rows."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .ranking import ranked
from .sides import pair_sides
from .windows import contest_no


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` by its keys, with an error where one comes twice.

    The check rides on an aggregate by the keys, which brings rows where a join by them needs them; no job runs before.
    """
    rest = [c for c in df.columns if c not in keys]
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in rest])
    twice = F.raise_error(F.concat(F.lit(f"rows not unique on {keys}: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    return rows.filter(F.when(F.col("__n") > 1, twice.cast("boolean")).otherwise(F.lit(True))).select(*df.columns)


def add_features(base: DataFrame, feats: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of ``feats`` added by key; columns already present are replaced."""
    fresh = [c for c in feats.columns if c not in keys]
    return base.drop(*fresh).join(feats, keys, "left")


def replace_partitions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All old rows of the touched keys replaced by the new rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def assemble(base: DataFrame, families: list[DataFrame], keys: list[str]) -> DataFrame:
    """Left-join family tables on the key; keys must be unique, so the row count stays."""
    out = unique(base, keys)
    for f in families:
        clash = (set(out.columns) & set(f.columns)) - set(keys)
        if clash:
            raise ValueError(f"duplicate feature columns {sorted(clash)}")
        out = out.join(unique(f, keys), keys, "left")
    return out


def attach_both(df: DataFrame, odds: DataFrame, cols: list[str], contest: str = "contest_id", ids: tuple[str, str] = ("entity1_id", "entity2_id"), entity: str = "entity_id") -> DataFrame:
    """Side values left-joined for both sides of a contest row as ``f1_<c>`` and ``f2_<c>``."""
    out = df
    for no, key in enumerate(ids, 1):
        side = odds.select(F.col(contest), F.col(entity).alias(key), *[F.col(c).alias(f"f{no}_{c}") for c in cols])
        out = out.join(side, [contest, key], "left")
    return out


def contest_diffs(sides: DataFrame, cols: list[str], target: str, head: list[str], contest: str = "contest_id", result: str = "result", method: str = "method") -> DataFrame:
    """One row per contest: side-1 and side-2 values, their difference, and the label.

    ``target`` is ``win_loss`` (``c``, ``c_2``, ``c_diff``; label = result) or ``decision``
    (``side1_c``, ``side2_c``, ``c_diff``; label = method mentions a decision).
    """
    pairs = pair_sides(sides, cols, contest, head=list(dict.fromkeys([*head, result, method])))
    one, two = ("side1_{}", "side2_{}") if target == "decision" else ("{}", "{}_2")
    y = F.contains(F.lower(F.coalesce(method, F.lit(""))), F.lit("decision")).cast("int") if target == "decision" else F.col(result)

    def clean(c: str) -> str:
        return c.replace("_prev", "")

    return pairs.select(
        contest, *head, y.alias("y_true"),
        *[F.col(f"{c}_1").alias(one.format(clean(c))) for c in cols], *[F.col(f"{c}_2").alias(two.format(clean(c))) for c in cols],
        *[(F.col(f"{c}_1") - F.col(f"{c}_2")).alias(f"{clean(c)}_diff") for c in cols])


def corr_target(df: DataFrame, cols: list[str], y: str) -> DataFrame:
    """Long table (feature, r) of Pearson correlations with the label, one pass."""
    agg = df.agg(*[F.corr(F.col(c).cast("double"), F.col(y).cast("double")).alias(c) for c in cols])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols])).alias("x")).select("x.*")


def abs_correlations(df: DataFrame, cols: list[str], block: int = 400) -> dict[tuple[str, str], float]:
    """|r| for every pair; rows with a null in a pair are left out of that pair.

    Complete columns go through one Gram matrix; pairs with gaps through ``corr`` in blocks.
    """
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    gaps = x.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    full = [c for c in cols if gaps[c] == 0]
    out: dict[tuple[str, str], float] = {}
    if len(full) > 1:
        vec = VectorAssembler(inputCols=full, outputCol="v").transform(x).select("v")
        m = Correlation.corr(vec, "v").first()[0].toArray()
        out = {(a, b): abs(float(m[i, j])) for (i, a), (j, b) in combinations(enumerate(full), 2)}
    rest = [p for p in combinations(cols, 2) if p not in out]
    for i in range(0, len(rest), block):
        part = rest[i:i + block]
        row = x.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(part)]).first()
        out |= {p: abs(row[k]) for k, p in enumerate(part) if row[k] is not None}
    return out


def drop_correlated(df: DataFrame, cols: list[str], threshold: float = 0.95, prefer: list[str] = ()) -> list[str]:
    """Columns to drop: one of each pair with |r| at or above the threshold.

    Kept by priority: preferred name, not round 1, not a slope, else the later column.
    """
    r = abs_correlations(df, cols)

    def rank(c: str, rule: int) -> bool:
        return (any(p in c for p in prefer), "rd1" not in c, "slope" not in c)[rule]

    drop = set()
    for a, b in combinations(cols, 2):
        if r.get((a, b), 0.0) < threshold:
            continue
        loser = a
        for rule in range(3):
            if rank(a, rule) != rank(b, rule):
                loser = b if rank(a, rule) else a
                break
        drop.add(loser)
    return [c for c in cols if c in drop]


# Method fragments that make a contest unusable, with and without split decisions.
UNWANTED = ["dq", "other", "overturned"]
UNWANTED_SPLIT = ["dq", "other", "decision - split", "decision - majority", "overturned"]


def experience_numbers(df: DataFrame, contest: str = "contest_id", date: str = "event_date", ids: tuple[str, str] = ("entity1_id", "entity2_id")) -> DataFrame:
    """Contest rows with each side's running contest number (``<id>_no``, from 1)."""
    long = df.select(contest, date, F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).alias("entity")) for i, c in enumerate(ids)])).alias("s")).select(contest, date, "s.*")
    numbered = contest_no(long, ["entity"], date, [contest], "no")
    wide = numbered.groupBy(contest).agg(*[F.max(F.when(F.col("k") == i, F.col("no"))).alias(f"{c}_no") for i, c in enumerate(ids)])
    return df.join(wide, contest)


def filter_contests(
    df: DataFrame, min_prior: int, *, contest: str = "contest_id", date: str = "event_date", ids: tuple[str, str] = ("entity1_id", "entity2_id"),
    label: str = "y_true", method: str = "method", start: str | None = None, end: str | None = None, split_decisions: bool = False, required: list[str] = (),
) -> DataFrame:
    """Eligible training rows: experience, usable method, binary label, dates, no missing inputs."""
    out = experience_numbers(df, contest, date, ids)
    for c in ids:
        out = out.filter(F.col(f"{c}_no") > min_prior)
    words = UNWANTED if split_decisions else UNWANTED_SPLIT
    out = out.filter(~F.lower(method).rlike("|".join(words)) & F.col(label).isin(0, 1))
    if start:
        out = out.filter(F.col(date) >= F.lit(start).cast("date"))
    if end:
        out = out.filter(F.col(date) <= F.lit(end).cast("date"))
    return out.dropna(subset=[contest, date, *ids, label, method, *required])


def swap_roles(df: DataFrame, when: Column, pairs: list[tuple[str, str]], label: str, negate: list[str]) -> DataFrame:
    """Exchange paired columns, flip the label and negate differences where ``when`` holds."""
    made = {}
    for a, b in pairs:
        made[a] = F.when(when, F.col(b)).otherwise(F.col(a))
        made[b] = F.when(when, F.col(a)).otherwise(F.col(b))
    made[label] = F.when(when, 1 - F.col(label)).otherwise(F.col(label))
    made |= {c: F.when(when, -F.col(c)).otherwise(F.col(c)) for c in negate}
    return df.select(*[made[c].alias(c) if c in made else F.col(c) for c in df.columns])


def balance(df: DataFrame, key: str, label: str, pairs: list[tuple[str, str]], target: float = 0.5, seed: int = 42) -> DataFrame:
    """Swap sides of a seeded random subset of the majority class until the target rate holds.

    The subset is the k smallest key hashes, by the ranks of the majority's keys alone.
    """
    rows = cut(df.filter(F.col(label).isin(0, 1)))
    n, ones = rows.agg(F.count(F.lit(1)), F.count_if(F.col(label) == 1)).first()
    if not n or abs(ones / n - target) < 0.01:
        return rows
    want = int(n * target)
    majority, k = (1, ones - want) if ones > want else (0, want - ones)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))).alias("__h")
    chosen = ranked(rows.filter(F.col(label) == majority).select(key, h), ["__h", key], "__r")[0]
    chosen = chosen.filter(F.col("__r") <= k).select(key, F.lit(True).alias("__in"))
    marked = rows.join(chosen, key, "left")
    when = (F.col(label) == majority) & F.coalesce("__in", F.lit(False))
    diffs = [c for c in df.columns if c.endswith("_diff")]
    return swap_roles(marked, when, pairs, label, diffs).select(*df.columns)


def experience(df: DataFrame, contests: DataFrame, entity: str, contest: str = "contest_id", ids: tuple[str, str] = ("entity1_id", "entity2_id")) -> DataFrame:
    """Distinct contests of both sides (0 when unknown) and their sum."""
    seen = df.select(entity, contest).distinct().groupBy(entity).agg(F.count(F.lit(1)).alias("__n"))
    out = contests
    for no, key in enumerate(ids, 1):
        out = out.join(seen.select(F.col(entity).alias(key), F.col("__n").alias(f"side{no}_total")), key, "left")
        out = out.withColumn(f"side{no}_total", F.coalesce(f"side{no}_total", F.lit(0)))
    return out.withColumn("combined_total", F.col("side1_total") + F.col("side2_total"))


def inference_features(pairs: DataFrame, stats: list[str], keys: list[str], single: tuple[str, ...] = ("odds", "grp_code")) -> DataFrame:
    """``side1_<s>``, ``side2_<s>`` and ``<s>_diff`` from ``<s>_1``/``<s>_2``; odds and codes only for side 1."""
    cols = []
    for s in stats:
        cols.append(F.col(f"{s}_1").alias(f"side1_{s}"))
        if not any(t in s.lower() for t in single):
            cols += [F.col(f"{s}_2").alias(f"side2_{s}"), (F.col(f"{s}_1") - F.col(f"{s}_2")).alias(f"{s}_diff")]
    return pairs.select(*keys, *cols)


def model_columns(df: DataFrame, wanted: list[str], keys: list[str]) -> DataFrame:
    """Columns a model asks for; an unprefixed name reads side 1, unknown names are left out."""
    have = set(df.columns)
    cols = []
    for w in wanted:
        if w in have:
            cols.append(F.col(w))
        elif not w.endswith("_diff") and f"side1_{w}" in have:
            cols.append(F.col(f"side1_{w}"))
    return df.select(*keys, *cols)


def cross_difference(pairs: DataFrame, spec: dict[str, tuple[str, str, float]], support: tuple[str, str]) -> DataFrame:
    """``l1 + r2 - l2 - r1`` per named interaction; null where either side lacks the support."""
    made = {}
    for name, (left, right, least) in spec.items():
        ok = (F.col(support[0]) >= least) & (F.col(support[1]) >= least)
        made[name] = F.when(ok, F.col(f"{left}_1") + F.col(f"{right}_2") - F.col(f"{left}_2") - F.col(f"{right}_1"))
    return pairs.withColumns(made)


def lineage_check(rows: DataFrame, prior_ids: list[str]) -> DataFrame:
    """One row: violations per rule over lineage rows, with support and uncertainty extremes."""
    rate = F.contains("feature_name", F.lit("rate")) | F.contains("feature_name", F.lit("posterior"))
    bad = {
        "identity_collision": F.col("entity_id") == F.col("opponent_id"),
        "fit_scope": F.col("fit_scope") != "prior-only",
        "unknown_prior": ~F.col("prior_id").isin(prior_ids),
        "zero_denominator": rate & (F.col("denominator") <= 0),
        "negative_numerator": rate & (F.col("numerator") < 0),
        "negative_support": F.col("effective_support") < 0,
        "invalid_uncertainty": F.isnan("uncertainty") | (F.col("uncertainty") < 0) | (F.col("uncertainty") == float("inf")),
        "future_source": F.exists("source_dates", lambda d: d >= F.col("cutoff")) | F.array_contains("source_event_ids", F.col("event_id")),
        "ragged_sources": (F.size("source_row_ids") != F.size("source_event_ids")) | (F.size("source_row_ids") != F.size("source_dates")),
    }
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("feature_name").alias("feature_count"),
        F.coalesce(F.min("effective_support"), F.lit(0.0)).alias("min_support"), F.coalesce(F.max("uncertainty"), F.lit(0.0)).alias("max_uncertainty"),
        *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in bad.items()])


def prior_context(df: DataFrame, before: str, length: int, exclude_event: str | None = None, contest: str = "contest_id", event: str = "event_id", date: str = "event_date", excluded_contests: DataFrame | None = None) -> DataFrame:
    """Rows of the most recent whole events before a date, at most ``length`` rows unless one event alone is longer.

    Events are counted per date first; only the one date on which the limit is
    reached needs its events in order.
    """
    rows = df.filter(F.col(date) < F.lit(before).cast("date"))
    if exclude_event is not None:
        rows = rows.filter(F.col(event).cast("string") != str(exclude_event))
    if excluded_contests is not None:
        rows = rows.join(excluded_contests.select(contest).distinct(), contest, "left_anti")
    per_event = cut(rows.groupBy(event).agg(F.max(date).alias("__d"), F.count(F.lit(1)).alias("__n")))
    days = per_event.groupBy("__d").agg(F.sum("__n").alias("n")).orderBy(F.desc("__d")).limit(length).collect()
    taken, edge = 0, None
    for d in days:
        if taken + d["n"] > length:
            edge = d["__d"]
            break
        taken += d["n"]
    if edge is None:
        last = days[-1]["__d"] if days else None
        keep = per_event.filter(F.col("__d") >= F.lit(last)) if days else per_event
        return rows.join(keep.select(event), event, "left_semi")
    newest = Window.partitionBy("__d").orderBy(F.desc(event)).rowsBetween(Window.unboundedPreceding, 0)
    at_edge = per_event.filter(F.col("__d") == F.lit(edge)).withColumn("__run", F.sum("__n").over(newest) + taken)
    first_alone = (F.lit(taken) == 0) & (F.col("__run") == F.col("__n"))
    kept = at_edge.filter((F.col("__run") <= length) | first_alone).select(event)
    keep = per_event.filter(F.col("__d") > F.lit(edge)).select(event).unionByName(kept)
    return rows.join(keep, event, "left_semi")


def select_stable(evidence: DataFrame, candidates: DataFrame, min_support: int, stability: float, min_gain: float, cap: int) -> DataFrame:
    """Stable features: enough folds, one sign, enough mean gain; at most ``cap`` per measurement group.

    ``evidence`` has (feature, fold, direction, delta), ``candidates`` has (feature, position, grp).
    """
    per = evidence.groupBy("feature").agg(
        F.count(F.lit(1)).alias("support"), F.count_if(F.col("direction") > 0).alias("positive"), F.avg("delta").alias("mean_delta"))
    out = candidates.join(per, "feature", "left").withColumns({
        "support": F.coalesce("support", F.lit(0)), "positive": F.coalesce("positive", F.lit(0)), "mean_delta": F.coalesce("mean_delta", F.lit(0.0))})
    steady = F.greatest(F.col("positive"), F.col("support") - F.col("positive"))
    out = out.withColumn("stability", F.coalesce(F.try_divide(steady, F.col("support")), F.lit(0.0)))
    out = out.withColumn("eligible", (F.col("support") >= min_support) & (F.col("stability") >= stability) & (F.col("mean_delta") > min_gain))
    w = Window.partitionBy("grp", "eligible").orderBy(F.desc("mean_delta"), "position")
    return out.withColumn("selected", F.col("eligible") & (F.row_number().over(w) <= cap))


def select_profile(evidence: DataFrame, order: list[str], years: int, profile: str = "profile", year: str = "year", loss: str = "loss") -> DataFrame:
    """Profiles with mean loss over the complete years; ``selected`` marks the lowest, earlier-listed on ties."""
    per = evidence.groupBy(profile).agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).alias("rows"), F.count_distinct(year).alias("years"))
    known = {r[profile]: r for r in per.limit(len(order) + 1).collect()}
    if set(known) != set(order) or any(r["rows"] != years or r["years"] != years for r in known.values()):
        raise ValueError("profile evidence is incomplete or unknown")
    best = min(order, key=lambda p: (known[p]["mean_loss"], order.index(p)))
    return per.select(profile, "mean_loss", (F.col(profile) == best).alias("selected"))
