"""Price ticks: line points, matching to contests, implied and fair probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.odds import complement_odds, implied_prob
from ..session import cut, stored

MATCH_DAYS = 4
#: Length of a stretch of days, as a multiple of the days from which a contest can be reached.
STRETCH = 4
#: What matching and side prices read of a line.
LINE = ("opening", "closing", "week", "closing_date")
#: What there is to know of a line.
POINTS = ("opening_ts", "opening", "closing_ts", "closing", "week_ts", "week")


def line_points(ticks: DataFrame, keys: list[str], ts: str = "ts", price: str = "odds", days: int = 7, points: tuple[str, ...] = POINTS) -> DataFrame:
    """Per key: first, last, and the price nearest to ``days`` before the last (latest on ties).

    Ticks are reduced to the first and last of each hour, which bounds what a key
    can hold; its hours stand side by side and answer for it. Only where the target lies
    between the first and the last of an hour of more ticks, that hour's raw
    ticks are read again, by an equi-join on (key, hour). The result is written, with the wanted ``points``.
    """
    rows = ticks.select(*keys, F.col(ts).alias("ts"), F.col(price).alias("price")).withColumn("hour", F.date_trunc("hour", F.col("ts"))).dropna(subset=keys)
    t = F.struct("ts", "price")
    hours = rows.groupBy(*keys, "hour").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n"))
    # an hour of one tick sends it once
    hours = hours.select(*keys, F.struct("first", F.when(F.col("n") > 1, F.col("last")).alias("last"), F.when(F.col("n") > 2, True).alias("more")).alias("h"))
    ends = hours.repartition(*keys).groupBy(*keys).agg(F.min("h.first").alias("opening"), F.max(F.coalesce("h.last", "h.first")).alias("closing"), F.collect_list("h").alias("hours"))
    ends = ends.withColumn("target", F.col("closing.ts") - F.make_dt_interval(F.lit(days)))

    def near(tick: Column) -> Column:
        at, to = (F.unix_micros(F.to_timestamp(c)) for c in (tick["ts"], F.col("target")))
        return F.struct(F.abs(at - to).alias("gap"), (-at).alias("late"), tick.alias("tick"))

    inside = F.exists("hours", lambda h: h["more"] & (h["first"]["ts"] < F.col("target")) & (h["last"]["ts"] > F.col("target")))
    best = F.array_min(F.flatten(F.transform("hours", lambda h: F.array(near(h["first"]), near(F.coalesce(h["last"], h["first"]))))))
    # most keys of a thin market hold one tick
    lone = (F.size("hours") == 1) & F.col("hours")[0]["last"].isNull()
    ends = ends.withColumn("week", F.when(lone, F.col("hours")[0]["first"]).otherwise(best["tick"])).withColumn("inside", F.coalesce(inside, F.lit(False)))
    # an instant that nobody wants is kept where it is needed to read the raw ticks
    made = {"opening_ts": F.col("opening.ts"), "opening": F.col("opening.price"), "closing_ts": F.col("closing.ts"), "closing": F.col("closing.price"), "week_ts": F.col("week.ts"), "week": F.col("week.price")}
    made |= {c: F.when(F.col("inside"), made[c]) for c in ("closing_ts", "week_ts") if c not in points}
    ends = stored(ends.select(*keys, "inside", *[e.alias(c) for c, e in made.items() if c in (*points, "closing_ts", "week_ts", "week")]), "lines")
    raw = ends.filter("inside")
    if raw.isEmpty():
        return ends.select(*keys, *points)
    raw = raw.withColumns({"target": F.col("closing_ts") - F.make_dt_interval(F.lit(days)), "best": F.struct(F.col("week_ts").alias("ts"), F.col("week").alias("price"))})
    raw = stored(raw.withColumn("hour", F.date_trunc("hour", F.col("target"))), "raw")  # its size is known to the join's planner
    seen = rows.join(raw.select(*keys, "hour", "target"), [*keys, "hour"]).groupBy(*keys).agg(F.min(near(t)).alias("seen"))
    seen = raw.join(seen, keys).withColumn("best", F.array_min(F.array(near(F.col("best")), "seen"))["tick"])
    seen = seen.withColumns({"week_ts": F.col("best.ts"), "week": F.col("best.price")}).select(*ends.columns)
    return ends.filter("NOT inside").unionByName(stored(seen, "lines")).select(*keys, *points)


def name_pair(a: str, b: str) -> list[Column]:
    """Orientation-free key of two names."""
    x, y = F.lower(F.col(a)), F.lower(F.col(b))
    return [F.least(x, y), F.greatest(x, y)]


def match_contests(
    lines: DataFrame, contests: DataFrame, tol: int = MATCH_DAYS, *, names: tuple[str, str] = ("fighter", "opponent"),
    order: list[str] = ("fighter", "opponent", "month"), date: str = "closing_date",
) -> DataFrame:
    """Odds groups matched to contests by both names (either orientation) and near dates.

    Each group takes its nearest contest; each contest goes to the first claiming
    group in ``order``. Days are cut into stretches and a contest stands in the one or two from which
    it can be reached, so the near-date rule is an equi-join on (names, stretch) and a rematch-heavy
    pair stays spread out. ``orientation`` is 1 when the group's first name is side 1.
    """
    width = STRETCH * (2 * tol + 1)

    def stretch(c: Column) -> Column:
        return F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / width)

    # the names travel once a side, their key as a hash; the join compares the names themselves
    reached = F.explode(F.array_distinct(F.array(stretch(F.date_sub("event_date", tol)), stretch(F.date_add("event_date", tol)))))
    near_days = contests.select(
        "contest_id", "event_id", "entity1_id", "entity2_id", F.lower("name1").alias("__n1"), F.lower("name2").alias("__n2"), "event_date",
        F.xxhash64(*name_pair("name1", "name2")).alias("__hash"), reached.alias("__stretch"))
    left = lines.select("*", F.xxhash64(*name_pair(*names)).alias("__key"), stretch(F.col(date)).alias("__at"))
    same = [F.col("__key") == F.col("__hash"), F.col("__at") == F.col("__stretch"), *[a == b for a, b in zip(name_pair(*names), name_pair("__n1", "__n2"))]]
    hits = left.join(near_days, same).withColumn("__gap", F.abs(F.datediff(F.col("event_date"), F.col(date)))).filter(F.col("__gap") <= tol)
    own = [c for c in lines.columns if c not in order]
    way = F.when(F.lower(F.col(names[0])) == F.col("__n1"), 1).otherwise(2).alias("orientation")
    nearest = F.struct(F.col("__gap").alias("gap"), "event_date", "event_id", "contest_id", "entity1_id", "entity2_id", way)
    near = hits.groupBy(*order).agg(F.min(nearest).alias("m"), *[F.first(c).alias(c) for c in own])
    body = F.struct(*order, *own, *[F.col(f"m.{c}").alias(c) for c in ("orientation", "entity1_id", "entity2_id")])
    return near.groupBy(F.col("m.contest_id").alias("contest_id"), F.col("m.event_id").alias("event_id")).agg(F.min(body).alias("g")).select("contest_id", "event_id", "g.*")


def side_prices(matched: DataFrame, lines: DataFrame, names: tuple[str, str] = ("fighter", "opponent"), month: str = "month") -> DataFrame:
    """Two side rows per matched contest with both sides' prices and implied probabilities.

    The other side's own line is used when it exists. Otherwise opening and closing
    are fair complements, and the week price falls back to the other side's opening,
    which may itself be a complement.
    """
    a, b = names
    rev = lines.select(F.col(a).alias(b), F.col(b).alias(a), month, *[F.col(c).alias(f"o_{c}") for c in ("opening", "closing", "week")])
    m = matched.join(rev, [a, b, month], "left")
    other_open = F.coalesce("o_opening", complement_odds(F.col("opening")))
    m = m.withColumns({"o_closing": F.coalesce("o_closing", complement_odds(F.col("closing"))), "o_week": F.coalesce("o_week", other_open), "o_opening": other_open})

    def side(entity: Column, pre: str) -> Column:
        vals = []
        for c in ("opening", "closing", "week"):
            v = F.col(pre + c).cast("double")
            vals += [v.alias(c), implied_prob(v).alias(f"ip_{c}")]
        return F.struct(entity.alias("entity_id"), *vals)

    first = F.col("orientation") == 1
    me = F.when(first, F.col("entity1_id")).otherwise(F.col("entity2_id"))
    you = F.when(first, F.col("entity2_id")).otherwise(F.col("entity1_id"))
    return m.select("contest_id", "event_id", F.explode(F.array(side(me, ""), side(you, "o_"))).alias("s")).select("contest_id", "event_id", "s.*")


def vig_free(prices: DataFrame) -> DataFrame:
    """Implied probabilities scaled to sum to one per contest."""
    # a contest has two rows, so they meet in a window and the prices are not computed a second time for their totals
    keys, w = ["contest_id", "event_id"], Window.partitionBy("contest_id", "event_id")
    cols = ["ip_opening", "ip_closing", "ip_week"]
    out = prices.dropna(subset=keys).withColumns({f"__t_{c}": F.sum(c).over(w) for c in cols})
    return out.withColumns({c: F.when(F.col(f"__t_{c}") > 0, F.col(c) / F.col(f"__t_{c}")).otherwise(0.5) for c in cols}).drop(*[f"__t_{c}" for c in cols])


def monthly_lines(ticks: DataFrame, days: int = 7) -> DataFrame:
    """Lines of (fighter, opponent, month) with what matching and side prices read of them."""
    monthly = ticks.withColumn("month", F.date_format("ts", "yyyy-MM"))
    lines = line_points(monthly, ["fighter", "opponent", "month"], days=days, points=("opening", "closing_ts", "closing", "week")).withColumn("closing_date", F.to_date("closing_ts"))
    return lines.select("fighter", "opponent", "month", *LINE)


def odds_features(ticks: DataFrame, contests: DataFrame, tol: int = MATCH_DAYS, days: int = 7) -> DataFrame:
    """Ticks (fighter, opponent, ts, odds) to vig-free side prices: points, match, sides, shares."""
    lines = monthly_lines(ticks, days)
    return vig_free(side_prices(match_contests(lines, contests, tol), lines))


def similarity(a: Column, b: Column) -> Column:
    """Edit similarity in percent: 100 * (1 - levenshtein / longer length); Spark's own measure."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def token_key(c: Column) -> Column:
    """Lower-cased words in sorted order."""
    return F.array_join(F.array_sort(F.split(F.trim(F.lower(c)), r"\s+")), " ")


def blocks(names: DataFrame, threshold: float) -> DataFrame:
    """(k, g) of distinct strings ``k``: any two of at least ``threshold`` similarity share a ``g``.

    With L the longer length, such strings differ by at most (1 - t) L edits and so have (2t - 1) L - 1
    two-letter runs and t L letters in common, each counted as often as it occurs. Of strings that
    have c members in common, the rarest (size - c + 1) members of each have one in common, in any
    order that is the same for all; only these are kept, so frequent runs bring few strings
    together. Letters alone are needed where runs are too few, for strings that can meet a short one.
    """
    t, length = threshold / 100.0, F.length("k")
    if t <= 0.5:
        raise ValueError("a threshold over 50 is needed")
    least = int(1 / (2 * t - 1)) + 1

    def members(q: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), length - q + 1), lambda i: F.substring(F.col("k"), i, F.lit(q)))
        return F.transform(runs, lambda g, i: F.concat_ws(":", g, F.size(F.filter(F.slice(runs, F.lit(1), i), lambda x: x == g)).cast("string")))

    none = F.array().cast("array<string>")
    two, one = (length >= least) & (length >= 2), (length > 0) & (length < least / t)
    keep_two = length - F.ceil((2 * t - 1) * length - 1 - 1e-9)
    keep_one = length - F.ceil(t * length - 1e-9) + 1
    kinds = [(2, two, keep_two, members(2)), (1, one, keep_one, members(1))]
    each = F.array(*[F.struct(F.lit(q).alias("q"), keep.cast("int").alias("keep"), F.when(ok, m).otherwise(none).alias("m")) for q, ok, keep, m in kinds])
    rows = names.select("k", F.explode(each).alias("x")).select("k", "x.q", "x.keep", F.explode("x.m").alias("m"))
    often = rows.groupBy("q", "m").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("k", "q").orderBy("n", "m"))  # a name's own letters
    kept = rows.join(often, ["q", "m"]).withColumn("r", rank).filter("r <= keep")
    return kept.select("k", F.concat_ws("/", "q", "m").alias("g")).unionByName(names.filter(length == 0).select("k", F.lit("").alias("g")))


def alike(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of all strings ``k`` of two tables with at least ``threshold`` similarity, none lost."""
    left, right = left.select("k").distinct(), right.select("k").distinct()
    g = cut(blocks(cut(left.unionByName(right).distinct()), threshold))
    lg, rg = left.join(g, "k").withColumnRenamed("k", "a"), right.join(g, "k").withColumnRenamed("k", "b")
    size = F.least(F.length("a"), F.length("b")) >= F.greatest(F.length("a"), F.length("b")) * (threshold / 100.0) - 1e-9
    pairs = lg.join(rg, "g").filter(size).select("a", "b").distinct()
    return pairs.withColumn("score", similarity(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)


#: Edits up to which names are met by what is left after as many deletions, and the longest name that is done so.
EDITS, LONG = 2, 40
#: Then thresholds so far above the wanted one.
STEPS = (20.0, 10.0, 0.0)


def shortened(names: DataFrame, edits: int) -> DataFrame:
    """(k, g) of strings ``k``: hashes of all that is left of a string after up to ``edits`` deletions.

    Strings that differ by so many edits share one of these.
    """

    def less(s: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))

    left = F.array("k")
    for _ in range(edits):
        left = F.array_distinct(F.concat(left, F.flatten(F.transform(left, lambda x: F.when(F.length(x) > 0, less(x)).otherwise(F.array(x))))))
    return names.select("k", F.explode(left).alias("left")).select("k", F.xxhash64("left").alias("g"))


def within(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """(a, b) of all strings ``k`` of two tables, those of ``left`` up to LONG, that differ by up to ``edits`` edits."""
    l = left.select("k").filter(F.length("k") <= LONG).distinct()
    r = right.select("k").filter(F.length("k") <= LONG + edits).distinct()
    if not edits:
        return l.join(r, "k").select(F.col("k").alias("a"), F.col("k").alias("b"))
    pairs = shortened(l, edits).withColumnRenamed("k", "a").join(shortened(r, edits).withColumnRenamed("k", "b"), "g").select("a", "b").distinct()
    return pairs.filter(F.levenshtein("a", "b") <= edits)


def _beyond(name: Column, edits: int) -> Column:
    """The highest similarity that a string of more than ``edits`` edits can have."""
    return F.when(F.length(name) <= LONG, 100.0 * F.length(name) / (F.length(name) + edits + 1)).otherwise(100.0)


def _closest(left: DataFrame, right: DataFrame, threshold: float, matches: Callable, reach: Callable, top: Callable, names: list[str]) -> DataFrame:
    """``matches(left, pairs)`` of each row of ``left``, pairs of alike names taken from the closest on.

    ``matches`` returns the rows with the match ``m`` (null: none yet) and its ``score`` out of all that share one of
    ``pairs``. A row is done once nothing outside them can score as much (``reach(edits)``, ``top(threshold)``), so that only rows without a
    near match meet the many names that are somewhat alike. ``right`` holds the names (``k``) of the other side.
    """
    done = []
    plain = [*[(e, None) for e in range(EDITS + 1)], *[(None, threshold + s) for s in STEPS if not s or threshold + s < 100]]
    for edits, t in plain:
        mine = left.select(F.explode(F.array(*names)).alias("k"))
        pairs = within(mine, right, edits) if t is None else alike(mine, right, t).select("a", "b")
        found = cut(matches(left, pairs))
        if t is None:
            settled = (F.coalesce(F.col("score"), F.lit(0.0)) > reach(edits) + 1e-6) | (reach(edits) < top(threshold) - 1e-6)
        else:
            settled = F.col("score") >= top(t) if t > threshold else F.lit(True)
        settled = F.coalesce(settled, F.lit(False))
        done.append(found.filter(settled & F.col("m").isNotNull()))
        left = cut(found.filter(~settled).drop("m", "score"))
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def fuzzy_pairs(lines: DataFrame, contests: DataFrame, date: str, threshold: float = 70.0, days: int = 1, every: bool = False) -> DataFrame:
    """Pairs of names matched to contests up to ``days`` away by the better of two orientations.

    The score is the sum of both names' similarities and must reach twice the
    threshold; ties go to orientation 1. ``every`` returns all such contests, otherwise
    the best one, the smallest id on ties. One of the two names must reach the threshold by itself, so
    candidates are the names that do (see ``alike``) on neighbouring days; no pair is lost. For the best one
    the closest names come first (see ``_closest``).
    """
    kept = lines.columns
    f, o = F.lower(F.col("fighter")), F.lower(F.col("opponent"))
    lines = cut(lines.withColumns({"__id": F.monotonically_increasing_id(), "__f": f, "__o": o}))
    right = contests.filter("contest_id IS NOT NULL").select("contest_id", F.col("event_date").alias("__day"), F.lower("name1").alias("__n1"), F.lower("name2").alias("__n2"))
    right = cut(right.withColumn("__row", F.monotonically_increasing_id()))
    names = right.select(F.explode(F.array("__n1", "__n2")).alias("k")).distinct()
    there = right.select("*", F.explode(F.array_distinct(F.array("__n1", "__n2"))).alias("b"))

    def scored(left: DataFrame, pairs: DataFrame) -> DataFrame:
        near = left.select("__id", "__f", "__o", date, F.explode(F.array_distinct(F.array("__f", "__o"))).alias("a"))
        near = near.withColumn("__day", F.explode(F.array([F.date_add(date, d) for d in range(-days, days + 1)]))).drop(date)
        met = near.join(pairs, "a").join(there, ["__day", "b"])
        s1, s2 = (similarity(F.col("__f"), F.col(x)) + similarity(F.col("__o"), F.col(y)) for x, y in (("__n1", "__n2"), ("__n2", "__n1")))
        met = met.select("__id", "__row", "contest_id", s1.alias("s1"), s2.alias("s2"))
        return met.select("__id", "__row", "contest_id", F.greatest("s1", "s2").alias("score"), F.when(F.col("s1") >= F.col("s2"), 1).otherwise(2).alias("orientation")).filter(F.col("score") >= 2 * threshold)

    if every:
        found = scored(lines, alike(lines.select(F.explode(F.array("__f", "__o")).alias("k")), names, threshold).select("a", "b"))
        return lines.join(found.distinct(), "__id").select(*kept, "contest_id", "orientation", "score")

    def matches(left: DataFrame, pairs: DataFrame) -> DataFrame:
        best = F.max_by(F.struct("contest_id", "orientation"), F.struct("score", -F.col("contest_id")))
        return left.join(scored(left, pairs).groupBy("__id").agg(best.alias("m"), F.max("score").alias("score")), "__id", "left")

    out = _closest(lines, names, threshold, matches, lambda e: _beyond(F.col("__f"), e) + _beyond(F.col("__o"), e), lambda t: F.lit(2 * t), ["__f", "__o"])
    return out.select(*kept, "m.contest_id", "m.orientation", "score")


def name_map(left: DataFrame, right: DataFrame, threshold: float = 65.0) -> DataFrame:
    """Best right name per left name by similarity of the token-sorted forms; equal forms match first, the closest names next."""
    l = left.select(F.col("name").alias("left_name"), token_key(F.col("name")).alias("k")).distinct()
    r = cut(right.select(F.col("name").alias("right_name"), token_key(F.col("name")).alias("k")).distinct())

    def matches(left: DataFrame, pairs: DataFrame) -> DataFrame:
        scored = pairs.select("a", "b", similarity(F.col("a"), F.col("b")).alias("score")).filter(F.col("score") >= threshold)
        scored = scored.join(r.select("right_name", F.col("k").alias("b")), "b")
        best = scored.groupBy("a").agg(F.min_by(F.struct("right_name", "score"), F.struct(-F.col("score"), F.col("right_name"))).alias("m"))
        return left.join(best.select(F.col("a").alias("k"), "m", "m.score"), "k", "left")

    out = _closest(cut(l), r.select("k"), threshold, matches, lambda e: _beyond(F.col("k"), e), lambda t: F.lit(t), ["k"])
    return out.select("left_name", "m.right_name", "score")
