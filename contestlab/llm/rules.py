"""Quality rules whose cutoffs come with a bound on false rejections. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import written

#: White space that separates words.
BLANKS = " \t\n\x0b\f\r"
#: Largest share of good documents that all rules together may reject in a stratum, and the
#: probability that any of the stated bounds is wrong.
RISK, ERROR = 0.05, 0.05
MIN_WORDS, REPEAT_PERCENT = 50, 50


@dataclass(frozen=True)
class Rule:
    """Rejects where ``sign * num >= sign * cutoff * den``. Cutoffs run from mild to strict."""

    name: str
    num: str
    den: str
    sign: int
    cutoffs: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols", "n_words", 1, (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    Rule("bangs", "n_bangs", "n_words", 1, (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    Rule("capitals", "n_capitals", "word_chars", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)),
    Rule("dup_lines", "n_dup_lines", "n_lines", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1)),
    Rule("repeats", "n_repeat_words", "n_words", 1, (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("long_words", "word_chars", "n_words", 1, (40.0, 30.0, 20.0, 16.0, 14.0, 12.0, 10.0)),
    Rule("short_words", "word_chars", "n_words", -1, (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)),
)

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_capitals"]


def count_of(text: str, pattern: str) -> Column:
    return F.regexp_count(F.col(text), F.lit(pattern)).cast("bigint")


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the columns MEASURES, from whole texts. Expects no such names in ``docs``.

    Windows of three words are compared by 64-bit hashes, inside one text only. All work on a
    text stays in its row: hashes with positions are sorted, equal neighbours are repeated
    windows, and the words they cover are the gaps between their sorted positions, three at most.
    """
    x = docs.withColumn("__t", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    bare = F.btrim("__t", F.lit(BLANKS))
    x = x.withColumn("__w", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{BLANKS}]+")))
    x = x.withColumn("__l", F.filter(F.split("__t", "\n"), lambda s: F.btrim(s, F.lit(BLANKS)) != ""))
    x = x.withColumn("n_words", F.size("__w").cast("bigint"))
    w = F.col("__w")
    window = lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("i"))
    x = x.withColumn("__s", F.when(F.col("n_words") >= 4, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))))
    s = F.col("__s")
    again = lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["h"] == s[j]["h"]))
    found = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), again), lambda j: s[j]["i"]))
    x = x.withColumn("__p", F.when(s.isNotNull(), found))
    p = F.col("__p")
    covered = F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(3))).cast("bigint").alias("n")), lambda a: a["n"])
    return x.withColumns({
        "word_chars": F.length(F.array_join(w, "")).cast("bigint"),
        "n_symbols": count_of("__t", "[#*$%&|<>]"),
        "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("bigint")),
        "n_lines": F.size("__l").cast("bigint"),
        "n_bangs": count_of("__t", "!"),
        "n_capitals": count_of("__t", r"\p{Lu}"),
    }).drop("__t", "__w", "__l", "__s", "__p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def level(rule: Rule) -> Column:
    """How many of the rule's cutoffs reject the row; cutoffs are nested."""
    hit = [F.when(rule.sign * F.col(rule.num) >= F.lit(rule.sign * c) * F.col(rule.den), 1).otherwise(0) for c in rule.cutoffs]
    return sum(hit[1:], hit[0])


def log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series for n + 8, stepped down; the error is below 1e-9."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    down = F.log(n + 1.0)
    for i in range(2, 9):
        down = down + F.log(n + float(i))
    return series - down


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p) where k <= n p, else 1: the largest term and its falling ratios."""
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    terms = F.least(k, (F.lit(60) + 14 * F.sqrt(n * p)).cast("bigint"))
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] * (k - i) / (n - k + 1 + i) * ((1 - p) / p)
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"))

    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), terms), one, step, lambda a: a["s"])
    return F.when(k > n * p, F.lit(1.0)).otherwise(F.exp(top) * total)


def cutoffs(rows: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, least array<int>): per rule the level from which a row is rejected, null for none.

    ``rows`` hold doc_id, stratum, base_failed and MEASURES. The labelled good rows that pass the
    base rules are the holdout of their stratum. A rule may reject a share of ``risk`` over the
    number of rules. Its cutoffs are tested from mild to strict; a cutoff stands if the exact
    binomial probability of so few rejections, were the true share higher, is at most ``error``
    over the number of (stratum, rule) pairs. The order is fixed and rejections are nested, so
    the cutoffs of one rule need no further correction.
    """
    good = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("q")).groupBy("doc_id").agg(F.min("q").alias("q")).filter("q = 1")
    held = rows.filter(~F.col("base_failed")).join(good, "doc_id")
    held = held.select("stratum", F.posexplode(F.array(*[level(r) for r in rules])).alias("rule", "level"))
    counted = held.groupBy("stratum", "rule", "level").agg(F.count(F.lit(1)).alias("n"))
    per = cut(counted.groupBy("stratum", "rule").agg(F.sum("n").alias("all"), F.collect_list(F.struct("level", "n")).alias("levels")))  # strata x rules
    tests = max(1, per.count())
    steps = F.array(*[F.lit(len(r.cutoffs)) for r in rules])
    at = per.withColumn("least", F.explode(F.sequence(F.lit(1), steps[F.col("rule")])))
    k = F.aggregate(F.filter("levels", lambda x: x["level"] >= F.col("least")), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    at = at.withColumn("k", k)
    passed = at.filter(binomial_tail(F.col("k"), F.col("all"), risk / len(rules)) <= error / tests)
    least = passed.groupBy("stratum", "rule").agg(F.min("least").alias("least"))
    least = least.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "least"))).alias("m"))
    return least.select("stratum", F.transform(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda i: F.try_element_at("m", i)).alias("least"))


def judged(rows: DataFrame, found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``kept`` and ``rejected_by`` (names of the rules, in order) to measured rows with ``stratum``."""
    rows = rows.join(found, "stratum", "left")
    names = F.array(*[F.when(level(r) >= F.col("least")[i], F.lit(r.name)) for i, r in enumerate(rules)])
    rows = rows.withColumn("rejected_by", F.array_join(F.array_compact(F.when(F.col("base_failed"), F.array(F.lit("base"))).otherwise(names)), ","))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == "")).drop("least")


def stratum_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("stratum")


def learned(docs: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, risk: float = RISK, error: float = ERROR) -> tuple[DataFrame, DataFrame]:
    """Measured narrow rows (doc_id, stratum, MEASURES, base_failed), written once, and the cutoffs from them."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), stratum_of(stratum), F.col(text_col).alias("text"))
    rows = measured(rows).select("doc_id", "stratum", *MEASURES, base_failed().alias("base_failed"))
    rows = written(rows, "measures")
    return rows, written(cutoffs(rows, labels, rules, risk, error), "cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: (doc_id, MEASURES, base_failed, kept, rejected_by, stratum).

    The base rules hold always. The other rules get their cutoffs from the labelled documents, so
    that in each stratum no more than RISK of the good documents are rejected by them, with
    probability 1 - ERROR over all statements; a stratum with too few labels to show this has no
    cutoffs and its documents are judged by the base rules alone.

    A null text has no words and fails the base rules; a null stratum is a stratum of its own; a
    null or unlabelled id is judged like any other; several labels of one id count as good only
    if all are; repeated rows are judged each; empty tables of documents or labels are allowed;
    other columns are not looked at. Options as for ``learned``.
    """
    rows, found = learned(docs, labels, **options)
    return judged(rows, found, options.get("rules", RULES)).select("doc_id", *MEASURES, "base_failed", "kept", "rejected_by", "stratum")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text", **options) -> DataFrame:
    """The documents that the rules keep, with their own columns; texts are measured again where
    they are, which costs less than shuffling them to their verdicts."""
    found = learned(docs, labels, stratum=stratum, text_col=text_col, **options)[1]
    own = docs.select(F.struct("*").alias("doc"), F.col(text_col).alias("text"), stratum_of(stratum))
    rows = measured(own).withColumn("base_failed", base_failed())
    # one condition over both sides of the join: parts of it must not move below, where each use would measure anew
    return judged(rows, found, options.get("rules", RULES)).filter("rejected_by = ''").select("doc.*")
