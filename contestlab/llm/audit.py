"""Filter interaction audit: paths are counted over the lattice of applied filters, per-order steps are its edges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, written

MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5

_CAPITALS = bytes(range(65, 91))
_OTHERS = bytes(sorted(set(range(256)) - set(_CAPITALS)))
_INSIDE = bytes(range(0x80, 0xC0))


def few_words(text: bytes, words: list[bytes]) -> bool:
    return len(words) < MIN_WORDS


def few_distinct(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < DISTINCT_PERCENT * len(words)


def many_capitals(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(text.translate(None, _OTHERS)) > CAPITAL_PERCENT * len(text.translate(None, _INSIDE))


def any_symbol(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, b"#$%&*|")) < len(text)


#: Filters on one text by their letter: true where a text (UTF-8 bytes, its words between ASCII blanks) fails.
CHECKS: dict[str, Callable[[bytes, list[bytes]], bool]] = {"A": few_words, "B": few_distinct, "C": many_capitals, "D": any_symbol}
#: The filter that fails texts which a smaller id has too.
REPEATED = "E"


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """For each set of applied filters (bits of its number): orders that reach it from none, and that lead from it to all."""
    full = (1 << n) - 1
    reaching, leaving = [1] + [0] * full, [0] * full + [1]
    for state in range(full + 1):
        for f in range(n):
            if not state >> f & 1:
                reaching[state | 1 << f] += reaching[state]
    for state in range(full, -1, -1):
        for f in range(n):
            if not state >> f & 1:
                leaving[state] += leaving[state | 1 << f]
    return reaching, leaving


def checked(docs: DataFrame, part_col: str, id_col: str, text_col: str, checks: dict[str, Callable]) -> DataFrame:
    """(rid, part, same, mask): failed checks as bits in their order, and a 128-bit digest of the text."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("rid"), part, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    tests = list(checks.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, mask = [], []
            for text in batch["text"]:
                text = text.as_py()
                words = text.split()
                same.append(blake2b(text, digest_size=16).digest())
                mask.append(sum(1 << i for i, fails in enumerate(tests) if fails(text, words)))
            yield pa.RecordBatch.from_arrays([batch["rid"], batch["part"], pa.array(same, pa.binary()), pa.array(mask, pa.int32())], ["rid", "part", "same", "mask"])

    return rows.mapInArrow(run, "rid long, part string, same binary, mask int")


def failures(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", checks: dict[str, Callable] | None = None) -> DataFrame:
    """(rid, part, mask, n): rows by their failed filters; the bit behind those of ``checks`` stands for REPEATED.

    Copies of a text meet only in an aggregate with partial sums: the join asks for the row that
    holds the smallest id, so its keys are (text, id) and a text of many rows is spread over them.
    """
    checks = CHECKS if checks is None else checks
    rows = written(checked(docs, part_col, id_col, text_col, checks), "checked")
    first = rows.groupBy("same").agg(F.min("rid").alias("rid")).withColumn("first", F.lit(True))
    rows = rows.groupBy("rid", "part", "same", "mask").agg(F.count(F.lit(1)).alias("n")).join(first, ["same", "rid"], "left")
    bit = F.when(F.col("first").isNull(), 1 << len(checks)).otherwise(0)
    return rows.select("rid", "part", F.col("mask").bitwiseOR(bit).alias("mask"), "n")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): sums of rows, rows marked good, rows marked toxic. Rows without an id have no labels."""
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("rid")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.filter(F.col("rid") != NULL_ID).join(marks, "rid", "left")
    every = known.unionByName(rows.filter(F.col("rid") == NULL_ID), allowMissingColumns=True)
    count = lambda flag: F.sum(F.when(F.col(flag) == 1, F.col("n")).otherwise(0)).alias(flag)
    return every.groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good"), count("toxic"))


def interactions(cells: DataFrame, filters: str) -> DataFrame:
    """The audit from (part, mask, n, good, toxic); ``filters`` names the bits of the mask, one letter each.

    A part's cells, at most 2^filters, are one row. From them comes what is kept in every state of
    the lattice; an edge removes the difference of its ends. An edge lies on as many orders as reach
    its start times as leave its end, which weighs it for the Shapley sum; a step of an order is an edge.
    """
    count, full = len(filters), (1 << len(filters)) - 1
    reaching, leaving = path_counts(count)
    per = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("n", "good", "toxic")])

    def total(test: Callable[[Column], Column]) -> Column:
        plus = lambda a, x: F.struct(*[(a[c] + x[c]).alias(c) for c in ("n", "good", "toxic")])
        return F.aggregate(F.filter("cells", lambda x: test(x["mask"])), none, plus)

    per = per.withColumn("kept", F.transform(F.sequence(F.lit(0), F.lit(full)), lambda s: total(lambda m: m.bitwiseAND(s) == 0)))
    bits = [1 << f for f in range(count)]
    kept = lambda s: F.col("kept")[s]

    def shapley(bit: int) -> Column:
        starts = [s for s in range(full + 1) if not s & bit]
        return sum((F.lit(reaching[s] * leaving[s | bit]) * (kept(s)["n"] - kept(s | bit)["n"]) for s in starts[1:]), F.lit(reaching[0] * leaving[bit]) * (kept(0)["n"] - kept(bit)["n"]))

    per = per.select(
        "part", "kept", F.array(*[total(lambda m, b=b: m.bitwiseAND(F.lit(b)) != 0)["n"] for b in bits]).alias("fails"),
        F.array(*[total(lambda m, b=b: m == b)["n"] for b in bits]).alias("alone"), F.array(*[shapley(b).cast("bigint") for b in bits]).alias("shapley"))
    state = lambda applied: sum(bits[f] for f in applied)
    steps = [("".join(filters[f] for f in order), t + 1, state(order[:t]), state(order[: t + 1]), f) for order in permutations(range(count)) for t, f in enumerate(order)]
    named = json.dumps([dict(zip(("filter_order", "step", "before", "after", "filter"), s)) for s in steps])
    rows = per.withColumn("s", F.explode(F.from_json(F.lit(named), "array<struct<filter_order:string,step:int,before:int,after:int,filter:int>>")))
    before, after = kept(F.col("s.before")), kept(F.col("s.after"))
    of = lambda name: F.col(name)[F.col("s.filter")]
    removed = before["n"] - after["n"]
    return rows.select(
        "part", "s.filter_order", "s.step", after["n"].alias("kept"), removed.alias("removed"), (of("fails") - removed).alias("redundant"), of("alone").alias("unique_fails"),
        (before["good"] - after["good"]).alias("good_lost"), (before["toxic"] - after["toxic"]).alias("toxic_lost"), of("shapley").alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text", checks: dict[str, Callable] | None = None) -> DataFrame:
    """One row per (part, order of all filters, step): what the step's filter does there.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), all counts of
    rows: kept after the step and removed by it, failing its filter but removed before, failing its
    filter alone, removed with a label quality = 1 or toxic = 1, and removed by its filter summed over
    all orders. Filters are ``checks`` and REPEATED, which fails a text that a smaller id has anywhere in the table.

    A null part is the empty one; a null or empty text has no words; a null id is the smallest and
    has no label; rows with equal id and text repeat each other's fate and count each; of several
    labels of an id any that is 1 counts; very long texts are read whole, by their own task; empty tables give no rows;
    other columns are not looked at. Equal texts are told by 128 bits of their digest.
    """
    checks = CHECKS if checks is None else checks
    return interactions(with_labels(failures(docs, part_col, id_col, text_col, checks), labels), "".join(checks) + REPEATED)
