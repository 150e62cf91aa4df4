"""Removal of repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, null_ids, row_key, texts, written
from .ragged import spread_ranges

LENGTH, GRAM = 100, 32
#: Starts that are parsed together in one text.
SEGMENT = 1 << 20
#: Documents of the sample that finds hot triggers, and how often one occurs there.
HOT_SAMPLE, HOT_COUNT = 50_000, 16

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(97).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    for i, x in enumerate((_BASE, _INVERSE)):
        while len(_POWERS[i]) < n:
            m = len(_POWERS[i])
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * np.uint64(pow(x, m, 1 << 64))])
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Rolling hashes of all substrings of a text of at most a segment and a string."""

    def __init__(self, raw: np.ndarray):
        self.up, down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[raw] * down[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes, whatever their place: powers count from the end of the segment's base."""
        return mixed((self.sums[stop] - self.sums[start]) * self.up[start] + (stop - start).astype(np.uint64))


def phrases(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, context, first start, number of starts) of the phrases of a text, by start.

    The trigger of a string of ``length`` bytes is its substring of ``gram`` bytes with the least
    rolling hash, the leftmost of equal ones; so equal strings have equal triggers at equal places.
    A phrase is a run of neighbouring strings with one trigger; it reaches from its first start to
    the end of its last string, which overlaps the next phrase. ``key`` is the trigger's hash,
    ``context`` that of the whole phrase.
    """
    parts = []
    for lo in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = raw[lo : lo + SEGMENT + length - 1]
        hashes = Hashes(part)
        grams = hashes.of(np.arange(len(part) - gram + 1), np.arange(gram, len(part) + 1))
        least = (grams & ~np.uint64((1 << 24) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if width > span:
            least = np.minimum(least[: -(width - span)], least[width - span :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        place = (at[first] - first).astype(np.uint64)
        parts.append((grams[at[first]], mixed(hashes.of(first, first + count + length - 1) + place), first + lo, count))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def firsts(key: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Whether no earlier entry has the same pair."""
    by = np.lexsort((np.arange(len(key)), context, key))
    k, c = key[by], context[by]
    out = np.ones(len(key), bool)
    out[by[1:]] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return out


def window_hashes(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for lo in range(0, max(0, len(raw) - length + 1), SEGMENT):
        here = (starts >= lo) & (starts < lo + SEGMENT)
        if here.any():
            hashes = Hashes(raw[lo : lo + SEGMENT + length - 1])
            out[here] = hashes.of(starts[here] - lo, starts[here] - lo + length)
    return out


#: Bits that a phrase's number of starts takes beside its context, and a text's hash beside the start.
COUNT_BITS, TEXT_BITS = 12, 31


def parsed(rows: DataFrame, length: int, gram: int, hot=None, want_hot: bool = False, with_again: bool = False) -> DataFrame:
    """The dictionary entries of each text, once a text: (key, entry, rid, place, again).

    ``entry`` holds the context and the number of starts, ``place`` the first start and the text's
    hash; four numbers a phrase are all that is shuffled of the parse. ``with_again`` adds the phrases that
    their own text has earlier, under keys of their own, as nothing more is asked of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = None if hot is None else hot.value
        for b in batches:
            for lo in range(0, len(b), 512):
                own, parts = b.iloc[lo : lo + 512], []
                for raw, rth in zip(own["raw"], own["rth"]):
                    key, start, count, entry = local_phrases(np.frombuffer(raw, np.uint8), length, gram)
                    keep = firsts(key, entry)
                    again = ~keep if with_again else np.zeros(len(key), bool)
                    if known is not None:
                        keep &= among(known, key) == want_hot
                    key = np.where(again, mixed(key ^ start.view(np.uint64)), key)
                    keep |= again
                    parts.append((key[keep], entry[keep], start[keep] << TEXT_BITS | int(rth), again[keep]))
                n = [len(p[0]) for p in parts]
                key, entry, place, again = (np.concatenate(x) for x in zip(*parts))
                yield pd.DataFrame({"key": key.view(np.int64), "entry": entry.view(np.int64), "rid": np.repeat(own["rid"].to_numpy(), n), "place": place, "again": again})

    return rows.select("rid", "rth", "raw").mapInPandas(run, "key bigint, entry bigint, rid bigint, place bigint, again boolean")


def local_phrases(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, count, entry) of a text's phrases."""
    key, context, start, count = phrases(raw, length, gram)
    return key, start, count, context >> np.uint64(COUNT_BITS) << np.uint64(COUNT_BITS) | count.astype(np.uint64)


def among(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def hot_keys(rows: DataFrame, n_rows: int, length: int, gram: int, sample: int = HOT_SAMPLE, count: int = HOT_COUNT) -> np.ndarray:
    """Triggers of a large share of the texts, from a sample of fixed size. They only decide on which
    of two ways, with equal results, a phrase is compared; there are at most sample / count a phrase of a text."""
    draw = F.pmod(F.xxhash64("rid", "rth"), F.lit(1 << 30)) / float(1 << 30)
    some = rows.filter(draw < sample / max(1, n_rows))
    found = parsed(some, length, gram).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


def compared(rows: DataFrame, hot, length: int, gram: int) -> DataFrame:
    """(rid, rth, start, count, open, key) of phrases that occur earlier whole (not open), or
    that share their trigger with other phrases and must be compared string by string (open)."""
    usual = parsed(rows, length, gram, hot, with_again=True)
    by_key, by_phrase = Window.partitionBy("key"), Window.partitionBy("key", "entry")
    usual = usual.withColumns({"n": F.count(F.lit(1)).over(by_key), "lo": F.min("entry").over(by_key), "hi": F.max("entry").over(by_key)}).filter("n > 1 OR again")
    usual = usual.withColumn("first", F.min("rid").over(by_phrase)).withColumn("many", F.col("lo") != F.col("hi"))
    common = parsed(rows, length, gram, hot, want_hot=True)
    entries = written(common.groupBy("key", "entry").agg(F.min("rid").alias("first")), "entries")
    many = entries.groupBy("key").agg((F.count(F.lit(1)) > 1).alias("many"))
    common = common.join(entries.join(many, "key"), ["key", "entry"])
    columns = ["rid", F.col("place").bitwiseAND(F.lit((1 << TEXT_BITS) - 1)).cast("int").alias("rth"), F.shiftright("place", TEXT_BITS).alias("start"), F.col("entry").bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int").alias("count"), (~F.col("again") & (F.col("rid") == F.col("first"))).alias("open"), "key"]
    chosen = F.col("again") | F.col("many") | (F.col("rid") > F.col("first"))
    return usual.filter(chosen).select(*columns).unionByName(common.filter(chosen).select(*columns))


def repeated(key: np.ndarray, content: np.ndarray, rid: np.ndarray, rth: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which strings have an equal one in a smaller id, or earlier in the same text; equal: key and content."""
    by = np.lexsort((start, rth, rid, content, key))
    k, c, i, t = key[by], content[by], rid[by], rth[by]
    same = np.concatenate([[False], (k[1:] == k[:-1]) & (c[1:] == c[:-1])])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    out = np.zeros(len(by), bool)
    out[by] = (i > i[head]) | (same & np.concatenate([[False], (i[1:] == i[:-1]) & (t[1:] == t[:-1])]))
    return out


def runs(rid: np.ndarray, rth: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Neighbouring starts of a text as (rid, rth, start, count)."""
    by = np.lexsort((start, rth, rid))
    rid, rth, start = rid[by], rth[by], start[by]
    new = np.concatenate([[True], (rid[1:] != rid[:-1]) | (rth[1:] != rth[:-1]) | (start[1:] != start[:-1] + 1)]) if len(by) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return pd.DataFrame({"rid": rid[at], "rth": rth[at], "start": start[at], "count": np.diff(np.append(at, len(by))).astype(np.int32)})


SPAN = "rid bigint, rth int, start bigint, count int"


def resolved(packed: DataFrame, open_: DataFrame, hot, length: int, gram: int) -> DataFrame:
    """(rid, rth, start, count) of strings of open phrases that occur earlier."""
    per = open_.groupBy("rid", "rth").agg(F.collect_list("start").alias("s"), F.collect_list("count").alias("c"), F.collect_list("key").alias("k"))

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = {"key": np.int64, "hash": np.int64, "rid": np.int64, "rth": np.int32, "start": np.int64, "count": np.int32}
        for b in batches:
            usual, hot_parts = [], []
            for rid, rth, z, s, c, k in zip(b["rid"], b["rth"], b["z"], b["s"], b["c"], b["k"]):
                raw, s, c, k = unpacked(z), np.asarray(s, np.int64), np.asarray(c, np.int64), np.asarray(k, np.int64).view(np.uint64)
                by = np.argsort(s)
                s, c, k = s[by], c[by], k[by]
                is_hot = among(hot.value, k)
                usual += [(x, None, rid, rth, a, n, raw[a : a + n + length - 1].tobytes()) for x, a, n in zip(k[~is_hot].view(np.int64).tolist(), s[~is_hot].tolist(), c[~is_hot].tolist())]
                if is_hot.any():
                    s, c, k = s[is_hot], c[is_hot], k[is_hot]
                    at = spread_ranges(s, c)
                    hot_parts.append((np.repeat(k, c), window_hashes(raw, at, length), np.full(len(at), rid), np.full(len(at), rth), at))
            if usual:
                yield pd.DataFrame(usual, columns=[*columns, "content"]).astype({"key": np.int64, "count": np.int32, "rth": np.int32})
            if hot_parts:
                key, h, rid, rth, at = (np.concatenate(x) for x in zip(*hot_parts))
                gone = repeated(key, h, rid, rth, at)  # already within this batch
                known = runs(rid[gone], rth[gone], at[gone])
                yield pd.DataFrame({"key": None, "hash": None, **known, "content": None})[[*columns, "content"]]
                left = ~gone
                yield pd.DataFrame({"key": key[left].view(np.int64), "hash": h[left].view(np.int64), "rid": rid[left], "rth": rth[left].astype(np.int32), "start": at[left], "count": np.int32(1), "content": None})

    def strings(rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["content"].map(len).to_numpy() - length + 1
        raw = np.frombuffer(b"".join(rows["content"]), np.uint8)
        first = np.cumsum(size + length - 1) - (size + length - 1)
        at = spread_ranges(first, size)
        h = window_hashes(raw, at, length)
        key, rid, rth = (np.repeat(rows[c].to_numpy(), size) for c in ("key", "rid", "rth"))
        start = spread_ranges(rows["start"].to_numpy(), size)
        gone = repeated(key, h, rid, rth, start)
        return runs(rid[gone], rth[gone], start[gone])

    def by_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the rows of the last key, which may go on in the next batch
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            last = b["key"].to_numpy() == b["key"].iloc[-1]
            held = b[last]
            if not last.all():
                yield strings(b[~last])
        if held is not None:
            yield strings(held)

    found = packed.join(per, ["rid", "rth"]).mapInPandas(contents, f"key bigint, hash bigint, {SPAN}, content binary")
    found = written(found, "strings")
    usual = found.filter("content is not null").select("key", "rid", "rth", "start", "content").repartition("key").sortWithinPartitions("key")
    common = found.filter("hash is not null").withColumn("first", F.min("rid").over(Window.partitionBy("key", "hash"))).filter("rid > first")
    spans = ["rid", "rth", "start", "count"]
    return usual.mapInPandas(by_key, SPAN).unionByName(common.select(spans)).unionByName(found.filter("key is null").select(spans))


def marked(n: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, stops, -1)
    return np.cumsum(depth[:-1]) > 0


RESULT = "rid bigint, rth int, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def unpacked(z: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8)


def packed_rows(rows: DataFrame) -> DataFrame:
    """(rid, rth, z): texts compressed before they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pd.DataFrame({"rid": b["rid"], "rth": b["rth"], "z": [c.compress(x) for x in b["raw"]]})

    return rows.select("rid", "rth", "raw").mapInPandas(run, "rid bigint, rth int, z binary")


def kept_text(raw: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters all of whose bytes are gone."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first bytes of characters
    if not len(lead):
        return ""
    whole = np.logical_and.reduceat(gone, lead)
    return raw[~np.repeat(whole, np.diff(np.append(lead, len(raw))))].tobytes().decode("utf-8", "replace")


def removed_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """``rows`` (rid, rth int, raw) to (rid, rth, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    hot = rows.sparkSession.sparkContext.broadcast(hot_keys(rows, rows.count(), length, gram))
    packed = packed_rows(rows)
    found = written(compared(rows, hot, length, gram), "phrases")
    spans = found.filter("not open").drop("open", "key").unionByName(resolved(packed, found.filter("open"), hot, length, gram))
    per = spans.groupBy("rid", "rth").agg(F.collect_list("start").alias("s"), F.collect_list("count").alias("c"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 512):
                out = []
                for r in b.iloc[lo : lo + 512].itertuples():
                    raw = unpacked(r.z)
                    starts, counts = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (r.s, r.c))
                    gone = marked(len(raw), starts, starts + counts + length - 1)
                    edges = np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) > 0)
                    out.append((r.rid, r.rth, len(raw), int(gone.sum()), edges, hashlib.sha256(raw[~gone].tobytes()).hexdigest()) + ((kept_text(raw, gone),) if with_text else ()))
                yield pd.DataFrame(out, columns=["rid", "rth", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    return packed.join(per, ["rid", "rth"], "left").mapInPandas(run, RESULT + (", kept string" if with_text else ""))


def byte_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return texts(docs, id_col, text_col).select(*row_key(), F.col("text").cast("binary").alias("raw")).withColumn("rth", F.expr("cast(rth & 2147483647 as int)"))


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    Each byte covered by a string of ``length`` bytes that also starts earlier (in a smaller id, or
    earlier in the same document) is removed, judged on the input.

    The texts are parsed into phrases at rolling-hash triggers. A dictionary entry is a phrase's
    content; the parse of the corpus is its phrases by (id, start). A phrase whose entry occurs
    in an earlier place goes whole. Only where entries share a trigger but differ, which happens at
    the ends of repeated passages, are the entries' strings of ``length`` bytes (the truncated
    suffixes that a suffix array of the dictionary would sort) brought together by key and hash,
    and all but the earliest marked.

    Strings are equal if their trigger and a 64-bit hash of all their bytes are. Very long texts are parsed
    in overlapping segments, whole. A null or empty text has no bytes; texts shorter than ``length`` lose none; a null id is the
    smallest; rows of equal id are not earlier than one another, so repeated rows have equal
    results; an empty table gives no rows; other columns are not looked at.
    """
    out = removed_spans(byte_rows(docs, id_col, text_col), length, gram)
    return null_ids(out.withColumn("doc_id", F.col("rid"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text_col``; all other columns stay.

    A character goes only if all its bytes do. Null texts stay null.
    """
    cut = removed_spans(byte_rows(docs, id_col, text_col), length, gram, with_text=True).select("rid", "rth", "kept").dropDuplicates(["rid", "rth"])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("rid"), (F.xxhash64(text).bitwiseAND(F.lit(2147483647))).cast("int").alias("rth")]
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*key, F.col(text_col).isNull().alias("no_text"), F.struct(*others).alias("doc")).join(cut, ["rid", "rth"])
    return rows.select("doc.*", F.when(~F.col("no_text"), F.col("kept")).alias(text_col)).select(*docs.columns)
