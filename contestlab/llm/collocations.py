"""Phrase collocations: frequency-ranked ids, pairs counted in direct-addressed tiles, frequent pairs ranked anew."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LONGEST, MIN_COUNT, SHARE, TOP = 5, 100, 100, 2000
#: Bytes of text that are numbered together; a text is never cut.
SLICE_BYTES = 1 << 22
#: Ids on either side of a tile, and the pairs it must hold to be counted in a dense array.
TILE_BITS, DENSE_PAIRS = 10, 1 << 15
#: Pairs of a bucket, about: buckets part the pairs of one length among tasks.
BUCKET_PAIRS = 1 << 20
#: Parts in which the best phrases of a language are chosen before they are ranked.
PARTS = 32

#: Signs that end a piece become a full stop, the tab a blank; words are then what blanks leave.
_SIGNS = bytes.maketrans(b"\t,;:!?\n\x0b\x0c\r", b" .........")

_PACK = pa.struct([("bucket", pa.int64()), ("data", pa.binary()), ("words", pa.binary())])
_STATE = "slice long, lang string, n long, ids binary, packs array<struct<bucket:long,data:binary,words:binary>>"
_FOUND = "slice long, data binary, lang string, word string, first long, second long, f long, id long"


def squeezed(*columns: np.ndarray) -> bytes:
    """Whole numbers of equal length from 0 on: bytes of a place in one run, so that leading zeros cost nothing."""
    out = [len(columns[0]).to_bytes(8, "little")]
    for x in columns:
        x = x.astype("<u4" if x.max(initial=0) < 1 << 32 else "<u8")
        out += [bytes([x.itemsize]), np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def loosened(data: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for _ in range(columns):
        unit = raw[at]
        x = np.frombuffer(raw, np.uint8, n * unit, at + 1).reshape(unit, n).T
        out.append(np.ascontiguousarray(x).view(f"<u{unit}").reshape(n).astype(np.int64))
        at += 1 + n * unit
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Rising numbers as differences."""
    return np.diff(x, prepend=0)


def numbered(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words by falling count, their counts, and the texts as numbers of words (from 1; 0 between pieces)."""
    tokens = b"\n".join(texts).lower().translate(_SIGNS).replace(b".", b" . ").split()
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    ids, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    counts = np.bincount(ids, minlength=len(words))
    stop = np.array([w == b"." for w in words.to_pylist()], bool)
    counts[stop] = 0
    order = np.argsort(-counts, kind="stable")[: len(words) - int(stop.sum())]
    rank = np.zeros(len(words), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return words.take(pa.array(order)), counts[order], rank[ids]


def joined(ids: np.ndarray) -> np.ndarray:
    """Without what has no neighbour; a single 0 between runs."""
    has = ids > 0
    side = np.concatenate([[False], has, [False]])
    keep = has & (side[:-2] | side[2:])
    after = np.concatenate([[False], keep[:-1]])
    return np.where(keep, ids, 0)[keep | after]


def tiled_pairs(a: np.ndarray, b: np.ndarray, bits: int = TILE_BITS, dense: int = DENSE_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ranks (first, second, count), and for each given pair its number among them.

    Ranks are dealt into square tiles. As low ranks are frequent ones, few tiles hold most pairs:
    these are counted by direct address in a dense array, all others as sorted coordinates.
    """
    side = int(max(a.max(initial=0), b.max(initial=0)) >> bits) + 1
    tile = (a >> bits) * side + (b >> bits)
    cell = ((a & ((1 << bits) - 1)) << bits) | (b & ((1 << bits) - 1))
    order = np.argsort(tile, kind="stable")
    edges = np.flatnonzero(np.diff(tile[order], prepend=-1, append=-1))
    firsts, seconds, counts, number, sparse, upto = [], [], [], np.empty(len(a), np.int64), [], 0
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi - lo < dense:
            sparse.append(order[lo:hi])
            continue
        at = order[lo:hi]
        n = np.bincount(cell[at], minlength=1 << 2 * bits)
        used = np.flatnonzero(n)
        place = np.zeros(1 << 2 * bits, np.int64)
        place[used] = np.arange(upto, upto + len(used))
        number[at] = place[cell[at]]
        t = int(tile[at[0]])
        firsts.append((t // side << bits) + (used >> bits))
        seconds.append((t % side << bits) + (used & ((1 << bits) - 1)))
        counts.append(n[used])
        upto += len(used)
    if sparse:
        at = np.concatenate(sparse)
        width = side << bits
        pairs, where, n = np.unique(a[at] * width + b[at], return_inverse=True, return_counts=True)
        number[at] = upto + where
        firsts.append(pairs // width)
        seconds.append(pairs % width)
        counts.append(n)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *seconds]), np.concatenate([none, *counts]), number


def advanced(ids: np.ndarray, slots: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Next state of a slice: its phrases (by slot, 0 between runs) take the ids of the frequent ones among
    them, and neighbours that overlap in all but one word become the slots of the next length."""
    known = np.sort(names)
    near = np.zeros(max(int(ids.max(initial=0)), int(slots.max(initial=0)) + 1) + 1, np.int64)
    near[slots + 1] = np.searchsorted(known, names) + 1  # rank among the ids met here: low ids are frequent
    x = near[ids]
    both = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
    first, second, n, number = tiled_pairs(x[both] - 1, x[both + 1] - 1)
    state = np.zeros(len(x), np.int64)
    state[both] = number + 1
    return state, known[first], known[second], n


def parted(bucket: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of each bucket that is met, places in the given order."""
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(bucket[order[lo]]), order[lo:hi]


def pair_packs(state: np.ndarray, first: np.ndarray, second: np.ndarray, n: np.ndarray, buckets: int) -> tuple[np.ndarray, list[dict]]:
    """The state with slots in the order of buckets, and each bucket's pairs, sorted."""
    mixed = (first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    bucket = (((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.lexsort((second, first, bucket))
    place = np.zeros(len(order) + 1, np.int64)
    place[order + 1] = np.arange(1, len(order) + 1)
    packs = [{"bucket": b, "data": squeezed(steps(place[at + 1] - 1), n[at], steps(first[at]), second[at]), "words": None} for b, at in parted(bucket, order)]
    return place[state], packs


def word_packs(words: pa.Array, counts: np.ndarray, buckets: int) -> list[dict]:
    """Each bucket's words with their slots and counts."""
    listed = words.to_pylist()
    bucket = np.fromiter(map(zlib.crc32, listed), np.int64, len(listed)) % buckets
    pack = lambda at: zstandard.ZstdCompressor(level=1).compress(b"\n".join([listed[i] for i in at]))
    return [{"bucket": b, "data": squeezed(steps(at), counts[at]), "words": pack(at)} for b, at in parted(bucket, np.argsort(bucket, kind="stable"))]


def state_row(number: int, lang: str, n: int, ids: np.ndarray, packs: list[dict]) -> pa.RecordBatch:
    values = [pa.array([number], pa.int64()), pa.array([lang], pa.string()), pa.array([n], pa.int64()), pa.array([squeezed(joined(ids))], pa.binary()), pa.array([packs], pa.list_(_PACK))]
    return pa.RecordBatch.from_arrays(values, ["slice", "lang", "n", "ids", "packs"])


def slices(docs: DataFrame, lang_col: str, text_col: str, size: int, buckets: int) -> DataFrame:
    """One row per slice and language: number of words, the text as slots of its words, and the words by buckets."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang")
    rows = docs.select(lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held, bytes_held = TaskContext.get().partitionId() << 32, {}, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal made
            for name in list(held):
                words, counts, ids = numbered(held.pop(name))
                if len(words):
                    yield state_row(made, name, int(counts.sum()), ids, word_packs(words, counts, buckets))
                made += 1

        for batch in batches:
            for name, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                held.setdefault(name, []).append(text)
                bytes_held += len(text)
                if bytes_held >= size:
                    yield from out()
                    bytes_held = 0
        yield from out()

    return rows.mapInArrow(run, _STATE)


def next_length(state: DataFrame, marks: DataFrame, buckets: int) -> DataFrame:
    """``marks`` (slice, data): slots and ids of the frequent phrases of each slice, by buckets."""
    rows = state.select("slice", "lang", "ids").join(marks.groupBy("slice").agg(F.collect_list("data").alias("marks")), "slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, lang, ids, marks in zip(*[batch[c].to_pylist() for c in ("slice", "lang", "ids", "marks")]):
                slots, names = (np.concatenate(x) for x in zip(*[(np.cumsum(s), i) for s, i in (loosened(m, 2) for m in marks)]))
                state, first, second, n = advanced(loosened(ids, 1)[0], slots, names)
                if len(n):
                    yield state_row(number, lang, int(n.sum()), *pair_packs(state, first, second, n, buckets))

    return rows.mapInArrow(run, _STATE)


def counted(state: DataFrame, min_count: int, buckets: int, words: bool) -> DataFrame:
    """The frequent words or pairs of all slices: rows of marks (slice, data), and of phrases (lang, word or first and second, f, id).

    A bucket is summed in one task, from one entry of each slice that has the phrase. Ids run over the
    buckets by falling count, so that low ids are frequent phrases.
    """
    rows = state.select("slice", "lang", F.explode("packs").alias("p")).select("slice", "lang", "p.*")

    def run(table: pa.Table) -> pa.Table:
        bucket, owners, langs = table["bucket"][0].as_py(), table["slice"].to_pylist(), table["lang"].to_pylist()
        packs = [loosened(d, 2 if words else 4) for d in table["data"].to_pylist()]
        lengths = np.array([len(p[0]) for p in packs])
        row = np.repeat(np.arange(len(packs)), lengths)
        if words:
            coded = pa.array([w for x in table["words"].to_pylist() for w in zstandard.ZstdDecompressor().decompress(x).split(b"\n")], pa.binary()).dictionary_encode()
            names, first = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            known = sorted(set(langs))
            others, second = np.arange(len(known)), np.repeat(np.searchsorted(known, langs), lengths)
        else:
            names, first = np.unique(np.concatenate([np.cumsum(p[2]) for p in packs]), return_inverse=True)
            others, second = np.unique(np.concatenate([p[3] for p in packs]), return_inverse=True)
        phrases, where = np.unique(first * len(others) + second, return_inverse=True)
        f = np.zeros(len(phrases), np.int64)
        np.add.at(f, where, np.concatenate([p[1] for p in packs]))
        chosen = np.flatnonzero(f >= min_count)
        chosen = chosen[np.argsort(-f[chosen], kind="stable")]
        ids = np.full(len(phrases), -1, np.int64)
        ids[chosen] = np.arange(len(chosen)) * buckets + bucket
        found = np.flatnonzero(ids[where] >= 0)
        slots = np.concatenate([np.cumsum(p[0]) for p in packs])
        out: dict[str, list] = {c: [] for c in ("slice", "data", "lang", "word", "first", "second", "f", "id")}

        def add(**values) -> None:
            for c in out:
                out[c].append(values.get(c))

        for r, at in parted(row, found):
            add(slice=owners[r], data=squeezed(steps(slots[at]), ids[where[at]]))
        lang_of = dict(zip(where[found].tolist(), row[found].tolist()))
        for i in chosen.tolist():
            a, b = divmod(int(phrases[i]), len(others))
            key = {"word": names[a].as_py().decode("utf-8", "replace")} if words else {"first": int(names[a]), "second": int(others[b])}
            add(lang=langs[lang_of[i]], f=int(f[i]), id=int(ids[i]), **key)
        kinds = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    return rows.groupBy("bucket").applyInArrow(run, _FOUND)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Rows that may hold megabytes each: the writer looks at its buffers after every row."""
    checks = {"parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
    return written(df, label, checks | {"parquet.block.size": str(16 << 20)})


def lengths(docs: DataFrame, lang_col: str, text_col: str, longest: int, min_count: int, size: int) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and, for each length, its frequent phrases: (lang, id, f) with ``word``, or the ids ``first`` and
    ``second`` of the phrases without the last and the first word. Ids start anew with each length."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = stored(slices(docs, lang_col, text_col, size, buckets), "slices")
    totals = written(state.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    found = []
    for length in range(1, longest + 1):
        both = stored(counted(state, min_count, buckets, length == 1), "phrases")
        found.append(both.filter("slice IS NULL").select("lang", "f", "id", *(["word"] if length == 1 else ["first", "second"])))
        if length == 1:
            buckets = max(buckets, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_PAIRS)
        if length < longest:
            state = stored(next_length(state, both.filter("slice IS NOT NULL").select("slice", "data"), buckets), "state")
    return totals, found


def phrased(found: list[DataFrame]) -> list[DataFrame]:
    """Per length (lang, id, f, phrase, last, heads, tails): the counts of its first and last 1, 2, ... words, itself left out."""
    counts = F.array().cast("array<bigint>")
    out = [found[0].select("lang", "id", "f", F.col("word").alias("phrase"), F.col("word").alias("last"), counts.alias("heads"), counts.alias("tails"))]
    for grams in found[1:]:
        a = out[-1].select(F.col("id").alias("first"), F.col("phrase").alias("a_phrase"), F.concat("heads", F.array("f")).alias("heads"))
        b = out[-1].select(F.col("id").alias("second"), "last", F.concat("tails", F.array("f")).alias("tails"))
        out.append(written(grams.join(a, "first").join(b, "second").select("lang", "id", "f", F.concat_ws(" ", "a_phrase", "last").alias("phrase"), "last", "heads", "tails"), "phrases"))
    return out


def whole(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def scored(phrases: DataFrame, totals: DataFrame, length: int) -> DataFrame:
    """Add ``cut`` (score, k, l, r) of the worst cut, the first of equal ones, in whole numbers of 38 digits."""
    cuts = []
    for k in range(1, length):
        l, r = F.col("heads")[k - 1], F.col("tails")[length - k - 1]  # noqa: E741
        score = F.call_function("div", whole(F.lit(1000)) * whole(F.col("f")) * whole(F.col("n")), whole(l) * whole(r))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    return phrases.join(totals, "lang").withColumn("cut", F.array_min(F.array(*cuts)))


def top_rows(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with ``rank``: chosen in parts first, so that no task ranks a whole key."""
    part = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(PARTS)))
    part = part.withColumn("__r", F.row_number().over(Window.partitionBy(*key, "__part").orderBy(*order))).filter(F.col("__r") <= n).drop("__r", "__part")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, min_count: int = MIN_COUNT, share: int = SHARE, top: int = TOP, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to ``longest`` words of each language.

    Texts are lower-cased (A to Z only), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces
    into words at blanks and tabs. A phrase of ``a >= min_count`` occurrences is cut after each of its words; with ``l`` and ``r``
    occurrences of the two parts and ``n`` words in the language, the cut with the lowest
    floor(1000 a n / (l r)) counts, the first of equal ones. A phrase inside a longer frequent one
    with at least ``share`` percent of its occurrences is dropped. Ranked by score, a, phrase (bytes).

    Words are numbered by falling count. Neighbouring numbers are counted in tiles: dense arrays
    where a tile holds many pairs, sorted coordinates elsewhere. Frequent pairs are numbered by
    falling count in turn, so that two overlapping phrases make the next length. Slices' counts meet in
    hash buckets, packed; each slice of text gets back the numbers of its own frequent phrases only; nothing is broadcast.

    A null language is ``und``; null and empty texts have no words; repeated rows count each; very
    long texts are worked on whole, in one slice; ties are ranked as said, so no two phrases share a rank; an empty table
    gives no rows; other columns are not looked at.
    """
    totals, found = lengths(docs, lang_col, text_col, longest, min_count, slice_bytes)
    phrases, out = phrased(found), None
    for length in range(2, longest + 1):
        rows = phrases[length - 1]
        if length < longest:
            above = found[length].select("f", F.explode(F.array_distinct(F.array("first", "second"))).alias("id")).groupBy("id").agg(F.max("f").alias("above"))
            rows = rows.join(above, "id", "left").filter("above IS NULL OR 100 * above < %d * f" % share)
        rows = scored(rows, totals, length).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")
        out = rows if out is None else out.unionByName(rows)
    ranked_rows = top_rows(out, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top)
    return ranked_rows.select("lang", F.col("rank").cast("int").alias("rank"), "phrase", "a", "l", "r", "n", "score")
