"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, null_ids, row_key, texts, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 shares no band once in 1,600 cases, one of 0.85 once in 31,000.
BANDS, BAND_ROWS, SEED = 14, 4, 20240229
#: Buckets of the document-frequency sketch: 2**18 numbers, whatever the input. A bucket's count is
#: too high by the other shingles in it, a fixed share of the documents at any size.
SKETCH_BITS = 18
TABLE_BITS = 16
#: Shingles that are sampled together.
CHUNK = 1 << 15
#: Hubs that a bucket compares its members with, and members of a block of those that are left.
HUBS, BLOCK = 1, 512
#: Sum of weights of a block's texts, so that long texts make small blocks.
BLOCK_WEIGHT = 1_000_000
#: Least number of equal samples, of all, for a pair to be verified; a pair of similarity 0.8 has fewer once in 10**8 cases.
AGREE = 28

_PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
_WORDS: dict[str, int] = {}
#: About 40 MB in a worker, which lives on through later stages.
_WORD_LIMIT = 1 << 18


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words; a shorter text is one run; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > _WORD_LIMIT:
        _WORDS.clear()
    known = _WORDS
    at = [known.get(w) for w in words]
    if None in at:
        for i, (w, h) in enumerate(zip(words, at)):
            if h is None:
                at[i] = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
    h = np.array(at, np.uint64)
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = (out ^ h[j : len(h) - n + 1 + j]) * _PRIMES[j % 5]
        out ^= out >> np.uint64(29)
    return out


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles(text), return_counts=True)


def document_frequencies(rows: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """Number of documents per bucket of shingle hashes, over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.int64)
        held, n = [], 0
        for b in batches:
            for t in b["text"]:
                held.append((np.unique(shingles(t)) >> np.uint64(64 - bits)).astype(np.int64))
                n += len(held[-1])
                if n >= CHUNK:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    out = np.zeros(1 << bits, np.int64)
    sums = rows.select("text").mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # 2**bits rows at most
    out[sums["bucket"]] = sums["n"]
    return out


def idf(df: np.ndarray, documents: int) -> np.ndarray:
    """1 for shingles of all documents up to 2 for those of one. Kept this flat so that a large
    group's own shingles, frequent by being copied, are not outweighed by the few that differ."""
    n = max(documents, 1)
    return 1 + np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 1)


class Sampler:
    """Consistent weighted samples; the random variates of a shingle come from tables by its hash bits."""

    def __init__(self, weight: np.ndarray, hashes: int = BANDS * BAND_ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.weight, self.shift = weight, np.uint64(64 - int(np.log2(len(weight))))
        size = 1 << TABLE_BITS
        self.r = rng.gamma(2.0, 1.0, size)
        self.inverse, self.log_c = 1 / self.r, np.log(rng.gamma(2.0, 1.0, size))
        self.keys = rng.integers(1, 2**63, (hashes, 2), np.uint64) * np.uint64(2) + np.uint64(1)

    def weights(self, shingle: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf * self.weight[(shingle >> self.shift).astype(np.int64)]

    def signatures(self, shingle: np.ndarray, log_w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """hashes x documents: the least ln(a) over a document's shingles stands for (shingle, t)."""
        out = np.empty((len(self.keys), len(first)))
        mask = np.uint64((1 << TABLE_BITS) - 1)
        for k, (x, m) in enumerate(self.keys):
            h = (shingle ^ x) * m
            h ^= h >> np.uint64(31)
            h *= _PRIMES[1]
            a = (h >> np.uint64(48)).astype(np.int64)
            beta = ((h >> np.uint64(16)) & mask) * (1 / 65536)
            r = self.r[a]
            t = np.floor(log_w * self.inverse[a] + beta)
            out[k] = np.minimum.reduceat(self.log_c[((h >> np.uint64(32)) & mask).astype(np.int64)] - r * (t - beta + 1), first)
        return out


def signed(rows: DataFrame, weight, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(rid, rth, node, total, digest, bands) of every text: ``node`` hashes its words, ``total`` is the
    sum of its weights, ``digest`` has 16 bits of each sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(weight.value, bands * band_rows)

        def group(own: list[tuple], parts: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
            lens = np.array([len(s) for s, _ in parts])
            some = lens > 0
            shingle, tf = (np.concatenate(x) for x in zip(*parts))
            keys = np.zeros((len(parts), bands), np.int64)
            total, digest = np.zeros(len(parts)), np.zeros((len(parts), bands * band_rows), np.uint16)
            if some.any():
                w = sampler.weights(shingle, tf)
                first = (np.cumsum(lens) - lens)[some]
                total[some] = np.add.reduceat(w, first)
                bits = sampler.signatures(shingle, np.log(w), first).view(np.uint64)
                digest[some] = ((bits * _PRIMES[0]) >> np.uint64(48)).astype(np.uint16).T
                for b in range(bands):
                    h = np.full(len(first), b + 1, np.uint64)
                    for j in range(band_rows):
                        h = (h ^ bits[b * band_rows + j]) * _PRIMES[j % 5]
                        h ^= h >> np.uint64(31)
                    keys[some, b] = h.view(np.int64)
            rid, rth, node = zip(*own)
            return pd.DataFrame({"rid": rid, "rth": rth, "node": node, "total": total, "digest": [x.tobytes() for x in digest], "bands": [k if s else k[:0] for k, s in zip(keys, some)]})

        for b in batches:
            own, parts, n = [], [], 0
            for rid, rth, text in zip(b["rid"], b["rth"], b["text"]):
                s = counted(text)
                words = " ".join(text.lower().split())
                own.append((rid, rth, xxhash.xxh3_128_digest((words or f"\0{rid} {rth}").encode("utf-8", "replace"))))
                parts.append(s)
                n += len(s[0])
                if n >= CHUNK:
                    yield group(own, parts)
                    own, parts, n = [], [], 0
            if own:
                yield group(own, parts)

    return rows.mapInPandas(run, "rid bigint, rth bigint, node binary, total double, digest binary, bands array<bigint>")


def weighted_jaccard(sampler: Sampler, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    every = np.union1d(a[0], b[0])
    w = np.zeros((2, len(every)))
    for row, (s, tf) in zip(w, (a, b)):
        row[np.searchsorted(every, s)] = sampler.weights(s, tf)
    top = np.maximum(w[0], w[1]).sum()
    return float(np.minimum(w[0], w[1]).sum() / top) if top else 0.0


def verified(pairs: DataFrame, node_texts: DataFrame, weight) -> DataFrame:
    """(a, b, sim) of distinct pairs of nodes by their texts, where the samples leave it possible that they are similar."""

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(len(batch), -1) for c in ("da", "db"))
            yield batch.loc[(x == y).sum(1) >= AGREE, ["a", "b"]]

    marks = node_texts.select("node", "digest")
    pairs = pairs.select("a", "b").distinct().join(marks.toDF("b", "db"), "b").join(marks.toDF("a", "da"), "a")
    pairs = written(pairs.mapInPandas(alike, "a binary, b binary"), "alike")
    left = node_texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = node_texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(right, "b").join(left, "a")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(weight.value, 1)
        last, held = None, None
        for batch in batches:
            sims = []
            for a, ta, tb in zip(batch["a"], batch["ta"], batch["tb"]):
                if a != last:  # the pairs of a hub come one after the other
                    last, held = a, counted(ta)
                sims.append(weighted_jaccard(sampler, held, counted(tb)))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "sim": sims})

    return both.mapInPandas(run, "a binary, b binary, sim double")


class Roots:
    """Roots of a group's members, joined as links are found."""

    def __init__(self, roots: list[bytes]):
        first: dict[bytes, int] = {}
        self.up = [first.setdefault(r, i) for i, r in enumerate(roots)]

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x


def occurrences(s: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """A set whose common elements count what two texts share: a shingle, its second occurrence and so on."""
    if len(s) == tf.sum():
        return s
    at = np.repeat(np.cumsum(tf) - tf, tf)
    return np.repeat(s, tf) + (np.arange(len(at)) - at).astype(np.uint64) * _PRIMES[3]


def joining(sampler: Sampler, members: pd.DataFrame, parts: list[tuple[np.ndarray, np.ndarray]], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between members of different roots, one for every two roots that meet: a forest, never all pairs.

    A text similar to another one holds one of any of that one's elements that weigh more than one minus the
    limit of it; the rarest ones are looked up, and what is shared is summed only where that finds a partner.
    """
    n, node, total = len(members), list(members["node"]), members["total"].to_numpy()
    home, block = members["home"].to_numpy(bool), members["block"].to_numpy()
    cross = members["i"].iloc[0] != members["j"].iloc[0]
    own = [occurrences(*p) for p in parts]
    lens = np.array([len(x) for x in own])
    ends = np.cumsum(lens)
    _, element, df = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    w = np.concatenate([np.repeat(sampler.weights(s, np.ones(len(s))), tf) for s, tf in parts])
    postings = np.repeat(np.arange(n), lens)[np.argsort(element, kind="stable")]
    start = np.cumsum(df) - df

    def of(elements: np.ndarray) -> np.ndarray:
        size = df[elements]
        return postings[np.repeat(start[elements] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    roots, out = Roots(list(members["root"])), []
    for u in range(n):
        if cross and block[u] != members["i"].iloc[0]:
            continue
        mine = slice(ends[u] - lens[u], ends[u])
        e, x = element[mine], w[mine]
        rare = np.argsort(df[e], kind="stable")
        upto = np.searchsorted(np.cumsum(x[rare]), (1 - similarity + 1e-6) * x.sum(), side="right") + 1
        found = np.unique(of(e[rare[:upto]]))
        found = found[block[found] != block[u]] if cross else found[found > u]
        found = found[(home[found] | home[u]) & (np.minimum(total[found], total[u]) >= (similarity - 1e-9) * np.maximum(total[found], total[u]))]
        found = [v for v in found.tolist() if roots.find(u) != roots.find(v)]
        if not found:
            continue
        both = np.bincount(of(e), np.repeat(x, df[e]), n)[found]
        near = both / (total[u] + total[found] - both) >= similarity - 1e-6
        for v in np.array(found)[near].tolist():
            a, b = roots.find(u), roots.find(v)
            if a != b and weighted_jaccard(sampler, parts[u], parts[v]) >= similarity:
                roots.up[a] = b
                out.append((min(node[u], node[v]), max(node[u], node[v])))
    return out


def block_links(blocks: DataFrame, weight, similarity: float) -> DataFrame:
    """(a, b) of links found within the groups (key, i, j) of (node, total, home, root, block, text), which lie together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler, held = Sampler(weight.value, 1), None
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        size = 0

        def answered(group: pd.DataFrame) -> list[tuple[bytes, bytes]]:
            nonlocal size
            parts = []
            for node, text in zip(group["node"], group["text"]):
                if node not in known:  # a node stands in several groups
                    known[node] = counted(text)
                    size += len(known[node][0])
                parts.append(known[node])
            if size > BLOCK_WEIGHT:
                known.clear()
                size = 0
            return joining(sampler, group, parts, similarity)

        for batch in (b for b in batches if len(b)):
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = batch[["key", "i", "j"]].to_numpy()
            first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)])
            out = [x for lo, hi in itertools.pairwise(first) for x in answered(batch.iloc[lo:hi])]
            held = batch.iloc[first[-1] :]  # the last group may go on
            yield pd.DataFrame(out, columns=["a", "b"])
        if held is not None:
            yield pd.DataFrame(answered(held), columns=["a", "b"])

    return blocks.mapInPandas(run, "a binary, b binary")


def links(buckets: DataFrame, node_texts: DataFrame, weight, similarity: float = SIMILARITY, hubs: int = HUBS, block: int = BLOCK) -> DataFrame:
    """(a, b) that connect all nodes of similarity ``similarity`` or more within the buckets (key, node, total, home).

    Members of a bucket are first compared with its hubs. Members of one component by then need no
    comparison with each other; a bucket whose other members are of several is cut into blocks of about ``block``
    members, and each two blocks are compared as sets (``joining``), all buckets at once. No row is made for a pair: a task
    gets two blocks of texts and gives the links that connect something. Two members that are not at ``home`` are
    compared in the bucket below.
    """
    part = F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("part")
    chosen = buckets.groupBy("key", part).agg(F.min(F.struct((~F.col("home")).alias("guest"), "node")).alias("x"))
    chosen = written(chosen.filter("NOT x.guest").select("key", F.col("x.node").alias("a")), "hubs")
    star = buckets.join(chosen, "key").filter("node <> a").select("key", "a", F.col("node").alias("b"))
    pairs = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    good = written(verified(pairs, node_texts, weight).filter(F.col("sim") >= similarity).select("a", "b"), "hub-links")
    roots = components(good)
    others = buckets.join(chosen.withColumnRenamed("a", "node"), ["key", "node"], "left_anti")
    others = written(others.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "others")
    cuts = others.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("w"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("home").alias("homes"))
    cuts = cuts.filter("homes AND lo < hi").select("key", F.ceil(F.greatest(F.col("n") / block, F.col("w") / BLOCK_WEIGHT)).cast("int").alias("blocks"))
    left = others.join(cuts, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = left.join(node_texts.select("node", "text"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "total", "home", "root", "block", "text")
    found = block_links(left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), weight, similarity)
    return written(good.unionByName(found), "links")


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rid, rth, node, root) of every row, and per root (root, class_id, class_size, rid, rth of the first)."""
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).select(*row_key(), "text")
    weight = spark.sparkContext.broadcast(idf(document_frequencies(rows), rows.count()))  # 2**SKETCH_BITS numbers
    sig = written(signed(rows, weight, bands, band_rows), "signatures")
    reps = written(sig.groupBy("node").agg(F.min(F.struct("rid", "rth", "total", "digest", "bands")).alias("x")).select("node", "x.*"), "texts")
    # texts of similar weight only: a class of weights and the next one up hold all partners of a text
    step = F.floor(F.log("total") / math.log(1 / (similarity - 1e-6))).cast("bigint")
    each = reps.select("node", "total", step.alias("step"), F.explode("bands").alias("band")).withColumn("up", F.explode(F.array(F.lit(0), F.lit(1))))
    each = each.select("node", "total", (F.col("up") == 0).alias("home"), F.xxhash64("band", F.col("step") + F.col("up")).alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("homes")).filter("n > 1 AND homes").select("key")
    buckets = written(each.join(shared, "key").select("key", "node", "total", "home"), "buckets")
    wanted = buckets.select("node").distinct().join(reps.select("node", "rid", "rth", "digest"), "node")
    node_texts = written(rows.join(wanted, ["rid", "rth"]).dropDuplicates(["node"]).select("node", "text", "digest"), "node-texts")
    roots = written(components(links(buckets, node_texts, weight, similarity)), "roots")
    placed = written(sig.select("rid", "rth", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed")
    first = placed.groupBy("root").agg(F.min(F.struct("rid", "rth")).alias("x"), F.count(F.lit(1)).alias("class_size"))
    return placed, first.select("root", F.nullif(F.col("x.rid"), F.lit(NULL_ID)).alias("class_id"), "class_size", "x.rid", "x.rth")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: (doc_id, class_id, class_size); class_id is the smallest id of its class.

    Classes are the connected components of the links: pairs of texts whose weighted Jaccard
    similarity over five-word shingles, weight tf times idf, is SIMILARITY or more, found among
    texts that share a band of consistent weighted samples. Texts of equal words are one node, and
    hot buckets are compared through hubs, so that copies are never expanded into all pairs.

    Words are lower-cased and split at white space. Texts with fewer than five words are one
    shingle; a null text or one without words is a class of its own (rows equal in id and text
    together); a null id counts as the smallest; repeated rows share a class; an empty table gives
    no rows; other columns are not looked at.
    """
    placed, first = classes(docs, **options)
    out = placed.select("rid", "root").join(first.select("root", "class_id", "class_size"), "root")
    return null_ids(out.withColumn("doc_id", F.col("rid"))).select("doc_id", "class_id", "class_size")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id, all columns as they are."""
    _, first = classes(docs, id_col=id_col, text_col=text_col, **options)
    key = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("rid"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("rth")]
    rows = docs.select(*key, F.struct("*").alias("doc")).join(first.select("rid", "rth"), ["rid", "rth"])
    return rows.dropDuplicates(["rid", "rth"]).select("doc.*")
