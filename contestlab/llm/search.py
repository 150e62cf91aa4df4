"""Exact top-k inner products over norm-sorted blocks with rotated partial sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, written

K, SCALE, QUERY_EVERY = 5, 256, 50
#: Rows of a block of candidates, rows of a block of queries, candidate blocks a task holds at most.
BLOCK, QUERY_BLOCK, STRIP = 2048, 2048, 16
#: Shares of the rotated dimensions after which the residual bound is applied.
STEPS = (0.25, 0.5)
#: Relative slack of a floating bound; pairs that pass are scored in whole numbers.
SLACK = 1e-9

BLOCK_SCHEMA = "norm double, rows int, ids binary, whole binary"


def scaled(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<bigint>, neg_norm) of the vectors that take part."""
    x = vectors.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    x = x.filter(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    x = x.select("vec_id", F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))
    return x.withColumn("neg_norm", -F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))


def second_moments(rows: DataFrame, dim: int) -> np.ndarray:
    """Sum of v vᵀ: each task sums its own, the sums of the tasks meet by cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for b in batches:
            m = matrix(b["v"], dim).astype(np.float64)
            total += m.T @ m
        yield pd.DataFrame({"cell": np.arange(dim * dim), "value": total.ravel()})

    cells = rows.select("v").mapInPandas(run, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    out = np.zeros(dim * dim)
    for cell, value in cells.collect():  # dim * dim numbers
        out[cell] = value
    return out.reshape(dim, dim)


def matrix(vectors, dim: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def blocks(rows: DataFrame, dim: int, size: int) -> DataFrame:
    """Rows in descending length, ``size`` at a time: (norm of the longest, rows, ids, whole numbers)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def block(b: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"norm": [-float(b["neg_norm"].iloc[0])], "rows": [len(b)], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "whole": [matrix(b["v"], dim).tobytes()]})

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += len(b)
            while n >= size:
                all_rows = pd.concat(held, ignore_index=True)
                yield block(all_rows.iloc[:size])
                held, n = [all_rows.iloc[size:]], n - size
        if n:
            yield block(pd.concat(held, ignore_index=True))

    order = ["neg_norm", "vec_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, BLOCK_SCHEMA)


class Side:
    """A block's rows, whole and rotated."""

    def __init__(self, ids: bytes, whole: bytes, rotation: np.ndarray):
        self.ids = np.frombuffer(ids, np.int64)
        self.whole = np.frombuffer(whole, np.int64).reshape(len(self.ids), -1)
        self.turned = self.whole @ rotation
        self.norm = np.sqrt((self.turned**2).sum(1))
        self.cuts = sorted({max(1, int(self.whole.shape[1] * s)) for s in STEPS})
        self.rest = [np.sqrt((self.turned[:, c:] ** 2).sum(1)) for c in self.cuts]


def survivors(q: Side, c: Side, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose Cauchy-Schwarz bound, after each partial sum, still reaches the query's least score."""
    slack = SLACK * (1 + np.abs(least))
    live = np.flatnonzero(q.norm * c.norm.max(initial=0) * (1 + SLACK) >= least - slack)
    if not len(live):
        return live, live
    floor = (least - slack)[live, None]
    upto, part = 0, 0
    mask = q.norm[live, None] * c.norm[None, :] * (1 + SLACK) >= floor
    for cut, q_rest, c_rest in zip(q.cuts, q.rest, c.rest):
        part = part + q.turned[live, upto:cut] @ c.turned[:, upto:cut].T
        mask &= part + (q_rest[live, None] * c_rest[None, :] + q.norm[live, None] * c.norm[None, :] * SLACK) >= floor
        upto = cut
    i, j = np.nonzero(mask)
    return live[i], j


def best(q: Side, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, ...]:
    """The k highest (query, score, id) a query, ties to the smaller id."""
    i, score, ids = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((ids, -score, i))
    i, score, ids = i[by], score[by], ids[by]
    nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
    keep = nth < k
    return i[keep], score[keep], ids[keep]


def scan(q: Side, candidates: Iterator[Side], k: int, least: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in descending length against the queries; a query's least score rises as it goes."""
    none = np.zeros(0, np.int64)
    kept, least = (none, none, none), least.copy()
    for c in candidates:
        i, j = survivors(q, c, least)
        other = q.ids[i] != c.ids[j]
        i, j = i[other], j[other]
        score = np.concatenate([np.einsum("nd,nd->n", q.whole[i[a : a + 65536]], c.whole[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [none])
        high = score >= least[i]
        kept = best(q, [kept, (i[high], score[high], c.ids[j[high]])], k)
        full = np.flatnonzero(np.bincount(kept[0], minlength=len(q.ids)) >= k)
        last = np.searchsorted(kept[0], full, "right") - 1
        least[full] = np.maximum(least[full], kept[1][last])
    return kept


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, query_every: int = QUERY_EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK, strip: int = STRIP,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products of each query.

    Queries are the rows whose id is divisible by ``query_every``; candidates all rows of another
    id. Components are floor(scale * x). The candidates lie in blocks by descending length. Their
    second moments give the rotation (right singular vectors, strongest first). The longest block
    gives each query a first least score; a block whose length times the query's stays below it is
    not shipped at all. A task takes one block of queries through a strip of at most ``strip``
    candidate blocks, longest first; partial sums over the first rotated dimensions plus the
    product of the residual lengths rule pairs out, the rest is scored in whole numbers.

    Vectors that are null or hold a null or non-finite component take no part; shorter ones count
    as filled up with zeros; a null id is a candidate but no query, and comes first among ties and is
    returned as null; rows with the query's own id are not its candidates, other repeated rows
    each are, and each row with a query's id is a query of its own; components whose scores could pass 64 bits are an error; no vector or no query gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = written(scaled(vectors, scale, id_col, vector_col), "vectors")
    size, most = rows.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    dim = max(1, size or 0)
    if (most or 0.0) ** 2 * dim >= 2.0**62:
        raise ValueError("components too large for whole-number scores of 64 bits")
    rotation = np.linalg.eigh(second_moments(rows, dim))[1][:, ::-1].copy()
    cands = written(blocks(rows, dim, block), "candidates")
    asked = rows.filter((F.col("vec_id") % query_every == 0) & (F.col("vec_id") != NULL_ID))
    longest = cands.orderBy(F.desc("norm"), F.desc("rows"), "ids").limit(1).collect()  # one block
    top = [(bytes(r["ids"]), bytes(r["whole"])) for r in longest]

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = [Side(*t, rotation) for t in top]
        for b in batches:
            for r in b.itertuples():
                q = Side(r.ids, r.whole, rotation)
                least = np.full(len(q.ids), -np.inf)
                i, score, _ = scan(q, iter(first), k, least)
                full = np.flatnonzero(np.bincount(i, minlength=len(q.ids)) >= k)
                least[full] = score[np.searchsorted(i, full, "right") - 1]
                need = np.min(np.where(q.norm > 0, least / np.maximum(q.norm, 1e-300), np.where(least > 0, np.inf, -np.inf)))
                yield pd.DataFrame({"need": [float(need)], "ids": [r.ids], "whole": [r.whole], "least": [least.tobytes()]})

    queries = blocks(asked, dim, query_block).mapInPandas(begin, "need double, ids binary, whole binary, least binary")
    queries = written(queries.withColumn("qb", F.monotonically_increasing_id()), "queries")
    n_cands = cands.count()
    strips = max(1, -(-n_cands // strip))
    needs = queries.select(F.col("qb").alias("block"), "need")  # two numbers a block of queries
    cands = cands.withColumn("strip", F.pmod(F.xxhash64("norm", "ids"), F.lit(strips)).cast("int"))
    wanted = needs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    right = wanted.join(cands, wanted["part"] == cands["strip"]).filter(F.col("norm") * (1 + SLACK) + SLACK >= F.col("need")).drop("need", "strip")
    left = queries.withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qb": [], "row": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        q, least = Side(a["ids"].iloc[0], a["whole"].iloc[0], rotation), np.frombuffer(a["least"].iloc[0])
        b = b.sort_values("norm", ascending=False)
        i, score, ids = scan(q, (Side(x, w, rotation) for x, w in zip(b["ids"], b["whole"])), k, least)
        return pd.DataFrame({"qb": a["qb"].iloc[0], "row": i, "query_id": q.ids[i], "vec_id": ids, "score": score})

    found = left.groupBy("qb", "strip").cogroup(right.groupBy("block", "part")).applyInPandas(run, "qb bigint, row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("qb", "row").orderBy(F.desc("score"), "vec_id"))
    out = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif(F.col("vec_id"), F.lit(NULL_ID)).alias("vec_id"), "score")
