"""Contiguous byte-balanced shards from prefix sums. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, with_offsets

SHARDS = 24
ROW_BYTES = 8


def byte_shards(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Documents in the order of their ids are laid end to end. Global positions are the prefix
    sums of the sizes, from per-partition totals; the line is cut at ``shards`` equal targets and
    a document goes where its middle lies, so that a cut is off by half a document at most.
    ``slot`` numbers the documents of a shard from 0, in the same order.

    A null text has no bytes, a null id comes first, equal ids are ordered by crc and size
    (rows equal in all three are interchangeable), a document larger than a target fills its
    shard alone and may leave shards empty, an empty table gives no rows, other columns are
    not looked at. Only (id, size, crc) are shuffled, never texts.
    """
    raw = F.col("text").cast("binary")
    rows = texts(docs, id_col, text_col).select("doc_id", (F.octet_length(raw) + F.lit(row_bytes)).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit(1).cast("bigint").alias("one"))
    rows, total = with_offsets(rows, ["doc_id", "text_crc32", "size"], ["size", "one"])
    whole = max(1, total["size"])
    rows = rows.withColumn("shard", F.expr(f"cast((2 * size_before + size) * {shards}L div {2 * whole}L as int)"))
    first = rows.groupBy("shard").agg(F.min("one_before").alias("first"))  # one row a shard
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("one_before") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
