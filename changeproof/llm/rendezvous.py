"""Sharding by weighted rendezvous hashing, in DataFrame operations only.

Each shard scores each record key, and the record goes to the shard with the best score -w / ln(u). A score depends on the
key and that one shard, so a further shard takes records only for itself and moves no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Groups in which the rows of a shard are numbered.
BUCKETS = 1024


def _score(key: Column, shard: int, weight: float) -> Column:
    # 52 bits of the hash as a number strictly between 0 and 1.
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    return F.lit(float(-weight)) / F.log(u)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The best shard for a key; of equal scores the smallest shard. A null key is a key like any other."""
    best = F.array_max(F.array(*[F.struct(_score(key, s, w).alias("score"), F.lit(-s).alias("minus")) for s, w in enumerate(weights)]))
    return (-best["minus"]).cast("int")


def shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    size is the UTF-8 length of the text (0 if null) plus 16; text_crc32 is that of its bytes (null: of none). slot numbers
    the rows of a shard without gaps from 0: by hash bucket of the id, then id, then checksum. Equal ids share a shard,
    repeated rows have different slots. grown_shard is the shard among ``grown`` weights, null if none are given. An empty
    table gives an empty one. Other columns are not read.
    """
    key = F.col("doc_id").cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, weights).alias("shard"),
        (shard_of(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(BUCKETS)).cast("int").alias("bucket"),
    )
    # A shard may hold very many rows: they are counted by bucket, and only a bucket is sorted in one place.
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
