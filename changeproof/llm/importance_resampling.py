"""Importance resampling towards a target: hashed n-gram features, their gains, and Gumbel-perturbed top scores.

The features of a text are its runs of 1 to ORDER consecutive words; a feature's bucket is the CRC-32 of its bytes modulo the number of
buckets. CRCs are taken from length-bucketed matrices: the distinct features of some texts are grouped by equal length into
two-dimensional uint8 arrays, all CRCs of an array are updated column by column, and the buckets are scattered back
to the places where the features occur.

The corpus is read twice: once for the counts of each bucket (one vector of ``buckets`` numbers a task, added up by Spark), once
for the documents' own gains. Only the two count vectors, whose length is a parameter, come to the driver. Ranks come from one
range sort of narrow rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from changeproof.llm.common import small_batches, written
from changeproof.operators.scale import number_rows

#: Longest feature, in bytes, that goes through the matrices; a longer one has hardly another of its length and is taken alone.
MATRIX_BYTES = 192
#: Cells of one matrix that are gathered at once.
_CELLS = 1 << 21


def _crc_table() -> np.ndarray:
    """The CRC-32 (polynomial 0xEDB88320) of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """The CRC-32 of each column's bytes from top to bottom: matrix[j] holds byte j of every feature."""
    crc = np.full(matrix.shape[1], 0xFFFFFFFF, np.uint32)
    for row in matrix:
        crc = _CRC[(crc ^ row) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def _classes(lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, places) of each length that occurs."""
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    cuts = np.flatnonzero(np.diff(ranked)) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(lengths[part[0]]), part


def _matrices(buf: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[slice, np.ndarray]]:
    """The features of one length as arrays of bytes by features, at most _CELLS bytes each."""
    step = max(1, _CELLS // length)
    for at in range(0, len(starts), step):
        part = slice(at, at + step)
        yield part, buf[np.arange(length)[:, None] + starts[part][None, :]]


def crc_of_ranges(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of buf[start : start + length] for each range, by matrices of equal lengths."""
    out = np.zeros(len(starts), np.uint32)
    for length, places in _classes(lengths):
        if length > MATRIX_BYTES:
            out[places] = [zlib.crc32(buf[s : s + length]) for s in starts[places].tolist()]
            continue
        for part, matrix in _matrices(buf, starts[places], length):
            out[places[part]] = crc_columns(matrix)
    return out


def _first_places(codes: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n codes occurs first."""
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


def distinct_ranges(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each range, place of each number's first range): ranges of equal bytes have equal numbers."""
    codes, n = np.empty(len(starts), np.int64), 0
    for length, places in _classes(lengths):
        at = starts[places]
        if length > MATRIX_BYTES:
            own, kinds = pd.factorize(np.array([buf[s : s + length].tobytes() for s in at.tolist()], object))
        else:
            own = np.zeros(len(at), np.int64)
            for lo in range(0, length, 8):
                word = np.zeros(len(at), np.uint64)
                for j in range(lo, min(lo + 8, length)):
                    word = (word << np.uint64(8)) | buf[at + j]
                eight, of = pd.factorize(word)
                own, kinds = pd.factorize(own * len(of) + eight)
        codes[places] = n + own
        n += len(kinds)
    return codes, _first_places(codes, n)


def feature_buckets(texts: Sequence[bytes], buckets: int, order: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature of some UTF-8 texts, its text's number, words of each text)."""
    codes = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    begins = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=begins[1:])
    inside = _IN_WORD[codes]
    edges = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(begins, starts, side="right") - 1
    # Words with one blank after each, so that every feature is one range.
    kept = inside.copy()
    kept[ends] = True
    buf = np.where(inside[kept], codes[kept], np.uint8(32))
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    found, owners = [], []
    run, first = distinct_ranges(buf, at, lengths)
    for n in range(1, order + 1):
        if n > 1:
            # A longer run is known by its shorter one and the last word.
            together = owner[: len(starts) - n + 1] == owner[n - 1 :]
            if n == 2:
                words, kinds = run, len(first)
            pairs = np.full(max(len(starts) - n + 1, 0), -1, np.int64)
            pairs[together] = run[: len(pairs)][together] * kinds + words[n - 1 :][together]
            places = np.flatnonzero(pairs >= 0)
            own, distinct = pd.factorize(pairs[places])
            run = np.full(len(pairs), -1, np.int64)
            run[places] = own
            first = places[_first_places(own, len(distinct))]
        else:
            places, own = np.arange(len(starts)), run
        crc = crc_of_ranges(buf, at[first], at[first + n - 1] + lengths[first + n - 1] - at[first])
        found.append((crc % np.uint32(buckets)).astype(np.int64)[own])
        owners.append(owner[places])
    return np.concatenate(found), np.concatenate(owners), np.bincount(owner, minlength=len(texts))


def _blocks(texts: Sequence[bytes | None], limit: int = 4_000_000) -> Iterator[list[bytes]]:
    """The texts in turn, some at a time: about ``limit`` bytes, or one longer text."""
    held, size = [], 0
    for text in texts:
        text = bytes(text) if text is not None else b""
        if held and size + len(text) > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def bucket_counts(texts: DataFrame, buckets: int, order: int = 2) -> np.ndarray:
    """How many features of all rows of texts(text) fall into each bucket: a vector of ``buckets`` numbers."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for block in _blocks(batch["utf8"].tolist()):
                sums += np.bincount(feature_buckets(block, buckets, order)[0], minlength=buckets)
        held = np.flatnonzero(sums)
        yield pd.DataFrame({"bucket": held.astype(np.int32), "features": sums[held]})

    parts = texts.select(_utf8(F.col("text")).alias("utf8")).mapInPandas(counted, "bucket int, features long")
    out = np.zeros(buckets, np.int64)
    # At most ``buckets`` rows.
    for row in parts.groupBy("bucket").agg(F.sum("features").alias("features")).collect():
        out[row.bucket] = row.features
    return out


def _utf8(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def bucket_gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of a bucket's add-one shares in target and corpus), as integers."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    gain = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(s_all + buckets) / (float(s + 1) * float(t_all + buckets))))
    return np.array([gain(s, t) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: str = "7", order: int = 2) -> DataFrame:
    """docs(doc_id, text) to (doc_id, n_features, weight, score, rank), one row for each row of docs, all long.

    target(text) holds the target distribution. weight is the floored mean of the gains of a document's features, 0 without any;
    score adds floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:doc_id"). Of the documents with least_words words or
    more, percent in a hundred (rounded down) are drawn, those with the highest scores, ties to smaller ids, and ranked from 1;
    the others have a null rank. Null texts are empty; a null id hashes as "null" and comes after other ids of its score. Repeated
    rows count as often as they occur and have ranks of their own, in the order of their texts' hashes. An empty target has gains of
    the corpus alone; an empty docs gives an empty table. Other columns are not read. Words longer than any limit are taken whole.
    """
    small_batches(docs.sparkSession)
    gains = bucket_gains(bucket_counts(target, buckets, order), bucket_counts(docs, buckets, order))

    @F.pandas_udf("struct<words: long, n_features: long, weight: long>")
    def weighed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for block in _blocks(batch.tolist()):
                bucket, owner, words = feature_buckets(block, buckets, order)
                n = np.bincount(owner, minlength=len(block))
                # Sums of integers below 2^53 are exact in doubles.
                total = np.bincount(owner, weights=gains[bucket], minlength=len(block)).astype(np.int64)
                out.append(np.stack((words, n, total // np.maximum(n, 1)), axis=1))
            yield pd.DataFrame(np.concatenate(out) if out else np.empty((0, 3), np.int64), columns=["words", "n_features", "weight"])

    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    u = (F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), weighed(_utf8(F.col("text"))).alias("w"))
    rows = rows.select("doc_id", "tie", (F.col("w.words") >= least_words).alias("counts"), "w.n_features", "w.weight", (F.col("w.weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u)))).cast("long").alias("score"))
    # Written, so that the range sort below, which reads its input twice, does not read the texts twice.
    rows = written(rows)
    # The last column parts rows that are alike in all others, however many there are.
    order_by = [F.col("counts").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    placed = number_rows(rows.withColumn("row", F.monotonically_increasing_id()), order_by, "place")
    drawn = placed.where("counts").count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))
