"""Best-fit packing of token sequences under several capacities at once (vector best fit).

Every piece is a vector (tokens, one document, attention cost = tokens squared) and every open sequence has the residual
capacities left in each. Pieces are placed longest first. Among the sequences that can take a piece in all dimensions, the
one with the smallest weighted residual norm after placing wins, or the one with the largest weighted dot product of piece
and residual; a new one opens only if none can.

Pieces are dealt to groups of about GROUP pieces by hash, and each group is packed in a task of its own; what is lost
against one packing of all is less than one open sequence a group. Full pieces need no search.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from changeproof.llm.common import small_batches, written

GROUP = 20_000
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pack(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, in the order given. Pieces longer than ``tokens`` are refused."""
    if len(lengths) and int(lengths.max()) > tokens:
        raise ValueError("a piece is longer than a sequence")
    capacity = np.array([tokens, documents, attention], float)
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    # What open sequences have left, in the order in which they were opened: a row for each dimension, a column for each of the first n.
    left, live, n, opened = np.empty((3, 1024)), np.empty(1024, np.int64), 0, 0
    smallest = int(lengths.min()) if len(lengths) else 0
    for i in order:
        v = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        t, d, a = after = left[:, :n] - v[:, None]
        fits = (t >= 0) & (d >= 0) & (a >= 0)
        if fits.any():
            if rule == "norm":
                t, d, a = (after / capacity[:, None]) ** 2
                cost = weights[0] * t + weights[1] * d + weights[2] * a
            else:
                t, d, a = (np.array(weights) * (v / capacity))[:, None] * (left[:, :n] / capacity[:, None])
                cost = -(t + d + a)
            cost[~fits] = np.inf
            best = int(cost.argmin())
        else:
            if n == len(live):
                left, live = np.hstack((left, np.empty_like(left))), np.append(live, np.empty_like(live))
            left[:, n], live[n] = capacity, opened
            best, opened, n = n, opened + 1, n + 1
        place[i], offset[i] = live[best], tokens - left[0, best]
        left[:, best] -= v
        if left[0, best] < smallest or left[1, best] < 1:
            left[:, best : n - 1], live[best : n - 1] = left[:, best + 1 : n], live[best + 1 : n]
            n -= 1
    return place, offset


#: Texts of these characters only are cut into the tokenizer's own words here, as lower-case letters, digits and the rest;
#: each kind of word then meets the tokenizer once. Other texts, and those that may hold the name of a special token, are
#: cut at white space, which it never joins across.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
_CHUNK = re.compile("[^ \t-\r]+")
_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+", re.A)
_SMALL = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: What a tokenizer's file must say for its texts to be cut so.
_CUT_SO = {
    "normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"],
    "split": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+",
}


def words_in(text: str) -> list[str]:
    """Words whose ids, in turn, are the ids of the text."""
    return _WORD.findall(text.lower()) if "<|" not in text and _PLAIN.fullmatch(text) else _CHUNK.findall(text)


def cuts_words(path: str) -> bool:
    """Whether the tokenizer's file says that texts are the same as their words_in, one after the other."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    steps = lambda name, inner: [x["type"] for x in (said.get(name) or {}).get(inner, [])]
    if steps("normalizer", "normalizers") != _CUT_SO["normalizer"] or steps("pre_tokenizer", "pretokenizers") != _CUT_SO["pre_tokenizer"]:
        return False
    return said["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _CUT_SO["split"]} and said.get("post_processor") is None


class WordTable(dict):
    """Ids of the words seen last: one row a word, all rows in one array, so that the ids of many words are one look-up."""

    def __init__(self, tokenizer, most: int):
        self.tokenizer, self.most, self.fresh = tokenizer, most, []
        self.ids, self.starts = np.empty(0, "<u4"), np.zeros(1, np.int64)
        # How the pre-tokeniser writes the bytes of small letters.
        self.bytes = {c: "".join(x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))) for c in (*range(0xDF, 0xF7), *range(0xF8, 0x100))}

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.fresh.append(word)
        return row

    def _take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, sizes = self.starts[rows], self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        return self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)], sizes

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each). Words that are new meet the tokenizer in one call."""
        found = pa.array(words, pa.string()).dictionary_encode()
        rows = np.fromiter(map(self.__getitem__, found.dictionary.to_pylist()), np.int64, len(found.dictionary))[found.indices.to_numpy()]
        if self.fresh:
            # Words of small letters come through the normaliser as they are, and the pre-tokeniser only writes their bytes, so the model may have them at once.
            plain = [*map(_SMALL, self.fresh)]
            encoded = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(self.fresh, plain, strict=True) if not p], add_special_tokens=False))
            model = self.tokenizer.model
            parts = [[t.id for t in model.tokenize(w if w.isascii() else w.translate(self.bytes))] if p else next(encoded).ids for w, p in zip(self.fresh, plain, strict=True)]
            sizes, self.fresh = [len(x) for x in parts], []
            self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(parts), "<u4", sum(sizes))))
        found = self._take(rows)
        if len(self) > self.most:
            # The older half goes.
            kept = list(self)[len(self) // 2 :]
            self.ids, sizes = self._take(np.arange(len(self) // 2, len(self)))
            self.starts = np.concatenate(([0], np.cumsum(sizes)))
            self.clear()
            self.update(zip(kept, range(len(kept)), strict=True))
        return found


def _pieces(ids: np.ndarray, limit: int) -> list[dict]:
    parts = [ids[start : start + limit] for start in range(0, len(ids), limit)]
    return [{"piece": i, "start": i * limit, "length": len(x), "ids_crc32": zlib.crc32(x.tobytes())} for i, x in enumerate(parts)]


def _tokenised(batches, path: str, end: int, limit: int, cache_words: int = 400_000, block_chars: int = 2_000_000):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    table, last = WordTable(tokenizer, cache_words) if cuts_words(path) else None, np.array([end], "<u4")
    for batch in batches:
        texts = [t if isinstance(t, str) else "" for t in batch]
        sizes, out = np.cumsum([len(t) for t in texts]), []
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes // block_chars)) + 1):
            if table is None:
                out += [_pieces(np.append(np.array(e.ids, "<u4"), last), limit) for e in tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)]
                continue
            words = [words_in(texts[i]) for i in part]
            ids, lengths = table.lookup([w for own in words for w in own])
            at = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum([len(own) for own in words])))]
            out += [_pieces(np.append(ids[a:b], last), limit) for a, b in zip(at, at[1:], strict=False)]
        yield pd.Series(out)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limit: int = 4096) -> DataFrame:
    """docs(doc_id, text) to (doc_id, piece, start, length, ids_crc32): ids of the whole text, then end_id, cut at limit.

    Where the tokenizer's file says that it cuts words as words_in does, each kind of word meets the tokenizer once; any other gets whole texts.
    """

    @F.pandas_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _tokenised(texts, tokenizer_path, end_id, limit)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(cut(F.col("text").cast("string"))).alias("p")).select("doc_id", "p.*")


def _packed(rows: pd.DataFrame, **capacities) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
    place, offset = pack(rows["length"].to_numpy(), **capacities)
    return rows.assign(sequence_id=rows["grp"].to_numpy() * (1 << 32) + place, offset=offset).drop(columns=["grp"]).astype({"doc_id": "Int64"})


def best_fit(
    docs: DataFrame, tokenizer_path: str, end_id: int = 1, tokens: int = 4096, documents: int = 4096, attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.2), rule: str = "norm"
) -> DataFrame:
    """Pack whole documents into sequences: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A sequence holds at most ``tokens`` tokens, ``documents`` pieces and ``attention`` (tokens squared by default) summed
    squares of lengths. Only documents longer than a sequence are cut. A null or empty text is the one token end_id. Repeated
    rows are placed each; a null doc_id stays null. An empty table gives an empty one. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    attention = tokens * tokens if attention is None else attention
    pieces = written(token_pieces(docs, tokenizer_path, end_id, tokens))
    rows = pieces.count()
    full = (F.col("length") == tokens) & F.lit(documents >= 1 and attention >= tokens * tokens)
    if attention < tokens * tokens and not pieces.where(F.col("length").cast("double") ** 2 > attention).isEmpty():
        raise ValueError("a piece alone exceeds the attention capacity")
    numbered = pieces.withColumn("grp", F.monotonically_increasing_id())
    alone = numbered.where(full).select(*pieces.columns, (-F.col("grp") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = max(1, rows // GROUP)
    shared = numbered.where(~full).withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "grp"), F.lit(groups)))
    capacities = {"tokens": tokens, "documents": documents, "attention": attention, "weights": tuple(weights), "rule": rule}
    packed = shared.groupBy("grp").applyInPandas(lambda g: _packed(g, **capacities), f"{SCHEMA}, sequence_id long, offset long")
    return packed.unionByName(alone)
