"""Language-model scores by Katz backoff, with n-gram counts and backoff weights in tables that Spark partitions by key.

Words are bytes between blanks, A-Z in lower case, and one end closes a text. An n-gram seen r times has its count discounted by
the Good-Turing factor of r (counts above FEW are trusted). What a context's successors lose is given to the words that never
followed it, in proportion to the next shorter context: the backoff weight is the mass that is left over the lower-order
probability of all words not seen there, so each distribution sums to one over the V known words and one unknown.

Texts are numbered into chunks of about CHUNK tokens, a row each: the distinct words and the tokens as numbers of them. A table of an
order holds the count of each n-gram. A chunk never sends an n-gram twice: it asks for its distinct n-grams (64-bit keys) with
its own training counts, keys are dealt to buckets (ranges of keys) whose number grows with the input, and each bucket adds up and answers in the order
of the asking, so that answers need no keys. Keys travel in rising order as differences, counts in as few bytes as they need, and the shuffle files of a
job go when it ends. Hence no n-gram, however frequent, weighs more than once a chunk. Each
n-gram of the training texts is marked at one chunk, its first, which adds its discounted mass to the sums of its context; those
sums meet in the same way and give the weights. A token's probability is then worked out from the shortest context up.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from changeproof.llm.common import forget, mixed, small_batches, swept, written

ORDER = 2
#: Counts up to this one are discounted.
FEW = 5
#: Tokens of a chunk (a longer text is a chunk of its own) and keys of a bucket.
CHUNK, BUCKET = 1_000_000, 500_000
_TEXTS = "chunk long, doc array<long>, sizes array<int>, train array<boolean>, words binary, token binary, n_words long, n_tokens long"
_ASKED = "chunk long, bucket long, keys binary, sums binary"
_ANSWER = "chunk long, kind int, bucket long, sums binary, first binary"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up: a byte that says how many bytes the largest needs, then all their lowest bytes, all their second ones and so on."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 up, or doubles, by their bits, deflated."""
    squeeze = zlib.compressobj(strategy=zlib.Z_RLE)
    return squeeze.compress(_planes(x.view(np.uint64) if x.dtype == np.float64 else x)) + squeeze.flush()


def _unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return _from_planes(zlib.decompress(data)).view(kind)


class _Numbers(dict):
    """A number for each word, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def _numbered(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    part, made = TaskContext.get().partitionId() << 32, 0
    words, tokens, docs = _Numbers(), [], []

    def row() -> pd.DataFrame:
        keys = b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words)
        doc, train = [d for d, _ in docs], [t for _, t in docs]
        sizes = np.array([len(t) for t in tokens], np.int32)
        return pd.DataFrame({"chunk": [part + made], "doc": [doc], "sizes": [sizes], "train": [train], "words": [keys], "token": [_packed(np.concatenate(tokens))], "n_words": [len(words)], "n_tokens": [int(sizes.sum())]})

    size = 0
    for batch in batches:
        for doc, text, train in zip(batch["doc_id"].astype(object).where(batch["doc_id"].notna(), None), batch["utf8"], batch["train"], strict=True):
            # The empty string is no word and stands for the end.
            found = [*bytes(text).lower().split(), b""]
            tokens.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            docs.append((None if doc is None else int(doc), bool(train)))
            size += len(found)
            if size >= limit:
                yield row()
                made += 1
                words, tokens, docs, size = _Numbers(), [], [], 0
    if docs:
        yield row()


class Chunk:
    """One row of texts, with its n-grams by order."""

    def __init__(self, row):
        self.doc, self.sizes, self.train = list(row.doc), np.asarray(row.sizes), np.asarray(row.train, bool)
        self.token, self.words = _unpacked(row.token), np.frombuffer(row.words, "<u8")
        begins = np.cumsum(self.sizes) - self.sizes
        self.begins, self.at = begins, np.arange(len(self.token)) - np.repeat(begins, self.sizes)
        self.counted = np.repeat(self.train, self.sizes).astype(np.float64)
        #: By order: number of each token's n-gram (-1 too near the text's start), keys, contexts' numbers in the order below, first places.
        self.grams = {1: (self.token, self.words, None, _firsts(self.token, len(self.words)))}

    def of(self, n: int) -> tuple:
        if n not in self.grams:
            shorter, keys, _, _ = self.of(n - 1)
            here = np.flatnonzero(self.at >= n - 1)
            pairs = shorter[here - 1] * len(self.words) + self.token[here]
            codes, distinct = pd.factorize(pairs)
            context, word = np.divmod(distinct, max(len(self.words), 1))
            number = np.full(len(self.token), -1, np.int64)
            number[here] = codes
            own = mixed(mixed(keys[context]) + self.words[word] * np.uint64(0x9E3779B97F4A7C15))
            self.grams[n] = (number, own, context, here[_firsts(codes, len(distinct))])
        return self.grams[n]

    def contexts(self, n: int) -> np.ndarray:
        """The numbers, in order n - 1, of the contexts of the n-grams."""
        return np.unique(self.of(n)[2])


def _firsts(codes: np.ndarray, n: int) -> np.ndarray:
    first = np.empty(n, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the keys, which is also that of the buckets, what each is above the one before it in its bucket or the bucket's start, where each bucket that occurs starts, and the end)."""
    order = np.argsort(keys)
    rising, step = keys[order], np.uint64((1 << 63) // buckets + 1)
    bucket = (rising >> np.uint64(1)) // step
    starts = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    above = np.diff(rising, prepend=np.uint64(0))
    above[starts] = rising[starts] - (step * bucket[starts] << np.uint64(1))
    return order, above, np.append(starts, len(keys))


def _bucket(key: np.uint64, buckets: int) -> int:
    return (int(key) >> 1) // ((1 << 63) // buckets + 1)


def _asking(chunk: int, keys: np.ndarray, sums: np.ndarray, buckets: int) -> pd.DataFrame:
    order, above, starts = _dealt(keys, buckets)
    cuts = list(zip(starts, starts[1:], strict=False))
    return pd.DataFrame({"chunk": chunk, "bucket": [_bucket(keys[order[a]], buckets) for a, _ in cuts], "keys": [_planes(above[a:b]) for a, b in cuts], "sums": [_packed(sums[order[a:b]].ravel()) for a, b in cuts]})


def _number(kind: int) -> type:
    """Counts are whole, sums of contexts are not."""
    return np.float64 if kind % 2 else np.int64


def answers(asked: DataFrame, kind: int) -> DataFrame:
    """asked(chunk, bucket, keys, sums) to _ANSWER: each key's sums over all chunks, and whether the chunk is its first.

    sums has as many numbers a key as were asked, key after key. First is the smallest chunk whose first number is above 0.
    """
    number = _number(kind)

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ignore_index=True)
        asked_for = [np.cumsum(_from_planes(k)) for k in rows["keys"]]
        sizes = [len(k) for k in asked_for]
        sums = np.concatenate([_unpacked(x, number) for x in rows["sums"]]).reshape(sum(sizes), -1)
        codes, distinct = pd.factorize(np.concatenate(asked_for))
        total = np.stack([np.bincount(codes, weights=s, minlength=len(distinct)) for s in sums.T], axis=1).astype(number)[codes]
        first = np.zeros(len(codes), bool)
        holds = np.flatnonzero(sums[:, 0] > 0)
        first[holds[~pd.Series(codes[holds]).duplicated().to_numpy()]] = True
        cuts = np.cumsum(sizes)[:-1]
        return pd.DataFrame({"chunk": rows["chunk"], "kind": np.int32(kind), "bucket": rows["bucket"], "sums": [_packed(t.ravel()) for t in np.split(total, cuts)], "first": [np.packbits(f).tobytes() for f in np.split(first, cuts)]})

    return written(asked.groupBy("bucket").applyInPandas(added, _ANSWER), rows_a_file=4_096)


def _sums_first(rows: pd.DataFrame, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """All sums of the rows, key after key, and which keys are first (not read for sums of contexts)."""
    number = _number(kind)
    sums = [_unpacked(x, number) for x in rows["sums"]]
    first = [np.unpackbits(np.frombuffer(f, np.uint8), count=len(s)).astype(bool) for s, f in zip(sums, rows["first"], strict=True)] if number is np.int64 else []
    return np.concatenate([np.empty(0, number), *sums]), np.concatenate([np.empty(0, bool), *first])


def _answered(rows: pd.DataFrame, kind: int, keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, first) of the keys in their own order."""
    flat, marked = _sums_first(rows[rows["kind"] == kind].sort_values("bucket"), kind)
    order = _dealt(keys, buckets)[0]
    sums, first = np.empty((len(keys), len(flat) // max(len(keys), 1))), np.zeros(len(keys), bool)
    sums[order] = flat.reshape(len(keys), -1)
    first[order[: len(marked)]] = marked
    return sums, first


def discounts(seen: Sequence[int]) -> np.ndarray:
    """The factor of each count from 0 to the last that is discounted; seen[r] n-grams occur r times (seen[0] is not read).

    Good-Turing factors as Katz scales them, for the largest bound up to FEW at which all lie strictly between 0 and 1; where there is
    none, a count r keeps (r - 1/2) / r.
    """
    for few in range(min(FEW, len(seen) - 2), 0, -1):
        n = [float(x) for x in seen]
        if min(n[1 : few + 2]) <= 0:
            continue
        above = (few + 1) * n[few + 1] / n[1]
        factors = [((r + 1) * n[r + 1] / (r * n[r]) - above) / (1 - above) if above < 1 else 0.0 for r in range(1, few + 1)]
        if 0 < min(factors) and max(factors) < 1:
            return np.array([1.0, *factors])
    return np.array([1.0, *((r - 0.5) / r for r in range(1, FEW + 1))])


def _kept(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    few = counts < len(factors)
    return np.where(few, factors[np.where(few, counts, 0).astype(np.int64)], 1.0) * counts


class Model:
    """What all chunks share: the order, factors of each order, buckets of each kind of answer, training tokens, their distinct ones, and their discounted number.

    Kind 2n are counts of order n, kind 2n + 1 sums of contexts of n-grams.
    """

    def __init__(self, order: int):
        self.order, self.factors, self.buckets = order, {}, {}
        self.tokens, self.kinds, self.mass = 0, 0, 0.0

    def probabilities(self, chunk: Chunk, rows: pd.DataFrame, upto: int) -> tuple[np.ndarray, np.ndarray]:
        """(each token's probability by contexts of up to ``upto`` - 1 words, its count as a word)."""
        counts = _answered(rows, 2, chunk.words, self.buckets[2])[0][:, 0]
        kept = _kept(counts, self.factors[1])
        extra = 0.0 if self.mass < self.tokens * (1 - 1e-9) else 1.0
        p = np.where(counts > 0, kept, self.tokens + extra - self.mass)[chunk.token] / (self.tokens + extra)
        below = counts
        for n in range(2, upto + 1):
            number, keys, context, _ = chunk.of(n)
            counts_n = _answered(rows, 2 * n, keys, self.buckets[2 * n])[0][:, 0]
            held = chunk.contexts(n)
            sums, _ = _answered(rows, 2 * n + 1, chunk.of(n - 1)[1][held], self.buckets[2 * n + 1])
            left, weight = np.zeros((2, len(below)))
            total = below.copy()
            # A context none of whose counts is discounted gets one more, unseen, so that something is left for other words.
            total[held] += np.where(sums[:, 0] < below[held] * (1 - 1e-9), 0.0, 1.0)
            left[held] = total[held] - sums[:, 0]
            weight[held] = left[held] / np.maximum(total[held], 1.0) / np.maximum(1 - sums[:, 1], 1e-12)
            here = np.flatnonzero(number >= 0)
            gram = number[here]
            at = context[gram]
            seen = _kept(counts_n, self.factors[n])[gram] / np.maximum(total[at], 1.0)
            p[here] = np.where(below[at] == 0, p[here], np.where(counts_n[gram] > 0, seen, weight[at] * p[here]))
            below = counts_n
        return p, counts[chunk.token]


def katz_scores(docs: DataFrame, held_out: Column, order: int = ORDER, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """docs(doc_id, text) to SCHEMA, one row for each row of docs.

    Counts are of all texts where held_out (a condition on doc_id) is not true. score is the model's log10 probability of the text's
    tokens, with contexts of up to ``order`` - 1 words of the same text; base_score that of add-one-half unigrams. A word that no training text has is
    the unknown word in both. With no training text the unknown word has probability 1. Null and empty texts are the end
    alone; null ids follow held_out, repeated rows count and score each. An empty table gives an empty one. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("utf8"), (~F.coalesce(held_out, F.lit(True))).alias("train"))
    texts = written(rows.mapInPandas(lambda batches: _numbered(batches, chunk), _TEXTS), rows_a_file=8)
    sizes = texts.agg(*(F.coalesce(F.sum(f"n_{x}"), F.lit(0)).alias(x) for x in ("words", "tokens"))).first()
    model, known = Model(order), []
    with swept(docs.sparkSession):
        for n in range(1, order + 1):
            model.buckets[2 * n] = model.buckets[2 * n + 3] = 1 + (sizes.words if n == 1 else sizes.tokens) // bucket
            known.append(answers(_asked_counts(texts, model, n), 2 * n))
            *seen, kinds, tokens = _counts_of_counts(known[-1], 2 * n)
            model.factors[n] = discounts(seen)
            if n == 1:
                model.tokens, model.kinds = tokens, kinds
                model.mass = tokens - sum(r * seen[r] * (1 - f) for r, f in enumerate(model.factors[1]))
            else:
                known.append(answers(_by_chunk(texts, known, _ASKED, lambda c, r, n=n: _context_sums(model, c, r, n)), 2 * n + 1))
        out = written(_by_chunk(texts, known, SCHEMA, lambda c, r: _scored(model, c, r)))
    forget(texts, *known)
    return out


def _asked_counts(texts: DataFrame, model: Model, n: int) -> DataFrame:
    buckets = model.buckets[2 * n]

    def asking(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                c = Chunk(row)
                number, keys, _, _ = c.of(n)
                here = number >= 0
                yield _asking(row.chunk, keys, np.bincount(number[here], weights=c.counted[here], minlength=len(keys)).astype(np.int64), buckets)

    return texts.mapInPandas(asking, _ASKED)


def _counts_of_counts(known: DataFrame, kind: int) -> list[int]:
    """How many n-grams occur 0 (not counted), 1, ... FEW + 1 times, then how many there are and how often altogether."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(FEW + 4, np.int64)
        for batch in batches:
            sums, first = _sums_first(batch, kind)
            own = sums[first]
            seen += np.append(np.bincount(own[own < FEW + 2], minlength=FEW + 2), (len(own), own.sum()))
        yield pd.DataFrame({"place": np.arange(len(seen), dtype=np.int32), "n": seen})

    rows = known.select("sums", "first").mapInPandas(counted, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen = [0] * (FEW + 4)
    for row in rows:
        seen[row.place] = row.n
    return seen


def _by_chunk(texts: DataFrame, known: list[DataFrame], schema: str, make) -> DataFrame:
    """What ``make`` says of each chunk and of the answers to it."""
    union = known[0]
    for k in known[1:]:
        union = union.unionByName(k)

    def made(own: pd.DataFrame, answered: pd.DataFrame) -> pd.DataFrame:
        return make(Chunk(next(own.itertuples())), answered).assign(**({"chunk": own["chunk"].iloc[0]} if schema is _ASKED else {}))

    return texts.groupBy("chunk").cogroup(union.groupBy("chunk")).applyInPandas(made, schema)


def _context_sums(model: Model, chunk: Chunk, rows: pd.DataFrame, n: int) -> pd.DataFrame:
    """Of the n-grams that are first here, the discounted counts and lower-order probabilities, summed by context."""
    _, keys, context, place = chunk.of(n)
    counts, first = _answered(rows, 2 * n, keys, model.buckets[2 * n])
    lower, _ = model.probabilities(chunk, rows, n - 1)
    sums = [np.bincount(context, weights=np.where(first, v, 0.0), minlength=len(chunk.of(n - 1)[1])) for v in (_kept(counts[:, 0], model.factors[n]), lower[place])]
    held = chunk.contexts(n)
    return _asking(0, chunk.of(n - 1)[1][held], np.stack(sums, axis=1)[held], model.buckets[2 * n + 1])


def _scored(model: Model, chunk: Chunk, rows: pd.DataFrame) -> pd.DataFrame:
    p, counts = model.probabilities(chunk, rows, model.order)
    base = np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.kinds + 1)))
    summed = lambda x: np.add.reduceat(x, chunk.begins)
    return pd.DataFrame({
        "doc_id": pd.array(chunk.doc, "Int64"), "held_out": ~chunk.train, "n_tokens": chunk.sizes.astype(np.int64), "n_known": summed((counts > 0).astype(np.int64)),
        "train_tokens": np.int64(model.tokens), "base_score": summed(base), "score": summed(np.log10(p)),
    })
