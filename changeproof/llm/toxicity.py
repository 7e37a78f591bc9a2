"""Toxicity: a support vector machine on a subsequence string kernel, with Nystrom landmarks.

The kernel compares two strings by the subsequences of N letters that both contain. Up to SKIPPED other letters may stand between
two of them, each at the factor DECAY, and any number of other characters: together they cost SEPARATED next to a letter
that stands alone, else DECAY. So an insult keeps most of its value when it is spelled out ("i.d.i.o.t", "i - d - i - o - t"), and
part of it with inserted letters. No sequence runs from one text to the next. Letters are compared without case and accents, common digits as the letters they look
like. Landmarks are words of the training sentences: those of toxic documents whose letter sequences tell the classes
apart, and others for contrast. The Nystrom map of a sentence is k(sentence, landmarks) K^-1/2, with K the landmarks' own kernel.

As the kernel is a dot product over the 2^20 sequences, the trained function is one number for each sequence, and a sentence is
scored in one pass over its characters. Labels are of documents; training keeps, in turn, the sentences of a toxic document
that the machine finds toxic (multiple-instance learning). A document scores as its most toxic sentence does.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from changeproof.llm.common import chunks, small_batches

N, DECAY, SEPARATED, SKIPPED = 4, 0.5, 0.95, 2
#: Labelled documents of each class that the machine is fitted on (smallest hashes), and the longest one taken.
SAMPLE, SAMPLE_CHARS = 1_500, 20_000
LANDMARKS, CONTRAST = 96, 32
#: Clean documents of the sample whose words may become landmarks for contrast.
CONTRAST_DOCS = 200
#: Longest sentence; a longer one is cut. Sequences may run over the cut.
SENTENCE = 200
_SIZE = 1 << 5 * N


def _letters() -> np.ndarray:
    """Symbol of each code point: 1 to 26 for Latin letters and look-alike digits, 27 to 31 for other letters, else 0."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x3000):
        base = unicodedata.normalize("NFKD", chr(c))[0].lower()
        if "a" <= base <= "z":
            table[c] = ord(base) - 96
        elif chr(c).isalpha():
            table[c] = 27 + c % 5
    for digit, letter in zip("013457", "oieast", strict=True):
        table[ord(digit)] = ord(letter) - 96
    return table


_SYMBOL = _letters()
_STOP = np.zeros(0x110000, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_PATTERNS = [(g, DECAY ** sum(g)) for g in product(range(SKIPPED + 1), repeat=N - 1)]


def letters(codes: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where letters are, whether other characters stand between each and the next, and which stand alone between others. starts: those of the texts."""
    at = np.flatnonzero(~echoes(codes, starts) & (_SYMBOL[codes] > 0))
    apart = np.diff(at) > 1
    return at, apart, np.concatenate(([True], apart)) & np.concatenate((apart, [True])) if len(at) else np.empty(0, bool)


def sequences(codes: np.ndarray, starts: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each way to skip letters (none at first): where sequences start, their numbers, and their weights. starts: those of the texts."""
    at, apart, alone = letters(codes, starts)
    s = _SYMBOL[codes[at]].astype(np.int32)
    step = np.where(apart, np.where(alone[1:] | alone[:-1], SEPARATED, DECAY), 1.0).astype(np.float32)
    if starts is not None:
        step[np.diff(np.searchsorted(starts, at, side="right")) > 0] = 0
    reach = [np.ones(len(s), np.float32)]
    for k in range((N - 1) * (SKIPPED + 1)):
        reach.append(reach[-1][:-1] * step[k:])
    for (a, b, c), weight in _PATTERNS:
        span = a + b + c + N - 1
        n = max(len(s) - span, 0)
        yield at[:n], (s[:n] << 15) | (s[a + 1 :][:n] << 10) | (s[a + b + 2 :][:n] << 5) | s[span:], np.float32(weight) * reach[span]


def echoes(codes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
    """Which characters belong to a word that repeats the word before it in the same text; such a word says nothing anew. One or two characters may be spelling."""
    blank = codes <= 32
    begins = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    sizes = np.append(np.flatnonzero(blank & ~np.concatenate(([True], blank[:-1]))), len(codes))[: len(begins)] - begins
    text = np.searchsorted(starts, begins, side="right") if starts is not None else np.zeros(len(begins), np.int64)
    like = np.flatnonzero((sizes[1:] > 2) & (sizes[1:] == sizes[:-1]) & (codes[begins[1:]] == codes[begins[:-1]]) & (text[1:] == text[:-1])) + 1
    length = sizes[like]
    owner = np.repeat(np.arange(len(like)), length)
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    at, before = begins[like][owner] + step, begins[like - 1][owner] + step
    differ = np.bincount(owner[codes[at] != codes[before]], minlength=len(like)) > 0
    out = np.zeros(len(codes), bool)
    out[at[~differ[owner]]] = True
    return out


def sentence_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where sentences begin: at each text, after a line's end, after a stop and a blank, and every SENTENCE characters.

    No line or stop ends a sentence whose last letter stands alone ("i. d. i. o. t").
    """
    blank = codes <= 32
    after = np.flatnonzero((codes == 10) | (blank & np.concatenate(([False], _STOP[codes[:-1]]))))[:-1]
    at, _, alone = letters(codes, starts)
    after = after[~np.concatenate(([False], alone))[np.searchsorted(at, after)]]
    begins = np.union1d(starts[:-1], after + 1)
    lengths = np.diff(np.append(begins, len(codes)))
    extra = (lengths - 1) // SENTENCE
    if extra.any():
        flat = np.repeat(begins, extra + 1)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(extra + 1) - extra - 1, extra + 1)
        begins = flat + SENTENCE * step
    return begins


@dataclass
class Machine:
    """Value of each sequence, bias, and the line from the decision value to the logit of a probability."""

    values: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def decisions(self, texts) -> np.ndarray:
        """The largest decision value of any sentence of each text; the bias for a text without letters."""
        out = []
        for _, codes, starts in chunks(texts):
            score = np.zeros(len(codes), np.float32)
            for at, index, weight in sequences(codes, starts):
                score[at] += weight * self.values[index]
            begins = sentence_starts(codes, starts)
            out.append(np.maximum.reduceat(np.add.reduceat(score, begins), np.searchsorted(begins, starts[:-1])) + self.bias)
        return np.concatenate(out) if out else np.empty(0)

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(texts) + self.shift, -30, 30)))


def _document_counts(texts: list[str]) -> np.ndarray:
    """How many texts hold each sequence without gaps."""
    counts = np.zeros(_SIZE, np.int64)
    for _, codes, starts in chunks(texts):
        at, index, weight = next(sequences(codes, starts))
        owner = np.searchsorted(starts, at, side="right") - 1
        kept = weight == 1
        pairs = np.unique(owner[kept].astype(np.int64) << 20 | index[kept])
        counts += np.bincount(pairs & _SIZE - 1, minlength=_SIZE)
    return counts


def _words(text: str) -> set[str]:
    return {w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split() if len(w) >= N}


def _landmarks(toxic: list[str], clean: list[str], contrast_docs: int = CONTRAST_DOCS) -> tuple[list[str], np.ndarray]:
    """Landmark words, and the evidence of each sequence for the toxic class (signed chi-square, not below 0)."""
    t, c = _document_counts(toxic), _document_counts(clean)
    n, m = len(toxic), len(clean)
    often = np.flatnonzero(t >= 3)
    tells = t[often] / n - c[often] / m
    share = (t[often] + c[often]) / (n + m)
    with np.errstate(divide="ignore", invalid="ignore"):
        tells /= np.sqrt(share * (1 - share) * (1 / n + 1 / m))
    z = np.zeros(_SIZE)
    z[often] = np.where(tells > 5, tells, 0.0) ** 2
    candidates, seen = {}, set()
    for text in toxic:
        for w in _words(text) - seen:
            seen.add(w)
            held = np.unique(next(sequences(np.array([*map(ord, w)], np.uint32)))[1])
            if len(held) and z[held].max() > 0:
                candidates[w] = held
    left, chosen = z.copy(), []
    names = sorted(candidates)
    score = {w: left[candidates[w]].sum() / len(candidates[w]) ** 0.5 for w in names}
    for _ in range(LANDMARKS):
        if not names:
            break
        # Scores only fall, so the best of a fresh look at the leaders is the best.
        while True:
            best = max(names, key=lambda w: (score[w], w))
            now = left[candidates[best]].sum() / len(candidates[best]) ** 0.5
            if now >= score[best] - 1e-12:
                break
            score[best] = now
        if score[best] <= 0:
            break
        chosen.append(best)
        names.remove(best)
        left[candidates[best]] *= 0.3
    others = sorted({w for text in clean[:contrast_docs] for w in _words(text)} - set(chosen))
    step = max(1, len(others) // CONTRAST)
    return chosen + others[::step][:CONTRAST], z


def _profile(word: str) -> dict[int, float]:
    """Weight of each sequence of a string, scaled to length 1."""
    out: dict[int, float] = {}
    for _, index, weight in sequences(np.array([*map(ord, word)], np.uint32)):
        for i, x in zip(index.tolist(), weight.tolist(), strict=True):
            out[i] = out.get(i, 0.0) + x
    norm = sum(v * v for v in out.values()) ** 0.5
    return {i: v / norm for i, v in out.items()} if norm else {}


def _kernel(texts: list[str], columns: np.ndarray, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """k(sentence, landmark) for the sentences that meet a landmark, and the text of each.

    columns: row of profiles for each sequence, or -1. The other sentences are all alike: their kernel is 0 throughout.
    """
    rows, owners = [], []
    for first, codes, starts in chunks(texts, 50_000):
        begins = sentence_starts(codes, starts)
        k = np.zeros((len(begins), profiles.shape[1]), np.float32)
        for at, index, weight in sequences(codes, starts):
            column = columns[index]
            held = np.flatnonzero((column >= 0) & (weight > 0))
            if len(held):
                inside, where = np.unique(np.searchsorted(begins, at[held], side="right") - 1, return_index=True)
                k[inside] += np.add.reduceat(profiles[column[held]] * weight[held, None], where, axis=0)
        met = np.flatnonzero(k.any(axis=1))
        rows.append(k[met])
        owners.append(first + np.searchsorted(starts, begins[met], side="right") - 1)
    return np.concatenate(rows), np.concatenate(owners)


#: Rows that are widened to double precision at once.
_BLOCK = 4_096


def _map(k: np.ndarray, root: np.ndarray) -> np.ndarray:
    """k @ root, in the place of k."""
    for at in range(0, len(k), _BLOCK):
        k[at : at + _BLOCK] = k[at : at + _BLOCK] @ root
    return k


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by Newton steps."""
    w, ridge = np.zeros(x.shape[1] + 1), np.ones(x.shape[1] + 1)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        left, right = np.diag(ridge), np.zeros(len(w))
        for at in range(0, len(x), _BLOCK):
            part, sign, price = x[at : at + _BLOCK], y[at : at + _BLOCK], cost[at : at + _BLOCK]
            x1 = np.hstack((part, np.ones((len(part), 1))))
            on = 1 - sign * (x1 @ w) > 0
            xa, ca = x1[on], price[on]
            left += (xa * ca[:, None]).T @ xa
            right += xa.T @ (ca * sign[on])
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * (w + new) if _ > 8 else new
    return w


def logistic_line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a logistic regression on one variable (Newton, light ridge on the slope)."""
    scale = float(x.std()) or 1.0
    z, w = np.stack((x / scale, np.ones(len(x))), axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (y - p) - np.array([ridge, 0]) * w
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def train(toxic: list[str], clean: list[str], rounds: int = 4, contrast_docs: int = CONTRAST_DOCS) -> Machine:
    """Fit on labelled texts. Without texts of both classes every score is the share of toxic ones (or one half)."""
    if not (toxic and clean):
        share = 0.5 if not (toxic or clean) else 0.98 if toxic else 0.02
        return Machine(np.zeros(_SIZE, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    landmarks, evidence = _landmarks(toxic, clean, contrast_docs)
    profiles = [p for p in map(_profile, landmarks) if p]
    known = sorted({i for p in profiles for i in p})
    columns = np.full(_SIZE, -1, np.int32)
    columns[known] = np.arange(len(known))
    phi = np.zeros((len(known), len(profiles)), np.float32)
    for j, p in enumerate(profiles):
        phi[columns[list(p)], j] = list(p.values())
    values, vectors = np.linalg.eigh((phi.T @ phi).astype(np.float64))
    root = vectors @ np.diag(np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0)) @ vectors.T
    k_toxic, of = _kernel(toxic, columns, phi)
    k_clean, _ = _kernel(clean, columns, phi)
    # One sentence stands for the clean ones that meet no landmark; toxic ones of that kind say nothing.
    x_clean = _map(np.vstack((k_clean, np.zeros((1, phi.shape[1]), np.float32))), root)
    del k_clean
    decision = k_toxic @ (evidence[known] @ phi)
    x_toxic = _map(k_toxic, root)
    for turn in range(rounds):
        top = np.full(len(toxic), -np.inf)
        np.maximum.at(top, of, decision)
        picked = (decision >= top[of]) & (decision > (0 if turn == 0 else -0.5)) | (decision > 0) & (turn > 0)
        if not picked.any():
            break
        x = np.vstack((x_toxic[picked], x_clean))
        y = np.repeat([1.0, -1.0], [picked.sum(), len(x_clean)])
        cost = np.repeat([10.0 * max(1.0, min(10.0, len(x_clean) / picked.sum() / 10)), 10.0], [picked.sum(), len(x_clean)])
        w = _svm(x, y, cost)
        decision = x_toxic @ w[:-1] + w[-1]
    else:
        table = np.zeros(_SIZE, np.float32)
        table[known] = phi @ (root @ w[:-1])
        machine = Machine(table, float(w[-1]))
        machine.slope, machine.shift = logistic_line(machine.decisions(toxic + clean), np.repeat([1.0, 0.0], [len(toxic), len(clean)]))
        return machine
    return Machine(np.zeros(_SIZE, np.float32), 0.0, 0.0, float(np.log(len(toxic) / len(clean))))


def _drawn(docs: DataFrame, labels: DataFrame, label: str, sample: int, most_chars: int) -> DataFrame:
    """Documents (doc_id, text, label) of at most ``most_chars`` code points with the labelled ids of the smallest hashes, ``2 * sample`` of each class."""
    marks = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).distinct()
    # Twice as many are drawn by hash as are wanted, since not all are found in docs or short enough.
    drawn = [marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample) for k in (1, 0)]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.length("text") <= most_chars)
    return texts.join(ids, "doc_id")


def _classes(rows: Iterable[tuple[str, int]], sample: int) -> tuple[list[str], list[str]]:
    """The first ``sample`` texts of each class: (label 1, label 0)."""
    found: dict[int, list[str]] = {1: [], 0: []}
    for text, label in rows:
        if len(found[label]) < sample:
            found[label].append(text)
    return found[1], found[0]


def learn(docs: DataFrame, labels: DataFrame, label: str, sample: int, most_chars: int) -> tuple[list[str], list[str]]:
    """Texts of at most ``sample`` labelled documents of each class: (label 1, label 0).

    Those with the smallest hashes of doc_id, of at most ``most_chars`` code points, in a stable order.
    """
    rows = _drawn(docs, labels, label, sample, most_chars).orderBy(F.xxhash64("doc_id"), "doc_id", "text").toLocalIterator()
    return _classes(((row.text, row.label) for row in rows), sample)


def _fitted(docs: DataFrame, labels: DataFrame, sample: int, most_chars: int, contrast_docs: int) -> Machine:
    """The machine trained on the texts that learn draws. One task of an executor trains it, so the driver holds neither texts nor kernels."""

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = train(*_classes((row for batch in batches for row in zip(batch["text"], batch["label"], strict=True)), sample), contrast_docs=contrast_docs)
        yield pd.DataFrame({"values": [made.values.tobytes()], "bias": [made.bias], "slope": [made.slope], "shift": [made.shift]})

    drawn = _drawn(docs, labels, "toxic", sample, most_chars).repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "text").select("text", "label")
    rows = drawn.mapInPandas(fit, "values binary, bias double, slope double, shift double").collect()
    return Machine(np.frombuffer(rows[0]["values"], np.float32), *rows[0][1:]) if rows else train([], [])


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, threshold: float = 0.3, most_chars: int = SAMPLE_CHARS, contrast_docs: int = CONTRAST_DOCS) -> DataFrame:
    """docs(doc_id, text, ...) with score and predicted added, one row for each row of docs.

    labels(doc_id, toxic) are learned from where held_out (a condition on doc_id) is not true: every sentence of at most ``sample``
    documents of each class of at most ``most_chars`` code points. Words of the first ``contrast_docs`` clean ones may be contrast landmarks. score is between 0 and 1, higher where
    toxic is likelier; predicted is 1 from ``threshold`` on. Null and empty texts score as texts without any letter. Null
    labels and null ids are not learned from. An empty table gives an empty one. Other columns are kept, but for score and predicted, which
    are replaced.

    A text scores by its own characters alone, so equal texts score equally wherever they stand. A sentence of more than SENTENCE
    characters is scored in parts of that many (the parts' sequences run on over the cut, and the highest part counts), and a word of
    three or more characters that repeats the word before it counts once.
    """
    small_batches(docs.sparkSession)
    machine = _fitted(docs, labels.where(~held_out), sample, most_chars, contrast_docs)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(machine.scores(batch.tolist()).astype(float))

    scored = docs.withColumn("score", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
