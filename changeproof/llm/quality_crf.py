"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are shares of character classes, word lengths, repetition and form, and the same of the lines
before and after it; transitions tie neighbouring labels. Forward-backward gives each line's marginal, and the marginals,
weighted by line length, give the document's quality, which a logistic line brings to a probability.

Labels are of documents: training starts with each line labelled as its document, then lets lines of bad documents be good
where the field finds them so, and fits again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from changeproof.llm.common import chunks, mixed, small_batches
from changeproof.llm.toxicity import learn, logistic_line

#: Labelled documents of each class that the field is fitted on (smallest hashes), and the longest one taken.
SAMPLE, SAMPLE_CHARS = 1_500, 20_000
LETTER, UPPER, DIGIT, STOP, PUNCT, SYMBOL, BAR, BLANK = range(8)


def _classes() -> np.ndarray:
    table = np.full(0x110000, LETTER, np.uint8)
    for c in range(0x3000):
        x = chr(c)
        table[c] = UPPER if x.isupper() else DIGIT if x.isdigit() else LETTER if x.isalpha() else SYMBOL
    for kind, characters in ((STOP, ".?"), (PUNCT, ",;:'\"()-"), (BAR, "|"), (BLANK, " \t\n\x0b\x0c\r\xa0")):
        table[[ord(c) for c in characters]] = kind
    return table


_CLASS = _classes()
FEATURES = 22


def line_features(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its characters without blanks, first line of each text and one end more)."""
    ends = np.flatnonzero(codes == 10)
    begins = np.concatenate(([0], ends[:-1] + 1))
    n = len(ends)
    kind = _CLASS[codes]
    line = np.repeat(np.arange(n), ends + 1 - begins)
    counts = np.bincount(line * 8 + kind, minlength=8 * n).reshape(n, 8).astype(np.float64)
    dense = counts[:, :BLANK].sum(axis=1)
    some = np.maximum(dense, 1)
    letters = np.maximum(counts[:, LETTER] + counts[:, UPPER], 1)
    # Words: runs without blanks; their hashes come from sums of scrambled characters by place.
    blank = kind == BLANK
    w0 = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    w1 = np.flatnonzero(blank & ~np.concatenate(([True], blank[:-1])))
    size = w1 - w0
    place = np.arange(len(codes), dtype=np.uint64)
    inside = np.repeat(w0, size)
    flat = inside + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    scrambled = mixed(codes[flat].astype(np.uint64) + ((place[flat] - inside.astype(np.uint64)) << np.uint64(24)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(scrambled)))
    stops = np.cumsum(size)
    word = total[stops] - total[stops - size] if len(size) else np.empty(0, np.uint64)
    of = line[w0]
    words = np.bincount(of, minlength=n).astype(np.float64)
    some_words = np.maximum(words, 1)
    same = np.concatenate(([False], (word[1:] == word[:-1]) & (of[1:] == of[:-1]))) if len(word) else np.empty(0, bool)
    repeated = np.bincount(of[same], minlength=n) / some_words
    distinct = np.unique(mixed(word + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    varied = np.bincount(of[distinct], minlength=n) / some_words
    per_word = counts[:, [SYMBOL, BAR]].sum(axis=1) / some_words
    last = kind[np.maximum(ends - 1, 0)]
    upper = counts[:, UPPER] / letters
    share = counts[:, :BLANK] / some[:, None]
    x = np.stack(
        (
            np.log1p(dense) / 6, np.log1p(words) / 4, dense / some_words / 10, upper, *(share[:, k] for k in (DIGIT, STOP, PUNCT, SYMBOL, BAR)),
            repeated, varied, (last == STOP).astype(float), (kind[begins] == UPPER).astype(float), (words == 0).astype(float),
            np.minimum(per_word, 3) / 3, upper > 0.5, share[:, SYMBOL] > 0.08, share[:, BAR] > 0.02, repeated > 0.3, varied < 0.5, (words > 0) & (words < 4), np.log1p(np.bincount(of, weights=size.astype(float) ** 2, minlength=n) / some_words) / 8,
        ),
        axis=1,
    )
    return x, dense, np.searchsorted(begins, starts)


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after (zeros at a text's ends), and marks of the ends."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    head, tail = first[:-1], first[1:] - 1
    before[head], after[tail] = 0, 0
    ends = np.zeros((len(x), 2))
    ends[head, 0], ends[tail, 1] = 1, 1
    return np.hstack((x, before, after, ends, np.ones((len(x), 1))))


def forward_backward(unary: np.ndarray, first: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the forward and the backward messages of each line. t[i, j]: transition from label i to j.

    All texts that still have a line at a step move together, so the steps are as many as the longest text has lines.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    head, lengths = first[:-1][order], lengths[order]
    active = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="left")
    a, b = unary.copy(), np.zeros_like(unary)
    for step in range(1, len(active)):
        at = head[: active[step]] + step
        p = a[at - 1]
        a[at] += np.logaddexp(t[0, 1], p + t[1, 1]) - np.logaddexp(t[0, 0], p + t[1, 0])
    for step in range(len(active) - 1, 0, -1):
        at = head[: active[step]] + step
        q = unary[at] + b[at]
        b[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + q) - np.logaddexp(t[0, 0], t[0, 1] + q)
    return a, b


@dataclass
class Field:
    """Weights of the features (standardised), transitions, and the line from the weighted mean's logit to a probability."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def marginals(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        unary = with_neighbours((x - self.centre) / self.scale, first) @ self.weights
        a, b = forward_backward(unary, first, self.moves)
        return 1 / (1 + np.exp(-np.clip(a + b, -30, 30)))

    def logits(self, texts) -> np.ndarray:
        """Logit of the length-weighted mean marginal of each text; 0 for a text of blanks."""
        out = []
        for _, codes, starts in chunks(texts):
            x, dense, first = line_features(codes, starts)
            out.append(_logit(self.marginals(x, first), dense, first))
        return np.concatenate(out) if out else np.empty(0)

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def _logit(good: np.ndarray, dense: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = np.add.reduceat(dense, first[:-1])
    mean = np.where(weight > 0, np.add.reduceat(good * dense, first[:-1]) / np.maximum(weight, 1), 0.5)
    return np.log((mean + 1e-3) / (1 - mean + 1e-3))


def _fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 200, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum conditional likelihood by adaptive gradient steps (moments of first and second order)."""
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    later = np.setdiff1d(np.arange(len(x)), first[:-1])
    labels = np.stack((1 - y, y), axis=1)
    seen = np.einsum("ni,nj->ij", labels[later - 1], labels[later])
    for k in range(1, steps + 1):
        w, t = theta[:-4], theta[-4:].reshape(2, 2)
        unary = x @ w
        a, b = forward_backward(unary, first, t)
        p = 1 / (1 + np.exp(-np.clip(a + b, -30, 30)))
        zero = np.zeros(len(later))
        joint = np.stack((zero, a[later - 1]), axis=1)[:, :, None] + t[None] + np.stack((zero, unary[later] + b[later]), axis=1)[:, None, :]
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        expected = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        gradient = np.concatenate((x.T @ (y - p), (seen - expected).ravel())) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(good: list[str], bad: list[str], rounds: int = 2) -> Field:
    """Fit on labelled texts. Without texts of both classes every score is the same."""
    if not (good and bad):
        share = 0.5 if not (good or bad) else 0.98 if good else 0.02
        width = 3 * FEATURES + 3
        return Field(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(width), np.zeros((2, 2)), 0.0, float(np.log(share / (1 - share))))
    texts = good + bad
    parts = [line_features(codes, starts) for _, codes, starts in chunks(texts)]
    x = np.concatenate([p[0] for p in parts])
    dense = np.concatenate([p[1] for p in parts])
    before = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
    first = np.concatenate([p[2][:-1] + b for p, b in zip(parts, before, strict=True)] + [[len(x)]])
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    full = with_neighbours((x - centre) / scale, first)
    label = np.repeat([1.0, 0.0], [len(good), len(bad)])
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    y = label[of]
    for turn in range(rounds):
        weights, moves = _fit(full, y, first)
        field = Field(centre, scale, weights, moves)
        p = field.marginals(x, first)
        if turn < rounds - 1:
            least = np.minimum.reduceat(p, first[:-1])
            y = np.where((label[of] == 0) & (p > 0.5) & (p > least[of]), 1.0, label[of])
    field.slope, field.shift = logistic_line(_logit(p, dense, first), label)
    return field


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """docs(doc_id, text, ...) with score and predicted added, one row for each row of docs.

    labels(doc_id, quality) are learned from where held_out (a condition on doc_id) is not true. score is between 0 and 1, higher where
    quality 1 is likelier; predicted is 1 from ``threshold`` on. Null, empty and blank texts score as a mean marginal of one half
    does. Null labels and null ids are not learned from. An empty table gives an empty one. Other columns are kept.
    """
    small_batches(docs.sparkSession)
    field = train(*learn(docs, labels.where(~held_out), "quality", sample, SAMPLE_CHARS))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(field.scores(batch.tolist()).astype(float))

    scored = docs.withColumn("score", score(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
