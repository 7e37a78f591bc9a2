"""Katz backoff against plain dictionaries, over several orders and chunk sizes, on rows with nulls, repeats and long texts."""

import math
import os
import random
import re
import time
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from changeproof.llm import katz_backoff as kb
from changeproof.llm.common import swept, written
from changeproof.llm.queries import fold

SCHEMA = "doc_id long, text string, score string, chunk string, train string, utf8 string, sizes string, token string"


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), None]


class Plain:
    """The model as it is defined, over all words and the unknown one (\\0)."""

    def __init__(self, texts, order):
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            for n in range(1, order + 1):
                self.counts[n].update(tuple(t[k : k + n]) for k in range(len(t) - n + 1))
        self.words = [w for (w,) in self.counts[1]] + ["\0"]
        self.n = sum(self.counts[1].values())
        self.factors = [None] + [kb.discounts([sum(v == r for v in c.values()) if r else 0 for r in range(kb.FEW + 2)]) for c in self.counts[1:]]
        self.seen = [{} for _ in range(order + 1)]
        for n in range(1, order + 1):
            for gram, c in self.counts[n].items():
                self.seen[n].setdefault(gram[:-1], {})[gram[-1]] = c
        self.memo = {}

    def p(self, word, context):
        key = (word, context)
        if key not in self.memo:
            n = len(context) + 1
            lower = (lambda w: self.p(w, context[1:])) if context else (lambda w: float(w == "\0"))
            followers = self.seen[n].get(context, {})
            if not followers:
                self.memo[key] = lower(word)
            else:
                kept = {w: c * (self.factors[n][c] if c < len(self.factors[n]) else 1.0) for w, c in followers.items()}
                total = sum(followers.values())
                total += math.isclose(sum(kept.values()), total, rel_tol=1e-9)
                if word in kept:
                    self.memo[key] = kept[word] / total
                else:
                    rest = sum(lower(w) for w in self.words if w not in followers)
                    self.memo[key] = (total - sum(kept.values())) / total * lower(word) / rest
        return self.memo[key]

    def score(self, text, order):
        known = [w if (w,) in self.counts[1] else "\0" for w in text]
        return sum(math.log10(self.p(w, tuple(known[max(0, i - order + 1) : i]))) for i, w in enumerate(known))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    line = lambda n: " ".join(r.choices(words, [1 / (k + 1) for k in range(40)], k=n))
    texts = [line(r.choice((1, 3, 12, 40))) for _ in range(150)]
    texts += [None, "", " \t\n", "W1 w2\x0bw3\x85w4", "neu " * 300, "x" * 5_000 + " w1 w2", "É é \U0001f600 w1", "w0 never w1 seen w2", line(3_000)]
    found = [(i, t) for i, t in enumerate(texts)]
    return found + found[10:16] * 3 + [(None, "w1 w2 w3"), (None, None)]


def held(i):
    return i is None or crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize(("order", "chunk", "parts"), [(1, 90, 3), (2, 10**6, 1), (2, 90, 4), (3, 200, 3)])
def test_scores(spark, rows, order, chunk, parts):
    docs = spark.createDataFrame([(*r, *"abcdef") for r in rows], SCHEMA).repartition(parts)
    got = kb.katz_scores(docs, fold(5, 1), order, chunk, 50).collect()
    model = Plain([tokens(t) for i, t in rows if not held(i)], order)
    v = len(model.words)
    expected = []
    for i, text in rows:
        t = tokens(text)
        c = [model.counts[1][w,] for w in t]
        expected.append((i is None, i or 0, held(i), len(t), sum(x > 0 for x in c), model.n, sum(math.log10((x + 0.5) / (model.n + 0.5 * v)) for x in c), model.score(t, order)))
    found = [(r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got]
    for e, f in zip(sorted(expected), sorted(found), strict=True):
        assert f[:6] == e[:6] and f[6:] == pytest.approx(e[6:], rel=1e-9)


def test_distributions_sum_to_one(rows):
    model = Plain([tokens(t) for i, t in rows if not held(i)], 3)
    for context in ((), ("w0",), ("w1", "w0"), ("neu", "neu"), ("w39",), ("\0",), ("\0", "w2")):
        assert sum(model.p(w, context) for w in model.words) == pytest.approx(1)


def test_order_two_is_better_where_words_depend_on_each_other(spark):
    r = random.Random(3)
    texts = []
    for i in range(400):
        w = [r.randrange(30)]
        for _ in range(30):
            w.append((7 * w[-1] + r.choice((1, 1, 1, 2))) % 30)
        texts.append((i, " ".join(f"v{x}" for x in w)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, two = ({r.doc_id: r for r in kb.katz_scores(docs, fold(5, 1), n).collect()} for n in (1, 2))
    for i, r in two.items():
        if r.held_out:
            assert r.score > one[i].score + 5 and r.score > r.base_score + 5


def test_discounts():
    # n1 to n6 of a Zipf-like table.
    factors = kb.discounts([0, 1000, 330, 160, 100, 66, 48])
    assert len(factors) == 6 and all(0 < f < 1 for f in factors[1:])
    r1 = 2 * 330 / 1000
    above = 6 * 48 / 1000
    assert factors[1] == pytest.approx((r1 - above) / (1 - above))
    for odd in ([0] * 7, [0, 5, 0, 0, 0, 0, 0], [0, 1, 9, 9, 9, 9, 9], [0, 0, 3, 2, 1, 1, 1]):
        assert list(kb.discounts(odd)) == [1.0, 0.5, 0.75, 5 / 6, 0.875, 0.9]


def test_no_training_and_no_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert kb.katz_scores(docs.limit(0), fold(5, 1)).count() == 0
    got = kb.katz_scores(docs.where("doc_id IS NULL"), fold(5, 1)).collect()
    assert {(r.train_tokens, r.n_known, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}


@pytest.mark.parametrize("values", [[], [0], [0, 0, 255], [256, 1], [2**40, 3, 0], [2**62, 2**53 + 1]])
def test_numbers_travel_unchanged(values):
    whole, real = np.array(values, np.int64), np.array([x / 3 for x in values] + [-0.0, 1e-300, -2.5])
    assert kb._unpacked(kb._packed(whole)).tolist() == values
    assert kb._unpacked(kb._packed(real), np.float64).tobytes() == real.tobytes()


@pytest.mark.parametrize("buckets", [1, 2, 7, 268])
def test_keys_are_dealt_by_ranges_and_take_few_bytes(buckets):
    r = np.random.default_rng(buckets)
    keys = np.append(r.integers(0, 2**64, 200_000, np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64))
    r.shuffle(keys)
    order, above, starts = kb._dealt(keys, buckets)
    bucket = [kb._bucket(k, buckets) for k in keys[order]]
    assert bucket == sorted(bucket) and bucket[0] == 0 and bucket[-1] == buckets - 1 and len(starts) == buckets + 1
    step = (1 << 63) // buckets + 1
    for a, b in zip(starts, starts[1:], strict=False):
        assert len(set(bucket[a:b])) == 1
        assert (np.cumsum(kb._from_planes(kb._planes(above[a:b]))) + np.uint64(2 * step * bucket[a])).tolist() == keys[order[a:b]].tolist()
    counts = r.choice([0, 1, 1, 1, 2, 3, 40], len(keys))
    asked = kb._asking(0, keys, counts, buckets)
    # A key and its count took 16 bytes.
    assert sum(len(x) for c in ("keys", "sums") for x in asked[c]) < 7.5 * len(keys)


def test_shuffle_files_go_when_a_job_ends(spark):
    places = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for p in places for _, _, found in os.walk(p) for f in found if f.startswith("shuffle_")}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, set_to = files(), spark.conf.get(key)
    with swept(spark):
        table = written(spark.range(1_000).groupBy((F.col("id") % 10).alias("k")).count())
        end = time.time() + 20
        while files() - before and time.time() < end:
            time.sleep(0.2)
        assert not files() - before
    assert table.count() == 10 and spark.conf.get(key) == set_to
