"""Importance resampling against a plain version, on rows with nulls, ties, repeats, long words and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from changeproof.llm import importance_resampling as ir

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, words long, weight string, score string, rank string, bucket string, place string, tie string, row string, w string, utf8 string"


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, words + [" ".join(p) for p in zip(words, words[1:], strict=False)]


def plain(docs, target, buckets=10_000, percent=25, least=20):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    s, t = count(x for _, x in docs), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        words, fs = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in fs)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    ranked = sorted((-r[3], r[0] is None, r[0] or 0) for r in out if r[4])
    return Counter(r[:4] for r in out), ranked[: len(ranked) * percent // 100]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    word = lambda: r.choice(("The", "Ding", "on2", "é", "ÀB", "x", "sh-re", "a", "\U0001f600", "und", "İ")) + r.choice(("", "s", "ing", "9"))
    texts = [" ".join(word() for _ in range(r.choice((0, 1, 5, 19, 25, 80)))) for _ in range(120)]
    texts += [None, "", " ,.\n", "one", "k" * 30_000 + " tail " + "k" * 30_000 + " tail", ("wort, " * 9_000), "A" * 64 + " " + "b" * 65, "x" * 300 + " y " * 30]
    found = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    return found + found[20:30] * 3 + [(None, "no id " * 30), (None, None)]


def test_features_and_crcs(rows):
    texts = [(t or "").encode() for _, t in rows]
    bucket, owner, words = ir.feature_buckets(texts, 10_000)
    got = [Counter(bucket[owner == k].tolist()) for k in range(len(texts))]
    assert got == [Counter(zlib.crc32(f.encode()) % 10_000 for f in features(t)[1]) for _, t in rows]
    assert words.tolist() == [len(features(t)[0]) for _, t in rows]
    r = np.random.default_rng(1)
    buf = r.integers(0, 256, 5_000, dtype=np.uint8)
    starts, lengths = r.integers(0, 4_000, 900), r.integers(1, 400, 900)
    assert ir.crc_of_ranges(buf, starts, lengths).tolist() == [zlib.crc32(buf[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]


def test_longer_runs():
    bucket, owner, _ = ir.feature_buckets([b"a b c d", b"a b", b"", b"b c d"], 997, order=3)
    runs = lambda w: [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
    for k, t in enumerate(("a b c d", "a b", "", "b c d")):
        assert sorted(bucket[owner == k].tolist()) == sorted(zlib.crc32(f.encode()) % 997 for f in runs(t.split()))


@pytest.mark.parametrize("parts", [1, 5])
def test_resample(spark, rows, parts):
    docs = spark.createDataFrame([(*r, 1, *"abcdefghi") for r in rows], SCHEMA).repartition(parts)
    target = [None, "", "The ding on2", "and then UNd ding x"]
    got = ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    expected, drawn = plain(rows, target)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == expected
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked] == drawn


def test_empty_tables(spark, rows):
    docs, none = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert ir.resample(none, docs).count() == 0
    got = ir.resample(docs, none).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == plain(rows, [])[0]
