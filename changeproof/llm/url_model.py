"""URL filter: the likelihood ratio of two character language models.

One variable-order Markov model is trained on accepted and one on rejected URLs. A character's probability mixes all context
lengths up to ORDER by Witten-Bell smoothing: the longest context seen counts most, and what it leaves goes to the next shorter
one, down to a uniform distribution over bytes. A URL's score is the difference of the two log-likelihoods over its
length; the threshold is the one that separates labelled URLs best that their models have not counted.

All labelled URLs are counted, whole, and all of them calibrate the threshold: they are dealt to FOLDS parts by hash, and beside the models of all URLs, which
give the scores, there are those without one part each, which judge that part. A byte and the ORDER bytes before it are a window; what a byte adds to a score depends on its
window alone. So windows are counted in one table, the shorter contexts are summed up from it, each distinct window gets its
gains once, and URLs are joined to the gains of their windows. The threshold comes from a table of the distinct scores with running sums by ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from changeproof.llm.common import small_batches, written

#: Longest context; a context and its next byte fit 64 bits up to 7.
ORDER = 5
#: Parts of the labelled URLs; each is judged by models counted from the others.
FOLDS = 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule (verdict, host + path) that fits the host or a subdomain and the path; else null.

    The rules are few and are part of the plan. Of rules of one length the first wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule in sorted(rules, key=lambda r: len(r[1])):
        at, start = rule.partition("/")[0], "/" + rule.partition("/")[2]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


@dataclass
class Markov:
    """One class in memory, as ``gains`` has it in tables. Counts: for each order the sorted (context, byte) keys with counts, and contexts with total and kinds."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, urls: list[bytes], order: int) -> Markov:
        codes, inside = _padded(urls, order)
        grams, contexts = [], []
        for k in range(order + 1):
            keys, counts = np.unique(_keys(codes, k)[inside], return_counts=True)
            grams.append((keys, counts))
            ctx, at = np.unique(keys >> np.uint64(8), return_index=True)
            at = np.append(at, len(keys))
            contexts.append((ctx, np.add.reduceat(counts, at[:-1]) if len(keys) else counts, np.diff(at)))
        return cls(grams, contexts)

    def log_probability(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        p = np.full(int(inside.sum()), 1 / 256)
        for k, ((keys, counts), (ctx, totals, kinds)) in enumerate(zip(self.grams, self.contexts, strict=True)):
            if not len(keys):
                continue
            key = _keys(codes, k)[inside]
            g = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            c = np.minimum(np.searchsorted(ctx, key >> np.uint64(8)), len(ctx) - 1)
            n = np.where(keys[g] == key, counts[g], 0)
            seen = ctx[c] == key >> np.uint64(8)
            p = np.where(seen, (n + kinds[c] * p) / (totals[c] + kinds[c]), p)
        return np.log(p)


def _padded(urls: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, each URL after ``order`` zeros and before one; inside marks bytes that count."""
    pad = b"\0" * order
    codes = np.frombuffer(b"".join(pad + u.replace(b"\0", b"\1") + b"\0" for u in urls), np.uint8)
    inside = codes > 0
    ends = np.cumsum([len(u) + order + 1 for u in urls]) - 1
    inside[ends.astype(np.int64)] = True
    return codes, inside


def _keys(codes: np.ndarray, k: int) -> np.ndarray:
    """For each byte: the k bytes before it and itself, as one integer. The context length is marked by the order's own table."""
    out = codes.astype(np.uint64)
    for j in range(1, k + 1):
        out[j:] |= codes[:-j].astype(np.uint64) << np.uint64(8 * j)
    return out


_CLASSES = ("accepted", "rejected")


def windows(order: int):
    """A column function: url to the window of each of its bytes and of its end, as one integer each."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for u in batch:
                codes, inside = _padded([u.encode("utf-8", "replace")], order)
                out.append(_keys(codes, order)[inside].view(np.int64))
            yield pd.Series(out, dtype=object)

    return keys


def gains(counts: DataFrame, order: int, models: int) -> DataFrame:
    """counts(win, accepted_0, rejected_0, accepted_1, ...), one row for each window and two counts a model, to (win, gains), one gain a model.

    A gain is the log of the byte's probability under accepted less that under rejected. Windows that are only to be scored have counts of 0. A context has at most 256 next bytes, and a window 256 longer ones.
    """
    names = [f"{c}_{m}" for m in range(models) for c in _CLASSES]
    level = None
    for k in range(order + 1):
        gram = F.col("win").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1 if k < 7 else -1))
        grams = counts.groupBy(gram.alias("gram")).agg(*(F.sum(c).alias(c) for c in names))
        context = Window.partitionBy(F.shiftrightunsigned("gram", 8))
        sums = [x for c in names for x in (F.sum(c).over(context).alias(f"total_{c}"), F.sum((F.col(c) > 0).cast("long")).over(context).alias(f"kinds_{c}"))]
        grams = grams.select("*", *sums)
        if level is None:
            grams = grams.select("*", *(F.lit(1 / 256).alias(f"p_{c}") for c in names))
        else:
            grams = grams.withColumn("shorter", F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))).join(level, "shorter")
        mixed = [(F.col(c) + F.col(f"kinds_{c}") * F.col(f"p_{c}")) / (F.col(f"total_{c}") + F.col(f"kinds_{c}")) for c in names]
        p = [F.when(F.col(f"total_{c}") > 0, x).otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c, x in zip(names, mixed, strict=True)]
        level = grams.select(F.col("gram").alias("shorter"), *p)
    return level.select(F.col("shorter").alias("win"), F.array(*(F.log(f"p_accepted_{m}") - F.log(f"p_rejected_{m}") for m in range(models))).alias("gains"))


def best_threshold(accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The middle between neighbouring scores that gives the best mean of both classes' rates, the one nearest 0 of several; 0 if a class has none.

    In memory, as ``threshold_of`` has it in tables.
    """
    if not (len(accepted) and len(rejected)):
        return 0.0
    ranked = np.unique(np.concatenate((accepted, rejected)))
    cuts = np.concatenate((ranked[:1] - 1e-6, (ranked[1:] + ranked[:-1]) / 2, ranked[-1:] + 1e-6))
    pos, neg = np.sort(accepted), np.sort(rejected)
    rate = (1 - np.searchsorted(pos, cuts) / len(pos)) + np.searchsorted(neg, cuts) / len(neg)
    best = cuts[rate >= rate.max() - 1e-12]
    return float(best[np.abs(best).argmin()])


def threshold_of(judged: DataFrame) -> float:
    """``best_threshold`` of judged(score, accepted), all rows: distinct scores are dealt to ranges, and sums run within a range and over the ranges.

    Rates are compared as whole numbers, over a common denominator.
    """
    levels = judged.groupBy("score").agg(F.count_if("accepted").alias("pos"), F.count_if(~F.col("accepted")).alias("neg"))
    ranged = written(levels.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    # One row for each range.
    parts = ranged.groupBy("part").agg(F.min("score").alias("lowest"), F.max("score").alias("highest"), F.sum("pos").alias("part_pos"), F.sum("neg").alias("part_neg"))
    rising = Window.orderBy("lowest")
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.lag("highest").over(rising).alias("last"), *(F.coalesce(F.sum(f"part_{c}").over(earlier), F.lit(0)).alias(f"start_{c}") for c in ("pos", "neg")))
    every = parts.agg(F.sum("part_pos").alias("pos"), F.sum("part_neg").alias("neg"), F.max("highest").alias("highest")).first()
    if not (every.pos and every.neg):
        return 0.0
    within = Window.partitionBy("part").orderBy("score")
    below = [F.col(f"start_{c}") + F.coalesce(F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in ("pos", "neg")]
    cuts = ranged.join(F.broadcast(starts), "part").select("score", F.coalesce(F.lag("score").over(within), "last").alias("last"), (below[1] * F.lit(every.pos) - below[0] * F.lit(every.neg)).alias("rate"))
    middle = (F.col("last") + F.col("score")) / 2
    # Between two doubles without one in between, the upper one parts them.
    cut = F.when(F.col("last").isNull(), F.col("score") - 1e-6).when(middle > F.col("last"), middle).otherwise(F.col("score"))
    best = cuts.select("rate", cut.alias("cut")).orderBy(F.desc("rate"), F.abs("cut"), "cut").first()
    return min((-best.rate, abs(best.cut), best.cut), (0, abs(every.highest + 1e-6), every.highest + 1e-6))[2]


def url_scores(urls: DataFrame, order: int = ORDER, sample: int | None = None) -> tuple[DataFrame, float] | None:
    """urls(url, accepted), distinct, without nulls in url, to (url, score) and the threshold.

    accepted is null where no rule says so. All labelled URLs are counted; None if a class has none. All calibrate the threshold, each by the
    models that count all parts but its own; a part without which a class has no URL does not, and the threshold is 0 if a class has nothing judged.
    With a ``sample``, there is one pair of models: a fifth (by hash) of that many URLs of each class with the smallest hashes is held out from them for the threshold.
    """
    mark = F.xxhash64("url")
    numbered = [F.monotonically_increasing_id().alias("id"), "url", "accepted"]
    # judge: the model that judges the URL for the threshold. Model 0 gives the scores.
    if sample is None:
        known = written(urls.select(*numbered, F.when(F.col("accepted").isNotNull(), 1 + F.pmod(mark, F.lit(FOLDS))).cast("int").alias("judge")))
        counted = [F.lit(True), *(F.col("judge") != k for k in range(1, FOLDS + 1))]
    else:
        drawn = [urls.where(F.col("accepted") == want).select("url", mark.alias("mark")).orderBy("mark", "url").limit(sample) for want in (True, False)]
        held = drawn[0].unionByName(drawn[1]).where("mark % 5 = 0").select("url", F.lit(0).alias("judge"))
        known = written(urls.join(F.broadcast(held), "url", "left").select(*numbered, "judge"))
        counted = [F.col("judge").isNull()]
    tells = [x & m for m in counted for x in (F.col("accepted"), ~F.col("accepted"))]
    there = known.agg(*(F.count_if(x).alias(f"n{i}") for i, x in enumerate(tells))).first()
    full = [m for m in range(len(counted)) if there[2 * m] and there[2 * m + 1]]
    if 0 not in full:
        return None
    cut = written(known.select("id", "accepted", "judge", windows(order)("url").alias("wins")))
    each = cut.select("accepted", "judge", F.explode("wins").alias("win"))
    names = [f"{c}_{m}" for m in range(len(counted)) for c in _CLASSES]
    counts = written(each.groupBy("win").agg(*(F.count_if(x).alias(c) for c, x in zip(names, tells, strict=True))))
    gain = written(gains(counts, order, len(counted)))
    met = cut.select("id", "judge", F.explode("wins").alias("win")).join(gain, "win").select("id", F.col("gains")[0].alias("own"), F.get("gains", "judge").alias("judged"))
    by_id = met.groupBy("id").agg(F.avg("own").alias("score"), F.avg("judged").alias("judged"))
    scored = written(known.join(by_id, "id").select("url", "accepted", "judge", "score", "judged"))
    threshold = threshold_of(scored.where(F.col("judge").isin(full)).select(F.col("judged").alias("score"), "accepted"))
    return scored.select("url", "score"), threshold


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], order: int = ORDER, sample: int | None = None) -> DataFrame:
    """pages(page_id, url, ...) to (page_id, host, path, rule, verdict, score), one row for each row of pages.

    A rule's verdict stands; URLs without a rule are judged by the ratio of the models of rule-accepted and rule-rejected
    URLs: block below the threshold. All of them are counted and calibrate it, unless a ``sample`` is asked for (see ``url_scores``). If
    a class has no examples, the score is 0 and such URLs are allowed. A null or empty URL has the empty host and
    path, and the score of its end alone. An empty table gives an empty one. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.col("url").isNull().alias("none"), "host", "path", rule.alias("rule"), said.alias("said"))
    found = url_scores(rows.groupBy("url").agg(F.max(F.when(~F.col("none"), F.col("said") == "allow")).alias("accepted")), order, sample)
    if found is None:
        scored, threshold = rows.withColumn("score", F.lit(0.0)), 0.0
    else:
        scored, threshold = rows.join(found[0], "url"), found[1]
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
