"""Secret scans: known forms of credentials, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of characters that keys and tokens are made of. Its characters fall in classes (lower, upper, digit,
other). For the candidate's alphabet (hex, letters and digits, base64) a window slides over it, character counts and the sum
of n * log n are updated by the one character that enters and the one that leaves, and windows whose entropy reaches the
alphabet's threshold are united to spans. Candidates of known harmless form (the allow-list) are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from changeproof.llm.common import small_batches

#: Base forms: kind, pattern, group whose length counts, least length. ASCII rules for case.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
#: hex runs below the least length cannot count, so the scan looks for longer ones only; runs are maximal either way.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits per character that a window must reach, by alphabet.
THRESHOLDS = {"entropy_hex": 3.0, "entropy_alnum": 3.7, "entropy_base64": 3.9}
KINDS = ("assign", "access", "hex", *THRESHOLDS)
#: Harmless candidates: words and joined words, numbers, paths and rulers, dates, and UUIDs with their hyphens.
ALLOW = (
    r"[A-Za-z]?[a-z]+(?:[-_/=+]+[A-Za-z]?[a-z]+)*[-_/=+]*",
    r"[A-Z]+(?:[-_/=+]+[A-Z]+)*[-_/=+]*",
    r"[0-9_/=+-]+",
    r"(?:[A-Za-z]*/)+[A-Za-z0-9_=-]{0,19}",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known forms: leftmost non-overlapping matches per kind, then those that are long enough."""
    spans = []
    for kind, pattern, group, least in BASE:
        for m in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if len(m.group(group)) >= least:
                spans.append((m.start(), m.end(), kind))
    return spans


def alphabet(candidate: str) -> str | None:
    """The alphabet a candidate is drawn from, by its character classes; None if it has one class only."""
    lower, upper, digit = (any(a <= c <= b for c in candidate) for a, b in (("a", "z"), ("A", "Z"), ("0", "9")))
    if lower + upper + digit < 2:
        return None
    if not set(candidate) - set("0123456789abcdef") or not set(candidate) - set("0123456789ABCDEF"):
        return "entropy_hex"
    return "entropy_alnum" if candidate.isalnum() else "entropy_base64"


def dense_windows(candidate: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Spans (start, end) of united windows whose entropy in bits per character reaches the threshold."""
    nlogn = [0.0] + [k * log2(k) for k in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, spans = 0.0, []
    for i, c in enumerate(candidate):
        k = counts.get(c, 0)
        total += nlogn[k + 1] - nlogn[k]
        counts[c] = k + 1
        if i >= window:
            k = counts[out := candidate[i - window]]
            total += nlogn[k - 1] - nlogn[k]
            counts[out] = k - 1
        if i >= window - 1 and log2(window) - total / window >= threshold - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def entropy_spans(text: str, window: int = WINDOW, thresholds: dict[str, float] = THRESHOLDS, allow: re.Pattern | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of high-entropy stretches of candidates that the allow-list does not know."""
    spans = []
    for m in CANDIDATE.finditer(text):
        candidate = m.group()
        kind = None if candidate.isalpha() and (candidate.islower() or candidate.istitle()) else alphabet(candidate)
        if kind and not (allow or _ALLOW).fullmatch(candidate):
            spans += [(m.start() + a, m.start() + b, kind) for a, b in dense_windows(candidate, window, thresholds[kind])]
    return spans


_ALLOW = re.compile("|".join(f"(?:{x})" for x in ALLOW))


def joined(spans: Iterable[tuple[int, int, str]]) -> str:
    """kind:start:end by start, then kind in the order of KINDS, joined by commas."""
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(batches, window: int, thresholds: dict[str, float], allow: str | None):
    known = re.compile(allow) if allow else None
    for batch in batches:
        rows = []
        for text in batch:
            text = text if isinstance(text, str) else ""
            base = base_spans(text)
            kinds = [kind for _, _, kind in base]
            rows.append((*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + entropy_spans(text, window, thresholds, known))))
        yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def secret_spans(docs: DataFrame, window: int = WINDOW, thresholds: dict[str, float] | None = None, allow: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of docs.

    Positions are code points, ends exclusive. Null text is empty: no spans, the checksum of nothing. An entropy span may
    overlap a base one; both stay. A null doc_id stays null. An empty table gives an empty one. Other columns are not read.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _scan(texts, window, thresholds or THRESHOLDS, allow)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scan(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")
