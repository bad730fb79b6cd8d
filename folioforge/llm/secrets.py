"""Secret scans: fixed patterns, and sliding-window Shannon entropy for each character class.

Base kinds (leftmost, non-overlapping within a kind): ``assign``, ``access``, ``hex``. The method adds
spans of kind ``entropy``: in every run of a character class, a window of fixed width slides with
incrementally updated character counts; windows above the class's entropy bound that touch one another are one span.
What a base span, an allowed part or an earlier class's span covers is cut out of a run first, and the rest of the run
is searched piece by piece. Pieces of the mixed classes need a digit and a letter.

Edge cases: a null text is an empty one (no spans, digest of the empty string). Offsets are code points,
ends exclusive. Where classes overlap, the first in the list has the span. Repeated rows are scanned one by one; texts and
runs of any length are read whole, in time that grows with them; an empty table gives an empty table. Columns named like
the results are replaced; all others come through.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # whole runs: the greedy match never leaves a part of one

#: Character classes: name, run of at least a window, entropy bound in bits a character, whether a piece needs a digit and a letter.
WINDOW = 20
CLASSES = (
    ("upper_hex", re.compile(r"(?<![A-Za-z0-9])[0-9A-F]{24,}(?![A-Za-z0-9])"), 3.0, True),
    ("base64", re.compile(r"[A-Za-z0-9+/]{20,}={0,2}"), 3.7, True),
    ("base64url", re.compile(r"[A-Za-z0-9_-]{20,}"), 3.7, True),
    ("lower", re.compile(r"(?<![A-Za-z])[a-z]{32,}(?![A-Za-z])"), 3.9, False),
    ("digits", re.compile(r"(?<![A-Za-z0-9.])[0-9]{20,}(?![A-Za-z0-9.])"), 3.1, False),
)
#: Parts of runs that look random but are no secrets: UUIDs, integrity digests, sample values, placeholders, alphabets.
ALLOWED = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])|sha(?:1|256|384|512)-[A-Za-z0-9+/=_-]+|wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|EXAMPLE|example|abcdefgh|0123456789|x{4,}")

_CLOGC = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def hot_windows(run: str, bound: float, width: int = WINDOW) -> list[tuple[int, int]]:
    """Start and end within the run of each group of touching windows with entropy of at least ``bound``; counts are kept incrementally."""
    if len(run) < width:
        return []
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c
    for ch in run[:width]:
        c = counts.get(ch, 0)
        total += _CLOGC[c + 1] - _CLOGC[c]
        counts[ch] = c + 1
    limit = width * (log2(width) - bound) + 1e-9
    groups: list[tuple[int, int]] = []
    first = last = -1
    for i in range(len(run) - width + 1):
        if i:
            c = counts[run[i - 1]]
            total += _CLOGC[c - 1] - _CLOGC[c]
            counts[run[i - 1]] = c - 1
            c = counts.get(run[i + width - 1], 0)
            total += _CLOGC[c + 1] - _CLOGC[c]
            counts[run[i + width - 1]] = c + 1
        if total <= limit:
            if i > last:  # no window of the group before reaches this one
                if last >= 0:
                    groups.append((first, last))
                first = i
            last = i + width
    if last >= 0:
        groups.append((first, last))
    return groups


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def uncovered(start: int, end: int, covers: list[tuple[int, int]], at: int) -> tuple[list[tuple[int, int]], int]:
    """The parts of start to end that no cover (sorted) meets, and the first cover that may meet what lies further on."""
    while at < len(covers) and covers[at][1] <= start:
        at += 1
    out, k = [], at
    while start < end:
        while k < len(covers) and covers[k][1] <= start:
            k += 1
        stop = min(end, max(start, covers[k][0])) if k < len(covers) else end
        if stop > start:
            out.append((start, stop))
        start = covers[k][1] if k < len(covers) and covers[k][0] < end else end
    return out, at


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    found: list[tuple[int, int, int]] = []
    covers: list[tuple[int, int]] | None = None  # made when the first run is met
    for _, runs, bound, mixed in CLASSES:
        at, own = 0, []
        for m in runs.finditer(text):
            if covers is None:
                covers = merged([(s, e) for s, _, e in base] + [a.span() for a in ALLOWED.finditer(text)])
            parts, at = uncovered(m.start(), m.end(), covers, at)
            for start, end in parts:
                piece = text[start:end]
                if end - start < WINDOW or (mixed and not (any(map(str.isdigit, piece)) and any(map(str.isalpha, piece)))):
                    continue
                own += [(start + a, start + b) for a, b in hot_windows(piece, bound)]
        if own:
            found += [(a, 3, b) for a, b in own]
            covers = merged(covers + own)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


FIELDS = [*(T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_entropy")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the counts, the digest of the base spans and all spans."""

    def task():
        def one(text):
            base = base_spans(text or "")
            more = entropy_spans(text or "", base)
            kinds = [k for _, k, _ in base]
            return (kinds.count(0), kinds.count(1), kinds.count(2), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)))

        names = [f.name for f in FIELDS]
        return lambda texts: dict(zip(names, zip(*map(one, texts), strict=True) if texts else [[]] * len(names), strict=True))

    return map_texts(docs, text_col, task, FIELDS)


def op7(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy")
