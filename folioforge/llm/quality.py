"""Quality rules as a short-circuit cascade.

Each rule reads a lazily computed view of one text and answers "reject"; it names the features that it reads, which
rules share. On a bounded sample are measured: the seconds of each feature, those of each rule once its features are there, and
how often each set of rules rejects together. The cascade is planned step by step: next comes the rule with the most rejections, among
the texts that no rule before it rejects, per second of what it adds (its own time, and that of the features that no rule before
it has needed). A text is asked until the first rejection. The order changes the work, never the verdict.

With ``base`` rules the cascade first tells whether one of them rejects, in planned order too, and asks the others of what passes.
``stats`` are features that the result holds for every text; they are computed for all, and so cost the rules nothing.

Edge cases: a null text has no words (and fails the base rules), an empty table gives an empty
table, repeated rows are judged one by one. Rules of equal gain keep their order. Texts of any length are read whole. Columns
named like the results are replaced; all others come through.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, WORD, map_texts

SYMBOLS = "#*$%&|<>"


class TextView:
    """Features of one whole text, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        """The lines that hold a word."""
        return [x for x in self.text.split("\n") if WORD.search(x)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by 5-word windows that occur twice or more, the first occurrence included."""
        w = self.words
        grams = list(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))
        if len(set(grams)) == len(grams):
            return 0
        times = Counter(grams)
        covered, end = 0, 0
        for i, g in enumerate(grams):
            if times[g] > 1:
                covered += i + 5 - max(i, end)
                end = i + 5
        return covered


#: Each feature with the features that it is computed from.
PARTS = {"words": (), "lines": (), "n_words": ("words",), "word_chars": ("words",), "n_symbols": (), "n_dup_lines": ("lines",), "n_repeat_words": ("words",)}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    reads: tuple[str, ...]
    rejects: Callable[[TextView], bool]


def needed(features: tuple[str, ...]) -> list[str]:
    """The features and what they are computed from, parts first."""
    out: list[str] = []
    for f in features:
        out += [x for x in (*needed(PARTS[f]), f) if x not in out]
    return out


#: The contract's base rules.
BASE_RULES = (
    Rule("few_words", ("n_words",), lambda v: v.n_words < 10),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda v: 100 * v.n_repeat_words > 20 * v.n_words),
)
#: The method's own rules, asked of what passes the base.
RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda v: 10 * v.n_symbols > v.n_words),
    Rule("duplicate_lines", ("n_dup_lines", "lines"), lambda v: 10 * v.n_dup_lines > 3 * len(v.lines)),
    Rule("word_length", ("n_words", "word_chars"), lambda v: not 2 * v.n_words <= v.word_chars <= 20 * v.n_words),
    Rule("wordless", ("n_words", "words"), lambda v: 10 * sum(map(has_letter, v.words)) < 7 * v.n_words),
    Rule("ellipses", ("lines",), lambda v: 10 * sum(x.rstrip(SPACE_CHARS).endswith(("...", "…")) for x in v.lines) > 3 * len(v.lines)),
    Rule("bullets", ("lines",), lambda v: 10 * sum(x.lstrip(SPACE_CHARS)[0] in "-*•‣" for x in v.lines) > 9 * len(v.lines)),
)


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def measure(docs: DataFrame, rules=BASE_RULES + RULES, text_col: str = "text", sample_rows: int = 2000, seed: int = 7) -> dict:
    """``seconds`` of each feature and rule, and ``rejected``: how many texts each set of rules (as bits) rejects, on about ``sample_rows`` rows of the whole table (documented bound)."""
    n = docs.count()
    part = docs.select(text_col).sample(min(1.0, sample_rows / max(1, n)), seed).limit(2 * sample_rows)
    features = needed(tuple(f for r in rules for f in r.reads))

    def task():
        def work(texts: list) -> dict[str, list]:
            seconds: Counter = Counter()
            sets: Counter = Counter()
            clock = time.perf_counter
            for t in texts:
                v, rejected = TextView(t), 0
                for f in features:
                    at = clock()
                    getattr(v, f)
                    seconds[f] += clock() - at
                for k, r in enumerate(rules):
                    at = clock()
                    rejected |= bool(r.rejects(v)) << k
                    seconds[r.name] += clock() - at
                sets[rejected] += 1
            rows = [("s", x, s) for x, s in seconds.items()] + [("r", str(k), float(c)) for k, c in sets.items()]
            return {"measured": [[{"what": w, "name": x, "value": y} for w, x, y in rows]] + [None] * (len(texts) - 1)}

        return work

    row = T.StructType([T.StructField("what", T.StringType()), T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType())])
    each = map_texts(part, text_col, task, [T.StructField("measured", T.ArrayType(row))], keep=[]).select(F.explode("measured").alias("m")).select("m.*")
    rows = each.groupBy("what", "name").agg(F.sum("value").alias("value")).collect()  # a row a feature, a rule and a set of rules met in the sample
    return {"seconds": {r["name"]: r["value"] for r in rows if r["what"] == "s"}, "rejected": {int(r["name"]): int(r["value"]) for r in rows if r["what"] == "r"}, "rules": [r.name for r in rules]}


def plan(measured: dict, rules, done=(), there: tuple[str, ...] = ()) -> list[Rule]:
    """The rules in order of what they reject of the texts that ``done`` rules and those before them pass, per second that they add to features already ``there``."""
    bit = {name: 1 << k for k, name in enumerate(measured["rules"])}
    cost = lambda x: measured["seconds"].get(x, 0.0)
    passed = {k: n for k, n in measured["rejected"].items() if not any(k & bit[r.name] for r in done)}
    have, left, out = set(needed(there)), list(rules), []
    while left:
        gain = lambda r: sum(n for k, n in passed.items() if k & bit.get(r.name, 0)) / max(1e-9, cost(r.name) + sum(cost(f) for f in needed(r.reads) if f not in have))  # noqa: B023, E731
        best = max(left, key=gain)
        left.remove(best)
        out.append(best)
        have.update(needed(best.reads))
        passed = {k: n for k, n in passed.items() if not k & bit.get(best.name, 0)}
    return out


def cascade(docs: DataFrame, rules, base=BASE_RULES, text_col: str = "text", stats: bool = True) -> DataFrame:
    """docs with ``base_failed``, ``failed_rule`` (the first rejection, null if none), ``kept`` and, if asked for, the base statistics."""
    longs = list(STATS) if stats else []
    names = [*longs, "base_failed", "failed_rule", "kept"]

    def task():
        def judge(text):
            v = TextView(text)
            bad = next((r.name for r in base if r.rejects(v)), None)
            first = bad or next((r.name for r in rules if r.rejects(v)), None)
            return (*(getattr(v, x) for x in longs), bad is not None, first, first is None)

        return lambda texts: dict(zip(names, zip(*map(judge, texts), strict=True) if texts else [[]] * len(names), strict=True))

    kinds = [T.LongType()] * len(longs) + [T.BooleanType(), T.StringType(), T.BooleanType()]
    return map_texts(docs, text_col, task, [T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])


def op1(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    measured = measure(docs)
    base = plan(measured, BASE_RULES, there=STATS)
    return cascade(docs, plan(measured, RULES, base, STATS), base).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS gram FROM p),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i FROM r WHERE c > 1) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
  count(*) FILTER (WHERE regexp_matches(line, '(\.\.\.|\x{2026})[\x20\x09-\x0D]*$')) AS n_ell, count(*) FILTER (WHERE regexp_matches(line, '^[\x20\x09-\x0D]*[-*\x{2022}\x{2023}]')) AS n_bul
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
s AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_alpha FROM d),
a AS (SELECT s.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_ell, 0) AS n_ell, coalesce(n_bul, 0) AS n_bul
  FROM s LEFT JOIN cov USING (doc_id) LEFT JOIN ln USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines OR NOT (word_chars BETWEEN 2 * n_words AND 20 * n_words) OR 10 * n_alpha < 7 * n_words OR 10 * n_ell > 3 * n_lines OR 10 * n_bul > 9 * n_lines) AS kept
FROM f
"""
