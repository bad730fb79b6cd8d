"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Both sides are lower-cased runs of word characters. Every n-gram of the test items is counted over all
documents (document frequency). An item's seeds are its ``rare`` least frequent n-grams that do occur, and
those as frequent, so a leaked item keeps seeds however many documents it or an edited copy leaked to. One seed,
or ``min_seeds`` different n-grams of an item near one another, seeds or not, have the passage around them aligned
with the item by Smith-Waterman (match 2, mismatch -1, gap -1), unless it holds too few of the item's words to reach
``min_score``; the score over the item's best possible score is the similarity. A document is contaminated if any
item reaches ``min_score``. A copy that keeps no n-gram of its item (every third word replaced) is not found.

Scale. No shuffle of texts and no pair table: documents stay in their tasks, and the items of one block are what is sent to
them (``block_chars`` characters of item text, a documented bound, as a few arrays), where seeds are looked up by n-gram hash; larger
benchmarks take two passes over the documents a block. Frequencies are sums a block n-gram. With the seeds' default settings
0.996 and more of the copies with up to 30 % of their words replaced that full alignment finds were found in trials (400 copies a rate).

Edge cases: a null or empty text or item matches nothing; an item shorter than an n-gram is one seed of
all its words; repeated items and rows each get their own verdict; item ids may be of any type that can be ordered, repeated, or null
(such an item is found like any other and its id is null); an empty table on either side gives no
contamination. Ties for the best item go to the smallest item id, null last. Texts of any length are read whole. Columns named
like the results are replaced; all others come through.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


class Items:
    """The items of a block: vocabulary, token ids, and the n-grams with the places they come from.

    ``grams`` are the distinct n-gram hashes in order; those of place p (``item[p]``, ``offset[p]``) from ``start[g]`` to
    ``start[g + 1]`` belong to gram g.
    """

    def __init__(self, texts: list[str | None], width: int):
        words = [tokens(t) for t in texts]
        self.vocab = {w: k + 1 for k, w in enumerate(sorted({w for x in words for w in x}))}
        self.tokens = [np.array([self.vocab[w] for w in x], np.int64) for x in words]
        self.width = width
        codes = [self.codes(t) for t in self.tokens]
        every = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        offset = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.start = np.append(first, len(every)).astype(np.int64)
        self.item, self.offset = item[order].astype(np.int32), offset[order].astype(np.int32)
        self.short = any(len(t) < width for t in self.tokens)

    def code(self, parts: list[np.ndarray]) -> np.ndarray:
        """A 64-bit hash of n word ids (0 past a short item's end); alignment verifies whatever a collision would let through."""
        out = np.zeros(len(parts[0]), np.uint64)
        for x in parts:
            out = (out ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def codes(self, t: np.ndarray) -> np.ndarray:
        """Code of the n-gram at each position. Items shorter than an n-gram are padded with 0."""
        if not len(t):
            return np.empty(0, np.uint64)
        n = max(1, len(t) - self.width + 1)
        padded = np.concatenate([t, np.zeros(self.width, np.int64)])
        return self.code([padded[k : k + n] for k in range(self.width)])

    def ids_of(self, text: str | None) -> np.ndarray:
        get = self.vocab.get
        words = tokens(text)
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def hits(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, number of the n-gram) of every n-gram of the block found in t."""
        if not len(t) or not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        w = self.width
        padded = np.concatenate([t, np.zeros(w, np.int64)])  # so that short items are found at any place
        known = padded > 0
        places, found = [], []
        for n in range(1, w + 1) if self.short else (w,):
            at = np.nonzero(np.logical_and.reduce([known[k : len(t) + k] for k in range(n)]))[0]
            none = np.zeros(len(at), np.int64)
            places.append(at)
            found.append(self.code([padded[at + k] if k < n else none for k in range(w)]))
        at, code = np.concatenate(places), np.concatenate(found)
        k = np.searchsorted(self.grams, code)
        k[k == len(self.grams)] = 0
        ok = self.grams[k] == code
        return at[ok], k[ok]


def align(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    """The Smith-Waterman local alignment score of two token sequences, a row of the matrix at a time."""
    best = 0
    above = np.zeros(len(b) + 1, np.int64)
    steps = np.arange(len(b) + 1) * -gap
    for x in a:
        row = np.zeros(len(b) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(b == x, match, mismatch), above[1:] + gap)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + steps) - steps  # gaps along the row
        best = max(best, int(row.max()))
        above = row
    return best


def frequencies(docs: DataFrame, items: Items, text_col: str = "text") -> np.ndarray:
    """Number of documents that hold each n-gram of the block, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def task():
        block = sent.value

        def work(texts: list) -> dict[str, list]:
            total = np.zeros(len(block.grams), np.int64)
            for t in texts:
                total[np.unique(block.hits(block.ids_of(t))[1])] += 1
            some = np.nonzero(total)[0]
            return {"seen": [[{"gram": int(g), "n": int(total[g])} for g in some]] + [None] * (len(texts) - 1)}

        return work

    pair = T.ArrayType(T.StructType([T.StructField("gram", T.IntegerType()), T.StructField("n", T.LongType())]))
    seen = map_texts(docs.select(text_col), text_col, task, [T.StructField("seen", pair)], keep=[])
    out = np.zeros(len(items.grams), np.int64)
    total = seen.select(F.explode("seen").alias("s")).groupBy("s.gram").agg(F.sum("s.n").alias("n")).toArrow()  # a row an n-gram of the block
    out[total["gram"].to_numpy()] = total["n"].to_numpy()
    return out


def rare_seeds(items: Items, df: np.ndarray, rare: int = 4) -> np.ndarray:
    """For each place of the block's list whether its n-gram is rare for its item: by rank among those that occur."""
    held = np.repeat(df, np.diff(items.start))
    gram = np.repeat(np.arange(len(df)), np.diff(items.start))
    limit = np.zeros(len(items.tokens), np.int64)
    once = np.unique(np.stack([items.item[held > 0], gram[held > 0]], axis=1), axis=0) if len(held) else np.empty((0, 2), np.int64)
    order = np.lexsort((df[once[:, 1]], once[:, 0]))
    item, n = once[order, 0], df[once[order, 1]]
    rank = np.arange(len(item)) - np.searchsorted(item, item)
    np.maximum.at(limit, item[rank < rare], n[rank < rare])
    return (held > 0) & (held <= limit[items.item])


def passages(at: np.ndarray, offset: np.ndarray, rare: np.ndarray, reach: int) -> list[tuple[int, int, int, bool]]:
    """(first start, last start, different n-grams, whether one is rare) of groups of hits; hits more than ``reach`` apart start a new group."""
    order = np.argsort(at, kind="stable")
    at, offset, rare = at[order], offset[order], rare[order]
    cuts = np.nonzero(np.diff(at) > reach)[0] + 1
    return [(int(x[0]), int(x[-1]), len(np.unique(o)), bool(r.any())) for x, o, r in zip(np.split(at, cuts), np.split(offset, cuts), np.split(rare, cuts), strict=True)]


def matches(items: Items, seeds: np.ndarray, text: str | None, min_seeds: int = 2, min_score: float = 0.5) -> list[tuple[int, float]]:
    """(number in the block, similarity) of every item that the text leaks."""
    t = items.ids_of(text)
    at, gram = items.hits(t)
    if not len(at):
        return []
    n = np.diff(items.start)[gram]
    place = np.repeat(items.start[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at, item = np.repeat(at, n), items.item[place]
    order = np.argsort(item, kind="stable")
    at, item, place = at[order], item[order], place[order]
    bounds = np.append(np.nonzero(np.diff(item, prepend=-1))[0], len(item))
    # of most items too few n-grams are met
    seeded = np.logical_or.reduceat(seeds[place], bounds[:-1])
    size = np.array([len(items.tokens[k]) for k in item[bounds[:-1]]])
    need = np.minimum(min_seeds, np.maximum(1, size - items.width + 1))
    out = []
    held: dict[int, np.ndarray] = {}
    for g in np.nonzero(seeded | (np.diff(bounds) >= need))[0].tolist():
        lo, hi = bounds[g], bounds[g + 1]
        k = int(item[lo])
        own = items.tokens[k]
        least = 2 * len(own) * min_score  # with m matches and e edits, 2 m - e: so at least half as many words match,
        reach = int(3 * len(own) - least) + 1  # and the words between first and last match are no more than this
        if k not in held:
            held[k] = np.concatenate(([0], np.cumsum(np.isin(t, own))))
        count, best = held[k], 0
        for first, last, found, rare in passages(at[lo:hi], items.offset[place[lo:hi]], seeds[place[lo:hi]], reach):
            if found >= need[g] or rare:
                low, high = max(0, first - reach), min(len(t), last + items.width + reach)
                span = min(reach, high - low)
                if 2 * int((count[low + span : high + 1] - count[low : high + 1 - span]).max()) >= least:
                    best = max(best, align(own, t[low:high]))
        score = best / (2 * len(own))
        if score >= min_score:
            out.append((k, score))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 3, min_seeds: int = 2, min_score: float = 0.5, block_chars: int = 8 << 20) -> DataFrame:
    """docs with ``contaminated``, ``n_items``, ``best_item``, ``best_score`` and ``items``."""
    out = docs
    kind = benchmark.schema[item_id].dataType
    rows = benchmark.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).where("text <> ''")
    blocks = max(1, -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    pair = T.StructType([T.StructField("item", kind), T.StructField("score", T.DoubleType())])
    names = []
    for block in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        held = part.orderBy("text", "id").collect()  # about block_chars characters
        ids, items = [r[0] for r in held], Items([r[1] for r in held], width)
        seeds = rare_seeds(items, frequencies(docs, items, text_col))
        sent = docs.sparkSession.sparkContext.broadcast((ids, items, seeds))

        name = f"found_{uuid.uuid4().hex}"

        def task(sent=sent, name=name):
            ids, items, seeds = sent.value
            return lambda texts: {name: [[{"item": ids[k], "score": s} for k, s in matches(items, seeds, t, min_seeds, min_score)] for t in texts]}

        names.append(name)
        out = map_texts(out, text_col, task, [T.StructField(name, T.ArrayType(pair))])
    found = F.concat(*names) if len(names) > 1 else F.col(names[0])
    best = f"best_{uuid.uuid4().hex}"
    before = lambda a, b: F.when(a["item"].eqNullSafe(b["item"]), 0).when(a["item"].isNull(), 1).when(b["item"].isNull(), -1).when(a["item"] < b["item"], -1).otherwise(1)
    order = lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(before(a, b))
    out = out.withColumn(best, F.array_sort(found, order)).drop(*names)
    first = F.get(best, F.lit(0))
    return out.withColumns({"contaminated": F.size(best) > 0, "n_items": F.size(best).cast("long"), "best_item": first["item"], "best_score": first["score"], "items": F.array_sort(F.transform(best, lambda x: x["item"]))}).drop(best)


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "contaminated", "n_items", "best_item", F.round("best_score", 6).alias("best_score"), "items")
