"""Substring dedup: suffix automata of reference shards give matching statistics; long repeated spans go.

A *window* is ``width`` consecutive words of one document. A word goes if a window covers it whose words also start in
a document with a smaller id; windows are judged on the input.

Routing. A window's *anchor* is the smallest hash of its ``anchor``-word grams, so equal windows have equal anchors. The run
of neighbouring windows with one anchor is a *passage* of ``width`` to ``2 * width - anchor`` words. An anchor met in one
document only cannot lie in a repeated window; a cuckoo filter of the others lets the tasks that read the texts pick
the passages to compare. The distinct ones are the references, dealt to shards by anchor.

Matching. A shard's references become one suffix automaton: a state is the set of places where its strings end, with the smallest
id among them; the arrays are built by sorting, no string is walked in Python. The passages of the documents stream through the
automaton of their shard: at each word the state of the longest suffix that the shard holds, and from there by suffix links the
state of the last ``width`` words, whose smallest id is the window's keeper. Documents of a larger id lose the window, and
touching windows are one span. Since a window can only match in the shard of its anchor, no automaton has to be sent to all tasks: passages come to it.

Scale. Anchors go once a batch of texts; filters over ``sent_bytes`` are not sent, the passages are then found by a join. A passage's words go to its
shard once for each batch of texts, however many documents repeat it, compressed with those of its group (four groups for each shuffle partition of the session); its verdict comes back by a join on its hashes, which Spark splits for hot passages. Texts are shuffled
once, compressed, for the cut. An anchor in over ``hot_batches`` batches has its passages split into single windows, each its own
anchor, so no shard follows one anchor.

Edge cases: null, empty and short texts keep all words; ids may be of any type that can be ordered; rows of one id are one document
(a window in rows of one id alone is not repeated) and each row is cut on its own; rows with a null id hold no references and keep all words;
texts of any length are read whole; an empty table gives an empty table. Columns named ``n_words`` or ``n_removed`` are replaced;
all others come through, the text as its kept words joined by one space.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stored
from .linededup import CuckooFilter

WIDTH, ANCHOR = 13, 5
_BYTE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- passages --------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def word_hashes(line: bytes, starts: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """A hash of each word of ``line`` (words at ``starts``, one space between them), worked out ``step`` bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + step)))
        stop = int(starts[upto]) if upto < len(starts) else len(line) + 1
        data = np.frombuffer(line, np.uint8, min(stop, len(line)) - int(starts[at]), int(starts[at]))
        own = starts[at:upto] - starts[at]
        place = np.arange(len(data)) - np.repeat(own, np.diff(np.append(own, len(data))))
        power = np.cumprod(np.full(int(place.max()) + 1, _ODD))
        values = _BYTE[data] * power[place]
        values[data == 32] = 0
        out[at:upto] = np.add.reduceat(values, own)
        at = upto
    return _mix(out)


class Passages(NamedTuple):
    """Passages of a batch of texts: all words joined by spaces and the words' starts there; of each passage its text's number, its first word's in the text, its words in the batch, its anchor."""

    line: bytes
    starts: np.ndarray
    text: np.ndarray
    own: np.ndarray
    first: np.ndarray
    last: np.ndarray
    a: np.ndarray

    def words(self) -> list[bytes]:
        ends = np.append(self.starts[1:] - 1, len(self.line))
        return [self.line[s:e] for s, e in zip(self.starts[self.first].tolist(), ends[self.last].tolist(), strict=True)]


def passages(texts: list[str | None], width: int = WIDTH, anchor: int = ANCHOR) -> Passages:
    lines = [b" ".join((t or "").encode().split()) for t in texts]
    counts = np.array([x.count(b" ") + 1 if x else 0 for x in lines], np.int64)
    line = b" ".join(x for x in lines if x)
    starts = np.concatenate(([0], np.nonzero(np.frombuffer(line, np.uint8) == 32)[0] + 1)) if line else np.empty(0, np.int64)
    none = Passages(line, starts, *[np.empty(0, np.int64)] * 5)
    n = len(starts) - width + 1
    if n < 1:
        return none
    h = word_hashes(line, starts)
    grams = np.zeros(len(h) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams = grams * _ODD + h[k : len(grams) + k]
    grams = _mix(grams)
    low, place = grams[:n].copy(), np.arange(n)
    for k in range(1, width - anchor + 1):
        less = grams[k : n + k] < low
        low[less] = grams[k : n + k][less]
        place[less] = np.nonzero(less)[0] + k
    text = np.repeat(np.arange(len(texts)), counts)
    inside = np.nonzero(text[:n] == text[width - 1 :])[0]
    if not len(inside):
        return none
    new = np.concatenate(([True], (place[inside[1:]] != place[inside[:-1]]) | (text[inside[1:]] != text[inside[:-1]])))
    first = inside[new]
    last = inside[np.append(np.nonzero(new)[0][1:], len(inside)) - 1] + width - 1
    return Passages(line, starts, text[first], first - (np.cumsum(counts) - counts)[text[first]], first, last, low[first].view(np.int64))


def _lists(owner: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list for each of n texts, of the values (in order of their owners)."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), values)


def anchors(docs: DataFrame, id_col: str, text_col: str, width: int, anchor: int) -> DataFrame:
    """(a): the anchors of each batch of documents, twice if two documents of it have the anchor."""

    def task():
        def one(texts):
            p = passages(texts, width, anchor)
            order = np.lexsort((p.text, p.a))
            a, text = p.a[order], p.text[order]
            fresh = np.append(True, a[1:] != a[:-1])[: len(a)]
            again = ~fresh & np.append(False, text[1:] != text[:-1])[: len(a)]
            second = again & ~np.append(False, (again[:-1] & (a[1:] == a[:-1])))[: len(a)]
            sent = a[fresh | second]
            return {"a": _lists(np.zeros(len(sent), np.int64), len(texts), pa.array(sent, pa.int64()))}

        return one

    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"))
    return map_texts(rows, "text", task, [T.StructField("a", T.ArrayType(T.LongType()))], keep=[], drop_text=True).select(F.explode("a").alias("a"))


def _filters(repeated: DataFrame) -> DataFrame:
    """(shard, cells): a cuckoo filter for each upper byte of the anchors."""

    def build(key, pdf):
        return pd.DataFrame({"shard": [key[0]], "cells": [CuckooFilter.of(pdf["a"].to_numpy(np.int64)).to_bytes()]})

    return repeated.select("a", F.shiftrightunsigned("a", 56).cast("int").alias("shard")).groupBy("shard").applyInPandas(build, "shard int, cells binary")


def _sent(filters: DataFrame) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """What tells, in a task, which anchors the filters hold."""
    sent = filters.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in filters.toLocalIterator()})  # the caller checks its size

    def opened():
        known = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}

        def holds(a: np.ndarray) -> np.ndarray:
            hit, shard = np.zeros(len(a), bool), (a.view(np.uint64) >> np.uint64(56)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for part in np.split(order, np.nonzero(np.diff(shard[order]))[0] + 1):
                if len(part) and (f := known.get(int(shard[part[0]]))) is not None:
                    hit[part] = f.contains(a[part])
            return hit

        return holds

    return opened


def _bytes(filters: DataFrame) -> int:
    return filters.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0]


def single_windows(p: Passages, take: np.ndarray, hot: np.ndarray, width: int) -> tuple[Passages, np.ndarray]:
    """The passages ``take``, those of ``hot`` anchors as single windows, and which of them are so."""
    size = np.where(hot[take], p.last[take] - p.first[take] - width + 2, 1)
    at = np.repeat(take, size)
    k = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
    split = np.repeat(hot[take], size)
    first = p.first[at] + k
    return Passages(p.line, p.starts, p.text[at], p.own[at] + k, first, np.where(split, first + width - 1, p.last[at]), p.a[at]), split


def _picked(rows: DataFrame, pick: Callable[[], Callable[[list, Passages], tuple[np.ndarray, np.ndarray]]], width: int, anchor: int, n_groups: int) -> DataFrame:
    """(id, t1, p, g) of the passages that ``pick`` chooses (and which of a batch's are of hot anchors); rows have id, t1, packed(id, text, ...).

    p: a document's passages (first, a, s), s a hash of the words. g, beside one document of a batch: the distinct passages of the batch by group of anchors, with the smallest
    id that has each and the words, compressed together.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    own = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("s", T.LongType())])
    longs = T.ArrayType(T.LongType())
    sent = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("a", longs), T.StructField("s", longs), T.StructField("keeper", T.ArrayType(kind)), T.StructField("words", T.BinaryType())])
    id_type = to_arrow_type(kind)

    def task():
        choose, packer = pick(), zstandard.ZstdCompressor(level=3)

        def one(batch):
            p = passages([x["text"] for x in batch], width, anchor)
            take, hot = choose(batch, p)
            p, split = single_windows(p, take, hot, width)
            words = p.words()
            s = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)
            a = p.a.copy()
            a[split] = np.array([xxhash.xxh64_intdigest(words[i]) for i in np.nonzero(split)[0].tolist()], np.uint64).view(np.int64)
            order = np.lexsort((s, a))
            new = np.append(True, (a[order[1:]] != a[order[:-1]]) | (s[order[1:]] != s[order[:-1]]))[: len(order)]
            ids = np.empty(len(batch), object)
            ids[:] = [x["id"] for x in batch]
            keeper = np.minimum.reduceat(ids[p.text[order]], np.nonzero(new)[0]) if len(order) else ids[:0]
            heads = order[new]
            group = ((a[heads].view(np.uint64) >> np.uint64(20)) % np.uint64(n_groups)).astype(np.int64)
            by_group = np.argsort(group, kind="stable")
            heads, keeper, group = heads[by_group], keeper[by_group], group[by_group]
            cuts = np.concatenate(([0], np.nonzero(np.diff(group))[0] + 1, [len(group)])) if len(group) else np.zeros(1, np.int64)
            blobs = [packer.compress(b"\n".join([words[h] for h in heads[lo:hi].tolist()])) for lo, hi in zip(cuts, cuts[1:], strict=False)]
            listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values, kind))
            groups = pa.StructArray.from_arrays([pa.array(group[cuts[:-1]], pa.int32()), listed(a[heads], pa.int64()), listed(s[heads], pa.int64()), listed(keeper.tolist(), id_type), pa.array(blobs, pa.binary())], names=sent.names)
            places = pa.StructArray.from_arrays([pa.array(p.own, pa.int32()), pa.array(a, pa.int64()), pa.array(s, pa.int64())], names=own.names)
            return {"p": _lists(p.text, len(batch), places), "g": _lists(np.zeros(len(blobs), np.int64), len(batch), groups)}

        return one

    out = map_texts(rows, "packed", task, [T.StructField("p", T.ArrayType(own)), T.StructField("g", T.ArrayType(sent))], keep=["id", "t1"], drop_text=True)
    return out.where("size(p) > 0 or size(g) > 0")


def candidates(docs: DataFrame, repeated: DataFrame, id_col: str, text_col: str, width: int, anchor: int, sent_bytes: int, n_groups: int) -> DataFrame:
    """(id, t1, p, g), as in ``_picked``, of the passages whose anchor may be in ``repeated`` (all that are, and few others)."""
    text = F.col(f"`{text_col}`")
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t1"), text.alias("text"))
    cells, hot_cells = stored(_filters(repeated)), stored(_filters(repeated.where("hot")))
    if _bytes(cells) + _bytes(hot_cells) <= sent_bytes:
        some, hot = _sent(cells), _sent(hot_cells)

        def by_filter():
            holds, is_hot = some(), hot()
            return lambda _, p: (np.nonzero(holds(p.a))[0], is_hot(p.a))

        return _picked(rows.select("id", "t1", F.struct("id", "text").alias("packed")), by_filter, width, anchor, n_groups)

    def held():
        def one(texts):
            p = passages(texts, width, anchor)
            return {"p": _lists(p.text, len(texts), pa.StructArray.from_arrays([pa.array(p.own, pa.int32()), pa.array(p.a, pa.int64())], names=["first", "a"]))}

        return one

    place = T.StructType([T.StructField("first", T.IntegerType()), T.StructField("a", T.LongType())])
    every = map_texts(rows, "text", held, [T.StructField("p", T.ArrayType(place))], keep=["id", "t1"], drop_text=True)
    hits = every.select("id", "t1", F.explode("p").alias("p")).select("id", "t1", "p.*").join(repeated, "a")
    wanted = hits.groupBy("id", "t1").agg(F.collect_set("first").alias("wanted"), F.collect_set(F.when(F.col("hot"), F.col("first"))).alias("hot"))

    def by_place():
        def choose(batch, p):
            take, hot = np.zeros(len(p.a), bool), np.zeros(len(p.a), bool)
            for k, x in enumerate(batch):
                lo, hi = np.searchsorted(p.text, [k, k + 1])
                take[lo:hi], hot[lo:hi] = np.isin(p.own[lo:hi], x["wanted"]), np.isin(p.own[lo:hi], x["hot"])
            return np.nonzero(take)[0], hot

        return choose

    return _picked(rows.join(wanted, ["id", "t1"]).select("id", "t1", F.struct("id", "text", "wanted", "hot").alias("packed")), by_place, width, anchor, n_groups)


# --- suffix automaton ---------------------------------------------------------------------------------


class SuffixAutomaton:
    """The suffix automaton of several word sequences, in arrays.

    A state's strings all end at the same places. Sorting the places by what stands before them, read backwards, makes each such set
    a range, and the states are the nodes of the tree of common beginnings of that order: ``length`` is a state's longest string,
    ``link`` its parent, ``low`` the smallest rank among its places. Edges are found from their ends: a state's longest string without its
    last word is the longest string of the first state with an edge to it, the others follow on the links of that one.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray, ranks: np.ndarray):
        """``words``: numbers from 0 of all sequences in a row; ``sizes``: words of each; ``ranks``: a rank for each sequence."""
        n, deep = len(words), int(sizes.max(initial=0))
        self.n_words = int(words.max(initial=-1)) + 1
        offset = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        levels, span = [words.astype(np.int64) + 1], 1  # levels[j]: rank of the last 2**j words, shorter at a beginning
        while span < deep:
            before = np.where(offset >= span, levels[-1][np.maximum(np.arange(n) - span, 0)], 0)
            levels.append(np.unique(levels[-1] * (n + self.n_words + 2) + before, return_inverse=True)[1] + 1)
            span *= 2
        kinds, at, place = np.unique(levels[-1], return_index=True, return_inverse=True)
        size = offset[at] + 1  # words of each distinct beginning
        common = np.zeros(max(0, len(at) - 1), np.int64)
        for j in range(len(levels) - 1, -1, -1):
            p, q = at[:-1], at[1:]
            inside = (size[:-1] > common) & (size[1:] > common)
            same = inside & (levels[j][np.maximum(p - common, 0)] == levels[j][np.maximum(q - common, 0)])
            common += np.where(same, np.minimum(1 << j, np.minimum(size[:-1], size[1:]) - common), 0)
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, place, np.repeat(ranks, sizes))
        before = place[np.maximum(at - 1, 0)]  # of each beginning without its last word, if it has two or more
        last = words[at]
        length, link, low, source, symbol = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.array([least.min(initial=np.iinfo(np.int64).max)])], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        state, count = np.zeros(len(at), np.int64), 1  # the deepest state so far of each beginning
        for depth in range(1, deep + 1):
            cut = np.concatenate(([True], common < depth)) if len(at) else np.zeros(0, bool)
            lo = np.nonzero(cut)[0]
            hi = np.append(lo[1:], len(at))
            ends = np.add.reduceat((size == depth).astype(np.int64), lo) > 0 if len(lo) else np.zeros(0, bool)
            splits = np.add.reduceat(np.concatenate(([0], common == depth)) * ~cut, lo) > 0 if len(lo) else ends
            full = size[lo] >= depth if len(lo) else ends
            real = np.nonzero((ends | splits) & full)[0]
            lo, hi = lo[real], hi[real]
            source.append(state[before[lo]] if depth > 1 else np.zeros(len(lo), np.int64))
            symbol.append(last[lo])
            length.append(np.full(len(lo), depth))
            link.append(state[lo])
            bounds = np.stack([lo, hi], 1).ravel()
            low.append(np.minimum.reduceat(np.append(least, 0), bounds)[::2] if len(lo) else np.zeros(0, np.int64))
            new = count + np.arange(len(lo))
            reach = np.zeros(len(at) + 1, np.int64)
            reach[lo] += 1
            reach[hi] -= 1
            covered = np.cumsum(reach[:-1]) > 0
            state[covered] = np.repeat(new, hi - lo)
            count += len(lo)
            if deep > depth and not (size > depth).any():
                break
        self.length, self.link, self.low = map(np.concatenate, (length, link, low))
        source, symbol = np.concatenate(source)[1:], np.concatenate(symbol)[1:]
        target, keys, ends = np.arange(1, count), [], []
        while len(target):
            keys.append(source * (self.n_words + 1) + symbol)
            ends.append(target)
            up = (source > 0) & (self.length[self.link[source]] + 1 > self.length[self.link[target]])
            source, symbol, target = self.link[source[up]], symbol[up], target[up]
        keys, ends = (np.concatenate(keys), np.concatenate(ends)) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ends = keys[order], ends[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The state after an edge of each word, -1 where there is none; a word the automaton does not know is -1."""
        key = state * (self.n_words + 1) + word
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where((self.keys[at] == key) & (word >= 0), self.ends[at], -1) if len(self.keys) else np.full(len(state), -1)

    def matches(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics: for each word of the sequences the longest suffix ending there that the automaton holds, and its state. All sequences advance together."""
        begin = np.cumsum(sizes) - sizes
        longest, states = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        state, length = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k in range(int(sizes.max(initial=0))):
            row = np.nonzero(sizes > k)[0]
            at = begin[row] + k
            here, size, word = state[row], length[row], words[at]
            nxt = self.step(here, word)
            while True:  # where no edge leads on, the next shorter suffixes are tried
                stuck = np.nonzero((nxt < 0) & (here > 0))[0]
                if not len(stuck):
                    break
                here[stuck] = self.link[here[stuck]]
                size[stuck] = self.length[here[stuck]]
                nxt[stuck] = self.step(here[stuck], word[stuck])
            size = np.where(nxt < 0, 0, size + 1)
            state[row], length[row] = np.maximum(nxt, 0), size
            longest[at], states[at] = size, state[row]
        return longest, states

    def lowest(self, states: np.ndarray, width: int) -> np.ndarray:
        """The smallest rank among the places of the last ``width`` words, for states of at least that length."""
        states = states.copy()
        while True:
            up = np.nonzero(self.length[self.link[states]] >= width)[0]
            if not len(up):
                return self.low[states]
            states[up] = self.link[states[up]]


def numbered(texts) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words, words of each text)."""
    known: dict[str, int] = {}
    flat, sizes = [], []
    for t in texts:
        row = t.split(" ")
        sizes.append(len(row))
        flat += [known.setdefault(w, len(known)) for w in row]
    return np.array(flat, np.int64), np.array(sizes, np.int64)


# --- keepers ----------------------------------------------------------------------------------------------


def match(words: list[str], ids: np.ndarray, width: int) -> list[list]:
    """For each passage and window of it, the smallest id among the passages that hold the window: all stream through the automaton of all."""
    names, ranks = np.unique(ids, return_inverse=True)
    flat, sizes = numbered(words)
    made = SuffixAutomaton(flat, sizes, ranks.ravel())
    longest, states = made.matches(flat, sizes)
    windows = sizes - width + 1
    upto = np.cumsum(windows)
    ends = np.arange(upto[-1]) + np.repeat(np.cumsum(sizes) - upto, windows)  # the last word of each window
    if (longest[ends] < width).any():
        raise AssertionError("a passage is not in the automaton of its shard")
    held = names[made.lowest(states[ends], width)].tolist()
    return [held[e - n : e] for n, e in zip(windows.tolist(), upto.tolist(), strict=True)]


def keepers(groups: DataFrame, width: int, shard_rows: int) -> DataFrame:
    """(a, s, keepers): for each distinct passage the smallest id that holds each of its windows; groups: (group, a, s, keeper, words) as in ``_picked``.

    A group's anchors are dealt to shards of about ``shard_rows`` passages, an automaton each.
    """
    kind = groups.schema["keeper"].dataType
    out = T.StructType([T.StructField("a", T.LongType()), T.StructField("s", T.LongType()), T.StructField("keepers", kind)])

    def shards(pdf):
        opener = zstandard.ZstdDecompressor()
        words = [w for x in pdf["words"] for w in opener.decompress(x).decode().split("\n")]
        a, s, ids = (np.concatenate(pdf[c].to_list()) for c in ("a", "s", "keeper"))
        rows = pd.DataFrame({"a": a, "s": s, "keeper": ids, "words": words}).sort_values("keeper", kind="stable").drop_duplicates(["a", "s"])
        shard = _mix(rows["a"].to_numpy(np.int64).view(np.uint64)) % np.uint64(-(-len(rows) // shard_rows))
        told = [pd.DataFrame({"a": own["a"], "s": own["s"], "keepers": match(own["words"].to_list(), own["keeper"].to_numpy(), width)}) for _, own in rows.groupby(shard)]
        return pd.concat(told)

    return groups.groupBy("group").applyInPandas(lambda pdf: shards(pdf), out)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, anchor: int = ANCHOR, sent_bytes: int = 64 << 20, hot_batches: int = 20_000, shard_rows: int = 10_000) -> DataFrame:
    """(id, t1, first, goes): for passages with a window held by a smaller id, the first word's number and for each window whether it is so held. t1 tells rows of one id apart by their texts."""
    met = anchors(docs, id_col, text_col, width, anchor).repartition("a").groupBy("a").agg(F.count("*").alias("n"))
    repeated = stored(met.where("n > 1").select("a", (F.col("n") > hot_batches).alias("hot")))
    n_groups = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(candidates(docs, repeated, id_col, text_col, width, anchor, sent_bytes, n_groups))
    kept = keepers(found.select(F.explode("g").alias("g")).select("g.*"), width, shard_rows)
    told = found.select("id", "t1", F.explode("p").alias("p")).select("id", "t1", "p.*").join(kept, ["a", "s"])
    return told.select("id", "t1", "first", F.transform("keepers", lambda k: k < F.col("id")).alias("goes")).where(F.exists("goes", lambda x: x))


def _zipped(rows: DataFrame) -> DataFrame:
    """rows (row, r, r1, text) with the text compressed (z) and its bytes (size), for the shuffle; a null text is an empty one."""

    def task():
        packer = zstandard.ZstdCompressor(level=3)

        def one(texts):
            raw = [(t or "").encode() for t in texts]
            return {"z": [packer.compress(x) for x in raw], "size": [len(x) for x in raw]}

        return one

    return map_texts(rows, "text", task, [T.StructField("z", T.BinaryType()), T.StructField("size", T.LongType())], keep=["row", "r", "r1"], drop_text=True)


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, **search) -> DataFrame:
    """docs with the text cut to its kept words, ``n_words`` (before) and ``n_removed``."""
    cut = repeated_windows(docs, id_col, text_col, width, **search).groupBy("id", "t1").agg(F.collect_list(F.struct("first", "goes")).alias("cuts"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*others).alias("row") if others else F.lit(0).alias("row"), F.col(f"`{id_col}`").alias("r"), F.xxhash64(text).alias("r1"), text.alias("text"))
    joined = _zipped(rows).join(cut.toDF("d", "d1", "cuts"), (F.col("r") == F.col("d")) & (F.col("r1") == F.col("d1")), "left")
    packed = joined.select("row", "size", F.struct("z", "cuts").alias("packed"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]

    def task():
        opener = zstandard.ZstdDecompressor()

        def one(x):
            words = opener.decompress(x["z"]).split()
            goes = np.zeros(len(words) + 1, np.int64)
            for c in x["cuts"] or ():
                for k, gone in enumerate(c["goes"]):
                    if gone:
                        goes[c["first"] + k] += 1
                        goes[c["first"] + k + width] -= 1
            gone = np.cumsum(goes[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            return len(words), len(words) - len(kept), b" ".join(kept).decode()

        names = [f.name for f in fields]
        return lambda batch: dict(zip(names, zip(*map(one, batch), strict=True) if batch else [[]] * 3, strict=True))

    out = map_texts(packed, "packed", task, fields, keep=["row", "size"], drop_text=True, sizes="size")
    added = ("n_words", "n_removed")
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def op13(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS k, words FROM w WHERE len(words) >= 13),
s AS (SELECT doc_id, k, array_to_string(words[k:k+12], ' ') AS win FROM v),
m AS (SELECT win, min(doc_id) AS keeper FROM s GROUP BY win),
g AS (SELECT DISTINCT s.doc_id, s.k + unnest(range(0, 13)) AS k FROM s JOIN m USING (win) WHERE m.keeper < s.doc_id),
x AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM w),
y AS (SELECT x.*, g.k IS NOT NULL AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.k = x.k),
z AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE gone) AS r, coalesce(string_agg(word, ' ' ORDER BY k) FILTER (WHERE NOT gone), '') AS kept FROM y GROUP BY doc_id)
SELECT w.doc_id, coalesce(z.n, 0) AS n_words, coalesce(z.r, 0) AS n_removed, sha256(coalesce(z.kept, '')) AS kept_sha256 FROM w LEFT JOIN z USING (doc_id)
"""
