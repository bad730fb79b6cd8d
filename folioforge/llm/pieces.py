"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text gets the model's leading space and falls into *marked words*: a run of spaces and what follows it.
No piece runs from a word into the next mark, so words are encoded alone, and every word once a batch. The
distinct words of a batch are sorted, which lays out their trie in depth-first order: of the forward table
(best score, last piece and the prefix before it) the rows of the prefix shared with the word before are kept,
and only the rest is computed; a word's ids are read once, from its end. So the table grows with a word's length.

Forward step: ``best[i] = max over pieces p ending at i of best[i - len(p)] + score(p)``. With a *unigram*
model every piece may follow every other. With a *bpe* model (the model file in use) the file's scores
are merge ranks, and its tokenisation is the one that merging in rank order gives; there a piece may follow
another only if merging would leave the boundary between the two standing. A sequence of pieces is the
merge result exactly if all its neighbours may stand so, hence each prefix has one allowed last piece and
the table gives the library's ids.

Characters that no piece holds become the UTF-8 byte pieces. A literal U+2581 in a text is coded in bytes
too, so that decoding is exact for every text (the library would return a space).

Edge cases: a null or empty text has no pieces; decoding gives "" for both, and ``round_trip`` compares
with the empty text. Repeated rows, long texts and words without spaces are encoded whole. Equal sums (unigram) go to the shorter
last piece. An empty table gives an empty table. Columns named like the results are replaced; all others come through.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts

MARK = "▁"
WORDS = re.compile(r" *[^ \n]+| +|\n")


class PieceTable:
    """Pieces, scores and, for merge-ordered models, which pieces may be neighbours."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], kind: str = "bpe", unknown: int = 0):
        self.kind, self.byte_ids, self.unknown = kind, byte_ids, unknown
        self.longest = max(map(len, pieces), default=1)
        if any(" " in p.lstrip(" ") or ("\n" in p and p != "\n") for p in pieces):
            raise ValueError("a piece crosses a word mark: words cannot be encoded alone")
        self.score = {p: s for p, (_, s) in pieces.items()}
        self.ids = {p: i for p, (i, _) in pieces.items()}
        self.text_of = {i: p.encode() for p, i in self.ids.items()} | {b: bytes([k]) for k, b in enumerate(byte_ids)}
        if kind == "bpe":
            self.split: dict[str, tuple[str, str] | None] = {}
            for p in sorted(pieces, key=len):
                last, whole = self._last_merge(p)
                if whole:
                    self.split[p] = last
            self.ids = {p: i for p, i in self.ids.items() if p in self.split}  # others can't be formed by merging
            self.right = {p: self._spine(p, 1) for p in self.split}
            self.left = {p: self._spine(p, 0) for p in self.split}

    def merged(self, text: str) -> list[str]:
        """The pieces that merging in score order (leftmost first) gives: slow, exact, also the tests' reference."""
        return self._merge(text)[0]

    def _merge(self, text: str):
        parts, last, score = list(text), None, self.score
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best[0]):
                    best = (s, i)
            if best is None:
                break
            i = best[1]
            last = (parts[i], parts[i + 1])
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts, last

    def _last_merge(self, piece: str):
        parts, last = self._merge(piece)
        return last, len(parts) == 1

    def _spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """From the edge character up to the piece: (part, score at which it is merged away; the running lowest)."""
        chain = [piece]
        while (halves := self.split.get(chain[-1])) is not None:
            chain.append(halves[side])
        chain.reverse()
        out, low = [], float("inf")
        for part, parent in zip(chain, chain[1:], strict=False):
            low = min(low, self.score[parent])
            out.append((part, low))
        return [*out, (piece, float("-inf"))]

    def may_follow(self, a: str, b: str) -> bool:
        """Whether merging a + b leaves exactly the pieces a and b."""
        x, y, i, j, score = self.right[a], self.left[b], 0, 0, self.score
        while True:
            (p, until_p), (q, until_q) = x[i], y[j]
            s = score.get(p + q)
            if s is not None and s > until_p and s >= until_q:
                return False
            if i == len(x) - 1 and j == len(y) - 1:
                return True
            if until_p >= until_q:
                i += 1
            else:
                j += 1


def load(model_file: str, kind: str = "bpe") -> PieceTable:
    """The table of a SentencePiece model file; read on the driver and sent to the tasks (the vocabulary bounds its size)."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=model_file)
    every = range(p.get_piece_size())
    pieces = {p.id_to_piece(i).replace(MARK, " "): (i, p.get_score(i)) for i in every if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))}
    return PieceTable(pieces, [i for i in every if p.is_byte(i)], kind, p.unk_id())


load = cache(load)


class Encoder:
    """Encodes sorted distinct words over one forward table that shrinks to each shared prefix."""

    def __init__(self, table: PieceTable, remember: int = 250_000):
        self.t, self.remember = table, remember
        self.known: dict[str, bytes] = {}
        self.held = 0  # characters of the known words
        self.suffixes = {p[k:] for p in table.ids for k in range(len(p))}
        self.ids = {p: (p, i.to_bytes(4, "little")) for p, i in table.ids.items()}
        self.bytes = [i.to_bytes(4, "little") for i in table.byte_ids] or [table.unknown.to_bytes(4, "little")] * 256
        self.start = dict.fromkeys(table.ids, True)  # any piece may come first, or after bytes
        self.follow: dict[str, dict[str, bool]] = {}  # by piece: which may come next, as far as asked; emptied with ``known`` once it is large

    def words(self, words: set[str]) -> None:
        """Puts the ids of all the words into ``known``. It is emptied before it outgrows ``remember`` words, or 16 times as many characters."""
        new = sorted(words - self.known.keys())
        more = sum(map(len, new))
        if len(self.known) + len(new) > self.remember or self.held + more > 16 * self.remember:
            self.known, self.held = {}, 0
            new = sorted(words)
            more = sum(map(len, new))
            if sum(map(len, self.follow.values())) > 2 * self.remember:
                self.follow = {}
        self.held += more
        longest, unigram, score, may = self.t.longest, self.t.kind != "bpe", self.t.score, self.t.may_follow
        ids, suffixes, follow, start, known, raw = self.ids, self.suffixes, self.follow, self.start, self.known, self.bytes
        # for each prefix: its score, its last piece with its ids, the prefix before that, what may follow
        best, last, back, after = [0.0], [("", b"")], [0], [start]
        before = ""
        for w in new:
            keep, most = 0, min(len(w), len(before))
            while keep < most and w[keep] == before[keep]:
                keep += 1
            del best[keep + 1 :], last[keep + 1 :], back[keep + 1 :], after[keep + 1 :]
            for i in range(keep + 1, len(w) + 1):
                top = None
                for j in range(i - 1, max(-1, i - longest - 1), -1):
                    p = w[j:i]
                    if p not in suffixes:
                        break
                    ok = after[j].get(p)
                    if ok is None:
                        ok = after[j][p] = p in ids and after[j] is not start and (unigram or may(last[j][0], p))
                    if ok:
                        s = best[j] + score[p]
                        if top is None or s > top[0]:
                            top = (s, p, j)
                            if not unigram:
                                break  # of a merge-ordered model no other piece can end here
                if top is None:
                    best.append(best[i - 1] - 1e6)
                    last.append(("", b"".join(raw[x] for x in w[i - 1].encode())))
                    back.append(i - 1)
                    after.append(start)  # nothing merges with bytes
                else:
                    s, p, j = top
                    best.append(s)
                    last.append(ids[p])
                    back.append(j)
                    f = follow.get(p)
                    if f is None:
                        f = follow[p] = {}
                    after.append(f)
            code, i = [], len(w)
            while i:
                code.append(last[i][1])
                i = back[i]
            known[w] = b"".join(reversed(code))
            before = w

    def texts(self, texts: list) -> list[bytes]:
        """int32 ids of each text."""
        cut = [WORDS.findall(" " + t) if t else [] for t in texts]
        out = []
        at = 0
        while at < len(cut):  # some texts at a time, so that the distinct words stay bounded
            upto, words = at, set()
            while upto < len(cut) and len(words) < self.remember // 4:
                words.update(cut[upto])
                upto += 1
            self.words(words)
            get = self.known.__getitem__
            out += [b"".join(map(get, x)) for x in cut[at:upto]]
            at = upto
        return out


def _bare(table: PieceTable) -> PieceTable:
    """The table without a worker's encoder."""
    table.__dict__.pop("encoder", None)
    return table


def decode_ids(table: PieceTable, ids) -> str:
    text = b"".join(map(table.text_of.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode(docs: DataFrame, model: PieceTable, text_col: str = "text") -> DataFrame:
    """docs with ``ids`` (array<int>), ``n_tokens``, ``ids_sha256`` (of the little-endian int32 ids) and ``round_trip``."""
    sent = docs.sparkSession.sparkContext.broadcast(_bare(model))

    def task():
        table = sent.value
        encoder = table.__dict__.setdefault("encoder", None) or Encoder(table)
        table.encoder = encoder  # a worker keeps it for its next task
        text_of = sent.value.text_of.__getitem__

        def work(texts: list) -> dict[str, list]:
            coded = encoder.texts(texts)
            sizes = np.array([len(x) // 4 for x in coded], np.int64)
            flat = np.frombuffer(b"".join(coded), "<i4")
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            same, at = [], offsets.tolist()
            for k, t in enumerate(texts):
                same.append(b"".join(map(text_of, flat[at[k] : at[k + 1]].tolist())) == ((" " + t).encode() if t else b""))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, pa.int32()))
            return {"ids": ids, "n_tokens": pa.array(sizes), "ids_sha256": [hashlib.sha256(x).hexdigest() for x in coded], "round_trip": same}

        return work

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    return map_texts(docs, text_col, task, fields)


def decode(coded: DataFrame, model: PieceTable, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """coded with the text of its ids; a null list gives an empty text."""
    sent = coded.sparkSession.sparkContext.broadcast(_bare(model))

    def task():
        table = sent.value
        return lambda rows: {text_col: [decode_ids(table, x or ()) for x in rows]}

    return map_texts(coded, ids_col, task, [T.StructField(text_col, T.StringType())])


#: The public tokenizer's model file that the registered queries take.
QUERY_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), load(QUERY_MODEL)).select("doc_id", F.col("n_tokens"), "ids", "ids_sha256", "round_trip")
