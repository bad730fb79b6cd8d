"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as a *framed text*: independent zstandard frames, one after another in ``data`` (any zstandard reader
takes the whole), with the running totals after each frame in ``bytes_to`` (compressed), ``chars_to`` (code points) and ``units_to``
(units that end in it or before). A unit is ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+``, matched from the left. Frames end
after a unit if one ends in them; a unit longer than a frame runs on into the next, and counts where it ends.

*Selection* reads the totals: a cut after unit u lies in the first frame whose total reaches u, and only that frame is decompressed to find its place.
*Output* is a framed text too, written from the ordered frames of the parts: prefix, middle and suffix in the order of the form, between
their marks. *Restoring* looks the marks up in the output's frames and streams the parts back in text order; *digests* take the frames in turn.
No step holds more than a frame of text beside the compressed ones.

Edge cases: a null or empty text has no frame and no unit and stays plain; so does a text that contains a mark, since its output could not be
taken apart. A unit of any length is kept whole. A null id draws as the empty decimal. Repeated rows are cut alike; an empty
table gives an empty table. Columns named like the results are replaced; all others come through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stored

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
FRAME_BYTES = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

FRAMED = [T.StructField("data", T.BinaryType()), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("bytes_to", "chars_to", "units_to"))]


def unit_ends(data: bytes) -> np.ndarray:
    """Byte offsets at which the units of a text end."""
    if not data:
        return np.empty(0, np.int64)
    space = _SPACE[np.frombuffer(data, np.uint8)]
    ends = np.nonzero(~space[:-1] & space[1:])[0] + 1
    return np.append(ends, len(data))


def code_points(data: bytes) -> int:
    return len(data) - int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) == 0x80))


class FramedText:
    """A text in frames; see the module's docstring."""

    def __init__(self, data: bytes, bytes_to: list[int], chars_to: list[int], units_to: list[int]):
        self.data, self.bytes_to, self.chars_to, self.units_to = data, bytes_to, chars_to, units_to

    @classmethod
    def of(cls, text: bytes, frame_bytes: int = FRAME_BYTES, level: int = 3) -> FramedText:
        return cls.written([text], frame_bytes, level)

    @classmethod
    def written(cls, pieces, frame_bytes: int = FRAME_BYTES, level: int = 3) -> FramedText:
        """The framed text of ordered pieces of UTF-8, of which a frame at a time is held."""
        out, bytes_to, chars_to, units_to = [], [], [], []
        packer, size, chars, units, held = zstandard.ZstdCompressor(level=level), 0, 0, 0, b""

        def put(part: bytes, ended: int) -> None:
            nonlocal size, chars, units
            out.append(packer.compress(part))
            size, chars, units = size + len(out[-1]), chars + code_points(part), units + ended
            bytes_to.append(size)
            chars_to.append(chars)
            units_to.append(units)

        for piece in pieces:
            at = 0
            while at < len(piece):
                more = piece[at : at + frame_bytes]
                at += len(more)
                held += more
                while len(held) > frame_bytes:  # the byte after a frame tells whether a unit ends with it
                    ends = unit_ends(held)[:-1]
                    ends = ends[ends <= frame_bytes]
                    stop = int(ends[-1]) if len(ends) else frame_bytes
                    while not len(ends) and held[stop] & 0xC0 == 0x80:
                        stop -= 1
                    put(held[:stop], len(ends))
                    held = held[stop:]
        if held:
            put(held, len(unit_ends(held)))
        return cls(b"".join(out), bytes_to, chars_to, units_to)

    @property
    def n_units(self) -> int:
        return self.units_to[-1] if self.units_to else 0

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[self.bytes_to[k - 1] if k else 0 : self.bytes_to[k]])

    def place(self, unit: int) -> tuple[int, int, int]:
        """(frame, byte in it, code points before it) of the place after a number of units; only that frame is decompressed."""
        if not unit:
            return 0, 0, 0
        k = int(np.searchsorted(self.units_to, unit))
        part = self.frame(k)
        ends = unit_ends(part)
        at = int(ends[unit - 1 - (self.units_to[k - 1] if k else 0)])
        return k, at, (self.chars_to[k - 1] if k else 0) + code_points(part[:at])

    def pieces(self, start: tuple[int, int] = (0, 0), stop: tuple[int, int] | None = None) -> Iterator[bytes]:
        """The text between two places (frame, byte), a frame at a time."""
        last = (len(self.bytes_to) - 1, None) if stop is None else stop
        for k in range(start[0], last[0] + 1):
            if k < len(self.bytes_to) and not (stop is not None and k == last[0] and not last[1]):
                part = self.frame(k)
                yield part[start[1] if k == start[0] else 0 : last[1] if k == last[0] else len(part)]

    def find(self, mark: bytes, start: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """The places before and after the first ``mark`` from a place on, which may run over the end of a frame."""
        tail: list[tuple[int, int]] = []  # the places of the bytes carried over
        carried, k, skip = b"", start[0], start[1]
        while k < len(self.bytes_to):
            part = self.frame(k)
            text, places = carried + part[skip:], lambda i, k=k, skip=skip, tail=tail: tail[i] if i < len(tail) else (k, skip + i - len(tail))
            at = text.find(mark)
            if at >= 0:
                end = places(at + len(mark) - 1)
                return places(at), (end[0], end[1] + 1)
            keep = min(len(mark) - 1, len(text))
            tail = [places(i) for i in range(len(text) - keep, len(text))]
            carried, k, skip = text[len(text) - keep :], k + 1, 0
        raise ValueError("the mark is not in the text")


def draws(doc_id, seed: int = 42) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def chosen(h: list[int], n: int, marked: bool, rate: int = 50, spm_rate: int = 80) -> tuple[str, int, int]:
    """(form, units of the prefix, units up to the end of the middle)."""
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("plain" if not n or marked or h[2] % 100 >= rate else "spm" if h[3] % 100 < spm_rate else "psm"), a, b


def transformed(text: FramedText, form: str, first: tuple[int, int], second: tuple[int, int]) -> Iterator[bytes]:
    """The output's pieces: the parts between the cut places in the order of the form."""
    if form == "plain":
        yield from text.pieces()
        return
    p, s, m = (x.encode() for x in MARKS)
    prefix, middle, suffix = ((p, (0, 0), first), (m, first, second), (s, second, None))
    for mark, start, stop in (suffix, prefix, middle) if form == "spm" else (prefix, suffix, middle):
        yield mark
        yield from text.pieces(start, stop)


def restored(output: FramedText, form: str) -> Iterator[bytes]:
    """The text's pieces again, from the output and its form."""
    if form == "plain":
        yield from output.pieces()
        return
    p, s, m = (x.encode() for x in MARKS)
    order = (s, p, m) if form == "spm" else (p, s, m)
    at, spans = (0, 0), {}
    for k, mark in enumerate(order):
        before, after = output.find(mark, at)
        if k:
            spans[order[k - 1]] = (at, before)
        at = after
    spans[order[-1]] = (at, None)
    for mark in (p, m, s):
        yield from output.pieces(*spans[mark])


# --- operators on tables -------------------------------------------------------------------------------


def _columns(texts: list[FramedText | None]) -> dict[str, list]:
    return {f.name: [None if x is None else getattr(x, f.name) for x in texts] for f in FRAMED}


def pack(docs: DataFrame, text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """docs with the text replaced by a framed text, and ``marked``: whether a mark occurs in it. No shuffle."""

    def task():
        marks = [m.encode() for m in MARKS]

        def one(texts):
            data = [(t or "").encode() for t in texts]
            return _columns([FramedText.of(t, frame_bytes) for t in data]) | {"marked": [any(m in t for m in marks) for t in data]}

        return one

    return map_texts(docs, text_col, task, [*FRAMED, T.StructField("marked", T.BooleanType())], drop_text=True)


def unpack(framed: DataFrame, text_col: str = "text") -> DataFrame:
    """Framed texts as texts in a column again."""

    def task():
        return lambda rows: {text_col: [None if r is None else b"".join(FramedText(**r).pieces()).decode() for r in rows]}

    names = [f.name for f in FRAMED]
    rows = framed.withColumn("_framed", F.struct(*names)).drop(*names)
    return map_texts(rows, "_framed", task, [T.StructField(text_col, T.StringType())], drop_text=True)


CUTS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]


def transform(framed: DataFrame, id_col: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Packed documents with ``n``, ``form``, ``prefix_chars``, ``middle_chars``, and the output in place of the framed text. No shuffle.

    Of the documents that may be, ``rate`` in a hundred are cut, of these ``spm_rate`` in a hundred with the suffix first.
    """

    def task():
        def one(row):
            text = FramedText(**{f.name: row[f.name] for f in FRAMED})
            form, a, b = chosen(draws(row["id"], seed), text.n_units, row["marked"], rate, spm_rate)
            if form == "plain":
                return text, text.n_units, form, None, None  # the frames are the output
            first, second = text.place(a), text.place(b)
            out = FramedText.written(transformed(text, form, first[:2], second[:2]), frame_bytes)
            return out, text.n_units, form, first[2], second[2] - first[2]

        names = [f.name for f in CUTS]

        def work(rows):
            got = list(zip(*map(one, rows), strict=True)) if rows else [[]] * 5
            return _columns(list(got[0])) | dict(zip(names, got[1:], strict=True))

        return work

    rows = _with_framed(framed, F.col(f"`{id_col}`").alias("id"), F.col("marked"))
    return map_texts(rows, "_framed", task, [*FRAMED, *CUTS], drop_text=True)


def _with_framed(df: DataFrame, *more: Column) -> DataFrame:
    """The framed text and ``more`` as one struct column; what is left are the other columns."""
    names = [f.name for f in FRAMED]
    return df.withColumn("_framed", F.struct(*names, *more)).drop(*names, "marked")


def digests(outputs: DataFrame) -> DataFrame:
    """Transformed documents with ``output_sha256`` and ``restored_sha256`` (of the text rebuilt from output and form) in place of the output."""

    def sha(pieces) -> str:
        h = hashlib.sha256()
        for x in pieces:
            h.update(x)
        return h.hexdigest()

    def task():
        def one(row):
            out = FramedText(**{f.name: row[f.name] for f in FRAMED})
            return sha(out.pieces()), sha(restored(out, row["form"]))

        return lambda rows: dict(zip(("output_sha256", "restored_sha256"), zip(*map(one, rows), strict=True) if rows else ([], []), strict=True))

    fields = [T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())]
    return map_texts(_with_framed(outputs, F.col("form")), "_framed", task, fields, drop_text=True)


def op11(spark, sf_dir: str) -> DataFrame:
    """The outputs are stored as framed texts; digests and restored texts come from what was stored."""
    from .common import table

    outputs = stored(transform(pack(table(spark, sf_dir, "documents").select("doc_id", "text"))))
    return digests(outputs).select("doc_id", *[f.name for f in CUTS], "output_sha256", "restored_sha256")


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
d AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a+1:b], '') AS m, array_to_string(u[b+1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
