"""Many given strings looked for in many texts, in one pass over the texts.

The patterns become an Aho-Corasick automaton, which is sent to the tasks that read the texts: each character of a text is read once, however many
patterns there are, and neither texts nor pairs are shuffled. Patterns of over ``block_chars`` characters in all are taken in blocks,
a pass over the texts for each.

A null pattern or text matches nothing; an empty pattern is in every text that is not null, as ``contains`` has it. Patterns that are the same string are all
reported. Matching is by code points; callers who want it case- or space-blind normalise both sides first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Patterns:
    """An automaton over (id, pattern) rows; ``found`` gives the numbers of the patterns in a text."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.ids = [i for i, _ in rows]
        self.everywhere = [k for k, (_, p) in enumerate(rows) if p == ""]
        held: dict[str, list[int]] = {}
        for k, (_, p) in enumerate(rows):
            if p:
                held.setdefault(p, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for p, numbers in held.items():
            self.automaton.add_word(p, tuple(numbers))
        if held:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> list[int]:
        if text is None:
            return []
        hits = {k for _, numbers in self.automaton.iter(text) for k in numbers} if len(self.automaton) else set()
        return sorted(hits.union(self.everywhere))


def blocks_of(patterns: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The (id, pattern) rows in blocks of bounded characters, streamed from the table one after another."""
    block, size = [], 0
    for row in patterns.toLocalIterator():
        if block and size + len(row[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1]) + 16
    if block:
        yield block


def texts_with(texts: DataFrame, patterns: DataFrame, text_col: str = "text", id_col: str = "pattern_id", pattern_col: str = "pattern", block_chars: int = 8_000_000) -> DataFrame:
    """A row for each text and pattern it contains: the columns of ``texts`` but the text, and the pattern's id."""
    kept = [c for c in texts.columns if c not in (text_col, id_col)]
    schema = T.StructType([*(texts.schema[c] for c in kept), T.StructField(id_col, patterns.schema[id_col].dataType)])
    sent_rows = texts.select(*[f"`{c}`" for c in kept], f"`{text_col}`")
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(schema[id_col].dataType)

    def search(block: list[tuple[object, str]]) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(block)  # block_chars bounds it

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Patterns(sent.value)
            for b in batches:
                rows, ids = [], []
                for k, text in enumerate(b.column(len(kept))):
                    hits = known.found(text.as_py())
                    rows += [k] * len(hits)
                    ids += [known.ids[h] for h in hits]
                if rows:
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(rows)) for i in range(len(kept))), pa.array(ids, kind)], names=[*kept, id_col])

        return sent_rows.mapInArrow(run, schema)

    rows = patterns.where(F.col(f"`{pattern_col}`").isNotNull()).select(f"`{id_col}`", f"`{pattern_col}`")
    parts = [search(block) for block in blocks_of(rows, block_chars)]
    return reduce(DataFrame.unionByName, parts) if parts else texts.sparkSession.createDataFrame([], schema)
