"""Line dedup: exact reference counts for line keys, screened by sharded cuckoo filters.

A line's key is the line stripped of space characters with A-Z lower-cased; keys shorter than
``min_chars`` code points are ignored. Keys held by two or more documents lose all their lines except
in the smallest id holding them (its keeper).

State. The *references* are one row for each (key, document): the exact table. ``repeated`` sums it to
references a key, its keeper, and whether a second document holds it. Inserting documents appends references,
deleting documents removes theirs, and both changes undo one another exactly; what a line's verdict is follows
from the counts alone. Each hash shard of the repeated keys has a *cuckoo filter* (16-bit fingerprints, buckets
of four), which supports insertion and deletion. A line asks its shard's filter first: most lines are unique,
miss, and are neither shuffled nor looked up; hits are settled against the exact rows, so a false positive drops nothing.

Scale. Keys travel as 128-bit hashes, counted by partial sums: a row a key and map task is shuffled. Filters of up to
``sent_bytes`` in all go to the tasks that read the texts, and only hits leave these; beyond that, key hashes are
dealt to their shard's filter, a shard in as many parts of ``shard_rows`` as all its lines need. Hits on a hot key (over 1/10,000
of all references; so there are under 10,000) meet its row where they are, the rest by a join. Texts are shuffled once.

Edge cases: null or empty text is one empty line; ids may be of any type that can be ordered, and are compared in it;
ids that repeat hold their lines together (a key in rows of one id alone is not repeated) and each row is cut by its own lines;
equal rows are cut alike; rows with a null id hold no references and keep all lines; texts of any length are read whole;
an empty table gives an empty table. Columns named ``n_lines`` or ``n_dropped`` are replaced; all others come through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CHARS, map_texts, stored

SLOTS = 4


class CuckooFilter:
    """A cuckoo filter over 64-bit hashes, with all operations on numpy arrays."""

    def __init__(self, capacity: int = 16, cells: np.ndarray | None = None):
        buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else cells

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = self._mix(keys.view(np.uint64) if keys.dtype == np.int64 else keys)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark = np.where(mark == 0, np.uint16(1), mark)
        one = (h & np.uint64(len(self.cells) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        jump = self._mix(mark.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return bucket ^ (jump & np.uint64(len(self.cells) - 1)).astype(np.int64)

    def _put(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts marks into free slots of their buckets; returns which found one."""
        done = np.zeros(len(mark), bool)
        for slot in range(SLOTS):
            free = np.nonzero(~done & (self.cells[bucket, slot] == 0))[0]
            _, first = np.unique(bucket[free], return_index=True)
            take = free[first]
            self.cells[bucket[take], slot] = mark[take]
            done[take] = True
        return done

    def insert(self, keys: np.ndarray, rounds: int = 500) -> CuckooFilter:
        """The filter with the keys added: itself, or one twice as large if it filled up (``keys`` must then be all of them)."""
        before = self.cells.copy()
        mark, one, two = self._places(keys)
        left = ~self._put(mark, one)
        mark, bucket = mark[left], two[left]
        rng = np.random.default_rng(len(self.cells))
        for _ in range(rounds):
            left = ~self._put(mark, bucket)
            mark, bucket = mark[left], bucket[left]
            if not len(mark):
                return self
            _, first = np.unique(bucket, return_index=True)  # one eviction a bucket and round
            slot = rng.integers(0, SLOTS, len(first))
            at = bucket[first]
            out = self.cells[at, slot].copy()
            self.cells[at, slot] = mark[first]
            mark[first], bucket[first] = out, self._other(at, out)
        self.cells = before
        raise OverflowError("the filter is full")

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        size = max(8, len(keys))
        while True:
            try:
                return cls(size).insert(keys)
            except OverflowError:
                size *= 2

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def delete(self, keys: np.ndarray) -> None:
        """Removes one mark for each key; every key must have been inserted."""
        for mark, *places in zip(*self._places(keys), strict=True):
            for b in places:
                hit = np.nonzero(self.cells[b] == mark)[0]
                if len(hit):
                    self.cells[b, hit[0]] = 0
                    break

    def to_bytes(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(cells=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())


# --- exact tables ---------------------------------------------------------------------------------


def line_key(line: Column) -> Column:
    letters, bare = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", F.trim(line, F.lit(SPACE_CHARS))
    plain = F.octet_length(line) == F.char_length(line)  # of single-byte characters: the same by a faster way
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, letters, letters.lower()))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(id, t1, t2, line_no, k1, k2) for every line with a key, from whole texts; t1, t2 tell rows of one id apart by their texts."""
    text = F.col(f"`{text_col}`")
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), *_text_mark(text), F.posexplode(lines_of(text)).alias("line_no", "line"))
    rows = rows.select("id", "t1", "t2", "line_no", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return rows.select("id", "t1", "t2", "line_no", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(77), "key").alias("k2"))


def _text_mark(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(78), text).alias("t2")]


def references(lines: DataFrame) -> DataFrame:
    """The exact reference table: (k1, k2, id, n_lines), one row for each key and document."""
    return lines.groupBy("k1", "k2", "id").agg(F.count("*").alias("n_lines"))


def insert_documents(refs: DataFrame, lines: DataFrame) -> DataFrame:
    """References after adding the documents of ``lines``; documents already there stay as they are."""
    return refs.unionByName(references(lines).join(refs.select("id").distinct(), "id", "left_anti").select(refs.columns))


def delete_documents(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """References after removing the documents of ``ids`` (column id)."""
    return refs.join(ids.select("id").distinct(), "id", "left_anti").select(refs.columns)


def repeated(refs: DataFrame) -> DataFrame:
    """(k1, k2, n_refs, keeper) of the keys that two or more documents hold, from references or from lines (n_refs counts their rows)."""
    return refs.groupBy("k1", "k2").agg(F.count("*").alias("n_refs"), F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper <> last").drop("last")


def shard_of(n_shards: int) -> Column:
    return F.pmod(F.xxhash64("k2", "k1"), F.lit(n_shards)).cast("int")


def filters(keys: DataFrame, n_shards: int) -> DataFrame:
    """(shard, cells): a cuckoo filter of each shard's keys."""

    def build(key, pdf):
        return pd.DataFrame({"shard": [key[0]], "cells": [CuckooFilter.of(pdf["k1"].to_numpy(np.int64)).to_bytes()]})

    return keys.select(shard_of(n_shards).alias("shard"), "k1").groupBy("shard").applyInPandas(build, "shard int, cells binary")


def update_filters(cells: DataFrame, before: DataFrame, after: DataFrame, n_shards: int) -> DataFrame:
    """The filters after the repeated keys changed from ``before`` to ``after``: the gone are deleted, the new inserted.

    Only shards with a change are opened; their present keys go along for the case that a filter overflows and is built anew.
    """
    shard, same = shard_of(n_shards).alias("shard"), ["k1", "k2"]
    gone = before.join(after, same, "left_anti").select(shard, "k1", F.lit("gone").alias("what"))
    new = after.join(before, same, "left_anti").select(shard, "k1", F.lit("new").alias("what"))
    changed = stored(gone.unionByName(new))
    touched = changed.select("shard").distinct()
    every = after.select(shard, "k1", F.lit("all").alias("what")).join(touched, "shard", "left_semi")

    def update(key, old: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        keys = {w: rows.loc[rows["what"] == w, "k1"].to_numpy(np.int64) for w in ("gone", "new", "all")}
        f = CuckooFilter.from_bytes(old["cells"].iloc[0]) if len(old) else CuckooFilter()
        if len(rows):
            f.delete(keys["gone"])
            try:
                f.insert(keys["new"])
            except OverflowError:
                f = CuckooFilter.of(keys["all"])
        return pd.DataFrame({"shard": [key[0]], "cells": [f.to_bytes()]})

    return cells.groupBy("shard").cogroup(changed.unionByName(every).groupBy("shard")).applyInPandas(update, "shard int, cells binary")


def screened(lines: DataFrame, cells: DataFrame, n_shards: int, sent_bytes: int = 64 << 20, shard_rows: int = 200_000) -> DataFrame:
    """The lines whose key may be repeated: those that their shard's filter holds."""
    cells = stored(cells)
    at = shard_of(n_shards).alias("shard")
    size = cells.agg(F.coalesce(F.sum(F.octet_length("cells")), F.lit(0))).first()[0]
    if size <= sent_bytes:
        sent = lines.sparkSession.sparkContext.broadcast({r[0]: bytes(r[1]) for r in cells.select("shard", "cells").toLocalIterator()})  # its size is checked above

        def ask(batches):
            known = {k: CuckooFilter.from_bytes(v) for k, v in sent.value.items()}
            for b in batches:
                shard, k1 = b.column(b.num_columns - 1).to_numpy(), b.column(b.num_columns - 3).to_numpy()
                hit = np.zeros(len(k1), bool)
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.nonzero(np.diff(shard[order]))[0] + 1):
                    if len(part) and (f := known.get(int(shard[part[0]]))) is not None:
                        hit[part] = f.contains(k1[part])
                yield b.filter(pa.array(hit))

        asked = lines.select("id", "t1", "t2", "line_no", "k1", "k2", at)
        return asked.mapInArrow(ask, asked.schema).drop("shard")
    loads = stored(lines.groupBy(at).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("salts")))  # all lines of a shard, repeated or not
    left = lines.withColumn("shard", at).join(loads, "shard")
    left = left.withColumn("salt", F.pmod(F.xxhash64("id", "t1", "line_no"), F.col("salts")).cast("int")).drop("salts")
    right = cells.join(loads, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "cells")
    schema = left.drop("shard", "salt").schema
    names = schema.names

    def settle(key, held, known):
        held = held.select(names)
        if not held.num_rows or not known.num_rows:
            return held.slice(0, 0)
        return held.filter(pa.array(CuckooFilter.from_bytes(known.column("cells")[0].as_py()).contains(held.column("k1").to_numpy())))

    return left.groupBy("shard", "salt").cogroup(right.groupBy("shard", "salt")).applyInArrow(settle, schema)


def shards_for(n_keys: int, shard_keys: int = 100_000) -> int:
    return max(8, -(-n_keys // shard_keys))


def dropped_lines(lines: DataFrame, keys: DataFrame, kept_filters: tuple[DataFrame, int] | None = None, **screen) -> DataFrame:
    """(id, t1, t2, line_no) of the lines to cut: in a repeated key, and not of its keeper. ``kept_filters``: filters of the keys and their number of shards, if there are."""
    keys = stored(keys)
    n_keys, n_refs = keys.agg(F.count("*"), F.coalesce(F.sum("n_refs"), F.lit(0))).first()
    n_shards = kept_filters[1] if kept_filters else shards_for(n_keys)
    hits = stored(screened(lines, kept_filters[0] if kept_filters else filters(keys, n_shards), n_shards, **screen))  # read twice below
    hot = F.broadcast(keys.where(F.col("n_refs") * 10_000 > n_refs).select("k1", "k2", F.col("keeper").alias("hot_keeper")))  # under 10,000 rows
    told = hits.join(hot, ["k1", "k2"], "left")
    here = told.where("hot_keeper <> id").select("id", "t1", "t2", "line_no")
    rest = told.where("hot_keeper is null").join(keys.where(F.col("n_refs") * 10_000 <= n_refs).select("k1", "k2", "keeper"), ["k1", "k2"]).where("keeper <> id")
    return here.unionByName(rest.select("id", "t1", "t2", "line_no"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, **screen) -> DataFrame:
    """docs with the text cut, and ``n_lines`` (before), ``n_dropped``."""
    lines = keyed_lines(docs, id_col, text_col, min_chars)
    return cut_lines(docs, dropped_lines(lines, repeated(lines), **screen), id_col, text_col)


def cut_lines(docs: DataFrame, cut: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs (whose columns travel as one struct, so that no name can clash) without the lines of ``cut``."""
    drops = cut.groupBy("id", "t1", "t2").agg(F.collect_set("line_no").alias("drops"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("r"), *_text_mark(F.col(f"`{text_col}`")))
    joined = rows.join(drops.toDF("d", "d1", "d2", "drops"), (F.col("r") == F.col("d")) & (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left")
    packed = joined.select(F.col("row").dropFields(f"`{text_col}`").alias("row") if len(docs.columns) > 1 else F.lit(None).alias("row"), F.struct(F.col("row")[text_col].alias("text"), "drops").alias("packed"))
    fields = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_text", T.StringType())]

    def task():
        def one(x):
            lines = (x["text"] or "").split("\n")
            gone = set(x["drops"] or ())
            return len(lines), len(gone), "\n".join(v for i, v in enumerate(lines) if i not in gone) if gone else x["text"]

        return lambda rows: dict(zip(("n_lines", "n_dropped", "kept_text"), zip(*map(one, rows), strict=True) if rows else ([], [], []), strict=True))

    out = map_texts(packed, "packed", task, fields, keep=["row"])
    added = ("n_lines", "n_dropped")
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in added], *added)


def _digested(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return _digested(dedup(table(spark, sf_dir, "documents").select("doc_id", "text")))


def incremental(spark, sf_dir: str) -> DataFrame:
    """The same verdicts by way of changes: documents of odd ids are inserted after those of even ids, then a third is deleted and inserted anew.

    References and filters are carried along; in the end every document is held, so the result is that of a single pass.
    """
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    odd, third = F.col("doc_id") % 2 != 0, F.col("doc_id") % 3 == 0
    refs = stored(references(keyed_lines(docs.where(~odd))))
    keys = stored(repeated(refs))
    n_shards = shards_for(keys.count())
    cells = stored(filters(keys, n_shards))

    def changed(new_refs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        new_refs = stored(new_refs)
        new_keys = stored(repeated(new_refs))
        return new_refs, new_keys, stored(update_filters(cells, keys, new_keys, n_shards))

    refs, keys, cells = changed(insert_documents(refs, keyed_lines(docs.where(odd))))
    refs, keys, cells = changed(delete_documents(refs, docs.where(third).select(F.col("doc_id").alias("id"))))
    refs, keys, cells = changed(insert_documents(refs, keyed_lines(docs.where(third))))
    return _digested(cut_lines(docs, dropped_lines(keyed_lines(docs), keys, (cells, n_shards)), "doc_id", "text"))


OP3_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
