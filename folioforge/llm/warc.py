"""WARC archives of pages, and their index by an external merge.

Writing. Every page becomes a WARC/1.1 record in gzipped archive files in shared storage. Of records with
equal payloads of at least ``min_bytes`` the one with the smallest id is the response; the others are
revisits that refer to it and hold no payload. Records of a file are sorted by URL key and capture time,
so each file is a locally sorted capture run.

Indexing. The archives are read back as a stream, record by record (by Content-Length): a task holds one record
at a time, however large its archive. The runs are cut at common range bounds, into ranges of about
``range_rows`` rows; within each range a loser tree merges the k sorted run segments by URL key, capture time and
id. Ranges in order give one global order: every URL's capture history, in time.

Scale. Texts are shuffled once, to put the revisit verdict and the sort order on them. A range holds index
rows only, and one URL's history may span ranges. Payload groups are never gathered: their smallest id is a partial
aggregate joined back, and Spark splits the hot side of that join. An archive is one gzip member, so its offsets count unpacked bytes.

Edge cases: null html is an empty payload (a response, being short); a null url has the empty key; line breaks in a url
are spaces; ids may be of any type that can be ordered and written as text without line breaks, of any size, or null (a record
without id is never the response that others refer to while one with an id has that payload); ids that
repeat get a record each (equal payloads of one id refer to nothing but themselves: a record whose id is
the smallest is a response, and so are all records of a payload that only rows without id hold); ties in key and time
fall by id, null first; payloads of any length are written whole; extra columns are left out; an empty table writes no record.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def url_key(url: Column) -> Column:
    """Sort key of a URL: lower-case host labels reversed (without www), then the path and query without the fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\d*\.|:\d+$", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.coalesce(F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))).otherwise(url), F.lit(""))


#: Capture times start here and go round after a hundred years, so that every id has a valid date.
START, SPAN = 1_700_000_000, 3_155_760_000


def capture_time(page_id: Column) -> Column:
    """The pages hold no capture times: one second a page from a fixed start, which pages without a numeric id get too."""
    return F.timestamp_seconds(F.lit(START) + F.pmod(F.coalesce(page_id.try_cast("long"), F.lit(0)), F.lit(SPAN)))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None, min_bytes: int = 100) -> DataFrame:
    """(url_key, captured_at, id, record): the text of each WARC record, revisits told from responses."""
    rows = pages.select(F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), (captured if captured is not None else capture_time(F.col(id_col))).alias("captured_at"))
    rows = rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    first = rows.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    told = rows.join(first, "digest", "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id")) & (F.col("bytes") >= min_bytes))
    block = F.concat(F.lit(HTTP), F.when(F.col("revisit"), "").otherwise(F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("bytes").cast("string")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return told.select(url_key(F.nullif("url", F.lit(""))).alias("url_key"), "captured_at", "id", F.concat(head, F.lit(END), block).alias("record"))


def write(pages: DataFrame, path: str, file_records: int = 10_000, **columns) -> None:
    """Writes the archives below ``path``, each file sorted by URL key and time."""
    recs = records(pages, **columns).sortWithinPartitions("url_key", "captured_at", "id")
    recs.select(F.col("record").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def parse(pieces: Iterator[bytes]) -> Iterator[dict]:
    """The records of one archive, in order, from the pieces between its double line ends. One record's bytes are held at a time."""
    end = END.encode()
    buffer, base = bytearray(), 0

    def more() -> bool:
        piece = next(pieces, None)
        if piece is None:
            return False
        buffer.extend(piece)
        buffer.extend(end)
        return True

    while True:
        while (stop := buffer.find(end)) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("the archive ends within a record's head")
                return
        if not stop:  # what is left of the end of the last record
            del buffer[: len(end)]
            base += len(end)
            continue
        lines = bytes(buffer[:stop]).decode().split("\r\n")
        head = {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])}
        start, size = stop + len(end), int(head["content-length"])
        while len(buffer) < start + size + len(end):
            if not more():
                raise ValueError("the archive ends within a record")
        yield head | {"_offset": base, "_block": bytes(buffer[start : start + size])}
        del buffer[: start + size + len(end)]
        base += start + size + len(end)


RUN_SCHEMA = "run string, seq long, url string, captured string, id string, record_type string, payload_digest string, payload_bytes long, refers_to string, file_offset long"


def _name(urn: str | None) -> str | None:
    return (urn or "").removeprefix("<urn:page:").removesuffix(">") or None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The capture runs: a row for each record of each archive, in file order. Payloads of responses are digested anew and must agree with their heads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((name, v) for b in batches for name, v in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True))
        for name, rest in itertools.groupby(pieces, key=lambda x: x[0]):  # a file is one split, and its pieces come in order
            rows = []
            for seq, r in enumerate(parse(v.as_py() for _, v in rest)):
                body = r["_block"].partition(END.encode())[2]
                digest, size = r["warc-payload-digest"].removeprefix("sha256:"), int(r["warc-payload-length"])
                if r["warc-type"] == "response" and (hashlib.sha256(body).hexdigest(), len(body)) != (digest, size):
                    raise ValueError(f"{name}: record {seq} does not match its digest")
                rows.append((name, seq, r.get("warc-target-uri", ""), r["warc-date"], _name(r["warc-record-id"]), r["warc-type"], digest, size, _name(r.get("warc-refers-to")), r["_offset"]))
                if len(rows) == 10_000:
                    yield _batch(rows, _RUN_ARROW)
                    rows = []
            if rows:
                yield _batch(rows, _RUN_ARROW)

    files = spark.read.option("lineSep", END).option("pathGlobFilter", "part-*").text(path).select(F.col("_metadata.file_path"), "value")
    return files.mapInArrow(run, RUN_SCHEMA)


_RUN_ARROW = pa.schema([("run", pa.string()), ("seq", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("id", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("file_offset", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class LoserTree:
    """Merges k sorted sequences of comparable keys: each inner node keeps the loser of its match, the overall winner is on top."""

    def __init__(self, runs: list[list]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.loser = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._first(leaf)

    def _key(self, r: int):
        return self.runs[r][self.at[r]] if self.at[r] < len(self.runs[r]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return x is not None and (y is None or (x, a) < (y, b))

    def _first(self, leaf: int) -> None:
        """While the tree is built, a leaf waits at the first empty node on its way up."""
        node, r = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.loser[node] < 0:
                self.loser[node] = r
                return
            if self._beats(self.loser[node], r):
                self.loser[node], r = r, self.loser[node]
            node //= 2
        self.loser[0] = r

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, place in it) in merged order."""
        if not self.k:
            return
        winner = self.loser[0]
        while self._key(winner) is not None:
            yield winner, self.at[winner]
            self.at[winner] += 1
            r, node = winner, (winner + self.k) // 2
            while node > 0:
                if self._beats(self.loser[node], r):
                    self.loser[node], r = r, self.loser[node]
                node //= 2
            winner = r


def merge_runs(runs: DataFrame, id_type: str = "bigint", range_rows: int = 200_000, ranges: int | None = None) -> DataFrame:
    """The runs' rows in one global order by (url_key, captured, id), numbered by ``position``.

    A range's index rows are what a task holds; their number bounds it, whatever the shuffle settings.
    """
    typed = {c: F.col(c).cast(id_type) for c in ("id", "refers_to")}
    keyed = stored(runs.withColumn("url_key", url_key(F.nullif("url", F.lit("")))).withColumns(typed))
    n = ranges or max(1, -(-keyed.count() // range_rows))
    cut = keyed.repartitionByRange(n, "url_key", "captured", "id", "run", "seq").withColumn("range", F.spark_partition_id())
    # each task gets its segments one after another, each in its run's own order
    cut = cut.sortWithinPartitions("run", "seq")
    at = {c: i for i, c in enumerate(cut.columns)}

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        run = rows.column(at["run"]).combine_chunks().dictionary_encode().indices.to_numpy()
        bounds = [0, *(np.nonzero(np.diff(run))[0] + 1).tolist(), len(run)]
        keys = [(k, c, i is not None, i if i is not None else 0) for k, c, i in zip(*(rows.column(at[c]).to_pylist() for c in ("url_key", "captured", "id")), strict=True)]
        tree = LoserTree([keys[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
        order = np.fromiter((bounds[r] + i for r, i in tree), np.int64, len(run))
        out = rows.take(pa.array(order))
        first = out.column(at["range"])[0].as_py() << 40
        yield from out.append_column("position", pa.array(np.arange(first, first + len(run)))).drop_columns(["range"]).to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema)
    return cut.mapInArrow(merge, f"{schema}, position long")


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **columns) -> DataFrame:
    """Writes the pages' archives, reads them back, and returns their merged index."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    write(pages, path, id_col=id_col, **columns)
    return merge_runs(read_runs(pages.sparkSession, path), pages.schema[id_col].dataType.simpleString())


def op6(spark, sf_dir: str) -> DataFrame:
    from .common import table

    index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured")


OP6_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(url, '[\r\n]+', ' ', 'g') AS url, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest),
u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\d*\.', ''), ':\d+$', '') AS host,
  regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to,
  coalesce(CASE WHEN host <> '' THEN array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END ELSE url END, '') AS url_key,
  strftime(to_timestamp(1700000000 + ((coalesce(page_id, 0) % 3155760000) + 3155760000) % 3155760000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM u LEFT JOIN f USING (payload_digest)
"""
