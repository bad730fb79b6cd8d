"""What the corpus operators share: words, shared storage, Arrow row passing."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.tables import shared_dir, stored

__all__ = ["SPACE_CHARS", "WORD", "map_texts", "remove_tables", "shared_dir", "stored", "table"]

#: A word is a run of characters other than space, tab and the line controls.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove_tables(spark: SparkSession) -> None:
    """Removes what the operators have stored in shared storage (all folders that ``shared_dir`` named below ``spark.checkpoint.dir``).

    To be called once their results have been written: results are read from those tables.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in files.listStatus(path) if files.exists(path) else ():
        if re.fullmatch("[0-9a-f]{32}", entry.getPath().getName()):
            files.delete(entry.getPath(), True)


#: Bytes of text that a task works on at a time; a longer text is a part of its own.
PART_BYTES = 4 << 20


def _parts(batch: pa.RecordBatch, text: int, sizes: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded text, so that what a task holds does not follow the batch's row count. ``sizes``: a column with the texts' bytes."""
    column = batch.column(text)
    if isinstance(column, pa.StructArray):
        column = column.field(0)
    if sizes is not None:
        ends = np.cumsum(batch.column(sizes).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    elif pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    else:
        ends = np.arange(1, batch.num_rows + 1, dtype=np.int64) * (PART_BYTES // 1000)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def map_texts(df: DataFrame, text_col: str, fn: Callable[[], Callable[[list], dict[str, list]]], fields: list[T.StructField], keep: list[str] | None = None, drop_text: bool = False, sizes: str | None = None) -> DataFrame:
    """Adds columns computed from whole texts, batch by batch, inside the tasks that read them.

    ``fn()`` runs once a task and returns a function from a list of texts (None for null) to a
    dict of lists (or Arrow arrays), one for each of ``fields``. The columns in ``keep`` (all, if None) come
    through unchanged; a new column replaces one of the same name. Texts that come compressed have their bytes in the kept column ``sizes``. No shuffle.
    """
    names = [f.name for f in fields]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names and not (drop_text and c == text_col)]
    sent = kept + ([text_col] if text_col not in kept else [])
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn()
        for b in (part for whole in batches for part in _parts(whole, sent.index(text_col), sent.index(sizes) if sizes else None)):
            out = work(b.column(sent.index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], k) for n, k in zip(names, kinds, strict=True)], names=kept + names)

    return df.select(*[f"`{c}`" for c in sent]).mapInArrow(run, schema)
