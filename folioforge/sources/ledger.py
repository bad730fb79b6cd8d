"""Calls to paid models, made once: replies are kept by a hash of what was asked.

Replies lie in a ``KeyedStore``. While a run is on, each task also notes its replies in a journal in shared storage, batch by batch, before it
goes on: a task that is tried again after a lost executor, or a run that is started again after a lost driver, finds them there and asks for
the rest only. What can be asked twice is a batch whose reply came but was not noted before the loss, and what two runs at a time both ask.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import KeyedStore


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The folder as tasks see it, made if absent; ``path`` is a URI or a local path."""
    files, at = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    files.create_dir(at, recursive=True)
    return files, at


def noted(files: fs.FileSystem, folder: str) -> dict:
    """Replies by key of all files of a journal's folder; files being written are passed over."""
    out: dict = {}
    for info in files.get_file_info(fs.FileSelector(folder)):
        if info.base_name.endswith(".json"):
            with files.open_input_stream(info.path) as f:
                out.update(json.loads(f.read()))
    return out


def note(files: fs.FileSystem, folder: str, replies: dict) -> None:
    """Adds a file of replies, seen whole or not at all."""
    name = f"{folder}/{uuid.uuid4().hex}"
    with files.open_output_stream(f"{name}.part") as f:
        f.write(json.dumps(replies).encode())
    files.move(f"{name}.part", f"{name}.json")


class CallLedger:
    """Replies of type ``reply`` (a DDL type whose values JSON can hold) at ``path``, which driver and tasks share.

    ``shards`` is fixed for a ledger: a task works through one shard of the open calls at a time, and holds its rows and replies.
    """

    def __init__(self, spark: SparkSession, path: str, reply: str, shards: int = 4096):
        self.spark, self.path, self.reply, self.shards = spark, path.rstrip("/"), reply, shards
        kind = T.StructType.fromDDL(f"key string, reply {reply}")
        self.store = KeyedStore(spark, f"{self.path}/replies", kind, ["key"])

    def replies(self, rows: DataFrame, inputs: list[str], call: Callable[[list], list], name: str, batch: int = 20, retries: int = 5, partitions: int | None = None) -> DataFrame:
        """rows with ``reply``. ``call`` takes a list of inputs (tuples, if there are several columns) and gives as many replies.

        Rows of equal inputs share one call; ``name`` tells models and prompts apart and is part of the key. Null inputs are asked as None, an
        empty table asks nothing, and a ``reply`` column of the rows is replaced. ``partitions`` bounds how many callers run at once.
        """
        rows = rows.drop("reply")
        asked = F.to_json(F.struct(F.lit(name).alias("name"), *[F.col(f"`{c}`") for c in inputs]), {"ignoreNullFields": "false"})
        keyed = rows.withColumn("_key", F.sha2(asked, 256))
        calls = keyed.select(F.col("_key").alias("key"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(inputs)]).alias("ask")).dropDuplicates(["key"])
        self.store.resume(calls, lambda fresh: self._ask(fresh, len(inputs), call, batch, retries, partitions))
        self._forget()
        return keyed.join(self.store.read().withColumnRenamed("key", "_key"), "_key", "left").drop("_key")

    def _ask(self, fresh: DataFrame, width: int, call: Callable, batch: int, retries: int, partitions: int | None) -> DataFrame:
        journal = f"{self.path}/journal"

        def tried(asks: list) -> list:
            for left in reversed(range(retries)):
                try:
                    got = list(call(asks))
                    if len(got) != len(asks):
                        raise ValueError(f"{len(asks)} inputs, {len(got)} replies")
                    return got
                except Exception:
                    if not left:
                        raise
            raise ValueError("retries must be at least 1")

        def answer(shard: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            files, at = open_folder(f"{journal}/{shard[0]}")
            known = noted(files, at)
            open_ = pdf[~pdf["key"].isin(known)].sort_values("key")
            for i in range(math.ceil(len(open_) / batch)):
                part = open_.iloc[i * batch : (i + 1) * batch]
                asks = [ask["c0"] if width == 1 else tuple(ask[f"c{j}"] for j in range(width)) for ask in part["ask"]]
                got = dict(zip(part["key"], tried(asks), strict=True))
                note(files, at, got)
                known.update(got)
            return pd.DataFrame({"key": pdf["key"], "reply": pd.Series([known[k] for k in pdf["key"]], index=pdf.index, dtype=object)})

        shard = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % self.shards).alias("shard")
        laid = fresh.select("key", "ask", shard)
        laid = laid.repartition(partitions, "shard") if partitions else laid
        return laid.groupBy("shard").applyInPandas(answer, f"key string, reply {self.reply}")

    def _forget(self) -> None:
        """The journal goes once its replies are in the store."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/journal")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
