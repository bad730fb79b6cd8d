"""A keyed table in shared storage that batches are added to: segments listed by a manifest, merged as they become many.

A *segment* is a folder of Parquet files, partitioned by a hash of the key and sorted by it, with Parquet's own Bloom filters on the key's hash: a small
batch asks for its keys and opens only the row groups that may hold them. A *manifest* (a small file, one for each change) lists the segments that make up
the table and how far each stream has come; a change is visible when its manifest is, and two writers cannot write the same one, so the slower
does its work again on what the other left.

A row carries the number of the change that wrote it, and of rows of one key the newest counts. Segments of like size are merged once there are ``fan`` of
them, so a table of n rows has about ``fan * log_fan(n)`` segments however many batches it came in, and a row is rewritten about ``log_fan(n)`` times.

Null keys are keys like others (one row for all nulls). Of rows of one key within a batch the least by ``order`` stays. An empty batch adds no segment.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many keys are pushed down to the files one by one.
PUSHED_KEYS = 1000


class KeyedStore:
    """The table at ``path``, with the columns of ``schema``, by ``keys``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 16, fan: int = 8):
        self.spark, self.path, self.keys, self.buckets, self.fan = spark, path.rstrip("/"), list(keys), buckets, fan
        self.schema = schema
        self._own = T.StructType([*schema.fields, T.StructField("_h", T.LongType()), T.StructField("_seq", T.LongType()), T.StructField("_seg", T.StringType()), T.StructField("_bucket", T.IntegerType())])

    # --- files ---

    def _files(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        files, at = self._files(folder)
        return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []

    def manifest(self) -> dict:
        """The newest readable manifest: number, segments, done (the last batch of each stream)."""
        for name in reversed(self._names("manifest")):
            text = self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()
            try:
                return json.loads(text[0]) if text else {}
            except ValueError:
                continue  # a writer that was lost while it wrote
        return {"number": 0, "segments": [], "done": {}}

    def _publish(self, state: dict) -> bool:
        files, at = self._files("manifest", f"{state['number']:012d}.json")
        try:
            out = files.create(at, False)
        except Exception as e:
            if "exists" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        return True

    def _drop(self, folder: str) -> None:
        files, at = self._files("data", f"_seg={folder}")
        files.delete(at, True)

    # --- rows ---

    def _keyed(self, rows: DataFrame) -> DataFrame:
        h = F.xxhash64(*[F.col(f"`{k}`") for k in self.keys])
        return rows.withColumns({"_h": h, "_bucket": F.pmod(h, F.lit(self.buckets)).cast("int")})

    def _segment(self, rows: DataFrame) -> dict | None:
        """rows (keyed, with _seq) written as a folder; None if there are none."""
        folder = uuid.uuid4().hex
        at = f"{self.path}/data/_seg={folder}"
        laid = rows.drop("_seg").repartition("_bucket").sortWithinPartitions("_bucket", "_h")
        laid.write.option("parquet.bloom.filter.enabled#_h", "true").partitionBy("_bucket").parquet(at)
        n = self._all([{"folder": folder}]).count() if self._names(f"data/_seg={folder}")[1:] else 0
        return {"folder": folder, "rows": n} if n else None

    def _all(self, segments: list[dict]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self._own)
        return self.spark.read.schema(self._own).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/_seg={s['folder']}" for s in segments])

    def _newest(self, rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("_h", *[F.col(f"`{k}`") for k in self.keys]).orderBy(F.desc("_seq"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def _single(self, rows: DataFrame, order: Column | None) -> DataFrame:
        w = Window.partitionBy(*[F.col(f"`{k}`") for k in self.keys]).orderBy(order if order is not None else F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def read(self) -> DataFrame:
        """The table: the newest row of each key."""
        state = self.manifest()
        rows = self._all(state["segments"])
        if state.get("replaced"):  # else no key is held twice
            rows = self._newest(rows)
        return rows.select(*[f"`{c}`" for c in self.schema.names])

    def missing(self, rows: DataFrame, state: dict | None = None) -> DataFrame:
        """The rows whose key the table does not hold. They need the keys, not all columns of the table."""
        state = state or self.manifest()
        if not state["segments"]:
            return rows
        keyed = self._keyed(rows)
        held = self._all(state["segments"])
        few = [r[0] for r in keyed.select("_h").distinct().limit(PUSHED_KEYS + 1).collect()]
        if len(few) <= PUSHED_KEYS:
            held = held.where(F.col("_bucket").isin({h % self.buckets for h in few}) & F.col("_h").isin(few))
        held = held.select("_h", *[f"`{k}`" for k in self.keys])
        same = [keyed[k].eqNullSafe(held[k]) for k in ["_h", *self.keys]]
        return keyed.join(held, same, "left_anti").drop("_h", "_bucket")

    # --- changes ---

    def _change(self, made: Callable[[dict], tuple[DataFrame, bool]], stream: str | None = None, batch: int | None = None, fresh: bool = False) -> bool:
        """Writes what ``made`` gives for the present state as a segment and publishes it; False if the stream's batch is in the table already."""
        while True:
            before = self.manifest()
            if stream is not None and before["done"].get(stream, -1) >= batch:
                return False
            number = before["number"] + 1
            for name in self._names("manifest")[-1:]:
                number = max(number, int(name.split(".")[0]) + 1)
            rows, replaces = made(before)
            new = self._segment(self._keyed(rows.select(*[f"`{c}`" for c in self.schema.names])).withColumn("_seq", F.lit(number).cast("long")))
            state = {"number": number, "segments": ([] if fresh else before["segments"]) + ([new] if new else []), "done": dict(before["done"]), "replaced": not fresh and (before.get("replaced", False) or (replaces and new is not None))}
            if stream is not None:
                state["done"][stream] = batch
            if self._publish(state):
                break
            if new:
                self._drop(new["folder"])
        self.compact()
        return True

    def recreate(self, rows: DataFrame, order: Column | None = None) -> None:
        """The table is what ``rows`` are, and nothing else."""
        self._change(lambda _: (self._single(rows, order), False), fresh=True)

    def resume(self, rows: DataFrame, work: Callable[[DataFrame], DataFrame] = lambda df: df, stream: str | None = None, batch: int | None = None, order: Column | None = None) -> bool:
        """Adds the rows whose key is not there yet, after ``work`` (say, embedding) on these alone."""
        return self._change(lambda state: (work(self.missing(self._single(rows, order), state)), False), stream, batch)

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None, order: Column | None = None) -> bool:
        """Adds the rows; they take the place of older ones of their key."""
        return self._change(lambda _: (self._single(rows, order), True), stream, batch)

    def compact(self, everything: bool = False) -> None:
        """Merges segments of like size where there are ``fan`` of them (``everything``: all into one), and removes folders that no longer count."""
        state = self.manifest()
        tiers: dict[int, list[dict]] = {}
        for s in state["segments"]:
            tiers.setdefault(int(math.log(max(1, s["rows"]), self.fan)), []).append(s)
        some = state["segments"] if everything else next((v for _, v in sorted(tiers.items()) if len(v) >= self.fan), [])
        if len(some) < 2:
            return
        rows = self._newest(self._all(some)) if state.get("replaced") else self._all(some)
        new = self._segment(rows)
        rest = [s for s in state["segments"] if s not in some]
        after = {"number": state["number"] + 1, "segments": rest + [new], "done": state["done"], "replaced": state.get("replaced", False) and bool(rest)}
        if not self._publish(after):
            self._drop(new["folder"])  # another writer was faster; its change is merged another time
            return
        self._clean(keep={s["folder"] for x in (state, after) for s in x["segments"]})
        if not everything:
            self.compact()

    def _clean(self, keep: set[str]) -> None:
        """Removes the folders of earlier states than the one before (which readers may still be at), and old manifests."""
        past = set()
        names = self._names("manifest")
        for name in names[:-2]:
            text = self.spark.read.text(f"{self.path}/manifest/{name}", wholetext=True).first()
            try:
                past |= {s["folder"] for s in json.loads(text[0])["segments"]} if text else set()
            except ValueError:
                pass
        for folder in past - keep:
            self._drop(folder)
        for name in names[:-2]:
            files, at = self._files("manifest", name)
            files.delete(at, False)
