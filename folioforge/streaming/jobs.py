"""Streaming jobs: questions answered against a static corpus, and indexing of new chunks. Both add to a keyed store.

A stream is known by an id that lies in its checkpoint, so a replayed batch changes nothing, while a new checkpoint or another source
is a stream of its own and takes nothing away from what others stored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import Bm25Index, retrieve
from ..operators.vectors import embed_texts
from ..sources.store import KeyedStore
from ..sources.tables import stored


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id kept in a checkpoint's folder; a new one where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/stream_id")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        out = files.create(at, False)
        out.write(bytearray(uuid.uuid4().hex.encode()))
        out.close()
    return spark.read.text(at.toString()).first()[0]


def answers_store(spark: SparkSession, path: str, query_type: T.DataType, chunk_type: T.DataType) -> KeyedStore:
    """Answers by question: query_id and its chunks (chunk_id, final_rank, score), best first."""
    chunk = T.StructType([T.StructField("final_rank", T.IntegerType()), T.StructField("chunk_id", chunk_type), T.StructField("score", T.DoubleType())])
    return KeyedStore(spark, path, T.StructType([T.StructField("query_id", query_type), T.StructField("chunks", T.ArrayType(chunk))]), ["query_id"])


def answer_stream(questions: DataFrame, index: Bm25Index, corpus: DataFrame, vectors: DataFrame, embed: Callable, store: str, checkpoint: str, **options) -> StreamingQuery:
    """Questions (query_id, question) that have no answer in the store yet are embedded and retrieved for, micro-batch by micro-batch.

    A question that comes again, in whatever batch or stream, is answered once; of two of one id in a batch the least by its text is asked.
    A batch reads the postings of its terms, all vectors (the search is exact) and of the corpus's texts those that are reranked.
    """
    spark = questions.sparkSession
    answers = answers_store(spark, store, questions.schema["query_id"].dataType, corpus.schema[options.get("id_col", "chunk_id")].dataType)
    stream = stream_id(spark, checkpoint)

    def answered(asked: DataFrame) -> DataFrame:
        found = retrieve(index, corpus, vectors, stored(embed_texts(asked, "question", embed)), **options)  # the searches read it many times
        best = F.struct(F.col("final_rank").cast("int").alias("final_rank"), F.col(options.get("id_col", "chunk_id")).alias("chunk_id"), "score")
        return found.groupBy("query_id").agg(F.array_sort(F.collect_list(best)).alias("chunks"))  # top_k entries

    def handle(batch: DataFrame, batch_id: int) -> None:
        answers.resume(batch.select("query_id", "question"), answered, stream, batch_id, F.col("question"))

    return questions.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_store(spark: SparkSession, path: str, schema: T.StructType, keys: tuple[str, ...] = ("chunk_id",)) -> KeyedStore:
    """Chunks with their vectors."""
    return KeyedStore(spark, path, T.StructType([*(f for f in schema.fields if f.name != "embedding"), T.StructField("embedding", T.ArrayType(T.FloatType()))]), list(keys))


def index_stream(chunks: DataFrame, embed: Callable, store: str, checkpoint: str, keys: tuple[str, ...] = ("chunk_id",), order: str | None = None) -> StreamingQuery:
    """New chunks are embedded and stored, those stored before (by key) left alone, whatever is replayed.

    Of rows of one key in a batch the least by ``order`` (by a hash of all columns, if None) is kept.
    """
    spark = chunks.sparkSession
    kept = index_store(spark, store, chunks.schema, keys)
    stream = stream_id(spark, checkpoint)

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept.resume(batch, lambda fresh: embed_texts(fresh, embed=embed), stream, batch_id, F.col(order) if order else None)

    return chunks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
