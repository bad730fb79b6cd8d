"""Readers and writers of the pipeline's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = (
    "doc_id bigint, id string, pos bigint, page_start int, page_end int, section_id string, section_title string, section_path array<string>, type string, text string, n_chars int, "
    "callout_kind string, lead_in string, term string, table_id string, caption string, header array<string>, rows array<array<string>>"
)
CHUNKS = (
    "doc_id bigint, chunk_id string, chunk_no bigint, source_record_ids array<string>, page_start int, page_end int, section_id string, section_title string, section_path array<string>, type string, "
    "display_text string, embed_text string, n_chars int, callout_kind string, lead_in string, term string, table_id string, caption string, header array<string>, rows array<array<string>>"
)
_QUESTION = "struct<id:string,type:string,question:string,answer:string,sections:array<string>,expected_response:string,topic_excluded_from_handbook:string>"
ANSWER_KEY = f"questions array<{_QUESTION}>, unanswerable_questions array<{_QUESTION}>"


def shared_dir(spark: SparkSession) -> str:
    """A new folder path in the cluster's shared storage (``spark.checkpoint.dir``).

    Where no such setting exists, a local session gets a temporary folder; a cluster's is refused, since its tasks share no such folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local") or spark.conf.get("spark.master", "").startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once into a Parquet table in shared storage: its lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """A stage's table. JSON Lines are read with the given schema; blank lines are no rows, a malformed line or a field of another type fails the read (see ``bad_records``)."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return (reader.option("mode", "FAILFAST") if kind == "json" else reader).format(kind).load(path)


def read_sound(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of JSON Lines that follow the schema; the others are what ``bad_records`` gives."""
    return _parsed(spark, path, schema).where("_corrupt_record is null").drop("_corrupt_record", "_file")


def bad_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """(file, record): the lines that are not records of the schema, to be set aside and looked at."""
    return _parsed(spark, path, schema).where("_corrupt_record is not null").select(F.col("_file").alias("file"), F.col("_corrupt_record").alias("record"))


def _parsed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    told = F.from_json("value", T.StructType([*kinds.fields, T.StructField("_corrupt_record", T.StringType())]), {"columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.select(told.alias("r"), "_file").select("r.*", "_file")


def read_answer_key(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Questions of both lists of nested answer keys (a file each, or a line each): query_id, type, question, answer, sections, answerable, topic_excluded."""
    key = spark.read.option("multiLine", multi_line).schema(ANSWER_KEY).json(path)

    def rows(field: str, answerable: bool) -> DataFrame:
        return key.select(F.explode(field).alias("q")).select(F.col("q.id").alias("query_id"), "q.type", "q.question", F.coalesce("q.answer", "q.expected_response").alias("answer"), F.coalesce("q.sections", F.array().cast("array<string>")).alias("sections"), F.lit(answerable).alias("answerable"), F.col("q.topic_excluded_from_handbook").alias("topic_excluded"))

    return rows("questions", True).unionByName(rows("unanswerable_questions", False))


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode).format(kind)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report object as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_evaluation(report: DataFrame, details: DataFrame, path: str) -> None:
    """An evaluation: the report object as one JSON file in ``report``, its questions as JSON Lines in ``details``, written by the tasks that have them."""
    write_report(report, f"{path}/report")
    details.write.mode("overwrite").json(f"{path}/details")


def read_evaluation(spark: SparkSession, path: str, report: T.StructType, details: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Report and details as written, by the schemas they had."""
    return read_table(spark, f"{path}/report", report, "json"), read_table(spark, f"{path}/details", details, "json")


def by_payload(points: DataFrame, section_id: str | None = None, kind: str | None = None) -> DataFrame:
    """Points filtered by their payload; stored ``partitionBy("type")``, the kind prunes partitions."""
    if kind is not None:
        points = points.where(F.col("type") == kind)
    return points if section_id is None else points.where(F.col("section_id") == section_id)
