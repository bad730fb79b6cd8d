"""Corpus pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. Rows with one id share the fate that stages 1 and 3 give the id; rows with a null id pass these two
and are judged on their own text in stage 4. Empty and null texts have no letters, so stage 1 rejects them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, langid, linededup, pieces, simhash
from folioforge.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language; ``lang`` is the declaration and labels the training sample (in two folds), ``source`` counts as host."""
    told = langid.identify(docs, declared=F.col("lang"), host=F.col("source"), folds=2)
    rejected = told.where("not accepted").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated over documents go from the texts; every document stays, if only with an empty text."""
    cut = linededup.dedup(docs)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        cut = cut.withColumn("n_chars", F.when(F.col("n_dropped") > 0, n).otherwise(F.col("n_chars")))
    return cut.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies."""
    others = simhash.near_duplicates(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, decodable to the exact texts."""
    return pieces.encode(docs, pieces.load(pieces.QUERY_MODEL)).select(*docs.columns, "n_tokens", "ids", "round_trip")


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("benchmark_decontamination", benchmark), ("sentencepiece", encoded)]

#: Language models, fingerprints and alignments are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
