"""Records to chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that a chunk takes from its first record, where the records have them.
OPTIONAL = ("callout_kind", "lead_in", "term", "table_id", "caption", "header", "rows")


def embed_text(callout: Column | None, path: Column, text: Column) -> Column:
    """``[TAG] [a > b > c]``, a new line, the text; the tag for callouts only."""
    tag = F.lit("")
    if callout is not None:
        tag = F.when(callout == "amendment", "[AMENDMENT] ").when(callout == "exception", "[EXCEPTION] ").otherwise("")
    return F.concat(tag, F.lit("["), F.array_join(path, " > "), F.lit("]\n"), text)


def build_chunks(records: DataFrame) -> DataFrame:
    """Runs of list items in one section become one chunk; every other record is its own. Ordered by ``pos`` within a document.

    One exchange by document carries the windows and the grouping. Text parts are joined by one space.
    """
    w = Window.partitionBy("doc_id").orderBy("pos")
    same = (F.col("type") == "list_item") & (F.lag("type").over(w) == "list_item") & F.lag("section_id").over(w).eqNullSafe(F.col("section_id"))
    marked = records.withColumn("_new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = [c for c in ("section_id", "section_title", "section_path", "type", *OPTIONAL) if c in records.columns]
    parts = F.array_sort(F.collect_list(F.struct("pos", "id", "text")))
    out = marked.groupBy("doc_id", F.col("_no").alias("chunk_no")).agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), *[F.min_by(c, "pos").alias(c) for c in first], parts.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda x: x["text"]), " ")
    callout = F.col("callout_kind") if "callout_kind" in first else None
    out = out.withColumns({"chunk_id": F.format_string("chk%04d", F.col("chunk_no")), "source_record_ids": F.transform("_parts", lambda x: x["id"]), "display_text": text})
    return out.withColumns({"embed_text": embed_text(callout, F.col("section_path"), F.col("display_text")), "n_chars": F.length("display_text")}).drop("_parts")


def point_key(chunk_id: Column) -> Column:
    """The integer key of a chunk id: its digits."""
    return F.regexp_extract(chunk_id, r"\d+", 0).cast("long")


def size_stats(chunks: DataFrame) -> DataFrame:
    """(type, n, min, max, mean characters, records covered) by type and in TOTAL."""
    out = chunks.rollup("type").agg(F.count("*").alias("n"), F.min("n_chars").alias("min_chars"), F.max("n_chars").alias("max_chars"), F.avg("n_chars").alias("mean_chars"), F.sum(F.size("source_record_ids")).alias("n_records"), F.grouping("type").alias("_all"))
    return out.withColumn("type", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("type"))).drop("_all")
