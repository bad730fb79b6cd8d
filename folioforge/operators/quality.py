"""Data-quality jobs: each returns the violating rows; ``summary`` counts them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import ancestors, flat, without_digits


def record_coverage(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, record_id, problem): records missing from, used twice by, or unknown to the chunks."""
    used = chunks.select("doc_id", F.explode("source_record_ids").alias("record_id"))
    have = records.select("doc_id", F.col("id").alias("record_id"))
    missing = have.join(used, ["doc_id", "record_id"], "left_anti").withColumn("problem", F.lit("missing"))
    unknown = used.join(have, ["doc_id", "record_id"], "left_anti").withColumn("problem", F.lit("unknown"))
    twice = used.groupBy("doc_id", "record_id").count().where("count > 1").drop("count").withColumn("problem", F.lit("used twice"))
    return missing.unionByName(unknown.distinct()).unionByName(twice)


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def field_faults(chunks: DataFrame, required: list[str], non_empty: list[str], text: str = "display_text") -> DataFrame:
    """(doc_id, chunk_id, faults): null required fields, empty ones, and n_chars that is not the text's length."""
    tests = [F.when(F.col(c).isNull(), F.lit(f"{c} null")) for c in required]
    tests += [F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.lit(f"{c} empty")) for c in non_empty]
    tests += [F.when(~F.col("n_chars").eqNullSafe(F.length(text)), F.lit("n_chars"))]
    return chunks.select("doc_id", "chunk_id", F.filter(F.array(*tests), lambda x: x.isNotNull()).alias("faults")).where(F.size("faults") > 0)


def section_mismatches(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that hold a record of another section."""
    used = chunks.select("doc_id", "chunk_id", "section_id", F.explode("source_record_ids").alias("id"))
    have = records.select("doc_id", "id", F.col("section_id").alias("record_section"))
    return used.join(have, ["doc_id", "id"]).where(~F.col("section_id").eqNullSafe(F.col("record_section")))


def prefix_faults(chunks: DataFrame) -> DataFrame:
    """Chunks whose embed text's first line lacks the section id, or whose callout tag or type's own fields are missing."""
    first = F.substring_index("embed_text", "\n", 1)
    faults = [F.when(~F.contains(first, F.coalesce("section_id", F.lit(""))), F.lit("section_id"))]
    if "callout_kind" in chunks.columns:
        faults += [F.when((F.col("type") == "callout") & ~F.col("embed_text").rlike(r"^\[(AMENDMENT|EXCEPTION)\] "), F.lit("tag")), F.when((F.col("type") == "callout") & F.col("callout_kind").isNull(), F.lit("callout_kind"))]
    for kind, field in (("glossary_entry", "term"), ("table", "caption")):
        if field in chunks.columns:
            faults.append(F.when((F.col("type") == kind) & F.col(field).isNull(), F.lit(field)))
    return chunks.select("doc_id", "chunk_id", F.filter(F.array(*faults), lambda x: x.isNotNull()).alias("faults")).where(F.size("faults") > 0)


def needles_found(needles: DataFrame, chunks: DataFrame, text: str = "display_text") -> DataFrame:
    """Needles (query_id, doc_id, section_id, needle) with ``found``: contained, flattened, in the concatenated text of the section's subtree in the document.

    Each chunk is keyed by its document and its section's ancestors, which makes the subtree an equi-join; only needled sections are kept
    before text is gathered, and what is gathered is part of one document.
    """
    same = ["doc_id", "section_id"]
    keyed = chunks.select("doc_id", "chunk_no", F.explode(ancestors(F.col("section_id"))).alias("section_id"), F.col(text).alias("text"))
    keyed = keyed.join(needles.select(*same).distinct(), same, "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", "text")))
    whole = keyed.groupBy(*same).agg(flat(F.array_join(F.transform(parts, lambda x: x["text"]), " ")).alias("_all"))
    return needles.join(whole, same, "left").withColumn("found", F.coalesce(F.contains("_all", flat(F.col("needle"))), F.lit(False))).drop("_all")


def contents_differences(toc: DataFrame, headings: DataFrame, extra_level: int = 3) -> DataFrame:
    """(doc_id, id, problem): contents entries without a heading or with another title, page or level; headings beyond the contents above ``extra_level``."""
    t = toc.select("doc_id", "id", F.struct("title", "page", "level").alias("t"))
    h = headings.select("doc_id", "id", F.struct("title", "page", "level").alias("h"))
    both = t.join(h, ["doc_id", "id"], "full_outer")
    depth = F.size(F.split("id", r"\."))
    problem = (
        F.when(F.col("h").isNull(), "missing")
        .when(F.col("t").isNull() & (F.col("h.level") != extra_level), "extra")
        .when(F.col("t").isNotNull() & ~(F.col("t.title").eqNullSafe(F.col("h.title"))), "title")
        .when(F.col("t").isNotNull() & ~(F.col("t.page").eqNullSafe(F.col("h.page"))), "page")
        .when(F.col("t").isNotNull() & (~(F.col("t.level").eqNullSafe(F.col("h.level"))) | (F.col("h.level") != depth)), "level")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("doc_id", "id", "problem")


def numbering_faults(headings: DataFrame, pos: str = "pos") -> DataFrame:
    """(doc_id, id, problem): children not numbered 1, 2, 3 ... within their parent, or before it."""
    parts = F.split("id", r"\.")
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")
    rows = headings.select("doc_id", "id", F.col(pos).alias("pos"), parent.alias("parent"), F.element_at(parts, -1).cast("int").alias("number"))
    w = Window.partitionBy("doc_id", "parent").orderBy("pos")
    gap = rows.withColumn("before", F.coalesce(F.lag("number").over(w), F.lit(0))).where("number <> before + 1").select("doc_id", "id", F.lit("number").alias("problem"))
    first = rows.groupBy("doc_id", F.col("id").alias("parent")).agg(F.min("pos").alias("at"))
    orphan = rows.where("parent <> ''").join(first, ["doc_id", "parent"], "left").where("at is null or at > pos").select("doc_id", "id", F.lit("parent").alias("problem"))
    return gap.unionByName(orphan)


def leaked_running_text(records: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, id, pattern): records whose text, digits as ``#``, is a running line of their document."""
    p = patterns.select("doc_id", "pattern").distinct()
    return records.select("doc_id", "id", without_digits(F.col("text")).alias("pattern")).join(p, ["doc_id", "pattern"], "left_semi").select("doc_id", "id", "pattern")


def unexpected_patterns(patterns: DataFrame, allowed: DataFrame) -> DataFrame:
    return patterns.select("pattern").subtract(allowed.select("pattern"))


def table_cells(tables: DataFrame) -> DataFrame:
    """(doc_id, table_id, row_key, column, value): tables (header, rows) in long form, keyed by the first column."""
    rows = tables.select("doc_id", "table_id", "header", F.posexplode("rows").alias("row_no", "row"))
    return rows.select("doc_id", "table_id", F.get("row", F.lit(0)).alias("row_key"), F.posexplode(F.arrays_zip(F.col("header").alias("h"), F.col("row").alias("v"))).alias("n", "c")).where("n > 0").select("doc_id", "table_id", "row_key", F.col("c.h").alias("column"), F.col("c.v").alias("value"))


def ragged_rows(tables: DataFrame) -> DataFrame:
    return tables.select("doc_id", "table_id", F.size("header").alias("n_columns"), F.posexplode("rows").alias("row_no", "row")).where(F.size("row") != F.col("n_columns")).select("doc_id", "table_id", "row_no", "n_columns", F.size("row").alias("n_cells"))


def cell_mismatches(cells: DataFrame, expected: DataFrame) -> DataFrame:
    """Expectations (doc_id, table_id, row_key, column, expected) that no cell meets."""
    joined = expected.join(cells, ["doc_id", "table_id", "row_key", "column"], "left")
    return joined.where(~F.col("value").eqNullSafe(F.col("expected")))


def character_counts(df: DataFrame, key: str = "doc_id", text: str = "text", step: int = 1 << 20) -> DataFrame:
    """(key, ch, n): a row for each key and distinct character of a batch, ``step`` characters being counted at a time.

    Rows of a key are partial counts, to be summed; no row is wider than a character, whatever the texts' lengths.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).drop_null()
            keys = b.column(0).filter(b.column(1).is_valid()).dictionary_encode(null_encoding="encode")
            codes = keys.indices.to_numpy().astype(np.int64)
            whole = "".join(texts.to_pylist())
            ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
            for at in range(0, len(whole), step):
                points = np.frombuffer(whole[at : at + step].encode("utf-32-le"), np.uint32)
                owner = codes[np.searchsorted(ends, np.arange(at, at + len(points)), "right")]
                found, n = np.unique(owner << 21 | points, return_counts=True)
                chars = pa.array([chr(c) for c in (found & ((1 << 21) - 1)).tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([keys.dictionary.take(pa.array(found >> 21)), chars, pa.array(n.astype(np.int64))], names=[key, "ch", "n"])

    schema = T.StructType([df.schema[key], T.StructField("ch", T.StringType()), T.StructField("n", T.LongType())])
    return df.select(key, text).mapInArrow(count, schema)


def character_differences(left: DataFrame, right: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ch, n_left, n_right): where the two sides' letters and digits do not balance. Characters of rows without key are a key's, null."""
    zero = F.lit(0).cast("long")
    sides = character_counts(left, key, text).select(key, "ch", F.col("n").alias("n_left"), zero.alias("n_right"))
    sides = sides.unionByName(character_counts(right, key, text).select(key, "ch", zero.alias("n_left"), F.col("n").alias("n_right")))
    both = sides.groupBy(key, "ch").agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return both.where((F.col("n_left") != F.col("n_right")) & F.col("ch").rlike(r"[\p{L}\p{N}]"))


def glossary_faults(records: DataFrame, section: str) -> DataFrame:
    """(doc_id, n_entries, n_elsewhere, n_repeated): documents whose glossary entries lie outside ``section`` or repeat a term.

    An entry without term is none of the repeated ones. Compare ``n_entries`` with the expected count by ``set_differences``.
    """
    entries = records.where("type = 'glossary_entry'").groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.count_if(~F.col("section_id").eqNullSafe(F.lit(section))).alias("out"))
    extra = F.when(F.col("term").isNotNull(), F.col("n") - 1).otherwise(0)
    per = entries.groupBy("doc_id").agg(F.sum("n").alias("n_entries"), F.sum("out").alias("n_elsewhere"), F.sum(extra).alias("n_repeated"))
    return per.where("n_elsewhere > 0 or n_repeated > 0")


def kind_counts(lines: DataFrame, records: DataFrame, line_is_bullet: Column) -> DataFrame:
    """(doc_id, n_bullets, n_items) where a document's bullet lines and list items differ."""
    b = lines.groupBy("doc_id").agg(F.count_if(line_is_bullet).alias("n_bullets"))
    r = records.groupBy("doc_id").agg(F.count_if(F.col("type") == "list_item").alias("n_items"))
    return b.join(r, "doc_id", "full_outer").na.fill(0).where("n_bullets <> n_items")


def set_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of one side only, with ``side``."""
    cols = expected.columns
    return found.select(cols).distinct().exceptAll(expected.distinct()).withColumn("side", F.lit("unexpected")).unionByName(expected.distinct().exceptAll(found.select(cols).distinct()).withColumn("side", F.lit("missing")))


def paragraph_warnings(records: DataFrame) -> DataFrame:
    """(doc_id, id, warning): paragraphs that start in lower case or end as if cut off."""
    w = F.when(F.substring("text", 1, 1).rlike(r"^\p{Ll}"), "starts lower-case").when(F.col("text").rlike(r"(,|\b(and|or|the|of))$"), "ends open")
    return records.where("type = 'paragraph'").withColumn("warning", w).where("warning is not null").select("doc_id", "id", "warning")


def excluded_words(records: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """(word, n_records) for each excluded word, by one pass that tests all of them (the list is small and given)."""
    hit = F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))
    found = records.select(F.explode(hit).alias("word")).groupBy("word").agg(F.count("*").alias("n_records"))
    every = records.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return every.join(found, "word", "left").na.fill(0, ["n_records"])


def question_pages(questions: DataFrame, headings: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, doc_id, section_id, heading_page, first_page, last_page): where each question's sections lie in its document; null pages: the section is missing."""
    same = ["doc_id", "section_id"]
    asked = questions.select("query_id", "doc_id", F.explode("sections").alias("section_id"))
    at = headings.groupBy("doc_id", F.col("id").alias("section_id")).agg(F.min("page").alias("heading_page"))
    span = records.where("section_id is not null").select("doc_id", F.explode(ancestors(F.col("section_id"))).alias("section_id"), "page_start", "page_end").groupBy(*same).agg(F.min("page_start").alias("first_page"), F.max("page_end").alias("last_page"))
    return asked.join(at, same, "left").join(span, same, "left").select("query_id", *same, "heading_page", "first_page", "last_page")


def unlisted_needles(needles: DataFrame, questions: DataFrame) -> DataFrame:
    """Needles in sections that their question does not list for the document."""
    return needles.join(questions.select("query_id", "doc_id", F.explode("sections").alias("section_id")), ["query_id", "doc_id", "section_id"], "left_anti")


def page_number_faults(lines: DataFrame, pattern: str = r"Page (\d+) of (\d+)") -> DataFrame:
    """(doc_id, page): pages but the first whose printed number or total is absent or wrong."""
    said = lines.groupBy("doc_id", "page").agg(F.max(F.when(F.col("text").rlike(pattern), F.struct(F.regexp_extract("text", pattern, 1).cast("int").alias("n"), F.regexp_extract("text", pattern, 2).cast("int").alias("total")))).alias("said"))
    total = said.groupBy("doc_id").agg(F.max("page").alias("pages"))
    bad = ~(F.coalesce(F.col("said.n") == F.col("page"), F.lit(False)) & F.coalesce(F.col("said.total") == F.col("pages"), F.lit(False)))
    return said.join(total, "doc_id").where((F.col("page") > 1) & bad).select("doc_id", "page")


def basic_faults(records: DataFrame) -> DataFrame:
    """(doc_id, id) of records with blank text, no section or a page range that is not one."""
    bad = (F.coalesce(F.trim("text"), F.lit("")) == "") | F.col("section_id").isNull() | F.coalesce(F.col("page_start") > F.col("page_end"), F.lit(True))
    return records.where(bad).select("doc_id", "id")


def summary(checks: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(check_name, status, n_bad) of named checks; ``severity`` FAIL or WARN is the status of a check with violations."""
    rows = [df.agg(F.count("*").alias("n_bad")).select(F.lit(name).alias("check_name"), F.when(F.col("n_bad") == 0, "PASS").otherwise(severity).alias("status"), "n_bad") for name, df, severity in checks]
    return reduce(DataFrame.unionByName, rows)


def verdict(checked: DataFrame) -> DataFrame:
    """One row: counts by status and the overall status."""
    n = {s: F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("PASS", "WARN", "FAIL")}
    return checked.agg(*n.values()).withColumn("overall", F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 0, "WARN").otherwise("PASS"))
