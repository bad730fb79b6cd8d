"""Queries on data quality (Q). Faults are put into copies of the derived tables, so that the jobs have something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ancestors
from ..operators import quality as qa
from . import bindings as b
from .document_queries import CELLS_SQL, HEADINGS_SQL, headings, page_tables
from .registry import query


def faulty_chunks(spark, sf_dir):
    """Chunks with every 17th lost, every 19th holding a record twice, every 23rd one unknown, every 29th in another section and of a wrong length."""
    n = F.col("chunk_no")
    ids = F.col("source_record_ids")
    c = b.chunks(spark, sf_dir).where(n % 17 != 0)
    ids = F.when(n % 19 == 0, F.concat(ids, F.slice(ids, 1, 1))).when(n % 23 == 0, F.concat(ids, F.array(F.lit("rec9999x")))).otherwise(ids)
    bad = n % 29 == 0
    return c.withColumns({"source_record_ids": ids, "section_id": F.when(bad, "9.9.9").otherwise(F.col("section_id")), "n_chars": F.when(bad, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


FAULTY_SQL = (
    b.CHUNKS_SQL
    + """,
faulty AS (SELECT doc_id, chunk_no, chunk_id, CASE WHEN chunk_no % 19 = 0 THEN list_concat(source_record_ids, source_record_ids[1:1]) WHEN chunk_no % 23 = 0 THEN list_concat(source_record_ids, ['rec9999x']) ELSE source_record_ids END AS ids,
  CASE WHEN chunk_no % 29 = 0 THEN '9.9.9' ELSE section_id END AS section_id, type, display_text, embed_text, CASE WHEN chunk_no % 29 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM chunks WHERE chunk_no % 17 <> 0),
used AS (SELECT doc_id, chunk_id, section_id, unnest(ids) AS record_id FROM faulty)"""
)


@query("q1_record_coverage", f"""WITH {FAULTY_SQL}
SELECT doc_id, id AS record_id, 'missing' AS problem FROM records r WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = r.doc_id AND u.record_id = r.id)
UNION ALL SELECT DISTINCT doc_id, record_id, 'unknown' FROM used u WHERE NOT EXISTS (SELECT 1 FROM records r WHERE u.doc_id = r.doc_id AND u.record_id = r.id)
UNION ALL SELECT doc_id, record_id, 'used twice' FROM used GROUP BY doc_id, record_id HAVING count(*) > 1""")
def q1(spark, sf_dir):
    return qa.record_coverage(b.records(spark, sf_dir), faulty_chunks(spark, sf_dir))


@query("q2_duplicate_keys", f"WITH {b.RECORDS_SQL} SELECT text, count(*) AS n FROM records GROUP BY text HAVING count(*) > 1")
def q2(spark, sf_dir):
    return qa.duplicate_keys(b.records(spark, sf_dir), ["text"])


@query("q3_field_faults", f"WITH {FAULTY_SQL} SELECT doc_id, chunk_id, ['n_chars'] AS faults FROM faulty WHERE n_chars <> length(display_text)")
def q3(spark, sf_dir):
    return qa.field_faults(faulty_chunks(spark, sf_dir), ["chunk_id", "source_record_ids", "page_start", "section_id", "type"], ["display_text", "embed_text", "section_title"])


@query("q4_section_mismatches", f"WITH {FAULTY_SQL} SELECT u.doc_id, u.chunk_id, u.record_id AS id, u.section_id, r.section_id AS record_section FROM used u JOIN records r ON r.doc_id = u.doc_id AND r.id = u.record_id WHERE u.section_id <> r.section_id")
def q4(spark, sf_dir):
    return qa.section_mismatches(b.records(spark, sf_dir), faulty_chunks(spark, sf_dir)).select("doc_id", "chunk_id", "id", "section_id", "record_section")


@query("q5_prefix_faults", f"WITH {FAULTY_SQL} SELECT doc_id, chunk_id, list_filter([CASE WHEN NOT contains(string_split(embed_text, chr(10))[1], section_id) THEN 'section_id' END, CASE WHEN chunk_no % 7 = 0 AND chunk_no % 14 <> 0 THEN 'tag' END], lambda x: x IS NOT NULL) AS faults FROM faulty WHERE NOT contains(string_split(embed_text, chr(10))[1], section_id) OR (chunk_no % 7 = 0 AND chunk_no % 14 <> 0)")
def q5(spark, sf_dir):
    """Every seventh chunk is a callout, every other of them without its tag; the paths hold no section ids, so nearly all lack theirs."""
    n = F.col("chunk_no")
    c = faulty_chunks(spark, sf_dir).withColumns({"type": F.when(n % 7 == 0, "callout").otherwise(F.col("type")), "callout_kind": F.when(n % 7 == 0, "exception"), "embed_text": F.when(n % 14 == 0, F.concat(F.lit("[EXCEPTION] "), F.col("embed_text"))).otherwise(F.col("embed_text"))})
    return qa.prefix_faults(c)


NEEDLE_SQL = b.CHUNKS_SQL + r""",
needles AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 ELSE doc_id END AS doc_id, regexp_extract(section_id, '^\d+\.\d+') AS section_id, translate(display_text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || CASE WHEN doc_id % 4 = 0 THEN ' zz' ELSE '' END AS needle FROM chunks WHERE chunk_no = 1)"""


def needles(spark, sf_dir):
    """The first chunk of every document, in capitals, is to be found in its source's sections of the document; every fourth has been changed, every fifth is asked of the next document, which has the same sections or none."""
    d = F.col("doc_id")
    c = b.chunks(spark, sf_dir).where("chunk_no = 1")
    return c.select(d.alias("query_id"), F.when(d % 5 == 0, d + 1).otherwise(d).alias("doc_id"), F.regexp_extract("section_id", r"^\d+\.\d+", 0).alias("section_id"), F.concat(F.translate("display_text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.when(F.col("doc_id") % 4 == 0, " zz").otherwise("")).alias("needle"))


@query("q6_needles", f"WITH {NEEDLE_SQL}, whole AS (SELECT n.query_id, string_agg(c.display_text, ' ' ORDER BY c.chunk_no) AS t, any_value(n.needle) AS needle FROM needles n LEFT JOIN chunks c ON c.doc_id = n.doc_id AND starts_with(c.section_id, n.section_id || '.') GROUP BY n.query_id) SELECT query_id, coalesce(contains(lower(t), lower(needle)), false) AS found FROM whole")
def q6(spark, sf_dir):
    return qa.needles_found(needles(spark, sf_dir), b.chunks(spark, sf_dir)).select("query_id", "found")


TOC_SQL = HEADINGS_SQL + """,
toc AS (SELECT doc_id, id, CASE WHEN pos % 5 = 1 THEN title || 'x' ELSE title END AS title, CASE WHEN pos % 7 = 2 THEN page + 1 ELSE page END AS page, level FROM headings WHERE pos % 3 <> 1
  UNION ALL SELECT doc_id, id || '.9', title, page, level + 1 FROM headings WHERE pos % 11 = 5)"""


@query("q7_contents_differences", f"""WITH {TOC_SQL} SELECT coalesce(t.doc_id, h.doc_id) AS doc_id, coalesce(t.id, h.id) AS id,
 CASE WHEN h.id IS NULL THEN 'missing' WHEN t.id IS NULL THEN 'extra' WHEN t.title <> h.title THEN 'title' WHEN t.page <> h.page THEN 'page' END AS problem FROM toc t FULL JOIN headings h ON t.doc_id = h.doc_id AND t.id = h.id WHERE h.id IS NULL OR t.id IS NULL OR t.title <> h.title OR t.page <> h.page""")
def q7(spark, sf_dir):
    h = headings(spark, sf_dir)
    p = F.col("pos")
    toc = h.where(p % 3 != 1).select("doc_id", "id", F.when(p % 5 == 1, F.concat("title", F.lit("x"))).otherwise(F.col("title")).alias("title"), F.when(p % 7 == 2, F.col("page") + 1).otherwise(F.col("page")).alias("page"), "level")
    toc = toc.unionByName(h.where(p % 11 == 5).select("doc_id", F.concat("id", F.lit(".9")).alias("id"), "title", "page", (F.col("level") + 1).alias("level")))
    return qa.contents_differences(toc, h.select("doc_id", "id", "title", "page", "level"))


@query("q8_numbering_faults", rf"""WITH {HEADINGS_SQL}, h AS (SELECT doc_id, id, pos, CASE WHEN contains(id, '.') THEN regexp_extract(id, '^(.*)\.', 1) ELSE '' END AS parent, CAST(regexp_extract(id, '(\d+)$', 1) AS INTEGER) AS number FROM headings WHERE pos % 24 <> 8)
SELECT doc_id, id, 'number' AS problem FROM (SELECT *, coalesce(lag(number) OVER (PARTITION BY doc_id, parent ORDER BY pos), 0) AS before FROM h) WHERE number <> before + 1
UNION ALL SELECT doc_id, id, 'parent' FROM h WHERE parent <> '' AND NOT EXISTS (SELECT 1 FROM h p WHERE p.doc_id = h.doc_id AND p.id = h.parent AND p.pos <= h.pos)""")
def q8(spark, sf_dir):
    return qa.numbering_faults(headings(spark, sf_dir).where("pos % 24 <> 8"))


def running(spark, sf_dir):
    """Line patterns that at least three documents hold."""
    p = F.regexp_replace("raw", r"\d+", "#")
    lines = b.lines(spark, sf_dir).where(r"raw rlike '\\S'").select("doc_id", p.alias("pattern")).distinct()
    return lines.groupBy("pattern").agg(F.count("*").alias("n_docs")).where("n_docs >= 3")


RUNNING_SQL = b.RECORDS_SQL + r""",
running AS (SELECT pattern, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, regexp_replace(raw, '\d+', '#', 'g') AS pattern FROM lines WHERE regexp_matches(raw, '\S')) GROUP BY pattern HAVING count(*) >= 3)"""


@query("q9_leaked_running_text", f"WITH {RUNNING_SQL} SELECT doc_id, id, regexp_replace(text, '\\d+', '#', 'g') AS pattern FROM records WHERE regexp_replace(text, '\\d+', '#', 'g') IN (SELECT pattern FROM running)")
def q9(spark, sf_dir):
    docs = b.records(spark, sf_dir)
    patterns = docs.select("doc_id", F.regexp_replace("text", r"\d+", "#").alias("pattern")).join(running(spark, sf_dir), "pattern", "left_semi")
    return qa.leaked_running_text(docs, patterns)


@query("q9_unexpected_patterns", f"WITH {RUNNING_SQL} SELECT pattern FROM running WHERE n_docs < 5")
def q9_patterns(spark, sf_dir):
    r = running(spark, sf_dir)
    return qa.unexpected_patterns(r, r.where("n_docs >= 5"))


def cell_tables(spark, sf_dir):
    t = page_tables(spark, sf_dir)
    return t.select("doc_id", F.concat(F.lit("Table "), F.col("page").cast("string")).alias("table_id"), F.col("rows")[0].alias("header"), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))).alias("rows"))


CELL_SQL = CELLS_SQL + """,
ct AS (SELECT doc_id, 'Table ' || page AS table_id, rows[1] AS header, rows[2:] AS body FROM tabs),
cr AS (SELECT doc_id, table_id, header, unnest(body) AS row FROM ct),
cc AS (SELECT doc_id, table_id, row[1] AS row_key, unnest(range(2, greatest(len(header), len(row)) + 1)) AS i, header, row FROM cr)"""


@query("q10_table_cells", f"WITH {CELL_SQL} SELECT doc_id, table_id, row_key, header[i] AS \"column\", row[i] AS value FROM cc")
def q10(spark, sf_dir):
    return qa.table_cells(cell_tables(spark, sf_dir))


@query("q10_ragged_rows", f"WITH {CELL_SQL} SELECT doc_id, table_id, len(header) AS n_columns, len(row) AS n_cells FROM cr WHERE len(header) <> len(row)")
def q10_ragged(spark, sf_dir):
    return qa.ragged_rows(cell_tables(spark, sf_dir)).drop("row_no")


@query("q10_cell_mismatches", f"WITH {CELL_SQL}, e AS (SELECT doc_id, table_id, row_key, header[i] AS \"column\", CASE WHEN length(row_key) % 3 = 0 THEN row[i] || '?' ELSE row[i] END AS expected, row[i] AS value FROM cc WHERE header[i] IS NOT NULL AND row[i] IS NOT NULL), u AS (SELECT * FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, table_id, row_key, \"column\") = 1) SELECT doc_id, table_id, row_key, \"column\", expected, value FROM u WHERE expected <> value")
def q10_mismatches(spark, sf_dir):
    """Unambiguous cells are expected as they are, those of some rows with a mark that no cell has."""
    from pyspark.sql import Window

    cells = qa.table_cells(cell_tables(spark, sf_dir)).where("column is not null and value is not null")
    one = cells.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "table_id", "row_key", "column"))).where("n = 1").drop("n")
    expected = one.select("doc_id", "table_id", "row_key", "column", F.when(F.length("row_key") % 3 == 0, F.concat("value", F.lit("?"))).otherwise(F.col("value")).alias("expected"))
    return qa.cell_mismatches(one, expected)


@query("q11_text_conservation", rf"""WITH {b.RECORDS_SQL},
a AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(raw, '[^\p{{L}}\p{{N}}]', '', 'g'), '')) AS ch FROM lines) WHERE ch <> '' GROUP BY 1, 2),
z AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g'), '')) AS ch FROM records WHERE pos % 10 <> 9) WHERE ch <> '' GROUP BY 1, 2)
SELECT coalesce(a.doc_id, z.doc_id) AS doc_id, coalesce(a.ch, z.ch) AS ch, coalesce(a.n, 0) AS n_left, coalesce(z.n, 0) AS n_right FROM a FULL JOIN z ON a.doc_id = z.doc_id AND a.ch = z.ch WHERE coalesce(a.n, 0) <> coalesce(z.n, 0)""")
def q11(spark, sf_dir):
    """Body text against records of which every tenth line is lost."""
    lines = b.lines(spark, sf_dir).select("doc_id", F.col("raw").alias("text"))
    return qa.character_differences(lines, b.records(spark, sf_dir).where("pos % 10 <> 9"))


@query("q12_kind_counts", f"WITH {b.RECORDS_SQL}, l AS (SELECT doc_id, count(*) FILTER (WHERE contains(raw, ' | ')) AS n_bullets FROM lines GROUP BY doc_id), r AS (SELECT doc_id, count(*) FILTER (WHERE type = 'list_item' AND pos % 2 = 0) AS n_items FROM records GROUP BY doc_id) SELECT doc_id, n_bullets, coalesce(n_items, 0) AS n_items FROM l LEFT JOIN r USING (doc_id) WHERE n_bullets <> coalesce(n_items, 0)")
def q12(spark, sf_dir):
    """Ruled lines against list items, every other of which is taken for a paragraph."""
    r = b.records(spark, sf_dir).withColumn("type", F.when(F.col("pos") % 2 == 0, F.col("type")).otherwise("paragraph"))
    return qa.kind_counts(b.lines(spark, sf_dir), r, F.contains("raw", F.lit(" | ")))


@query("q12_section_sets", f"WITH {b.RECORDS_SQL}, f AS (SELECT DISTINCT section_id FROM records WHERE type = 'list_item'), e AS (SELECT DISTINCT section_id FROM records WHERE doc_id % 2 = 0) SELECT section_id, 'unexpected' AS side FROM f WHERE section_id NOT IN (SELECT section_id FROM e) UNION ALL SELECT section_id, 'missing' FROM e WHERE section_id NOT IN (SELECT section_id FROM f)")
def q12_sets(spark, sf_dir):
    r = b.records(spark, sf_dir)
    return qa.set_differences(r.where("type = 'list_item'").select("section_id"), r.where("doc_id % 2 = 0").select("section_id"))


@query("q12_glossary", f"WITH {b.RECORDS_SQL}, g AS (SELECT doc_id, section_id, lower(split_part(text, ' ', 1)) AS term FROM records WHERE type = 'paragraph'), c AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_entries, CAST(count(*) FILTER (WHERE section_id IS DISTINCT FROM '1') AS BIGINT) AS n_elsewhere, CAST(count(*) - count(DISTINCT term) AS BIGINT) AS n_repeated FROM g GROUP BY doc_id) SELECT * FROM c WHERE n_elsewhere > 0 OR n_repeated > 0")
def q12_glossary(spark, sf_dir):
    """Paragraphs taken for entries of a glossary in section 1, the first word being the term."""
    r = b.records(spark, sf_dir).where("type = 'paragraph'").select("doc_id", "section_id", F.lit("glossary_entry").alias("type"), F.lower(F.split_part("text", F.lit(" "), F.lit(1))).alias("term"))
    return qa.glossary_faults(r, "1")


@query("q13_paragraph_warnings", rf"WITH {b.RECORDS_SQL} SELECT doc_id, id, CASE WHEN regexp_matches(text, '^\p{{Ll}}') THEN 'starts lower-case' ELSE 'ends open' END AS warning FROM records WHERE type = 'paragraph' AND (regexp_matches(text, '^\p{{Ll}}') OR regexp_matches(text, '(,|\b(and|or|the|of))$'))")
def q13(spark, sf_dir):
    return qa.paragraph_warnings(b.records(spark, sf_dir))


WORDS = ("idiot", "licence", "license", "copyright", "parking")


@query("q14_excluded_words", f"WITH {b.RECORDS_SQL} SELECT word, (SELECT count(*) FROM records WHERE contains(lower(text), word)) AS n_records FROM (SELECT unnest({list(WORDS)}) AS word)")
def q14(spark, sf_dir):
    return qa.excluded_words(b.records(spark, sf_dir), list(WORDS))


def section_questions(spark, sf_dir):
    """Every document asks for its first page's section and for its source's, which has no heading."""
    r = b.records(spark, sf_dir).groupBy("doc_id").agg(F.min("section_id").alias("s"))
    return r.select(F.col("doc_id").alias("query_id"), "doc_id", F.array(F.col("s"), F.regexp_extract("s", r"^\d+\.\d+", 0), F.lit("0.0")).alias("sections"))


@query("q15_question_pages", f"""WITH {b.RECORDS_SQL}, q AS (SELECT doc_id AS query_id, doc_id, min(section_id) AS s FROM records GROUP BY doc_id), a AS (SELECT query_id, doc_id, unnest([s, regexp_extract(s, '^\\d+\\.\\d+'), '0.0']) AS section_id FROM q),
h AS (SELECT doc_id, section_id, min(page_start) AS heading_page FROM records GROUP BY doc_id, section_id),
sp AS (SELECT doc_id, x AS section_id, min(page_start) AS first_page, max(page_end) AS last_page FROM (SELECT doc_id, page_start, page_end, unnest([split_part(section_id, '.', 1), regexp_extract(section_id, '^\\d+\\.\\d+'), section_id]) AS x FROM records) GROUP BY doc_id, x)
SELECT query_id, doc_id, section_id, heading_page, first_page, last_page FROM a LEFT JOIN h USING (doc_id, section_id) LEFT JOIN sp USING (doc_id, section_id)""")
def q15(spark, sf_dir):
    r = b.records(spark, sf_dir)
    heads = r.select("doc_id", F.col("section_id").alias("id"), F.col("page_start").alias("page"))
    return qa.question_pages(section_questions(spark, sf_dir), heads, r)


@query("q15_unlisted_needles", f"WITH {NEEDLE_SQL} SELECT query_id, section_id FROM needles WHERE query_id % 100 <> 0")
def q15_unlisted(spark, sf_dir):
    n = needles(spark, sf_dir)
    listed = n.select("query_id", "doc_id", F.when(F.col("query_id") % 100 == 0, ancestors(F.col("section_id"))).otherwise(F.array().cast("array<string>")).alias("sections"))
    return qa.unlisted_needles(n, listed).select("query_id", "section_id")


@query("q16_page_numbers", f"WITH {b.LINES_SQL}, p AS (SELECT doc_id, page, max(page) OVER (PARTITION BY doc_id) AS pages FROM lines GROUP BY doc_id, page) SELECT doc_id, page FROM p WHERE page > 1 AND (page % 4 = 0 OR pages % 3 = 0)")
def q16(spark, sf_dir):
    """Each page's first line prints its number; every fourth page's is wrong, and the totals of some documents are."""
    from pyspark.sql import Window

    total = F.max("page").over(Window.partitionBy("doc_id"))
    lines = b.lines(spark, sf_dir).withColumn("total", total)
    shown = F.format_string("Page %d of %d", F.when(F.col("page") % 4 == 0, F.col("page") + 1).otherwise(F.col("page")), F.when(F.col("total") % 3 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return qa.page_number_faults(lines.withColumn("text", F.when(F.col("line_no") % 40 == 0, shown).otherwise("")))


CHECKS_SQL = f"""WITH {FAULTY_SQL},
c AS (SELECT 'field_faults' AS check_name, 'FAIL' AS bad, (SELECT count(*) FROM faulty WHERE n_chars <> length(display_text)) AS n_bad
  UNION ALL SELECT 'paragraph_warnings', 'WARN', (SELECT count(*) FROM records WHERE type = 'paragraph' AND (regexp_matches(text, '^\\p{{Ll}}') OR regexp_matches(text, '(,|\\b(and|or|the|of))$')))
  UNION ALL SELECT 'basic', 'FAIL', 0),
checks AS (SELECT check_name, CASE WHEN n_bad = 0 THEN 'PASS' ELSE bad END AS status, n_bad FROM c)"""


def checks(spark, sf_dir):
    records = b.records(spark, sf_dir)
    fields = qa.field_faults(faulty_chunks(spark, sf_dir), ["chunk_id"], ["display_text"])
    return qa.summary([("field_faults", fields, "FAIL"), ("paragraph_warnings", qa.paragraph_warnings(records), "WARN"), ("basic", qa.basic_faults(records), "FAIL")])


@query("q17_check_summary", CHECKS_SQL + " SELECT check_name, status, n_bad FROM checks")
def q17(spark, sf_dir):
    return checks(spark, sf_dir)


@query("q17_verdict", CHECKS_SQL + " SELECT count(*) FILTER (WHERE status = 'PASS') AS n_pass, count(*) FILTER (WHERE status = 'WARN') AS n_warn, count(*) FILTER (WHERE status = 'FAIL') AS n_fail, CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE status = 'WARN') > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM checks")
def q17_verdict(spark, sf_dir):
    return qa.verdict(checks(spark, sf_dir))


@query("q18_basic_faults", f"WITH {b.RECORDS_SQL} SELECT doc_id, id FROM records WHERE pos % 31 = 3 OR pos % 37 = 4")
def q18(spark, sf_dir):
    """Some records have lost their text, some their section."""
    p = F.col("pos")
    r = b.records(spark, sf_dir).withColumns({"text": F.when(p % 31 == 3, " ").otherwise(F.col("text")), "section_id": F.when(p % 37 != 4, F.col("section_id"))})
    return qa.basic_faults(r)
