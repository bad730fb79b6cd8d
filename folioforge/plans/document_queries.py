"""Queries on sources (S), layout (I), chunks (C), answers (G) and streams (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_cell, heading_id, heading_title, norm, table_markdown
from ..operators import answers, chunks, layout
from ..operators.vectors import hashing_embedder
from ..sources import tables
from ..sources.store import KeyedStore
from ..streaming import jobs
from . import bindings as b
from .registry import query
from .retrieval_queries import FUSE_SQL, rerank_sql

SPACE = r"'[\s\x{A0}]+'"


# --- sources and sinks ----------------------------------------------------------------------------


@query("s1_json_lines", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def s1(spark, sf_dir):
    path = tables.shared_dir(spark)
    c = b.table(spark, sf_dir, "conversations")
    tables.write_table(c, path, "json")
    return tables.read_table(spark, path, c.schema, "json").select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("s1_bad_records", "SELECT conv_id % 10 = 0 AS cut_short, count(*) AS n, CAST(sum(CASE WHEN conv_id % 10 = 0 THEN 0 ELSE length(text) END) AS BIGINT) AS n_chars FROM conversations WHERE conv_id % 10 <> 3 GROUP BY ALL")
def s1_bad(spark, sf_dir):
    """Conversations written as lines, those of every tenth conversation cut short and another tenth with a word for a number: read apart."""
    path = tables.shared_dir(spark)
    c = b.table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(*c.columns))
    broken = F.when(F.col("conv_id") % 10 == 0, F.concat(F.lit('{"cut": 1, '), F.substring(line, 2, 12))).when(F.col("conv_id") % 10 == 3, F.regexp_replace(line, '"turn":', '"turn":"none", "x":')).otherwise(line)
    c.select(broken.alias("value")).write.text(path)
    sound = tables.read_sound(spark, path, c.schema).select(F.lit(False).alias("cut_short"), F.length("text").alias("n"))
    bad = tables.bad_records(spark, path, c.schema).where(F.startswith("record", F.lit('{"cut"'))).select(F.lit(True).alias("cut_short"), F.lit(0).alias("n"))
    return sound.unionByName(bad).groupBy("cut_short").agg(F.count("*").alias("rows"), F.sum("n").alias("n_chars")).withColumnRenamed("rows", "n")


@query("s2_answer_key", f"WITH {b.QUESTIONS_SQL} SELECT CAST(query_id AS VARCHAR) AS query_id, type, question, answerable FROM questions")
def s2(spark, sf_dir):
    """The questions written as nested answer keys, one for each question's hash bucket, and read back: two lists become one table.

    A key holds about a hundred questions, so no row grows with the table.
    """
    path = tables.shared_dir(spark)
    q = b.questions(spark, sf_dir)
    n = -(-q.count() // 100)
    item = F.struct(F.col("query_id").cast("string").alias("id"), "type", "question", "sections")
    key = q.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(max(1, n))).alias("key")).agg(F.collect_list(F.when(F.col("answerable"), item)).alias("questions"), F.collect_list(F.when(~F.col("answerable"), item)).alias("unanswerable_questions"))
    tables.write_table(key.drop("key"), path, "json")
    return tables.read_answer_key(spark, path, multi_line=False).select("query_id", "type", "question", "answerable")


@query("s3_write_chunks", f"WITH {b.CHUNKS_SQL} SELECT type, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM chunks GROUP BY type")
def s3(spark, sf_dir):
    path = tables.shared_dir(spark)
    tables.write_table(b.chunks(spark, sf_dir), path, partition_by=["type"])
    return tables.read_table(spark, path).groupBy("type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("s4_report", "SELECT count(*) AS n_documents, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents")
def s4(spark, sf_dir):
    path = tables.shared_dir(spark)
    tables.write_report(b.table(spark, sf_dir, "documents").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars")), path)
    return spark.read.schema("n_documents bigint, n_chars bigint").json(path)


@query("s5_upsert", "SELECT vec_id, CAST(CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS BIGINT) AS label, CAST(CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM embeddings")
def s5(spark, sf_dir):
    """A store is created anew with half of the points, the rest is resumed from all of them, and every third is upserted in a second version."""
    e = b.table(spark, sf_dir, "embeddings").select("vec_id", "label").withColumn("version", F.lit(1))
    points = KeyedStore(spark, tables.shared_dir(spark), e.schema, ["vec_id"])
    points.recreate(e.where("vec_id % 5 = 0").withColumn("version", F.lit(0)))
    points.recreate(e.where("vec_id % 2 = 0"))
    points.resume(e)
    points.upsert(e.where("vec_id % 3 = 0").withColumns({"label": F.col("label") + 100, "version": F.lit(2)}))
    return points.read()


@query("s6_payload_filter", f"WITH {b.CHUNKS_SQL} SELECT doc_id, chunk_id, n_chars FROM chunks WHERE type = 'list_item' AND section_id LIKE '%.1'")
def s6(spark, sf_dir):
    path = tables.shared_dir(spark)
    tables.write_table(b.chunks(spark, sf_dir), path, partition_by=["type"])
    return tables.by_payload(tables.read_table(spark, path), kind="list_item").where(F.endswith("section_id", F.lit(".1"))).select("doc_id", "chunk_id", "n_chars")


# --- lines to records -----------------------------------------------------------------------------


@query("i1_norm", f"WITH {b.LINES_SQL} SELECT doc_id, line_no, trim(regexp_replace(raw, {SPACE}, ' ', 'g')) AS text FROM lines")
def i1(spark, sf_dir):
    return b.lines(spark, sf_dir).select("doc_id", "line_no", norm(F.col("raw")).alias("text"))


@query("i2_line_from_spans", f"""WITH {b.LINES_SQL},
w AS (SELECT doc_id, line_no, raw, list_filter(string_split(raw, ' '), lambda x: x <> '') AS s FROM lines),
k AS (SELECT *, list_transform(s, lambda x: length(x) > 4) AS bold FROM w WHERE len(s) > 0),
p AS (SELECT *, coalesce(list_position(bold, false), 0) AS rest FROM k)
SELECT doc_id, line_no, trim(regexp_replace(raw, {SPACE}, ' ', 'g')) AS text, bold[1] AS bold, CASE WHEN rest > 1 THEN array_to_string(s[1:rest - 1], ' ') ELSE '' END AS lead FROM p""")
def i2(spark, sf_dir):
    """Words as spans, those over four characters in bold."""
    words = F.split("raw", " ")
    spans = F.transform(words, lambda x: F.struct(F.concat(x, F.lit(" ")).alias("text"), F.when(F.length(x) > 4, "Serif-Bold").otherwise("Serif").alias("font"), F.lit(11.0).alias("size")))
    lines = b.lines(spark, sf_dir).select("doc_id", "line_no", spans.alias("spans"))
    return layout.line_from_spans(lines).select("doc_id", "line_no", "text", "bold", "lead")


@query("i3_heading_level", f"WITH {b.LINES_SQL} SELECT doc_id, line_no, CAST(CASE WHEN top THEN 1 WHEN second THEN 2 ELSE 0 END AS BIGINT) AS level FROM lines")
def i3(spark, sf_dir):
    return b.lines(spark, sf_dir).select("doc_id", "line_no", layout.heading_level().alias("level"))


@query("i4_parse_heading", f"WITH {b.LINES_SQL} SELECT doc_id, line_no, regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 1) AS id, regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\s+(.+)$', 2) AS title FROM lines WHERE (top OR second) AND trim(raw) <> ''")
def i4(spark, sf_dir):
    h = b.lines(spark, sf_dir).where(layout.heading_level() > 0).where("trim(raw) <> ''")
    return h.select("doc_id", "line_no", heading_id(F.col("text")).alias("id"), heading_title(F.col("text")).alias("title"))


@query("i5_running_lines", f"WITH {b.LINES_SQL} SELECT doc_id, regexp_replace(text, '\\d+', '#', 'g') AS pattern, count(*) AS n_lines FROM lines WHERE NOT y0 BETWEEN 55 AND 775 GROUP BY 1, 2")
def i5(spark, sf_dir):
    return layout.running_lines(b.lines(spark, sf_dir))


HEADINGS_SQL = b.LINES_SQL + r""",
headings AS (SELECT doc_id, line_no AS pos, number AS id, CASE WHEN top THEN 1 ELSE 2 END AS level, page, regexp_extract(text, '^(\d+(?:\.\d+)*)\s+(.+)$', 2) AS title FROM lines WHERE (top OR second) AND regexp_matches(raw, '\S'))"""


def headings(spark, sf_dir):
    h = b.lines(spark, sf_dir).withColumn("level", layout.heading_level()).where(r"level > 0 and raw rlike '\\S'")
    return h.select("doc_id", F.col("line_no").alias("pos"), heading_id(F.col("text")).alias("id"), "level", "page", heading_title(F.col("text")).alias("title"))


def contents_lines(spark, sf_dir):
    """A printed contents on page 0 of each document: title and dot leader at one height, a heading each."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    h = headings(spark, sf_dir).withColumn("n", n)
    cols = lambda text, x, no: ["doc_id", F.lit(0).alias("page"), no.alias("line_no"), (F.col("n") * 14 + 60).cast("double").alias("y0"), F.lit(float(x)).alias("x0"), text.alias("text")]
    titles = h.select(*cols(F.concat_ws(" ", "id", "title"), 72, F.col("n") * 2))
    leaders = h.select(*cols(F.concat(F.when(F.col("n") % 2 == 0, "........ ").otherwise(". . . . "), F.col("page").cast("string")), 300, F.col("n") * 2 + 1))
    top = h.select("doc_id").distinct().select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("line_no"), F.lit(56.0).alias("y0"), F.lit(72.0).alias("x0"), F.lit("Table of Contents").alias("text"))
    return titles.unionByName(leaders).unionByName(top)


@query("i6_contents", f"WITH {HEADINGS_SQL} SELECT doc_id, id, title, page, len(string_split(id, '.')) AS level FROM headings")
def i6(spark, sf_dir):
    return layout.contents_entries(contents_lines(spark, sf_dir))


def unnumbered(spark, sf_dir):
    """Lines of which the headings at two places of each page have lost their number."""
    return b.lines(spark, sf_dir).withColumns({"level": layout.heading_level(), "text": F.when((F.col("line_no") % 40).isin(8, 24), F.col("raw")).otherwise(F.col("text"))})


@query("i6_body_start", f"WITH {HEADINGS_SQL} SELECT doc_id, CAST(1 AS BIGINT) AS body_start FROM headings GROUP BY doc_id")
def i6_body(spark, sf_dir):
    return layout.body_start(contents_lines(spark, sf_dir))


@query("i4_heading_warnings", f"WITH {b.LINES_SQL} SELECT doc_id, page, line_no, text FROM (SELECT * REPLACE (CASE WHEN line_no % 40 IN (8, 24) THEN raw ELSE text END AS text) FROM lines) WHERE (top OR second) AND NOT regexp_matches(text, '^\\d+(\\.\\d+)*\\s+.+$')")
def i4_warnings(spark, sf_dir):
    """Some headings have lost their number."""
    return layout.heading_warnings(unnumbered(spark, sf_dir))


CELLS_SQL = b.LINES_SQL + r""",
rows_ AS (SELECT doc_id, page, line_no, string_split(raw, ' | ') AS cells, y0 FROM lines WHERE contains(raw, ' | ')),
tabs AS (SELECT doc_id, page, min(y0) AS y0, max(y0) + 12 AS y1, min(line_no) AS first, list(cells ORDER BY line_no) AS rows FROM rows_ GROUP BY doc_id, page)"""


def page_tables(spark, sf_dir):
    """A page's cell-ruled lines are its table."""
    rows = b.lines(spark, sf_dir).where(F.contains("raw", F.lit(" | ")))
    parts = F.array_sort(F.collect_list(F.struct("line_no", F.split("raw", r" \| ").alias("cells"))))
    return rows.groupBy("doc_id", "page").agg(F.lit(1).alias("table_no"), F.lit(70.0).alias("x0"), F.min("y0").alias("y0"), F.lit(540.0).alias("x1"), F.max("y1").alias("y1"), F.transform(parts, lambda r: r["cells"]).alias("rows"))


@query("i7_clean_cells", f"WITH {CELLS_SQL} SELECT doc_id, line_no, list_transform(cells, lambda x: CASE trim(regexp_replace(x, {SPACE}, ' ', 'g')) WHEN 'the' THEN 'THE' ELSE trim(regexp_replace(x, {SPACE}, ' ', 'g')) END) AS cells FROM rows_")
def i7(spark, sf_dir):
    rows = b.lines(spark, sf_dir).where(F.contains("raw", F.lit(" | ")))
    return rows.select("doc_id", "line_no", F.transform(F.split("raw", r" \| "), lambda c: clean_cell(c, {"the": "THE"})).alias("cells"))


@query("i8_outside_tables", f"WITH {CELLS_SQL} SELECT l.doc_id, l.line_no FROM lines l WHERE NOT EXISTS (SELECT 1 FROM tabs t WHERE t.doc_id = l.doc_id AND t.page = l.page AND l.y0 + 6 BETWEEN t.y0 - 1 AND t.y1 + 1)")
def i8(spark, sf_dir):
    return layout.outside_tables(b.lines(spark, sf_dir), page_tables(spark, sf_dir)).select("doc_id", "line_no")


@query("i9_captions", f"WITH {CELLS_SQL} SELECT t.doc_id, t.page, (SELECT max(l.line_no) FROM lines l WHERE l.doc_id = t.doc_id AND l.page = t.page AND NOT contains(l.raw, ' | ') AND l.y0 + 12 <= t.y0 + 3 AND t.y0 - l.y0 - 12 <= 40) AS caption_line FROM tabs t")
def i9(spark, sf_dir):
    """Every line that is no table row may be a caption."""
    caps = b.lines(spark, sf_dir).where(~F.contains("raw", F.lit(" | "))).select("doc_id", "page", "line_no", "y1", F.col("raw").alias("text"))
    return layout.attach_captions(page_tables(spark, sf_dir), caps).select("doc_id", "page", "caption_line")


ATTACHED_SQL = CELLS_SQL + """,
cap AS (SELECT t.doc_id, t.page, t.rows, (SELECT max(l.line_no) FROM lines l WHERE l.doc_id = t.doc_id AND l.page = t.page AND NOT contains(l.raw, ' | ') AND l.y0 + 12 <= t.y0 + 3 AND t.y0 - l.y0 - 12 <= 40) AS caption_line FROM tabs t)"""


def attached(spark, sf_dir):
    """Every line that is no table row may be a caption; those of even pages are numbered as tables."""
    text = F.when(F.col("page") % 2 == 0, F.concat(F.lit("Table "), F.col("page").cast("string"), F.lit(". x"), F.col("raw"))).otherwise(F.col("raw"))
    caps = b.lines(spark, sf_dir).where(~F.contains("raw", F.lit(" | "))).select("doc_id", "page", "line_no", "y1", text.alias("text"))
    return caps, layout.attach_captions(page_tables(spark, sf_dir), caps)


@query("i9_uncaptioned_tables", f"WITH {ATTACHED_SQL} SELECT doc_id, page FROM cap WHERE caption_line IS NULL")
def i9_tables(spark, sf_dir):
    return layout.uncaptioned_tables(attached(spark, sf_dir)[1]).select("doc_id", "page")


@query("i9_unused_captions", f"WITH {ATTACHED_SQL} SELECT l.doc_id, l.page, l.line_no FROM lines l LEFT JOIN cap c ON c.doc_id = l.doc_id AND c.page = l.page AND c.caption_line = l.line_no WHERE NOT contains(l.raw, ' | ') AND c.doc_id IS NULL")
def i9_unused(spark, sf_dir):
    caps, tables_ = attached(spark, sf_dir)
    return layout.unused_captions(caps, tables_).select("doc_id", "page", "line_no")


@query("i10_table_records", f"WITH {ATTACHED_SQL} SELECT c.doc_id, c.page, CASE WHEN c.caption_line IS NOT NULL AND c.page % 2 = 0 THEN 'Table ' || c.page END AS table_id, coalesce(nullif(CASE WHEN c.page % 2 = 0 THEN 'Table ' || c.page || '. x' || l.raw ELSE l.raw END, ''), 'Table ?') AS caption, array_to_string(c.rows[1], '|') AS header, CAST(len(c.rows) - 1 AS BIGINT) AS n_rows FROM cap c LEFT JOIN lines l ON l.doc_id = c.doc_id AND l.line_no = c.caption_line")
def i10_records(spark, sf_dir):
    out = layout.table_records(attached(spark, sf_dir)[1])
    return out.select("doc_id", "page", "table_id", "caption", F.array_join("header", "|").alias("header"), F.size("rows").alias("n_rows"))


@query("i10_table_markdown", f"""WITH {CELLS_SQL}
SELECT doc_id, page, 'Table ' || page || chr(10) || '| ' || array_to_string(rows[1], ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(rows[1])) || CASE WHEN len(rows) > 1 THEN chr(10) || array_to_string(list_transform(rows[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) ELSE '' END AS text FROM tabs""")
def i10(spark, sf_dir):
    return page_tables(spark, sf_dir).select("doc_id", "page", table_markdown(F.concat(F.lit("Table "), F.col("page").cast("string")), F.col("rows")).alias("text"))


@query("i11_sections", f"""WITH {HEADINGS_SQL},
tagged AS (SELECT l.doc_id, l.line_no, last_value(CASE WHEN h.level = 1 THEN h.id || ' ' || h.title END IGNORE NULLS) OVER w AS one, last_value(CASE WHEN h.level = 1 THEN h.pos END IGNORE NULLS) OVER w AS at1,
  last_value(CASE WHEN h.level = 2 THEN h.id || ' ' || h.title END IGNORE NULLS) OVER w AS two, last_value(CASE WHEN h.level = 2 THEN h.pos END IGNORE NULLS) OVER w AS at2,
  last_value(CASE WHEN h.level = 1 THEN h.id END IGNORE NULLS) OVER w AS id1, last_value(CASE WHEN h.level = 2 THEN h.id END IGNORE NULLS) OVER w AS id2
  FROM lines l LEFT JOIN headings h ON h.doc_id = l.doc_id AND h.pos = l.line_no WINDOW w AS (PARTITION BY l.doc_id ORDER BY l.line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, line_no, CASE WHEN at2 IS NOT NULL AND (at1 IS NULL OR at2 > at1) THEN id2 ELSE id1 END AS section_id,
  list_filter([one, CASE WHEN at2 IS NOT NULL AND (at1 IS NULL OR at2 > at1) THEN two END], lambda x: x IS NOT NULL) AS section_path FROM tagged""")
def i11(spark, sf_dir):
    lines = b.lines(spark, sf_dir).withColumns({"pos": F.col("line_no"), "level": layout.heading_level(), "heading_id": heading_id(F.col("text")), "heading_title": heading_title(F.col("text"))})
    return layout.with_sections(lines).select("doc_id", "line_no", "section_id", "section_path")


@query("i12_element_kind", f"WITH {b.LINES_SQL} SELECT doc_id, line_no, CASE WHEN line_no % 11 = 0 THEN 'callout' WHEN line_no % 11 = 1 AND page = 1 THEN 'glossary_entry' ELSE 'paragraph' END AS type, CASE WHEN line_no % 22 = 0 THEN 'amendment' WHEN line_no % 11 = 0 THEN 'exception' END AS callout_kind FROM lines")
def i12(spark, sf_dir):
    n = F.col("line_no")
    lead = F.when(n % 22 == 0, "AMENDMENT 1.").when(n % 11 == 0, "Exception to 2.").when(n % 11 == 1, "Term.").otherwise("")
    lines = b.lines(spark, sf_dir).withColumns({"lead": lead, "section_id": F.concat(F.lit("1"), (F.col("page") + 4).cast("string"))}).withColumn("text", F.col("raw"))
    kind = layout.element_kind("15")
    return lines.select("doc_id", "line_no", kind.alias("type"), F.when(kind == "callout", layout.callout_kind()).alias("callout_kind"))


def elements(spark, sf_dir):
    lines = b.lines(spark, sf_dir).withColumns({"pos": F.col("line_no").cast("long"), "kind": F.when((layout.heading_level() > 0) & F.col("raw").rlike(r"\S"), "heading").otherwise("paragraph")})
    return layout.paragraphs(lines.where(r"raw rlike '\\S'"))


@query("i13_paragraphs", f"""WITH RECURSIVE {b.LINES_SQL},
seq AS (SELECT doc_id, page, line_no AS pos, top OR second AS heading, text, 72 + 4 * (line_no % 3) AS x, y0 AS y, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS n FROM lines WHERE regexp_matches(raw, '\\S')),
walk AS (SELECT doc_id, page, n, pos, heading, text, pos AS start, x, y, NOT heading AS page_top, NOT heading AS seen FROM seq WHERE n = 1
  UNION ALL SELECT doc_id, page, n, pos, heading, text, CASE WHEN goes_on THEN start ELSE pos END, CASE WHEN goes_on THEN anchor ELSE x END, y, CASE WHEN goes_on THEN page_top ELSE NOT heading AND NOT seen END, seen OR NOT heading
  FROM (SELECT s.*, w.start, w.x AS anchor, w.page_top, w.seen, NOT s.heading AND NOT w.heading AND s.y - w.y BETWEEN 0 AND 25 AND abs(s.x - w.x) <= 6 AS goes_on FROM walk w JOIN seq s ON s.doc_id = w.doc_id AND s.page = w.page AND s.n = w.n + 1))
SELECT doc_id, page, start AS pos, 'paragraph' AS kind, bool_or(page_top) AS page_top, length(trim(regexp_replace(string_agg(text, ' ' ORDER BY pos), {SPACE}, ' ', 'g'))) AS n_chars FROM walk WHERE NOT heading GROUP BY doc_id, page, start""")
def i13(spark, sf_dir):
    return elements(spark, sf_dir).select("doc_id", "page", "pos", "kind", "page_top", F.length("text").alias("n_chars"))


def split_records(spark, sf_dir):
    """Records whose later lines are cut to start in lower case on the page after."""
    r = b.records(spark, sf_dir).select("doc_id", "pos", F.col("pos").cast("int").alias("page_start"), F.col("pos").cast("int").alias("page_end"), F.lit("1").alias("section_id"), "type", F.col("text"))
    first_lower = F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))
    return r.withColumns({"text": F.regexp_replace(F.when(F.col("pos") % 3 > 0, first_lower).otherwise(F.col("text")), r"\.$", ""), "page_top": F.lit(True)})


SPLIT_SQL = b.RECORDS_SQL + r""",
split_ AS (SELECT doc_id, pos, type, regexp_replace(CASE WHEN pos % 3 > 0 THEN lower(text[1]) || text[2:] ELSE text END, '\.$', '') AS text FROM records),
joins AS (SELECT *, coalesce(type = 'paragraph' AND regexp_matches(text, '^\p{Ll}') AND lag(type) OVER w IN ('paragraph', 'list_item', 'callout') AND lag(pos) OVER w = pos - 1 AND NOT regexp_matches(lag(text) OVER w, '[.!?:;)]$'), false) AS joined FROM split_ WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""


@query("i14_stitch_pages", f"""WITH {SPLIT_SQL}, g AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM joins)
SELECT doc_id, min(pos) AS pos, max(pos) AS page_end, arg_min(type, pos) AS type, string_agg(text, ' ' ORDER BY pos) AS text FROM g GROUP BY doc_id, grp""")
def i14(spark, sf_dir):
    return layout.stitch_pages(split_records(spark, sf_dir)).select("doc_id", "pos", "page_end", "type", "text")


@query("i14_stitch_log", f"WITH {SPLIT_SQL} SELECT doc_id, pos, '1' AS section_id, pos AS page, text[1:40] AS joined_at FROM joins WHERE joined")
def i14_log(spark, sf_dir):
    return layout.stitch_log(split_records(spark, sf_dir))


@query("i15_number_records", f"WITH {b.RECORDS_SQL} SELECT doc_id, pos, id, n_chars FROM records")
def i15(spark, sf_dir):
    return b.records(spark, sf_dir).select("doc_id", "pos", "id", "n_chars")


@query("i16_parse_report", f"""WITH {SPLIT_SQL}
SELECT doc_id, 'records' AS part, type AS key, count(*) AS n FROM records GROUP BY doc_id, type
UNION ALL SELECT doc_id, 'headings', CASE WHEN top THEN '1' ELSE '2' END, count(*) FROM lines WHERE (top OR second) AND regexp_matches(raw, '\\S') GROUP BY doc_id, top
UNION ALL SELECT doc_id, 'removed', regexp_replace(text, '\\d+', '#', 'g'), count(*) FROM lines WHERE NOT y0 BETWEEN 55 AND 775 GROUP BY 1, 3
UNION ALL SELECT doc_id, 'joins', CAST(pos AS VARCHAR), count(*) FROM joins WHERE joined GROUP BY 1, 3
UNION ALL SELECT doc_id, 'warnings', CAST(page AS VARCHAR), count(*) FROM (SELECT * REPLACE (CASE WHEN line_no % 40 IN (8, 24) THEN raw ELSE text END AS text) FROM lines) WHERE (top OR second) AND NOT regexp_matches(text, '^\\d+(\\.\\d+)*\\s+.+$') GROUP BY doc_id, page""")
def i16(spark, sf_dir):
    return layout.parse_report(b.records(spark, sf_dir), headings(spark, sf_dir), layout.running_lines(b.lines(spark, sf_dir)), layout.stitch_log(split_records(spark, sf_dir)), layout.heading_warnings(unnumbered(spark, sf_dir)))


@query("i17_touching_page", f"WITH {b.RECORDS_SQL} SELECT doc_id, id FROM records WHERE 2 BETWEEN page_start AND page_end")
def i17(spark, sf_dir):
    return layout.touching_page(b.records(spark, sf_dir), 2).select("doc_id", "id")


# --- chunks ---------------------------------------------------------------------------------------


@query("c1_build_chunks", f"WITH {b.CHUNKS_SQL} SELECT doc_id, chunk_id, source_record_ids, page_start, page_end, section_id, type, n_chars FROM chunks")
def c1(spark, sf_dir):
    return b.chunks(spark, sf_dir).select("doc_id", "chunk_id", "source_record_ids", "page_start", "page_end", "section_id", "type", "n_chars")


@query("c2_chunk_text", f"WITH {b.CHUNKS_SQL} SELECT doc_id, chunk_id, display_text FROM chunks")
def c2(spark, sf_dir):
    return b.chunks(spark, sf_dir).select("doc_id", "chunk_id", "display_text")


@query("c3_embed_text", f"WITH {b.CHUNKS_SQL} SELECT doc_id, chunk_id, embed_text FROM chunks")
def c3(spark, sf_dir):
    return b.chunks(spark, sf_dir).select("doc_id", "chunk_id", "embed_text")


@query("c4_chunk_keys", f"WITH {b.CHUNKS_SQL} SELECT doc_id, chunk_id, chunk_no AS key FROM chunks")
def c4(spark, sf_dir):
    return b.chunks(spark, sf_dir).select("doc_id", "chunk_id", chunks.point_key(F.col("chunk_id")).alias("key"))


@query("c5_size_stats", f"WITH {b.CHUNKS_SQL} SELECT coalesce(type, 'TOTAL') AS type, count(*) AS n, min(n_chars) AS min_chars, max(n_chars) AS max_chars, round(avg(n_chars), 6) AS mean_chars, CAST(sum(len(source_record_ids)) AS BIGINT) AS n_records FROM chunks GROUP BY ROLLUP (type)")
def c5(spark, sf_dir):
    return chunks.size_stats(b.chunks(spark, sf_dir)).withColumn("mean_chars", F.round("mean_chars", 6))


# --- answers --------------------------------------------------------------------------------------

BLOCK_SQL = "'--- [CHUNK ' || chunk_id || ' | Section ' || CASE WHEN chunk_id % 7 = 0 THEN 'Unknown' ELSE section_id END || ': ' || section_title || ' | ' || CASE WHEN page_end = 1 THEN 'p. 1' ELSE 'pp. 1-' || page_end END || '] ---' || chr(10) || CASE WHEN chunk_id % 3 <> 0 THEN '[tag] ' ELSE '' END || text"
CONTEXT_SQL = f"WITH {b.RETRIEVED_SQL}, ctx AS (SELECT query_id, string_agg({BLOCK_SQL}, chr(10) || chr(10) ORDER BY final_rank) AS context FROM retrieved GROUP BY query_id)"


def contexts(spark, sf_dir):
    """Every third chunk has no embed text, every seventh no section."""
    n = F.col("chunk_id")
    r = b.retrieved(spark, sf_dir).withColumns({"embed_text": F.when(n % 3 != 0, F.concat(F.lit("[tag] "), "embed_text")), "section_id": F.when(n % 7 != 0, F.col("section_id"))})
    return answers.format_context(r.withColumn("chunk_id", n.cast("string")))


@query("g1_format_context", CONTEXT_SQL + " SELECT * FROM ctx")
def g1(spark, sf_dir):
    return contexts(spark, sf_dir)


@query("g2_prompts", CONTEXT_SQL + " SELECT item_id AS query_id, 'CONTEXT:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'QUESTION: ' || text AS prompt FROM benchmark LEFT JOIN ctx ON item_id = query_id")
def g2(spark, sf_dir):
    q = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return answers.prompts(q, contexts(spark, sf_dir)).select("query_id", "prompt")


def _short_only(prompt: str) -> str:
    if len(prompt) % 2:
        raise RuntimeError("the primary is busy")
    return '{"answer": "short"}'


@query("g3_complete", "SELECT conv_id * 1000 + turn AS query_id, CASE WHEN length(text) % 2 = 1 THEN 'fallback' ELSE 'primary' END AS model_used, CASE WHEN length(text) % 2 = 1 THEN '{}' ELSE '{\"answer\": \"short\"}' END AS response_json FROM conversations WHERE role = 'user'")
def g3(spark, sf_dir):
    """User turns as prompts for injected stand-ins, of which the primary fails on odd lengths."""
    p = b.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("prompt"))
    return answers.complete(p, _short_only, lambda _: "{}").drop("latency_sec")


@query("g4_parse_responses", f"WITH {b.RESPONSES_SQL} SELECT conv_id * 1000 + turn AS query_id, CASE WHEN turn % 4 = 0 THEN answer ELSE '' END AS answer, CAST(CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_citations, turn % 4 = 0 AND refusal AS refusal FROM responses")
def g4(spark, sf_dir):
    """Answers as JSON; those of other turns than every fourth are cut off and so malformed."""
    r = b.responses(spark, sf_dir).withColumn("query_id", F.col("conv_id") * 1000 + F.col("turn"))
    cites = F.array(F.struct(F.col("query_id").cast("string").alias("chunk_id"), F.lit("1").alias("section_id"), F.lit(1).alias("page"), F.lit("q").alias("quote")))
    text = F.to_json(F.struct("answer", cites.alias("citations"), "refusal"))
    r = r.select("query_id", F.when(F.col("turn") % 4 == 0, text).otherwise(F.concat(F.lit("{"), F.substring("answer", 1, 5))).alias("response_json"))
    return answers.parse_responses(r).select("query_id", "answer", F.size("citations").alias("n_citations"), "refusal")


@query("g5_enrich_citations", f"""WITH {b.CITATIONS_SQL} SELECT c.query_id, c.chunk_id, coalesce((SELECT arg_max(r.section_title, r.final_rank) FROM retrieved r WHERE r.query_id = c.query_id AND regexp_extract(r.section_id, '^\\d+\\.\\d+') = regexp_extract(c.section_id, '^\\d+\\.\\d+')), 'Section ' || regexp_extract(c.section_id, '^\\d+\\.\\d+')) AS section_title FROM citations c""")
def g5(spark, sf_dir):
    """Sections are language and source, so that a query retrieves several chunks of one."""
    section = F.regexp_extract("section_id", r"^\d+\.\d+", 0)
    return answers.enrich_citations(b.citations(spark, sf_dir).withColumn("section_id", section), b.retrieved(spark, sf_dir).withColumn("section_id", section)).select("query_id", "chunk_id", "section_title")


AMEND_SQL = b.RECORDS_SQL + ",\namend AS (SELECT doc_id, CAST(pos % 9 AS INTEGER) AS number, make_date(2026, CAST(pos % 12 AS INTEGER) + 1, 1) AS effective, section_id FROM records WHERE pos % 13 = 0)"


def amendment_records(spark, sf_dir):
    """Every thirteenth line's record is an amendment."""
    r = b.records(spark, sf_dir)
    month = F.date_format(F.make_date(F.lit(2026), (F.col("pos") % 12 + 1).cast("int"), F.lit(1)), "MMMM")
    lead = F.concat(F.lit("AMENDMENT "), (F.col("pos") % 9).cast("string"), F.lit(" (effective 1 "), month, F.lit(" 2026)."))
    hit = F.col("pos") % 13 == 0
    return r.withColumns({"callout_kind": F.when(hit, "amendment"), "lead_in": F.when(hit, lead)})


@query("g6_amendments", f"WITH {AMEND_SQL} SELECT doc_id, CAST(number AS BIGINT) AS number, strftime(effective, '%Y-%m-%d') AS effective, section_id FROM amend")
def g6(spark, sf_dir):
    return answers.amendments(amendment_records(spark, sf_dir)).withColumn("effective", F.date_format("effective", "yyyy-MM-dd"))


@query("g7_amended_citations", f"""WITH {AMEND_SQL}, c AS (SELECT doc_id AS query_id, section_id, CASE WHEN pos % 5 = 0 THEN 'see amendment ' || pos || ' here' ELSE text END AS quote FROM records)
SELECT query_id, bool_or(EXISTS (SELECT 1 FROM amend a WHERE a.doc_id = c.query_id AND (a.section_id = c.section_id OR a.number = CAST(nullif(regexp_extract(lower(quote), 'amendment (\\d+)', 1), '') AS INTEGER)))) AS amended FROM c GROUP BY query_id""")
def g7(spark, sf_dir):
    """Every record cites its section; every fifth line names an amendment by its line number."""
    r = b.records(spark, sf_dir)
    quote = F.when(F.col("pos") % 5 == 0, F.concat(F.lit("see amendment "), F.col("pos").cast("string"), F.lit(" here"))).otherwise(F.col("text"))
    return answers.amended_citations(r.select(F.col("doc_id").alias("query_id"), "doc_id", "section_id", quote.alias("quote")), answers.amendments(amendment_records(spark, sf_dir)))


# --- streams --------------------------------------------------------------------------------------


USERS_SQL = "(SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user' AND trim(coalesce(text, '')) <> '')"


@query("st1_answer_stream", f"""WITH {b.embedding_sql('vec', '(SELECT doc_id AS id, text FROM documents)')}, {b.embedding_sql('ask', f'(SELECT query_id AS id, text FROM {USERS_SQL})')}, {b.bm25_sql(USERS_SQL)},
near AS (SELECT a.id AS query_id, v.id AS chunk_id, CASE WHEN list_sum(list_transform(v.e, lambda x: abs(x))) * list_sum(list_transform(a.e, lambda x: abs(x))) > 0 THEN list_cosine_similarity(a.e, v.e) ELSE 0 END AS score FROM ask a CROSS JOIN vec v),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM near QUALIFY rank <= 20),
{FUSE_SQL}, cand AS (SELECT * FROM ranked WHERE rrf_rank <= 15), {rerank_sql(USERS_SQL)} SELECT query_id, chunk_id, final_rank, round(rerank_score, 6) AS score FROM final""")
def st1(spark, sf_dir):
    """User turns arrive as files and are retrieved for, micro-batch by micro-batch, against the documents; a second stream of half of them finds all answered."""
    base = tables.shared_dir(spark)
    q = b.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("question"))
    for name, rows in (("in", q), ("again", q.where("query_id % 2 = 0"))):
        tables.write_table(rows, f"{base}/{name}")
        stream = spark.readStream.schema(q.schema).parquet(f"{base}/{name}")
        jobs.answer_stream(stream, b.index(spark, sf_dir), b.corpus(spark, sf_dir), b.vectors(spark, sf_dir), hashing_embedder(), f"{base}/out", f"{base}/checkpoint-{name}").awaitTermination()
    kind = T.LongType()
    out = jobs.answers_store(spark, f"{base}/out", kind, kind).read().select("query_id", F.explode("chunks").alias("c"))
    return out.select("query_id", "c.chunk_id", "c.final_rank", F.round("c.score", 6).alias("score"))


@query("st2_index_stream", f"WITH {b.CHUNKS_SQL} SELECT doc_id, chunk_id, CAST(64 AS BIGINT) AS dim FROM chunks")
def st2(spark, sf_dir):
    """Chunks of even documents arrive in one stream, then those of odd ones, and every third again, in another; each is embedded and stored once."""
    base = tables.shared_dir(spark)
    c = b.chunks(spark, sf_dir).select("doc_id", "chunk_id", "embed_text")
    tables.write_table(c.where("doc_id % 2 = 0"), f"{base}/one")
    tables.write_table(c.where("doc_id % 2 = 1 or doc_id % 3 = 0"), f"{base}/two")
    for source in ("one", "two"):
        stream = spark.readStream.schema(c.schema).parquet(f"{base}/{source}")
        jobs.index_stream(stream, hashing_embedder(), f"{base}/store", f"{base}/checkpoint-{source}", ("doc_id", "chunk_id")).awaitTermination()
    return jobs.index_store(spark, f"{base}/store", c.schema, ("doc_id", "chunk_id")).read().select("doc_id", "chunk_id", F.size("embedding").alias("dim"))
