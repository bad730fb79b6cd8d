"""What the pipeline's tables are in terms of the driver's tables, in Spark and, beside it, in SQL.

The driver's tables hold no layout, sections or questions; these definitions stand in for them. Every one is
computed from whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..operators import layout
from ..operators.chunks import build_chunks
from ..operators.patterns import texts_with
from ..operators.retrieval import Bm25Index, bm25_index, open_index, sparse_search
from ..operators.vectors import embed_texts
from ..sources.tables import shared_dir

WORDS_SQL = r"'[\p{L}\p{N}_]+'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lang_no():
    return F.when(F.col("lang") == "de", "1").when(F.col("lang") == "en", "2").when(F.col("lang") == "es", "3").when(F.col("lang") == "fr", "4").otherwise("9")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text line is a line; 40 lines a page, 21 apart. Every eighth line is a numbered heading; x steps by 4 in threes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    on_page = F.col("line_no") % 40
    page = (F.floor(F.col("line_no") / 40) + 1).cast("int")
    top, second = on_page == 0, (on_page % 8 == 0) & (on_page > 0)
    number = F.when(top, page.cast("string")).when(second, F.concat(page.cast("string"), F.lit("."), (on_page / 8).cast("int").cast("string")))
    return docs.select(
        "doc_id", "lang", "source", "line_no", page.alias("page"), F.concat_ws(" ", number, "raw").alias("text"), F.col("raw"), (on_page * 21).cast("double").alias("y0"), (on_page * 21 + 12).cast("double").alias("y1"),
        (72 + 4 * (F.col("line_no") % 3)).cast("double").alias("x0"), F.when(top, 18.0).when(second, 14.0).otherwise(11.0).alias("size"), (top | second).alias("bold"), F.lit(False).alias("italic"), F.lit("").alias("lead"),
    )


LINES_SQL = r"""
raw_lines AS (SELECT doc_id, lang, source, n - 1 AS line_no, raw FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)),
lines AS (SELECT *, line_no // 40 + 1 AS page, 21.0 * (line_no % 40) AS y0, line_no % 40 = 0 AS top, line_no % 40 > 0 AND line_no % 8 = 0 AS second,
  CASE WHEN line_no % 40 = 0 THEN (line_no // 40 + 1) || ' ' || raw WHEN line_no % 8 = 0 THEN (line_no // 40 + 1) || '.' || ((line_no % 40) // 8) || ' ' || raw ELSE raw END AS text,
  CASE WHEN line_no % 40 = 0 THEN CAST(line_no // 40 + 1 AS VARCHAR) WHEN line_no % 8 = 0 THEN (line_no // 40 + 1) || '.' || ((line_no % 40) // 8) END AS number FROM raw_lines)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with text is a record: a list item if it has a cell rule, else a paragraph. Its section is language.source.page."""
    page = (F.floor(F.col("line_no") / 40) + 1).cast("int")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))
    rows = docs.select("doc_id", F.col("line_no").cast("long").alias("pos"), page.alias("page_start"), page.alias("page_end"), F.concat_ws(".", lang_no(), F.regexp_extract("source", r"\d+", 0), page.cast("string")).alias("section_id"), F.concat(F.lit("page "), page.cast("string")).alias("section_title"), F.array("lang", "source", F.concat(F.lit("page "), page.cast("string"))).alias("section_path"), F.when(F.contains("raw", F.lit(" | ")), "list_item").otherwise("paragraph").alias("type"), norm(F.col("raw")).alias("text"))
    return layout.numbered(rows.where("text <> ''"))


RECORDS_SQL = (
    LINES_SQL
    + r""",
records AS (SELECT *, 'rec' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR), CAST(greatest(4, length(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR))) AS INTEGER), '0') AS id, length(text) AS n_chars FROM (
  SELECT doc_id, line_no AS pos, page AS page_start, page AS page_end, CASE lang WHEN 'de' THEN '1' WHEN 'en' THEN '2' WHEN 'es' THEN '3' WHEN 'fr' THEN '4' ELSE '9' END || '.' || regexp_extract(source, '\d+') || '.' || page AS section_id,
    'page ' || page AS section_title, [lang, source, 'page ' || page] AS section_path, CASE WHEN contains(raw, ' | ') THEN 'list_item' ELSE 'paragraph' END AS type, trim(regexp_replace(raw, '[\s\x{A0}]+', ' ', 'g')) AS text FROM lines) WHERE text <> '')"""
)

CHUNKS_SQL = (
    RECORDS_SQL
    + r""",
marked AS (SELECT *, CASE WHEN type = 'list_item' AND lag(type) OVER w = 'list_item' AND lag(section_id) OVER w = section_id THEN 0 ELSE 1 END AS fresh FROM records WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS chunk_no FROM marked),
chunks AS (SELECT doc_id, CAST(chunk_no AS BIGINT) AS chunk_no, 'chk' || lpad(CAST(chunk_no AS VARCHAR), CAST(greatest(4, length(CAST(chunk_no AS VARCHAR))) AS INTEGER), '0') AS chunk_id, list(id ORDER BY pos) AS source_record_ids, min(page_start) AS page_start, max(page_end) AS page_end,
  arg_min(section_id, pos) AS section_id, arg_min(section_title, pos) AS section_title, arg_min(type, pos) AS type, string_agg(text, ' ' ORDER BY pos) AS display_text,
  '[' || array_to_string(arg_min(section_path, pos), ' > ') || ']' || chr(10) || string_agg(text, ' ' ORDER BY pos) AS embed_text, length(string_agg(text, ' ' ORDER BY pos)) AS n_chars FROM grouped GROUP BY doc_id, chunk_no)"""
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_chunks(records(spark, sf_dir))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: chunk_id the document, section language.source.document."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat_ws(".", lang_no(), F.regexp_extract("source", r"\d+", 0), F.col("doc_id").cast("string")).alias("section_id"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("section_title"), F.lit(1).alias("page_start"), (F.floor(F.col("n_chars") / 2000) + 1).cast("int").alias("page_end"), F.col("text").alias("display_text"), F.col("text").alias("embed_text"))


_STORED: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make) -> str:
    """The path of something built once in a session and read from shared storage from then on."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _STORED:
        path = shared_dir(spark)
        make(path)
        _STORED[key] = path
    return _STORED[key]


def index(spark: SparkSession, sf_dir: str) -> Bm25Index:
    """The documents' BM25 index."""
    return open_index(spark, _once(spark, sf_dir, "index", lambda path: bm25_index(corpus(spark, sf_dir), path=path)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' vectors by the bundled embedder: chunk_id, embedding."""
    made = embed_texts(corpus(spark, sf_dir).select("chunk_id", "embed_text")).select("chunk_id", "embedding")
    return spark.read.parquet(_once(spark, sf_dir, "vectors", lambda path: made.write.parquet(path)))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions; their truth is the sections of the documents that contain them word for word."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = corpus(spark, sf_dir).select("section_id", "embed_text")
    found = texts_with(docs, items, "embed_text", "query_id", "question")
    truth = found.groupBy("query_id").agg(F.sort_array(F.collect_set("section_id")).alias("sections"))
    out = items.join(truth, "query_id", "left").withColumn("answerable", F.col("sections").isNotNull())
    kind = F.when(~F.col("answerable"), "not in document").when(F.length("question") % 2 == 0, "simple fact").otherwise("multi-section")
    return out.select("query_id", kind.alias("type"), "question", F.coalesce("sections", F.array().cast("array<string>")).alias("sections"), "answerable")


SECTION_SQL = r"CASE lang WHEN 'de' THEN '1' WHEN 'en' THEN '2' WHEN 'es' THEN '3' WHEN 'fr' THEN '4' ELSE '9' END || '.' || regexp_extract(source, '\d+') || '.' || doc_id"

QUESTIONS_SQL = f"""
docs AS (SELECT doc_id AS chunk_id, {SECTION_SQL} AS section_id, 'document ' || doc_id AS section_title, 1 AS page_start, n_chars // 2000 + 1 AS page_end, text FROM documents),
truth AS (SELECT item_id AS query_id, section_id, chunk_id FROM benchmark b JOIN docs d ON contains(d.text, b.text)),
questions AS (SELECT item_id AS query_id, text AS question, item_id IN (SELECT query_id FROM truth) AS answerable,
  CASE WHEN item_id NOT IN (SELECT query_id FROM truth) THEN 'not in document' WHEN length(text) % 2 = 0 THEN 'simple fact' ELSE 'multi-section' END AS type FROM benchmark)"""

def bm25_sql(asked: str) -> str:
    """Best 20 documents by BM25 (``sparse``) for the rows (query_id, text) of a table."""
    return f"""
words AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(coalesce(text, '')), {WORDS_SQL}) AS w FROM documents),
post AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(w) AS term FROM words) GROUP BY chunk_id, term),
lens AS (SELECT chunk_id, len(w) AS dl FROM words),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
rawidf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs CROSS JOIN tot),
meanidf AS (SELECT avg(r) AS m FROM rawidf),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * m ELSE r END AS idf FROM rawidf CROSS JOIN meanidf),
asked AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(coalesce(text, '')), {WORDS_SQL})) AS term FROM {asked}) GROUP BY query_id, term),
bm AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM asked JOIN idf USING (term) JOIN post USING (term) JOIN lens USING (chunk_id) CROSS JOIN tot GROUP BY query_id, chunk_id),
sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 20)"""


ITEMS_SQL = "(SELECT item_id AS query_id, text FROM benchmark)"
BM25_SQL = bm25_sql(ITEMS_SQL)


def embedding_sql(name: str, rows: str) -> str:
    """The bundled embedder's vectors: table ``name`` (id, e) for the rows (id, text) of a table."""
    return f"""
{name}_words AS (SELECT id, md5(w) AS h FROM (SELECT id, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\S+')) AS w FROM {rows})),
{name}_cells AS (SELECT id, CAST('0x' || h[7:8] AS INTEGER) % 64 AS cell, CAST(sum(CASE WHEN CAST('0x' || h[9:10] AS INTEGER) >= 128 THEN 1 ELSE -1 END) AS INTEGER) AS c FROM {name}_words GROUP BY ALL),
{name}_maps AS (SELECT id, map(list(cell), list(c)) AS m, sqrt(sum(c * c)) AS length FROM {name}_cells GROUP BY id),
{name} AS (SELECT r.id, list_transform(range(64), lambda i: CAST(CAST(CASE WHEN length > 0 THEN coalesce(m[CAST(i AS INTEGER)], 0) / length ELSE 0 END AS FLOAT) AS DOUBLE)) AS e FROM {rows} r LEFT JOIN {name}_maps USING (id))"""


def retrieved(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    """The best k documents by BM25 of each question, with their chunk columns."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    docs = corpus(spark, sf_dir)
    top = sparse_search(index(spark, sf_dir), q, k).withColumnRenamed("rank", "final_rank")
    return top.join(docs, "chunk_id")


RETRIEVED_SQL = QUESTIONS_SQL + "," + BM25_SQL + ",\nretrieved AS (SELECT s.query_id, s.rank AS final_rank, d.* FROM sparse s JOIN docs d USING (chunk_id) WHERE s.rank <= 5)"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three citations a question, of its best documents' first lines, and one of a document by the item's number that may not be retrieved."""
    got = retrieved(spark, sf_dir)
    first = F.substring_index("display_text", "\n", 1)
    real = got.where("final_rank <= 3").select("query_id", "chunk_id", "section_id", F.lit(1).alias("page"), first.alias("quote"))
    docs = corpus(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    other = items.join(docs, items["query_id"] == docs["chunk_id"]).select("query_id", "chunk_id", "section_id", F.lit(1).alias("page"), F.lit("no such line in here").alias("quote"))
    return real.unionByName(other)


CITATIONS_SQL = (
    RETRIEVED_SQL
    + """,
citations AS (SELECT query_id, chunk_id, section_id, 1 AS page, string_split(text, chr(10))[1] AS quote FROM retrieved WHERE final_rank <= 3
  UNION ALL SELECT item_id, chunk_id, section_id, 1, 'no such line in here' FROM benchmark JOIN docs ON item_id = chunk_id)"""
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that follow a user turn, as answers; flags, verdicts and scores are read off the answer's length."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    n = F.length("answer")
    rows = c.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer", n.alias("n"))
    answerable = F.col("conv_id") % 6 != 0
    kind = F.when(~answerable, "not in document").when(F.col("conv_id") % 5 == 0, "simple fact").when(F.col("conv_id") % 5 == 1, "table lookup").when(F.col("conv_id") % 5 == 2, "multi-section").when(F.col("conv_id") % 5 == 3, "exception").otherwise("amendment")
    verdict = F.when(F.col("n") % 4 == 0, "EXACT_MATCH").when(F.col("n") % 4 == 1, "CORRECT").when(F.col("n") % 4 == 2, "PARTIAL")
    return rows.select("conv_id", "turn", "question", "answer", answerable.alias("answerable"), kind.alias("type"), (F.col("n") % 7 == 0).alias("refusal"), ((F.col("n") % 11) / 10).alias("raw_score"), verdict.alias("raw_verdict"), (F.col("n") % 2).cast("double").alias("hit"), ((F.col("n") % 5) / 4).alias("recall"))


RESPONSES_SQL = """
turns AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations),
responses AS (SELECT conv_id, turn, text AS question, answer, conv_id % 6 <> 0 AS answerable,
  CASE WHEN conv_id % 6 = 0 THEN 'not in document' WHEN conv_id % 5 = 0 THEN 'simple fact' WHEN conv_id % 5 = 1 THEN 'table lookup' WHEN conv_id % 5 = 2 THEN 'multi-section' WHEN conv_id % 5 = 3 THEN 'exception' ELSE 'amendment' END AS type,
  length(answer) % 7 = 0 AS refusal, (length(answer) % 11) / 10.0 AS raw_score, CASE length(answer) % 4 WHEN 0 THEN 'EXACT_MATCH' WHEN 1 THEN 'CORRECT' WHEN 2 THEN 'PARTIAL' END AS raw_verdict,
  CAST(length(answer) % 2 AS DOUBLE) AS hit, (length(answer) % 5) / 4.0 AS recall FROM turns WHERE role = 'user' AND next_role = 'assistant'),
judged AS (SELECT *, CASE WHEN refusal THEN 0.0 WHEN raw_score >= 0.8 THEN 1.0 WHEN raw_score >= 0.3 THEN 0.5 ELSE 0.0 END AS factual, CASE WHEN refusal THEN 'INCORRECT' ELSE coalesce(raw_verdict, 'INCORRECT') END AS verdict,
  refusal OR contains(lower(answer), 'not found') OR contains(lower(answer), 'does not contain') OR contains(lower(answer), 'no information') AS effective_refusal FROM responses)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evaluation import effective_refusal, normal_score, normal_verdict

    r = F.col("refusal")
    return responses(spark, sf_dir).withColumns({"factual": normal_score(F.col("raw_score"), r), "verdict": normal_verdict(F.col("raw_verdict"), r), "effective_refusal": effective_refusal(r, F.col("answer"))})
