"""Queries on vectors and retrieval (E, R), and the flagship ranking quality (V3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..operators import evaluation, retrieval, vectors
from ..sources.ledger import CallLedger
from ..sources.tables import shared_dir
from . import bindings as b
from .registry import query

WORDS = b.WORDS_SQL


def _items(spark, sf_dir):
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _vectors(spark, sf_dir):
    return b.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _vector_queries(spark, sf_dir):
    """Every hundredth vector is a query, numbered from 0."""
    return b.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select((F.col("vec_id") / 100).cast("long").alias("query_id"), "embedding")


DENSE_SQL = """
vec AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cosine AS (SELECT q.vec_id // 100 AS query_id, v.vec_id AS chunk_id, list_cosine_similarity(q.e, v.e) AS score FROM vec q CROSS JOIN vec v WHERE q.vec_id % 100 = 0),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosine QUALIFY rank <= 20)"""

FUSE_SQL = """
fused AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.chunk_id, s.chunk_id) AS chunk_id, d.score AS dense_score, d.rank AS dense_rank, s.score AS sparse_score, s.rank AS sparse_rank,
  1 / (60 + coalesce(d.rank, 1000)) + 1 / (60 + coalesce(s.rank, 1000)) AS rrf_score FROM dense d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.chunk_id = s.chunk_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, chunk_id) AS rrf_rank FROM fused)"""

FUSED_SQL = DENSE_SQL + "," + b.BM25_SQL + "," + FUSE_SQL


def rerank_sql(asked: str) -> str:
    """The best 5 (``final``) of the candidates (``cand``) of the rows (query_id, text) of a table."""
    return f"""
qw AS (SELECT query_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), {WORDS})) AS q FROM {asked}),
scored AS (SELECT c.*, len(list_intersect(q, list_distinct(w))) / len(q) AS rerank_score FROM cand c JOIN qw USING (query_id) JOIN words USING (chunk_id)),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, chunk_id) AS final_rank FROM scored QUALIFY final_rank <= 5)"""


RERANK_SQL = rerank_sql(b.ITEMS_SQL)


E1_SQL = f"""WITH {b.embedding_sql('vec', '(SELECT doc_id AS id, text FROM documents)')}
SELECT id AS chunk_id, len(e) AS dim, CAST(list_sum(list_transform(e, lambda x, i: i * sign(x))) AS BIGINT) AS signs, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS length FROM vec"""


def told_vectors(out):
    signs = F.aggregate(F.transform("embedding", lambda x, i: (i + 1) * F.signum(x)), F.lit(0.0), lambda a, x: a + x).cast("long")
    return out.select("chunk_id", F.size("embedding").alias("dim"), signs.alias("signs"), F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), 4).alias("length"))


@query("e1_embed_texts", E1_SQL)
def e1(spark, sf_dir):
    """Every document embedded by the bundled hashing embedder (a model is injected in use); signs is the sum of places by their signs."""
    return told_vectors(vectors.embed_texts(b.corpus(spark, sf_dir).select("chunk_id", "embed_text")))


@query("e1_embed_once", E1_SQL)
def e1_once(spark, sf_dir):
    """The same through a ledger of calls: some documents are embedded first, then all, which asks for the others alone."""
    docs = b.corpus(spark, sf_dir).select("chunk_id", "embed_text")
    ledger = CallLedger(spark, shared_dir(spark), "array<float>", shards=32)
    embed = vectors.hashing_embedder()
    ledger.replies(docs.where("chunk_id % 3 = 0"), ["embed_text"], embed, "hashing")
    return told_vectors(ledger.replies(docs, ["embed_text"], embed, "hashing").withColumnRenamed("reply", "embedding"))


@query("e2_vector_check", "SELECT vec_id AS chunk_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS length FROM embeddings WHERE len(embedding) <> 64 OR sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) < 1.0")
def e2(spark, sf_dir):
    """Vectors of another dimension or shorter than one: float rounding leaves many just below."""
    return vectors.bad_vectors(_vectors(spark, sf_dir), 64, least=1.0).withColumn("length", F.round("length", 6))


@query("e3_payload_check", "WITH s AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 50 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 97 <> 0) SELECT d.doc_id, CASE WHEN s.doc_id IS NULL THEN ['<missing>'] ELSE ['n_chars'] END AS fields FROM documents d LEFT JOIN s USING (doc_id) WHERE s.doc_id IS NULL OR s.n_chars <> d.n_chars")
def e3(spark, sf_dir):
    """Stored rows against source rows, the store having lost some and changed others."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    stored = d.where("doc_id % 97 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 50 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return vectors.payload_mismatches(d, stored, "doc_id", ["lang", "source", "n_chars"])


@query("r1_tokenize", f"SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {WORDS}) AS w FROM documents)")
def r1(spark, sf_dir):
    d = b.table(spark, sf_dir, "documents").select("doc_id", tokenize(F.col("text")).alias("w"))
    return d.select("doc_id", F.size("w").alias("n_tokens"), F.size(F.array_distinct("w")).alias("n_distinct"))


DF_SQL = f"""
sets AS (SELECT list_distinct(regexp_extract_all(lower(coalesce(text, '')), {WORDS})) AS ws FROM documents),
dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest(ws) AS term FROM sets) GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM dfs)"""


@query("r2_bm25_statistics", f"WITH {DF_SQL} SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END, 6) AS idf FROM raw")
def r2(spark, sf_dir):
    return b.index(spark, sf_dir).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("r2_postings", f"""WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), {WORDS}) AS ws FROM documents)
SELECT id, term, CAST(count(*) AS BIGINT) AS tf, CAST(any_value(dl) AS BIGINT) AS dl FROM (SELECT id, len(ws) AS dl, unnest(ws) AS term FROM w) GROUP BY id, term""")
def r2_postings(spark, sf_dir):
    """The postings of all documents, as the searches read them."""
    return b.index(spark, sf_dir).postings.select("id", "term", "tf", "dl")


@query("r3_sparse_search", f"WITH {b.BM25_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM sparse")
def r3(spark, sf_dir):
    return retrieval.sparse_search(b.index(spark, sf_dir), _items(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("r4_dense_search", f"WITH {DENSE_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM dense")
def r4(spark, sf_dir):
    return retrieval.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _lists(spark, sf_dir):
    dense = retrieval.dense_search(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir))
    return dense, retrieval.sparse_search(b.index(spark, sf_dir), _items(spark, sf_dir))


@query("r5_fuse_ranks", f"WITH {FUSED_SQL} SELECT query_id, chunk_id, round(dense_score, 6) AS dense_score, dense_rank, round(sparse_score, 6) AS sparse_score, sparse_rank, round(rrf_score, 9) AS rrf_score, rrf_rank FROM ranked")
def r5(spark, sf_dir):
    """Vectors and documents of the same number are one chunk."""
    out = retrieval.fuse_ranks(*_lists(spark, sf_dir))
    return out.select("query_id", "chunk_id", F.round("dense_score", 6).alias("dense_score"), "dense_rank", F.round("sparse_score", 6).alias("sparse_score"), "sparse_rank", F.round("rrf_score", 9).alias("rrf_score"), "rrf_rank")


@query("r6_rerank", f"WITH {b.BM25_SQL}, cand AS (SELECT * FROM sparse WHERE rank <= 15), {RERANK_SQL} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, final_rank FROM final")
def r6(spark, sf_dir):
    docs, items = b.corpus(spark, sf_dir), _items(spark, sf_dir)
    out = retrieval.rerank(retrieval.sparse_search(b.index(spark, sf_dir), items, 15), items, docs)
    return out.select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "final_rank")


ITEM_VECTORS_SQL = b.embedding_sql("vec", "(SELECT doc_id AS id, text FROM documents)") + "," + b.embedding_sql("ask", "(SELECT item_id AS id, text FROM benchmark)")
NEAR_SQL = """
near AS (SELECT a.id AS query_id, v.id AS chunk_id, CASE WHEN list_sum(list_transform(v.e, lambda x: abs(x))) * list_sum(list_transform(a.e, lambda x: abs(x))) > 0 THEN list_cosine_similarity(a.e, v.e) ELSE 0 END AS score FROM ask a CROSS JOIN vec v),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM near QUALIFY rank <= 20)"""


@query("r7_retrieve", f"WITH {ITEM_VECTORS_SQL},{NEAR_SQL},{b.BM25_SQL},{FUSE_SQL}, cand AS (SELECT * FROM ranked WHERE rrf_rank <= 15), {RERANK_SQL} SELECT query_id, chunk_id, round(rerank_score, 6) AS score, rrf_rank, final_rank FROM final")
def r7(spark, sf_dir):
    """The whole hybrid search for every item: both lists, fusion, 15 reranked, 5 kept. Items and documents are embedded by the bundled embedder."""
    asked = vectors.embed_texts(_items(spark, sf_dir), "question")
    docs = b.corpus(spark, sf_dir)
    out = retrieval.retrieve(b.index(spark, sf_dir), docs, b.vectors(spark, sf_dir), asked)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rrf_rank", "final_rank")


@query("v3_rank_metrics", f"""WITH {b.RETRIEVED_SQL},
firsts AS (SELECT q.query_id, q.type, min(r.final_rank) AS f FROM questions q LEFT JOIN truth t USING (query_id) LEFT JOIN retrieved r ON r.query_id = q.query_id AND r.section_id = t.section_id WHERE q.answerable GROUP BY q.query_id, q.type)
SELECT coalesce(type, 'ALL') AS type, count(*) AS n, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN f <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr
FROM firsts GROUP BY ROLLUP (type)""")
def v3(spark, sf_dir):
    """Flagship: documents as corpus, benchmark items as questions, BM25 top 5, hit rates and MRR by type."""
    asked = b.questions(spark, sf_dir).where("answerable")
    out = evaluation.rank_metrics(evaluation.first_ranks(asked, b.retrieved(spark, sf_dir)))
    return out.select("type", "n", *[F.round(c, 6).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5", "mrr")])
