"""Retrieval, citation and refusal metrics. Rates are rounded half to even where they are reported rounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sections_match

REFUSAL_PHRASES = ("not found", "does not contain", "no information")
#: Fixed quality gates: metric, least value.
GATES = (("hit_at_5", 0.90), ("section_recall", 0.85), ("grounding_rate", 0.999), ("refusal_precision", 0.80), ("refusal_recall", 0.80), ("refusal_f1", 0.80), ("factual", 0.80))

#: Fixed counts of questions that a full evaluation has.
COUNTS = (("total_questions", 36), ("answerable_count", 30), ("unanswerable_count", 6))


def _keys(truth: DataFrame, retrieved: DataFrame) -> list[str]:
    return ["query_id", *(["doc_id"] if "doc_id" in truth.columns and "doc_id" in retrieved.columns else [])]


def section_recall(truth: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, hit, recall): truth sections (``sections`` array) matched, as a subtree in either direction, by a retrieved section; recall 1 without truth. With ``doc_id`` on both sides, only sections of the question's document match."""
    same = _keys(truth, retrieved)
    wanted = truth.select(*same, F.explode_outer("sections").alias("t"))
    seen = retrieved.select(*same, F.col("section_id").alias("c")).distinct()
    pairs = wanted.join(seen, same, "left").groupBy("query_id", "t").agg(F.coalesce(F.bool_or(sections_match(F.col("t"), F.col("c"))), F.lit(False)).alias("ok"))
    n = F.count("t")
    return pairs.groupBy("query_id").agg((F.count_if("ok") > 0).cast("double").alias("hit"), F.when(n == 0, 1.0).otherwise(F.count_if("ok") / n).alias("recall"))


def first_ranks(truth: DataFrame, retrieved: DataFrame, rank: str = "final_rank") -> DataFrame:
    """Truth rows with ``first_rank``: the best rank of an exactly equal section (of the question's document, with ``doc_id`` on both sides), null if none."""
    same = _keys(truth, retrieved)
    wanted = truth.select(*same, F.explode("sections").alias("section_id")).distinct()
    best = wanted.join(retrieved.select(*same, "section_id", rank), [*same, "section_id"]).groupBy("query_id").agg(F.min(rank).alias("first_rank"))
    return truth.join(best, "query_id", "left")


def rank_metrics(ranks: DataFrame, by: str | None = "type") -> DataFrame:
    """Hit@1, 3, 5 and mean reciprocal rank, by type and overall (ALL)."""
    r = F.col("first_rank")
    aggs = [F.count("*").alias("n"), *[F.avg(F.coalesce(r <= k, F.lit(False)).cast("double")).alias(f"hit_at_{k}") for k in (1, 3, 5)], F.avg(F.coalesce(1 / r, F.lit(0.0))).alias("mrr")]
    if by is None:
        return ranks.agg(*aggs)
    out = ranks.rollup(by).agg(*aggs, F.grouping(by).alias("_all"))
    return out.withColumn(by, F.when(F.col("_all") == 1, "ALL").otherwise(F.col(by))).drop("_all")


def citation_checks(citations: DataFrame, retrieved: DataFrame, truth: DataFrame) -> DataFrame:
    """Citations with ``grounded`` (the chunk was retrieved), ``veracious`` (the quote or a longer part of it is in the chunk) and ``section_ok``."""
    text = F.lower(F.concat_ws(" ", F.coalesce("embed_text", F.lit("")), F.coalesce("display_text", F.lit(""))))
    chunks = retrieved.select("query_id", "chunk_id", text.alias("_text")).dropDuplicates(["query_id", "chunk_id"])
    q = F.lower(F.trim("quote"))
    part = F.exists(F.filter(F.split(q, r"\. "), lambda p: F.length(p) > 10), lambda p: F.contains(F.col("_text"), p))
    joined = citations.join(chunks, ["query_id", "chunk_id"], "left").join(truth.select("query_id", "sections"), "query_id", "left")
    ok = F.exists("sections", lambda s: sections_match(s, F.coalesce("section_id", F.lit(""))))
    return joined.withColumns({"grounded": F.col("_text").isNotNull(), "veracious": F.coalesce((q != "") & (F.contains(F.col("_text"), q) | part), F.lit(False)), "section_ok": F.coalesce(ok, F.lit(False))}).drop("_text", "sections")


def citation_rates(queries: DataFrame, checked: DataFrame) -> DataFrame:
    """(query_id, n_citations, grounding_rate, veracity_rate, section_match_rate); without citations 1, 1 and 0."""
    per = checked.groupBy("query_id").agg(F.count("*").alias("n_citations"), *[F.avg(F.col(c).cast("double")).alias(r) for c, r in (("grounded", "grounding_rate"), ("veracious", "veracity_rate"), ("section_ok", "section_match_rate"))])
    out = queries.select("query_id").join(per, "query_id", "left")
    return out.select("query_id", F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("grounding_rate", F.lit(1.0)).alias("grounding_rate"), F.coalesce("veracity_rate", F.lit(1.0)).alias("veracity_rate"), F.coalesce("section_match_rate", F.lit(0.0)).alias("section_match_rate"))


def pooled_rates(rates: DataFrame) -> DataFrame:
    """Rates over all citations: the per-question rates, rounded to 3 places, weighted by their citations."""
    n = F.sum("n_citations")
    return rates.agg(n.alias("n_citations"), *[F.when(n == 0, empty).otherwise(F.sum(F.bround(r, 3) * F.col("n_citations")) / n).alias(r) for r, empty in (("grounding_rate", 1.0), ("veracity_rate", 1.0), ("section_match_rate", 0.0))])


def normal_score(raw: Column, refusal: Column) -> Column:
    return F.when(refusal, 0.0).when(raw >= 0.8, 1.0).when(raw >= 0.3, 0.5).otherwise(0.0)


def normal_verdict(verdict: Column, refusal: Column) -> Column:
    return F.when(refusal, "INCORRECT").otherwise(F.coalesce(verdict, F.lit("INCORRECT")))


def effective_refusal(refusal: Column, answer: Column) -> Column:
    """The flag, or an answer that says it has nothing. Meant for unanswerable questions only."""
    text = F.lower(F.coalesce(answer, F.lit("")))
    said = F.lit(False)
    for p in REFUSAL_PHRASES:
        said = said | F.contains(text, F.lit(p))
    return F.coalesce(refusal, F.lit(False)) | said


def refusal_matrix(rows: DataFrame) -> DataFrame:
    """tp, fn (unanswerable, by effective refusal), fp, tn (answerable, by the flag), precision, recall (1 if empty), f1 (0 if empty)."""
    out = rows.agg(
        F.count_if(~F.col("answerable") & F.col("effective_refusal")).alias("tp"), F.count_if(~F.col("answerable") & ~F.col("effective_refusal")).alias("fn"),
        F.count_if(F.col("answerable") & F.col("refusal")).alias("fp"), F.count_if(F.col("answerable") & ~F.col("refusal")).alias("tn"),
    )
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    out = out.withColumns({"refusal_precision": p, "refusal_recall": r})
    return out.withColumn("refusal_f1", F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)))


def overall_means(rows: DataFrame) -> DataFrame:
    """hit_at_5, section_recall and factual over the answerable questions, 4 places."""
    a = F.col("answerable")
    return rows.agg(*[F.bround(F.avg(F.when(a, F.col(c))), 4).alias(n) for c, n in (("hit", "hit_at_5"), ("recall", "section_recall"), ("factual", "factual"))])


def verdicts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def verdict_shares(rows: DataFrame) -> DataFrame:
    """``correct_share`` counts CORRECT alone, as the report does; ``exact_or_correct_share`` both."""
    n = F.count("*")
    return rows.agg((F.count_if(F.col("verdict") == "CORRECT") / n).alias("correct_share"), (F.count_if(F.col("verdict").isin("CORRECT", "EXACT_MATCH")) / n).alias("exact_or_correct_share"))


def breakdown(rows: DataFrame, unanswerable: str = "not in document") -> DataFrame:
    """By question type: hit, recall, factual for the answerable ones; refusal rate for the others; 3 places, null where not applicable."""
    other = F.col("type") == unanswerable
    return rows.groupBy("type").agg(F.count("*").alias("n"), *[F.bround(F.avg(F.when(~other, F.col(c))), 3).alias(n) for c, n in (("hit", "hit_at_5"), ("recall", "section_recall"), ("factual", "factual"))], F.bround(F.avg(F.when(other, F.col("effective_refusal").cast("double"))), 3).alias("refusal_rate"))


def gates(metrics: DataFrame, thresholds=GATES) -> DataFrame:
    """(metric, value, least, passed) for one row of metrics; a missing value fails."""
    names = [m for m, _ in thresholds if m in metrics.columns]
    long = metrics.select(*[F.col(m).cast("double").alias(m) for m in names]).unpivot([], names, "metric", "value")
    least = metrics.sparkSession.createDataFrame(list(thresholds), "metric string, least double")
    return least.join(long, "metric", "left").select("metric", "value", "least", F.coalesce(F.col("value") >= F.col("least"), F.lit(False)).alias("passed"))


def question_counts(rows: DataFrame) -> DataFrame:
    """One row: total_questions, answerable_count, unanswerable_count. A row whose ``answerable`` is null counts in the total alone."""
    return rows.agg(F.count("*").alias("total_questions"), F.count_if("answerable").alias("answerable_count"), F.count_if(~F.col("answerable")).alias("unanswerable_count"))


def count_gates(rows: DataFrame, expected=COUNTS) -> DataFrame:
    """(metric, value, expected, passed): whether the evaluation has exactly the questions it should have."""
    long = question_counts(rows).unpivot([], [m for m, _ in expected], "metric", "value")
    want = rows.sparkSession.createDataFrame(list(expected), "metric string, expected long")
    return want.join(long, "metric").select("metric", "value", "expected", (F.col("value") == F.col("expected")).alias("passed"))


def missing_categories(rows: DataFrame, expected: DataFrame) -> DataFrame:
    return expected.select("type").distinct().join(rows.select("type").distinct(), "type", "left_anti")
