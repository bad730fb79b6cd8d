"""The report of an evaluation: one object of figures from one pass over the evaluated questions, and a row of details for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNANSWERABLE = "not in document"
#: What a row of an evaluation may lack, and what then holds.
OPTIONAL = {"n_citations": "0L", "grounding_rate": "1D", "veracity_rate": "1D", "section_match_rate": "0D", "latency_sec": "cast(null as double)", "model_used": "''"}


def _whole(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({c: F.expr(e) for c, e in OPTIONAL.items() if c not in rows.columns})
    empty = {c: F.coalesce(c, F.expr(OPTIONAL[c])) for c in ("n_citations", "grounding_rate", "veracity_rate", "section_match_rate", "model_used")}
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("answerable", "refusal", "effective_refusal")}
    return rows.withColumns({**empty, **flags, "type": F.coalesce("type", F.lit("")), "verdict": F.coalesce("verdict", F.lit("")), "recall": F.bround("recall", 3)})


def _share(part: Column, whole: Column, empty: float, places: int = 4) -> Column:
    return F.bround(F.when(whole == 0, F.lit(empty)).otherwise(part / whole), places)


def evaluation_report(rows: DataFrame, llm_model: str = "", judge_model: str = "", generated_at: str | None = None, unanswerable: str = UNANSWERABLE) -> DataFrame:
    """One row: ``metadata``, ``summary_metrics`` (retrieval, generation, citations, refusal) and ``category_breakdown`` by question type.

    rows: answerable, refusal, effective_refusal, type, hit, recall, factual, verdict and, where citations were made, n_citations,
    grounding_rate and veracity_rate. Null flags are false, null types and verdicts empty strings, null scores zeros. Means, verdicts and citation
    rates are the answerable questions'. Without rows means are 0, citation rates, precision and recall 1. Recall and the questions' citation
    rates count as they are reported, to 3 places. The table is read once, in grouping sets; what is gathered is a row for each type and verdict.
    """
    a = F.col("answerable")
    cited = F.col("n_citations")
    measures = {
        "n": F.count("*"), "n_ans": F.count_if(a),
        **{f"s_{c}": F.sum(F.when(a, F.coalesce(c, F.lit(0.0)))) for c in ("hit", "recall", "factual")},
        **{f"t_{c}": F.sum(F.coalesce(c, F.lit(0.0))) for c in ("hit", "recall", "factual")},
        "n_cited": F.sum(F.when(a, cited)), **{f"s_{c}": F.sum(F.when(a, F.bround(c, 3) * cited)) for c in ("grounding_rate", "veracity_rate")},
        "tp": F.count_if(~a & F.col("effective_refusal")), "fn": F.count_if(~a & ~F.col("effective_refusal")), "fp": F.count_if(a & F.col("refusal")), "tn": F.count_if(a & ~F.col("refusal")),
        "refused": F.count_if("effective_refusal"),
    }
    cells = _whole(rows).groupingSets([["type"], ["verdict"], []], "type", "verdict").agg(F.grouping_id().alias("g"), *[e.alias(m) for m, e in measures.items()])

    def of(m: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("g") == 3, F.col(m))), F.lit(0))

    n = F.col("n")
    apart = F.col("type") == unanswerable
    kinds = [F.when(~apart, _share(F.col(f"t_{c}"), n, 0.0, 3)).alias(name) for c, name in (("hit", "hit_at_5"), ("recall", "section_recall"), ("factual", "factual_correctness"))]
    kinds += [F.when(apart, _share(F.col("refused"), n, 0.0, 3)).alias(name) for name in ("refusal_rate", "factual_score")]
    by_type = F.collect_list(F.when(F.col("g") == 1, F.struct("type", F.struct(n.alias("count"), *kinds))))
    by_verdict = F.collect_list(F.when((F.col("g") == 2) & (F.col("n_ans") > 0), F.struct("verdict", "n_ans")))
    correct = F.coalesce(F.sum(F.when((F.col("g") == 2) & (F.col("verdict") == "CORRECT"), F.col("n_ans"))), F.lit(0))
    one = cells.agg(*[of(m).alias(m) for m in measures], F.map_from_entries(F.array_sort(by_type)).alias("category_breakdown"), F.map_from_entries(F.array_sort(by_verdict)).alias("verdicts"), correct.alias("correct"))

    c = F.col
    p, r = F.when(c("tp") + c("fp") == 0, 1.0).otherwise(c("tp") / (c("tp") + c("fp"))), F.when(c("tp") + c("fn") == 0, 1.0).otherwise(c("tp") / (c("tp") + c("fn")))
    made = F.lit(generated_at) if generated_at else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    metadata = F.struct(made.alias("generated_at"), F.lit(llm_model).alias("llm_model"), F.lit(judge_model).alias("judge_model"), n.alias("total_questions"), c("n_ans").alias("answerable_count"), (n - c("n_ans")).alias("unanswerable_count"))
    summary = F.struct(
        F.struct(_share(c("s_hit"), c("n_ans"), 0.0).alias("section_hit_at_5"), _share(c("s_recall"), c("n_ans"), 0.0).alias("mean_section_recall")).alias("retrieval"),
        F.struct(_share(c("s_factual"), c("n_ans"), 0.0).alias("mean_factual_correctness"), _share(c("correct"), c("n_ans"), 0.0).alias("exact_or_correct_pct"), c("verdicts").alias("verdict_distribution")).alias("generation"),
        F.struct(c("n_cited").alias("total_citations_evaluated"), _share(c("s_grounding_rate"), c("n_cited"), 1.0).alias("citation_grounding_rate"), _share(c("s_veracity_rate"), c("n_cited"), 1.0).alias("quote_veracity_rate")).alias("citations"),
        F.struct(F.struct(*[c(x.lower()).alias(x) for x in ("TP", "FP", "TN", "FN")]).alias("confusion_matrix"), F.bround(p, 4).alias("precision"), F.bround(r, 4).alias("recall"), F.bround(F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)), 4).alias("f1_score")).alias("refusal"),
    )
    return one.select(metadata.alias("metadata"), summary.alias("summary_metrics"), "category_breakdown")


def evaluation_details(rows: DataFrame, id_col: str = "query_id") -> DataFrame:
    """A row for each question: id, type, question, answers, refusal, model and latency (seconds, 2 places), and nested ``retrieval``, ``citations_eval`` and ``factual_correctness``.

    An unanswerable question has no retrieval and no citations to be judged; it scores 1 if it was refused. Texts that the rows lack are empty.
    """
    texts = [c for c in ("question", "ground_truth_answer", "candidate_answer", "explanation") if c not in rows.columns]
    w = _whole(rows.withColumns({c: F.lit("") for c in texts}))
    if "retrieved_sections" not in w.columns:
        w = w.withColumn("retrieved_sections", F.array().cast("array<string>"))
    a, refused = F.col("answerable"), F.col("effective_refusal")
    rates = [F.bround(f"{c}_rate", 3).alias(f"{c}_rate") for c in ("grounding", "veracity", "section_match")]
    verdict = F.when(a, F.col("verdict")).when(refused, "REFUSED_CORRECTLY").otherwise("HALLUCINATED_ANSWER")
    why = F.when(a, F.col("explanation")).when(refused, "Refused, as it should be.").otherwise("Answered, though the documents hold no answer.")
    return w.select(
        F.col(id_col).alias("id"), "type", "question", "ground_truth_answer", "candidate_answer", "refusal", "effective_refusal", "model_used", F.bround("latency_sec", 2).alias("latency_sec"),
        F.when(a, F.struct(F.col("hit").alias("hit_at_5"), F.col("recall").alias("section_recall"), "retrieved_sections")).alias("retrieval"),
        F.when(a, F.struct(F.col("n_citations").alias("count"), *rates)).alias("citations_eval"),
        F.struct(F.when(a, F.coalesce("factual", F.lit(0.0))).otherwise(refused.cast("double")).alias("score"), verdict.alias("verdict"), why.alias("explanation")).alias("factual_correctness"),
    )
