"""Queries on evaluation (V)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sections_match
from ..operators import evaluation as ev
from ..operators import report as rep
from ..sources import tables
from . import bindings as b
from .registry import query

MATCH = "(trim({t}) <> '' AND trim({c}) <> '' AND (trim({t}) = trim({c}) OR starts_with(trim({c}), trim({t}) || '.') OR starts_with(trim({t}), trim({c}) || '.') OR contains(lower(trim({c})), 'section ' || lower(trim({t})))))"


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("v1_section_matches", f"""WITH {b.RECORDS_SQL}, s AS (SELECT DISTINCT doc_id, section_id FROM records), t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_extract(section_id, '^\\d+\\.\\d+') WHEN doc_id % 3 = 1 THEN section_id ELSE section_id || '1' END AS target, CASE WHEN doc_id % 5 = 0 THEN 'see Section ' || section_id ELSE section_id END AS candidate FROM s)
SELECT doc_id, target, candidate, {MATCH.format(t='target', c='candidate')} AS ok FROM t""")
def v1(spark, sf_dir):
    s = b.records(spark, sf_dir).select("doc_id", "section_id").distinct()
    d = F.col("doc_id")
    target = F.when(d % 3 == 0, F.regexp_extract("section_id", r"^\d+\.\d+", 0)).when(d % 3 == 1, F.col("section_id")).otherwise(F.concat("section_id", F.lit("1")))
    candidate = F.when(d % 5 == 0, F.concat(F.lit("see Section "), F.col("section_id"))).otherwise(F.col("section_id"))
    return s.select("doc_id", target.alias("target"), candidate.alias("candidate")).withColumn("ok", sections_match(F.col("target"), F.col("candidate")))


RECALL_SQL = f"""
recall AS (SELECT q.query_id, q.type, q.answerable, coalesce(max(CASE WHEN ok THEN 1.0 ELSE 0 END), 0) AS hit, CASE WHEN count(t.section_id) = 0 THEN 1.0 ELSE sum(CASE WHEN ok THEN 1 ELSE 0 END) / count(t.section_id) END AS recall FROM questions q LEFT JOIN
  (SELECT t.query_id, t.section_id, coalesce((SELECT bool_or({MATCH.format(t='t.section_id', c='r.section_id')}) FROM retrieved r WHERE r.query_id = t.query_id), false) AS ok FROM truth t) t USING (query_id) GROUP BY q.query_id, q.type, q.answerable)"""


@query("v2_section_recall", f"WITH {b.RETRIEVED_SQL},{RECALL_SQL} SELECT query_id, round(CAST(hit AS DOUBLE), 6) AS hit, round(CAST(recall AS DOUBLE), 6) AS recall FROM recall")
def v2(spark, sf_dir):
    return rounded(ev.section_recall(b.questions(spark, sf_dir), b.retrieved(spark, sf_dir)), "hit", "recall")


CHECKED_SQL = f"""
checked AS (SELECT c.query_id, c.chunk_id, r.chunk_id IS NOT NULL AS grounded,
  coalesce(trim(c.quote) <> '' AND (contains(lower(r.text || ' ' || r.text), lower(trim(c.quote))) OR len(list_filter(string_split(lower(trim(c.quote)), '. '), lambda p: length(p) > 10 AND contains(lower(r.text || ' ' || r.text), p))) > 0), false) AS veracious,
  coalesce((SELECT bool_or({MATCH.format(t='t.section_id', c='c.section_id')}) FROM truth t WHERE t.query_id = c.query_id), false) AS section_ok
  FROM citations c LEFT JOIN retrieved r ON r.query_id = c.query_id AND r.chunk_id = c.chunk_id),
rates AS (SELECT item_id AS query_id, count(c.query_id) AS n_citations, coalesce(avg(CASE WHEN grounded THEN 1.0 ELSE 0 END) FILTER (WHERE c.query_id IS NOT NULL), 1.0) AS grounding_rate,
  coalesce(avg(CASE WHEN veracious THEN 1.0 ELSE 0 END) FILTER (WHERE c.query_id IS NOT NULL), 1.0) AS veracity_rate, coalesce(avg(CASE WHEN section_ok THEN 1.0 ELSE 0 END) FILTER (WHERE c.query_id IS NOT NULL), 0.0) AS section_match_rate
  FROM benchmark LEFT JOIN checked c ON c.query_id = item_id GROUP BY item_id)"""


def checked(spark, sf_dir):
    return ev.citation_checks(b.citations(spark, sf_dir), b.retrieved(spark, sf_dir), b.questions(spark, sf_dir))


def rates(spark, sf_dir):
    return ev.citation_rates(b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id")), checked(spark, sf_dir))


for _name, _col in (("v4_grounding", "grounded"), ("v5_quote_veracity", "veracious"), ("v6_citation_sections", "section_ok")):
    query(_name, f"WITH {b.CITATIONS_SQL},{CHECKED_SQL} SELECT query_id, chunk_id, {_col} FROM checked")(lambda spark, sf_dir, c=_col: checked(spark, sf_dir).select("query_id", "chunk_id", c))


@query("v4_v6_citation_rates", f"WITH {b.CITATIONS_SQL},{CHECKED_SQL} SELECT query_id, n_citations, round(grounding_rate, 6) AS grounding_rate, round(veracity_rate, 6) AS veracity_rate, round(section_match_rate, 6) AS section_match_rate FROM rates")
def v456(spark, sf_dir):
    return rounded(rates(spark, sf_dir), "grounding_rate", "veracity_rate", "section_match_rate")


@query("v7_judge_scores", f"WITH {b.RESPONSES_SQL} SELECT conv_id, turn, CAST(factual AS DOUBLE) AS factual, verdict FROM judged")
def v7(spark, sf_dir):
    return b.judged(spark, sf_dir).select("conv_id", "turn", "factual", "verdict")


@query("v8_effective_refusal", f"WITH {b.RESPONSES_SQL} SELECT conv_id, turn, effective_refusal, CAST(CASE WHEN effective_refusal THEN 1 ELSE 0 END AS DOUBLE) AS score FROM judged WHERE NOT answerable")
def v8(spark, sf_dir):
    return b.judged(spark, sf_dir).where("not answerable").select("conv_id", "turn", "effective_refusal", F.col("effective_refusal").cast("double").alias("score"))


MATRIX_SQL = """
m AS (SELECT count(*) FILTER (WHERE NOT answerable AND effective_refusal) AS tp, count(*) FILTER (WHERE NOT answerable AND NOT effective_refusal) AS fn, count(*) FILTER (WHERE answerable AND refusal) AS fp, count(*) FILTER (WHERE answerable AND NOT refusal) AS tn FROM judged),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM m),
matrix AS (SELECT tp, fn, fp, tn, p AS refusal_precision, r AS refusal_recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS refusal_f1 FROM pr)"""


@query("v9_refusal_matrix", f"WITH {b.RESPONSES_SQL},{MATRIX_SQL} SELECT tp, fn, fp, tn, round(refusal_precision, 6) AS refusal_precision, round(refusal_recall, 6) AS refusal_recall, round(refusal_f1, 6) AS refusal_f1 FROM matrix")
def v9(spark, sf_dir):
    return rounded(ev.refusal_matrix(b.judged(spark, sf_dir)), "refusal_precision", "refusal_recall", "refusal_f1")


#: Half to even at n places, for values that are exact enough to tell.
BROUND = "round_even({x}, {n})"


@query("v10_overall_means", f"WITH {b.RESPONSES_SQL} SELECT {', '.join(f'{BROUND.format(x=f'avg({c})', n=4)} AS {n}' for c, n in (('hit', 'hit_at_5'), ('recall', 'section_recall'), ('factual', 'factual')))} FROM judged WHERE answerable")
def v10(spark, sf_dir):
    return ev.overall_means(b.judged(spark, sf_dir))


@query("v11_pooled_rates", f"WITH {b.CITATIONS_SQL},{CHECKED_SQL} SELECT CAST(sum(n_citations) AS BIGINT) AS n_citations, {', '.join(f'round(sum({BROUND.format(x=c, n=3)} * n_citations) / sum(n_citations), 6) AS {c}' for c in ('grounding_rate', 'veracity_rate', 'section_match_rate'))} FROM rates")
def v11(spark, sf_dir):
    return rounded(ev.pooled_rates(rates(spark, sf_dir)), "grounding_rate", "veracity_rate", "section_match_rate")


@query("v12_verdicts", f"WITH {b.RESPONSES_SQL} SELECT verdict, count(*) AS n FROM judged GROUP BY verdict")
def v12(spark, sf_dir):
    return ev.verdicts(b.judged(spark, sf_dir))


@query("v12_verdict_shares", f"WITH {b.RESPONSES_SQL} SELECT round(avg(CASE WHEN verdict = 'CORRECT' THEN 1.0 ELSE 0 END), 6) AS correct_share, round(avg(CASE WHEN verdict IN ('CORRECT', 'EXACT_MATCH') THEN 1.0 ELSE 0 END), 6) AS exact_or_correct_share FROM judged")
def v12_shares(spark, sf_dir):
    return rounded(ev.verdict_shares(b.judged(spark, sf_dir)), "correct_share", "exact_or_correct_share")


@query("v13_breakdown", f"""WITH {b.RESPONSES_SQL} SELECT type, count(*) AS n, {', '.join(f"{BROUND.format(x=f'avg({c}) FILTER (WHERE answerable)', n=3)} AS {n}" for c, n in (('hit', 'hit_at_5'), ('recall', 'section_recall'), ('factual', 'factual')))},
  {BROUND.format(x="avg(CASE WHEN effective_refusal THEN 1.0 ELSE 0 END) FILTER (WHERE NOT answerable)", n=3)} AS refusal_rate FROM judged GROUP BY type""")
def v13(spark, sf_dir):
    return ev.breakdown(b.judged(spark, sf_dir))


GATE_SQL = "UNION ALL ".join(f"SELECT '{m}' AS metric, {v} AS value, {t} AS least FROM {s} " for m, v, t, s in (("hit_at_5", "round_even(avg(hit), 4)", 0.90, "judged WHERE answerable"), ("section_recall", "round_even(avg(recall), 4)", 0.85, "judged WHERE answerable"), ("factual", "round_even(avg(factual), 4)", 0.80, "judged WHERE answerable"), ("refusal_precision", "refusal_precision", 0.80, "matrix"), ("refusal_recall", "refusal_recall", 0.80, "matrix"), ("refusal_f1", "refusal_f1", 0.80, "matrix"), ("grounding_rate", "NULL", 0.999, "matrix")))


@query("v14_gates", f"WITH {b.RESPONSES_SQL},{MATRIX_SQL} SELECT metric, round(CAST(value AS DOUBLE), 6) AS value, CAST(least AS DOUBLE) AS least, coalesce(value >= least, false) AS passed FROM ({GATE_SQL})")
def v14(spark, sf_dir):
    """Gates over the responses' report; grounding is not measured there and so fails."""
    j = b.judged(spark, sf_dir)
    metrics = ev.overall_means(j).crossJoin(F.broadcast(ev.refusal_matrix(j)))  # one row each
    return rounded(ev.gates(metrics), "value")


ALL_GATES_SQL = GATE_SQL.replace("NULL AS value, 0.999 AS least FROM matrix", f"sum({BROUND.format(x='grounding_rate', n=3)} * n_citations) / sum(n_citations) AS value, 0.999 AS least FROM rates")


@query("v14_report_gates", f"WITH {b.CITATIONS_SQL},{CHECKED_SQL},{b.RESPONSES_SQL},{MATRIX_SQL} SELECT metric, round(CAST(value AS DOUBLE), 6) AS value, CAST(least AS DOUBLE) AS least, coalesce(value >= least, false) AS passed FROM ({ALL_GATES_SQL})")
def v14_report(spark, sf_dir):
    """All gates measured: answers and refusals of the conversations, grounding of all citations."""
    j = b.judged(spark, sf_dir)
    grounding = ev.pooled_rates(rates(spark, sf_dir)).select("grounding_rate")
    metrics = ev.overall_means(j).crossJoin(F.broadcast(ev.refusal_matrix(j))).crossJoin(F.broadcast(grounding))  # one row each
    return rounded(ev.gates(metrics), "value")


@query("v14_count_gates", f"WITH {b.RESPONSES_SQL}, n AS (SELECT count(*) AS t, count(*) FILTER (WHERE answerable) AS a, count(*) FILTER (WHERE NOT answerable) AS u FROM judged) " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {c} AS value, CAST({n} AS BIGINT) AS expected, {c} = {n} AS passed FROM n" for (m, n), c in zip(ev.COUNTS, "tau", strict=True)))
def v14_counts(spark, sf_dir):
    return ev.count_gates(b.judged(spark, sf_dir))


@query("v14_missing_categories", f"WITH {b.RESPONSES_SQL} SELECT type FROM (SELECT DISTINCT type FROM judged) WHERE type NOT IN (SELECT type FROM judged WHERE conv_id % 5 <> 2)")
def v14_missing(spark, sf_dir):
    j = b.judged(spark, sf_dir)
    return ev.missing_categories(j.where("conv_id % 5 <> 2"), j)


# --- the report as an object, written and read back ---

EVALUATED_SQL = f"""{b.RESPONSES_SQL},
evaluated AS (SELECT conv_id * 1000 + turn AS id, *, CAST(length(answer) % 4 AS BIGINT) AS n_citations, length(answer) % 3 / 3 AS grounding_rate, length(answer) % 8 / 8 AS veracity_rate, length(answer) % 1000 / 100 AS latency_sec FROM judged)"""


def evaluated(spark, sf_dir):
    """The judged answers with citations and latency read off their length."""
    n = F.length("answer")
    extra = {"query_id": F.col("conv_id") * 1000 + F.col("turn"), "candidate_answer": F.col("answer"), "n_citations": (n % 4).cast("long"), "grounding_rate": n % 3 / 3, "veracity_rate": n % 8 / 8, "latency_sec": n % 1000 / 100}
    return b.judged(spark, sf_dir).withColumns(extra)


def stored_evaluation(spark, sf_dir):
    rows = evaluated(spark, sf_dir)
    report, details = rep.evaluation_report(rows, "bundled", "bundled"), rep.evaluation_details(rows)
    path = tables.shared_dir(spark)
    tables.write_evaluation(report, details, path)
    return tables.read_evaluation(spark, path, report.schema, details.schema)


CITED = "{e} AS citation_grounding_rate, {v} AS quote_veracity_rate".format(**{k: f"round_even(coalesce(sum(round_even({c}, 3) * n_citations) FILTER (WHERE answerable) / nullif(sum(n_citations) FILTER (WHERE answerable), 0), 1), 4)" for k, c in (("e", "grounding_rate"), ("v", "veracity_rate"))})


@query("s4_evaluation_report", f"""WITH {EVALUATED_SQL},{MATRIX_SQL},
figures AS (SELECT count(*) AS total_questions, count(*) FILTER (WHERE answerable) AS answerable_count, count(*) FILTER (WHERE NOT answerable) AS unanswerable_count,
  round_even(avg(hit) FILTER (WHERE answerable), 4) AS section_hit_at_5, round_even(avg(recall) FILTER (WHERE answerable), 4) AS mean_section_recall, round_even(avg(factual) FILTER (WHERE answerable), 4) AS mean_factual_correctness,
  round_even(count(*) FILTER (WHERE answerable AND verdict = 'CORRECT') / count(*) FILTER (WHERE answerable), 4) AS exact_or_correct_pct, CAST(sum(n_citations) FILTER (WHERE answerable) AS BIGINT) AS total_citations_evaluated, {CITED} FROM evaluated)
SELECT figures.* REPLACE (CAST(mean_section_recall AS DOUBLE) AS mean_section_recall, CAST(mean_factual_correctness AS DOUBLE) AS mean_factual_correctness),
  (SELECT string_agg(verdict || ':' || n, ',' ORDER BY verdict) FROM (SELECT verdict, count(*) AS n FROM evaluated WHERE answerable GROUP BY verdict)) AS verdict_distribution,
  tp, fp, tn, fn, round_even(refusal_precision, 4) AS precision, round_even(refusal_recall, 4) AS recall, round_even(refusal_f1, 4) AS f1_score FROM figures CROSS JOIN matrix""")
def s4_evaluation(spark, sf_dir):
    report, _ = stored_evaluation(spark, sf_dir)
    told = F.transform(F.array_sort(F.map_entries("summary_metrics.generation.verdict_distribution")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    m = "summary_metrics"
    cells = [f"metadata.{c}" for c in ("total_questions", "answerable_count", "unanswerable_count")] + [f"{m}.retrieval.*", f"{m}.generation.mean_factual_correctness", f"{m}.generation.exact_or_correct_pct", f"{m}.citations.*"]
    matrix = [F.col(f"{m}.refusal.confusion_matrix.{c}").alias(c.lower()) for c in ("TP", "FP", "TN", "FN")]
    return report.select(*cells, F.array_join(told, ",").alias("verdict_distribution"), *matrix, *[f"{m}.refusal.{c}" for c in ("precision", "recall", "f1_score")])


@query("s4_report_categories", f"""WITH {EVALUATED_SQL} SELECT type, count(*) AS "count", {', '.join(f"CASE WHEN type <> 'not in document' THEN CAST(round_even(avg({c}), 3) AS DOUBLE) END AS {n}" for c, n in (('hit', 'hit_at_5'), ('recall', 'section_recall'), ('factual', 'factual_correctness')))},
  {', '.join(f"CASE WHEN type = 'not in document' THEN CAST(round_even(avg(CASE WHEN effective_refusal THEN 1.0 ELSE 0 END), 3) AS DOUBLE) END AS {n}" for n in ('refusal_rate', 'factual_score'))} FROM evaluated GROUP BY type""")
def s4_categories(spark, sf_dir):
    report, _ = stored_evaluation(spark, sf_dir)
    return report.select(F.explode("category_breakdown").alias("type", "c")).select("type", "c.*")


@query("s4_report_details", f"""WITH {EVALUATED_SQL} SELECT id, type, question, answer AS candidate_answer, refusal, effective_refusal, round_even(latency_sec, 2) AS latency_sec, CASE WHEN answerable THEN hit END AS hit_at_5, CASE WHEN answerable THEN CAST(recall AS DOUBLE) END AS section_recall,
  CASE WHEN answerable THEN n_citations END AS n_citations, CASE WHEN answerable THEN round_even(grounding_rate, 3) END AS grounding_rate, CASE WHEN answerable THEN round_even(veracity_rate, 3) END AS veracity_rate,
  CAST(CASE WHEN answerable THEN factual WHEN effective_refusal THEN 1 ELSE 0 END AS DOUBLE) AS score, CASE WHEN answerable THEN verdict WHEN effective_refusal THEN 'REFUSED_CORRECTLY' ELSE 'HALLUCINATED_ANSWER' END AS verdict FROM evaluated""")
def s4_details(spark, sf_dir):
    _, details = stored_evaluation(spark, sf_dir)
    c = details.select("*", "retrieval.hit_at_5", "retrieval.section_recall", F.col("citations_eval.count").alias("n_citations"), "citations_eval.grounding_rate", "citations_eval.veracity_rate", "factual_correctness.score", "factual_correctness.verdict")
    return c.select("id", "type", "question", "candidate_answer", "refusal", "effective_refusal", "latency_sec", "hit_at_5", "section_recall", "n_citations", "grounding_rate", "veracity_rate", "score", "verdict")
