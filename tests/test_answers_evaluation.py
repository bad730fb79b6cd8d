"""Answers, citations, metrics."""

import datetime
import json

from pyspark.sql import functions as F

from folioforge.operators import answers as an
from folioforge.operators import evaluation as ev

RETRIEVED = "query_id string, chunk_id string, section_id string, section_title string, page_start int, page_end int, display_text string, embed_text string, final_rank int"


def retrieved(spark):
    return spark.createDataFrame([
        ("q1", "c2", "5.5", "Late", 4, 5, "Second text", "[x]\nSecond text", 2),
        ("q1", "c1", "5", "Early", 3, 3, "First text. Students must register by Friday", "[x]\nFirst text. Students must register by Friday", 1),
        ("q2", "c9", "7", "", 1, 1, "t", "t", 1),
    ], RETRIEVED)


def test_context_and_prompt(spark):
    ctx = an.format_context(retrieved(spark))
    got = {r.query_id: r.context for r in ctx.collect()}
    assert got["q1"] == "--- [CHUNK c1 | Section 5: Early | p. 3] ---\n[x]\nFirst text. Students must register by Friday\n\n--- [CHUNK c2 | Section 5.5: Late | pp. 4-5] ---\n[x]\nSecond text"
    bare = retrieved(spark).where("chunk_id = 'c2'").withColumns({"embed_text": F.lit(None).cast("string"), "section_id": F.lit(None).cast("string")})
    assert an.format_context(bare).first().context == "--- [CHUNK c2 | Section Unknown: Late | pp. 4-5] ---\nSecond text"
    p = {r.query_id: r.prompt for r in an.prompts(spark.createDataFrame([("q1", "Who?"), ("q3", "What?")], "query_id string, question string"), ctx).collect()}
    assert p["q1"].endswith("\n\nQUESTION: Who?") and p["q3"] == "CONTEXT:\n\n\nQUESTION: What?"


def test_completion_falls_back(spark):
    def primary(p):
        if "bad" in p:
            raise RuntimeError("no")
        return "P" + p

    got = an.complete(spark.createDataFrame([("a", "x"), ("b", "bad")], "query_id string, prompt string"), primary, lambda p: "F" + p).collect()
    assert {r.query_id: (r.response_json, r.model_used) for r in got} == {"a": ("Px", "primary"), "b": ("Fbad", "fallback")}


def test_responses_and_citations(spark):
    full = {"answer": "A", "citations": [{"chunk_id": "c1", "section_id": "5", "quote": "q"}, {"chunk_id": "c2", "section_id": "9", "page": 7}, {"chunk_id": "c7", "section_id": "8"}, {"chunk_id": "c9", "section_id": "7"}], "refusal": True}
    rows = [("q1", json.dumps(full)), ("q2", "{bad"), ("q3", "{}"), ("q4", None), ("q2b", json.dumps({"citations": None}))]
    parsed = an.parse_responses(spark.createDataFrame(rows, "query_id string, response_json string"))
    got = {r.query_id: r for r in parsed.collect()}
    assert got["q1"].answer == "A" and got["q1"].refusal and len(got["q1"].citations) == 4
    assert all(got[k].answer == "" and got[k].citations == [] and got[k].refusal is False for k in ("q2", "q3", "q4", "q2b"))
    cites = an.citation_rows(parsed)
    rich = {r.chunk_id: r for r in an.enrich_citations(cites, retrieved(spark)).collect()}
    assert rich["c1"].section_title == "Early" and rich["c2"].section_title == "Late" and rich["c7"].section_title == "Section 8"
    assert rich["c1"].page == 1 and rich["c2"].page == 7 and rich["c7"].quote == ""


def test_amendments(spark):
    rec = spark.createDataFrame([(1, "amendment", "AMENDMENT 1 (effective 1 January 2026).", "fee is now 600", "5.3"), (1, "exception", "Exception to 2.", "x", "6"), (1, "amendment", "AMENDMENT 2", "effective 31 March 2027 x", "7"), (1, None, None, "AMENDMENT 3", "8")], "doc_id int, callout_kind string, lead_in string, text string, section_id string")
    cat = an.amendments(rec)
    assert {(r.number, r.effective, r.section_id) for r in cat.collect()} == {(1, datetime.date(2026, 1, 1), "5.3"), (2, datetime.date(2027, 3, 31), "7")}
    cites = spark.createDataFrame([("a", 1, "5.3", "x"), ("b", 1, "1", "see Amendment 2 there"), ("c", 1, "1", "amendment 9"), ("d", 1, "5", "no"), ("e", 2, "5.3", "amendment 1")], "query_id string, doc_id int, section_id string, quote string")
    assert {r.query_id: r.amended for r in an.amended_citations(cites, cat).collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_sections_are_those_of_the_questions_document(spark):
    truth = spark.createDataFrame([("q", 1, "x", ["5"]), ("r", 2, "x", ["5"])], "query_id string, doc_id long, type string, sections array<string>")
    got = spark.createDataFrame([("q", 2, "c1", "5", "Other", 1), ("q", 1, "c2", "5.1", "Own", 2), ("q", 1, "c3", "5", "Own five", 3), ("r", 1, "c2", "5.1", "Own", 1)], "query_id string, doc_id long, chunk_id string, section_id string, section_title string, final_rank int")
    assert {r.query_id: (r.hit, r.recall) for r in ev.section_recall(truth, got).collect()} == {"q": (1.0, 1.0), "r": (0.0, 0.0)}
    assert {r.query_id: r.first_rank for r in ev.first_ranks(truth, got).collect()} == {"q": 3, "r": None}
    cites = spark.createDataFrame([("q", 2, "c9", "5"), ("q", 1, "c9", "5")], "query_id string, doc_id long, chunk_id string, section_id string")
    assert {r.doc_id: r.section_title for r in an.enrich_citations(cites, got).collect()} == {1: "Own five", 2: "Other"}


TRUTH = "query_id string, type string, sections array<string>"


def test_two_notions_of_a_hit(spark):
    truth = spark.createDataFrame([("q1", "x", ["5.5.2", "9"]), ("q2", "x", ["8"]), ("q3", "y", []), ("q4", "y", ["5"])], TRUTH)
    got = {r.query_id: (r.hit, r.recall) for r in ev.section_recall(truth, retrieved(spark)).collect()}
    assert got == {"q1": (1.0, 0.5), "q2": (0.0, 0.0), "q3": (0.0, 1.0), "q4": (0.0, 0.0)}
    exact = spark.createDataFrame([("q1", "x", ["5.5"]), ("q2", "x", ["7.1"]), ("q9", "y", ["5"])], TRUTH)
    ranks = ev.first_ranks(exact, retrieved(spark))
    assert {r.query_id: r.first_rank for r in ranks.collect()} == {"q1": 2, "q2": None, "q9": None}
    m = {r.type: r for r in ev.rank_metrics(ranks).collect()}
    assert (m["ALL"].n, m["ALL"].hit_at_1) == (3, 0.0) and abs(m["ALL"].hit_at_3 - 1 / 3) < 1e-12 and m["x"].mrr == 0.25


def test_citation_rates(spark):
    cites = spark.createDataFrame([
        ("q1", "c1", "5", " FIRST text. "), ("q1", "c1", "9", "not there. students must register"), ("q1", "c1", "9", "not there. First tex"), ("q1", "cx", "5.1", "First text"), ("q1", "c1", "5", ""),
    ], "query_id string, chunk_id string, section_id string, quote string")
    truth = spark.createDataFrame([("q1", "x", ["5"])], TRUTH)
    checked = ev.citation_checks(cites, retrieved(spark), truth)
    got = [(r.grounded, r.veracious, r.section_ok) for r in checked.orderBy("chunk_id", "quote").collect()]
    assert sorted(got) == sorted([(True, True, True), (True, True, False), (True, False, False), (False, False, True), (True, False, True)])
    rates = {r.query_id: r for r in ev.citation_rates(spark.createDataFrame([("q1",), ("q5",)], "query_id string"), checked).collect()}
    assert rates["q1"].n_citations == 5 and rates["q1"].grounding_rate == 0.8 and abs(rates["q1"].veracity_rate - 0.4) < 1e-12
    assert (rates["q5"].grounding_rate, rates["q5"].veracity_rate, rates["q5"].section_match_rate) == (1.0, 1.0, 0.0)


def test_part_of_ten_characters_is_too_short(spark):
    r = spark.createDataFrame([("q", "c", "0123456789 and more", "")], "query_id string, chunk_id string, embed_text string, display_text string")
    c = spark.createDataFrame([("q", "c", "1", "zzz. 0123456789"), ("q", "c", "1", "zzz. 0123456789 ")], "query_id string, chunk_id string, section_id string, quote string")
    t = spark.createDataFrame([("q", "x", ["1"])], TRUTH)
    assert [x.veracious for x in ev.citation_checks(c, r, t).collect()] == [False, False]
    c2 = spark.createDataFrame([("q", "c", "1", "zzz. 0123456789 a")], "query_id string, chunk_id string, section_id string, quote string")
    assert ev.citation_checks(c2, r, t).first().veracious


def test_pooled_rates_weigh_rounded_rates(spark):
    rates = spark.createDataFrame([(3, 1 / 3, 0.0625, 1.0), (16, 0.0625, 0.0625, 0.0), (0, 1.0, 1.0, 0.0)], "n_citations long, grounding_rate double, veracity_rate double, section_match_rate double")
    r = ev.pooled_rates(rates).first()
    assert r.n_citations == 19 and abs(r.grounding_rate - (0.333 * 3 + 0.062 * 16) / 19) < 1e-12 and abs(r.veracity_rate - 0.062) < 1e-12


def test_scores_and_refusals(spark):
    rows = [(0.8, None, False), (0.79, "PARTIAL", False), (0.3, "X", False), (0.29, "X", False), (None, "X", False), (1.0, "CORRECT", True)]
    got = spark.createDataFrame(rows, "s double, v string, r boolean").select(ev.normal_score(F.col("s"), F.col("r")).alias("s"), ev.normal_verdict(F.col("v"), F.col("r")).alias("v")).collect()
    assert [r.s for r in got] == [1.0, 0.5, 0.5, 0.0, 0.0, 0.0] and got[0].v == "INCORRECT" and got[1].v == "PARTIAL" and got[5].v == "INCORRECT"
    said = spark.createDataFrame([(False, "It was NOT FOUND."), (True, None), (None, "There is no information"), (False, "yes")], "r boolean, a string").select(ev.effective_refusal(F.col("r"), F.col("a")).alias("e")).collect()
    assert [r.e for r in said] == [True, True, True, False]


REPORT = "answerable boolean, refusal boolean, effective_refusal boolean, type string, hit double, recall double, factual double, verdict string"


def test_report(spark):
    rows = [(True, False, True, "a", 1.0, 0.5, 1.0, "CORRECT"), (True, True, True, "b", 0.0, 1.0, 0.0, "EXACT_MATCH"), (False, False, True, "not in document", None, None, 1.0, "CORRECT"), (False, False, False, "not in document", None, None, 0.0, "INCORRECT")]
    df = spark.createDataFrame(rows, REPORT)
    m = ev.refusal_matrix(df).first()
    assert (m.tp, m.fn, m.fp, m.tn, m.refusal_precision, m.refusal_recall, m.refusal_f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    empty = ev.refusal_matrix(df.where("type = 'none'")).first()
    assert (empty.refusal_precision, empty.refusal_recall, empty.refusal_f1) == (1.0, 1.0, 1.0)
    assert tuple(ev.overall_means(df).first()) == (0.5, 0.75, 0.5)
    assert {r.verdict: r.n for r in ev.verdicts(df).collect()} == {"CORRECT": 2, "EXACT_MATCH": 1, "INCORRECT": 1}
    assert tuple(ev.verdict_shares(df).first()) == (0.5, 0.75)
    by = {r.type: r for r in ev.breakdown(df).collect()}
    assert by["not in document"].refusal_rate == 0.5 and by["not in document"].factual is None and by["a"].refusal_rate is None and by["a"].section_recall == 0.5
    g = {r.metric: r.passed for r in ev.gates(spark.createDataFrame([(0.9, 0.84, 0.9)], "hit_at_5 double, section_recall double, factual double")).collect()}
    assert g["hit_at_5"] and not g["section_recall"] and g["factual"] and not g["grounding_rate"] and len(g) == 7
    assert [r.type for r in ev.missing_categories(df.where("type <> 'b'"), df).collect()] == ["b"]
    few = ev.count_gates(df, (("total_questions", 4), ("answerable_count", 3), ("unanswerable_count", 2)))
    assert {r.metric: (r.value, r.passed) for r in few.collect()} == {"total_questions": (4, True), "answerable_count": (2, False), "unanswerable_count": (2, True)}
    assert {r.metric: r.value for r in ev.count_gates(df.limit(0)).collect()} == {"total_questions": 0, "answerable_count": 0, "unanswerable_count": 0}
