"""The ledger of calls, and the report object of an evaluation."""

import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioforge.operators import report as rep
from folioforge.operators.answers import complete
from folioforge.sources import tables
from folioforge.sources.ledger import CallLedger, note, noted, open_folder


def counting(log, lost_at=None):
    """A function that notes every text it is asked, and loses its worker once, at the text ``lost_at``."""

    def call(texts):
        if lost_at is not None and lost_at in texts and not os.path.exists(f"{log}.lost"):
            Path(f"{log}.lost").touch()
            os._exit(1)
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        return [None if t is None else str(t).upper() for t in texts]

    return call


def asked(log):
    return sorted(Path(log).read_text().split("\n")[:-1]) if os.path.exists(log) else []


def test_calls_are_made_once(spark, tmp_path):
    log, ledger = f"{tmp_path}/log", CallLedger(spark, f"{tmp_path}/ledger", "string", shards=3)
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "z"), (4, None, "n")], "id int, text string, reply string")
    got = {r.id: r.reply for r in ledger.replies(rows, ["text"], counting(log), "m").collect()}
    assert got == {1: "A", 2: "B", 3: "A", 4: None}
    assert asked(log) == ["None", "a", "b"]
    more = spark.createDataFrame([(1, "c"), (2, "b"), (3, None)], "id int, text string")
    assert {r.id: r.reply for r in ledger.replies(more, ["text"], counting(log), "m").collect()} == {1: "C", 2: "B", 3: None}
    assert asked(log) == ["None", "a", "b", "c"]
    ledger.replies(more, ["text"], counting(log), "other model")
    assert len(asked(log)) == 7
    assert ledger.replies(more.limit(0), ["text"], counting(log), "m").count() == 0 and len(asked(log)) == 7
    assert not os.path.exists(f"{tmp_path}/ledger/journal")


def test_a_lost_worker_repeats_no_call(spark, tmp_path):
    log, ledger = f"{tmp_path}/log", CallLedger(spark, f"{tmp_path}/ledger", "string", shards=2)
    rows = spark.range(60).select(F.concat(F.lit("t"), "id").alias("text"))
    with pytest.raises(Exception, match=r"(?i)worker|crash"):
        ledger.replies(rows, ["text"], counting(log, "t31"), "m", batch=4)
    before = asked(log)
    got = ledger.replies(rows, ["text"], counting(log, "t31"), "m", batch=4).collect()
    assert {r.text: r.reply for r in got} == {f"t{i}": f"T{i}" for i in range(60)}
    assert asked(log) == sorted(f"t{i}" for i in range(60)) and len(before) < 60


def test_retries_inputs_and_replies(spark, tmp_path):
    ledger = CallLedger(spark, f"{tmp_path}/ledger", "array<double>", shards=2)
    rows = spark.createDataFrame([(2, 3.5), (4, None)], "a int, b double")

    def call(pairs):
        if not os.path.exists(f"{tmp_path}/tried"):
            Path(f"{tmp_path}/tried").touch()
            raise RuntimeError("busy")
        return [[float(a), -1.0 if b is None or b != b else b] for a, b in pairs]

    assert sorted(tuple(r.reply) for r in ledger.replies(rows, ["a", "b"], call, "m").collect()) == [(2.0, 3.5), (4.0, -1.0)]
    with pytest.raises(Exception, match="1 inputs, 0 replies"):
        ledger.replies(rows.limit(1), ["a", "b"], lambda _: [], "n")


def test_journal_passes_over_unfinished_files(tmp_path):
    files, at = open_folder(f"{tmp_path}/j/0")
    note(files, at, {"k": [1.5]})
    Path(f"{at}/x.part").write_text('{"q": ')
    assert noted(files, at) == {"k": [1.5]} and open_folder(f"file:{tmp_path}/j/0")[1] == at


EVALUATED = "query_id string, answerable boolean, refusal boolean, effective_refusal boolean, type string, hit double, recall double, factual double, verdict string, n_citations long, grounding_rate double, veracity_rate double, latency_sec double"
ROWS = [
    ("a1", True, False, True, "a", 1.0, 0.6666667, 0.5, "CORRECT", 3, 0.6666667, 1.0, 1.238),
    ("a2", True, True, True, "a", 0.0, 0.0, 0.0, "INCORRECT", 0, 1.0, 1.0, None),
    ("b1", True, False, False, "b", 1.0, 1.0, 1.0, "EXACT_MATCH", 1, 0.0, 0.0, 2.0),
    ("u1", False, True, True, "not in document", None, None, 1.0, "CORRECT", 2, 0.0, 0.0, 0.5),
    ("u2", False, False, False, "not in document", None, None, 0.0, "INCORRECT", 2, 0.0, 0.0, 0.5),
]


def test_report_object(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, EVALUATED)
    report, details = rep.evaluation_report(rows, "m", "j", "2024-01-01T00:00:00+00:00"), rep.evaluation_details(rows)
    tables.write_evaluation(report, details, f"{tmp_path}/e")
    [file] = Path(f"{tmp_path}/e/report").glob("*.json")
    assert json.loads(file.read_text()) == {
        "metadata": {"generated_at": "2024-01-01T00:00:00+00:00", "llm_model": "m", "judge_model": "j", "total_questions": 5, "answerable_count": 3, "unanswerable_count": 2},
        "summary_metrics": {
            "retrieval": {"section_hit_at_5": 0.6667, "mean_section_recall": 0.5557},
            "generation": {"mean_factual_correctness": 0.5, "exact_or_correct_pct": 0.3333, "verdict_distribution": {"CORRECT": 1, "EXACT_MATCH": 1, "INCORRECT": 1}},
            "citations": {"total_citations_evaluated": 4, "citation_grounding_rate": round(0.667 * 3 / 4, 4), "quote_veracity_rate": 0.75},
            "refusal": {"confusion_matrix": {"TP": 1, "FP": 1, "TN": 2, "FN": 1}, "precision": 0.5, "recall": 0.5, "f1_score": 0.5},
        },
        "category_breakdown": {
            "a": {"count": 2, "hit_at_5": 0.5, "section_recall": 0.334, "factual_correctness": 0.25},
            "b": {"count": 1, "hit_at_5": 1.0, "section_recall": 1.0, "factual_correctness": 1.0},
            "not in document": {"count": 2, "refusal_rate": 0.5, "factual_score": 0.5},
        },
    }
    back, said = tables.read_evaluation(spark, f"{tmp_path}/e", report.schema, details.schema)
    assert back.first() == report.first()
    by = {r.id: r for r in said.collect()}
    assert by["a1"].latency_sec == 1.24 and by["a1"].retrieval.section_recall == 0.667 and by["a1"].citations_eval.grounding_rate == 0.667 and by["a2"].latency_sec is None
    assert by["u1"].retrieval is None and by["u1"].citations_eval is None and by["u1"].factual_correctness.verdict == "REFUSED_CORRECTLY" and by["u2"].factual_correctness.score == 0.0


def test_report_of_nothing_and_of_nulls(spark):
    rows = spark.createDataFrame(ROWS, EVALUATED)
    none = rep.evaluation_report(rows.limit(0)).first()
    assert none.metadata.total_questions == 0 and none.summary_metrics.retrieval.section_hit_at_5 == 0.0 and none.summary_metrics.citations.citation_grounding_rate == 1.0
    assert none.summary_metrics.refusal.precision == 1.0 and none.category_breakdown == {} and none.metadata.generated_at.endswith("+00:00")
    bare = spark.createDataFrame([("q", True), ("r", None)], "query_id string, answerable boolean")
    bare = bare.withColumns({c: F.lit(None).cast(k) for c, k in (("refusal", "boolean"), ("effective_refusal", "boolean"), ("type", "string"), ("hit", "double"), ("recall", "double"), ("factual", "double"), ("verdict", "string"))})
    one = rep.evaluation_report(bare).first()
    assert (one.metadata.answerable_count, one.metadata.unanswerable_count) == (1, 1) and one.category_breakdown[""]["count"] == 2 and one.summary_metrics.generation.verdict_distribution == {"": 1}
    assert {r.id: r.factual_correctness.score for r in rep.evaluation_details(bare).collect()} == {"q": 0.0, "r": 0.0}


def test_report_reads_its_table_once(spark, tmp_path):
    spark.createDataFrame(ROWS, EVALUATED).write.parquet(f"{tmp_path}/t")
    plan = rep.evaluation_report(spark.read.parquet(f"{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_completions_say_how_long_they_took(spark):
    got = complete(spark.createDataFrame([(1, "p")], "query_id int, prompt string"), lambda p: p).first()
    assert got.latency_sec >= 0 and got.model_used == "primary"
