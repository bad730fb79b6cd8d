"""The pipeline's stages, each against a plain version of its decision on its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from folioforge.llm.common import stored
from tests_llm_plain import plain_components, plain_dedup, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = cp.table(spark, sf, "documents")
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "", "en", "src0", 0), (9003, "1234 5678", "en", "src0", 9)], docs.schema)
    docs = stored(docs.unionByName(extra))
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], sf)))
    return [sorted(x.collect(), key=lambda r: r.doc_id) for x in out], docs.columns


def test_stage_list():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None


def test_columns(stages):
    rows, columns = stages
    assert all(list(r[0].asDict()) == columns for r in rows[:5])


def test_language_rejects_only_the_letterless(stages):
    rows, _ = stages
    assert {r.doc_id for r in rows[0]} - {r.doc_id for r in rows[1]} == {9001, 9002, 9003}


def test_lines(stages):
    rows, _ = stages
    want = plain_dedup([(r.doc_id, r.text) for r in rows[1]])
    assert [(r.doc_id, r.text) for r in rows[2]] == [(i, t) for i, _, _, t in want]
    assert all(r.n_chars == len(r.text) for r in rows[2])


def test_near_copies(stages):
    rows, _ = stages
    ids = [r.doc_id for r in rows[2]]
    label = plain_components(ids, [plain_fingerprint(r.text) for r in rows[2]])
    assert [r.doc_id for r in rows[3]] == [i for i in ids if label[i] == i]


def test_benchmark_passages_go(stages, spark, sf):
    rows, _ = stages
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in rows[4]}
    held = {r.doc_id for r in rows[3] if any(x in r.text for x in items)}
    gone = {r.doc_id for r in rows[3]} - kept
    assert held <= gone
    words = lambda t: re.findall(r"\w+", t.lower())
    for r in rows[3]:
        if r.doc_id in gone - held:  # what else went shares at least half of an item's words, in a row of them
            assert any(len(set(words(x)) & set(words(r.text))) > len(set(words(x))) / 2 for x in items)


def test_encoding(stages):
    rows, _ = stages
    assert [r.doc_id for r in rows[5]] == [r.doc_id for r in rows[4]]
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in rows[5])


def test_empty_documents(spark, sf):
    docs = cp.table(spark, sf, "documents").where(F.lit(False))
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf))
    assert docs.count() == 0
