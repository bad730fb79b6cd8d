"""Readers, writers, upserts and streams."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators.vectors import embed_texts, hashing_embedder
from folioforge.sources import tables
from folioforge.sources.store import KeyedStore
from folioforge.operators.retrieval import bm25_index
from folioforge.streaming import jobs


def test_json_lines_skip_blank_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": 1, "chunk_id": "a"}\n\n{"doc_id": 2, "chunk_id": "b", "type": "table"}\n   \n')
    got = tables.read_table(spark, str(tmp_path / "c.jsonl"), tables.CHUNKS, "json")
    assert [(r.chunk_id, r.type) for r in got.orderBy("doc_id").collect()] == [("a", None), ("b", "table")]


def test_broken_lines_fail_or_are_set_aside(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id": 1, "chunk_id": "a"}\n{"doc_id": 2, "chunk\n{"doc_id": "two", "chunk_id": "c"}\n\n{"doc_id": 4}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_table(spark, str(tmp_path / "c.jsonl"), tables.CHUNKS, "json").collect()
    sound = tables.read_sound(spark, str(tmp_path / "c.jsonl"), tables.CHUNKS)
    assert [(r.doc_id, r.chunk_id) for r in sound.orderBy("doc_id").collect()] == [(1, "a"), (4, None)] and "_file" not in sound.columns
    bad = tables.bad_records(spark, str(tmp_path / "c.jsonl"), tables.CHUNKS).collect()
    assert sorted(r.record for r in bad) == ['{"doc_id": "two", "chunk_id": "c"}', '{"doc_id": 2, "chunk'] and all(r.file.endswith("c.jsonl") for r in bad)


def test_answer_key(spark, tmp_path):
    key = {"questions": [{"id": "Q1", "type": "exception", "question": "x?", "answer": "y", "sections": ["5.5"]}], "unanswerable_questions": [{"id": "U1", "type": "not in document", "question": "z?", "expected_response": "none", "topic_excluded_from_handbook": "parking"}]}
    (tmp_path / "k.json").write_text(json.dumps(key, indent=2))
    got = {r.query_id: r for r in tables.read_answer_key(spark, str(tmp_path / "k.json")).collect()}
    assert got["Q1"].sections == ["5.5"] and got["Q1"].answerable and got["U1"].sections == [] and not got["U1"].answerable and got["U1"].topic_excluded == "parking" and got["U1"].answer == "none"


def test_write_and_filter(spark, tmp_path):
    c = spark.createDataFrame([(1, "table", "5"), (2, "paragraph", "5"), (3, "table", "6")], "k int, type string, section_id string")
    tables.write_table(c, f"{tmp_path}/c", partition_by=["type"])
    back = spark.read.parquet(f"{tmp_path}/c")
    found = tables.by_payload(back, "5", "table")
    assert [r.k for r in found.collect()] == [1] and "PartitionFilters: [isnotnull(type" in found._jdf.queryExecution().executedPlan().toString()
    tables.write_report(c.agg(F.count("*").alias("n")), f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first().n == 3


POINT = "k long, name string, v int"


def points(spark, rows):
    return spark.createDataFrame(rows, POINT)


def held(store):
    return sorted(((r.k, r.name, r.v) for r in store.read().collect()), key=repr)


def test_store_resumes_upserts_and_recreates(spark, tmp_path):
    st = KeyedStore(spark, f"{tmp_path}/s", points(spark, []).schema, ["k", "name"], buckets=4)
    assert held(st) == [] and st.missing(points(spark, [(1, "a", 1)])).count() == 1
    st.resume(points(spark, [(1, "a", 1), (None, "n", 2), (2, None, 3), (2, None, 3)]))
    st.resume(points(spark, [(1, "a", 9), (3, "c", 4), (None, "n", 9), (2, None, 9)]))
    assert held(st) == sorted([(1, "a", 1), (None, "n", 2), (2, None, 3), (3, "c", 4)], key=repr)
    st.upsert(points(spark, [(1, "a", 5), (4, "d", 6)]))
    st.upsert(points(spark, [(1, "a", 7)]))
    assert (1, "a", 7) in held(st) and len(held(st)) == 5
    seen = []
    st.resume(points(spark, [(1, "a", 0), (5, "e", 8)]), lambda fresh: seen.append(fresh.count()) or fresh)
    assert seen == [1] and (5, "e", 8) in held(st)
    st.compact(everything=True)
    assert len(st.manifest()["segments"]) == 1 and (1, "a", 7) in held(st) and len(held(st)) == 6
    st.recreate(points(spark, [(9, "z", 1)]))
    assert held(st) == [(9, "z", 1)]


def test_segments_do_not_grow_with_batches(spark, tmp_path):
    st = KeyedStore(spark, f"{tmp_path}/s", points(spark, []).schema, ["k"], buckets=2, fan=3)
    for n in range(20):
        st.upsert(points(spark, [(n, "x", n), (n // 2, "half", n)]))
    want = {n: n for n in range(20)} | {n // 2: n for n in range(20)}
    last = {}
    for n in range(20):
        last[n], last[n // 2] = n, n
    assert {r[0]: r[2] for r in held(st)} == last and set(last) == set(want)
    folders = [p for p in (tmp_path / "s" / "data").iterdir()]
    assert len(st.manifest()["segments"]) <= 8 and len(folders) <= 12 and len(list((tmp_path / "s" / "manifest").glob("*.json"))) <= 8


def test_a_slower_writer_does_its_work_again(spark, tmp_path):
    st, other = (KeyedStore(spark, f"{tmp_path}/s", points(spark, []).schema, ["k"]) for _ in range(2))
    st.resume(points(spark, [(1, "a", 1)]))
    raced = []

    def work(fresh):
        if not raced:
            raced.append(1)
            other.resume(points(spark, [(2, "other", 2)]))
        return fresh

    st.resume(points(spark, [(2, "mine", 2), (3, "mine", 3)]), work)
    assert held(st) == [(1, "a", 1), (2, "other", 2), (3, "mine", 3)]
    (tmp_path / "s" / "manifest" / "999999999998.json").write_text('{"number": 99')  # a writer lost on the way
    st.resume(points(spark, [(4, "d", 4)]))
    assert len(held(st)) == 4


def test_a_small_batch_opens_its_keys_only(spark, tmp_path):
    st = KeyedStore(spark, f"{tmp_path}/s", points(spark, []).schema, ["k"])
    st.resume(spark.range(1000).selectExpr("id as k", "'n' as name", "1 as v"))
    plan = st.missing(points(spark, [(5, "a", 1), (5000, "b", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "_bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "In(_h" in plan


def test_index_streams_add_to_one_another(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"word{i} common") for i in range(9)], "chunk_id string, embed_text string")
    for name, rows in (("one", chunks.where("chunk_id < 'c4'")), ("two", chunks.where("chunk_id > 'c1'"))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")

    def run(source, checkpoint):
        jobs.index_stream(spark.readStream.schema(chunks.schema).parquet(f"{tmp_path}/{source}"), hashing_embedder(), f"{tmp_path}/store", f"{tmp_path}/{checkpoint}").awaitTermination()
        return sorted(r.chunk_id for r in jobs.index_store(spark, f"{tmp_path}/store", chunks.schema).read().collect())

    first = [f"c{i}" for i in range(4)]
    assert run("one", "a") == first and run("one", "a") == first  # the same checkpoint again
    assert run("one", "b") == first  # a lost checkpoint: batch 0 once more, by another stream
    assert run("two", "c") == [f"c{i}" for i in range(9)]  # a second source takes nothing away
    ids = {jobs.stream_id(spark, f"{tmp_path}/{c}") for c in "abc"}
    assert len(ids) == 3 and set(KeyedStore(spark, f"{tmp_path}/store", chunks.schema, ["chunk_id"]).manifest()["done"]) == ids


def test_questions_are_answered_once(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"word{i} common") for i in range(6)], "chunk_id string, embed_text string")
    index, vectors = bm25_index(chunks, buckets=2, slices=2), embed_texts(chunks)
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return hashing_embedder()(texts)

    def ask(name, rows, checkpoint):
        q = spark.createDataFrame(rows, "query_id string, question string")
        q.write.mode("append").parquet(f"{tmp_path}/{name}")
        jobs.answer_stream(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/{name}"), index, chunks, vectors, embed, f"{tmp_path}/out", f"{tmp_path}/{checkpoint}", top_k=2).awaitTermination()
        store = jobs.answers_store(spark, f"{tmp_path}/out", q.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType)
        return {r.query_id: [c.chunk_id for c in r.chunks] for r in store.read().collect()}

    got = ask("q", [("q1", "word3"), ("q2", "word5 common"), ("q2", "word5 common")], "ck")
    assert got["q1"][0] == "c3" and got["q2"][0] == "c5" and all(len(v) == 2 for v in got.values())
    before = calls.value
    assert ask("q", [("q1", "word1"), ("q3", "word0")], "ck")["q1"] == got["q1"]  # asked again in a later batch
    new = calls.value - before
    assert ask("other", [("q1", "word3"), ("q3", "word0")], "ck2").keys() == {"q1", "q2", "q3"}  # and by another stream
    assert calls.value - before == new  # what is answered is not embedded again


def test_a_batch_is_embedded_once(spark, tmp_path):
    """Blocks, both searches and the reranker read stored vectors of a batch's questions."""
    chunks = spark.createDataFrame([(f"c{i}", f"word{i} common") for i in range(6)], "chunk_id string, embed_text string")
    index, vectors = bm25_index(chunks, buckets=2, slices=2), embed_texts(chunks)
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return hashing_embedder()(texts)

    q = spark.createDataFrame([(i, f"word{i % 6} common") for i in range(20)], "query_id long, question string")
    q.write.parquet(f"{tmp_path}/q")
    jobs.answer_stream(spark.readStream.schema(q.schema).parquet(f"{tmp_path}/q"), index, chunks, vectors, embed, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert calls.value == 20
    rows = jobs.answers_store(spark, f"{tmp_path}/out", q.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType).read().collect()
    assert {r.query_id: r.chunks[0].chunk_id for r in rows} == {i: f"c{i % 6}" for i in range(20)}
