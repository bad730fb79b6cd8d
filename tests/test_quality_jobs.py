"""Data-quality jobs: clean tables give no rows, faults are found."""

from pyspark.sql import functions as F

from folioforge.operators import quality as qa
from folioforge.operators.chunks import build_chunks

REC = "doc_id long, pos long, id string, page_start int, page_end int, section_id string, section_title string, section_path array<string>, type string, text string"


def records(spark):
    kinds = ["paragraph", "list_item", "list_item", "paragraph", "list_item"]
    return spark.createDataFrame([(d, n, f"rec{n:04d}", n, n, f"{d}.{n // 2}", "T", [f"{d}.{n // 2} T"], kinds[n % 5], f"Text {n} here.") for d in (1, 2) for n in range(1, 12)], REC)


def test_chunks_of_records_are_clean(spark):
    r = records(spark)
    c = build_chunks(r)
    assert qa.record_coverage(r, c).count() == 0 and qa.section_mismatches(r, c).count() == 0
    assert qa.field_faults(c, ["chunk_id"], ["display_text"]).count() == 0 and qa.prefix_faults(c).count() == 0 and qa.basic_faults(r).count() == 0
    assert qa.duplicate_keys(c, ["doc_id", "chunk_id"]).count() == 0
    assert qa.character_differences(r, c.select("doc_id", F.col("display_text").alias("text"))).count() == 0


def test_coverage_faults(spark):
    r = records(spark).where("doc_id = 1 and pos < 4")
    c = spark.createDataFrame([(1, ["rec0001", "rec0001"]), (1, ["rec0003", "recX"])], "doc_id long, source_record_ids array<string>")
    assert {(x.record_id, x.problem) for x in qa.record_coverage(r, c).collect()} == {("rec0002", "missing"), ("recX", "unknown"), ("rec0001", "used twice")}


def test_prefix_and_field_faults(spark):
    c = spark.createDataFrame([(1, "a", "callout", "exception", "5", "[EXCEPTION] [5 x]\nt", 1, "t"), (1, "b", "callout", None, "5", "[5 x]\nt", 2, "t"), (1, "c", "paragraph", None, "5", "[x]\n5", 1, " ")], "doc_id long, chunk_id string, type string, callout_kind string, section_id string, embed_text string, n_chars int, display_text string")
    assert {r.chunk_id: r.faults for r in qa.prefix_faults(c).collect()} == {"b": ["tag", "callout_kind"], "c": ["section_id"]}
    assert {r.chunk_id: r.faults for r in qa.field_faults(c, ["callout_kind"], ["display_text"]).collect()} == {"b": ["callout_kind null", "n_chars"], "c": ["callout_kind null", "display_text empty"]}


def test_needles(spark):
    c = spark.createDataFrame([(1, 1, "5.1", "Fee is  MRL"), (1, 2, "5.1.2", "2,500 a term"), (1, 3, "52", "other"), (2, 1, "5.1", "held by the second document only")], "doc_id long, chunk_no long, section_id string, display_text string")
    n = spark.createDataFrame([("a", 1, "5", "fee IS mrl 2,500"), ("b", 1, "5.1.2", "fee"), ("c", 1, "5", "other"), ("d", 1, "9", "x"), ("e", 1, "5", "held by"), ("f", 2, "5", "held by"), ("g", 2, "5.1", "fee")], "query_id string, doc_id long, section_id string, needle string")
    assert {r.query_id: r.found for r in qa.needles_found(n, c).collect()} == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": True, "g": False}


def test_contents_and_numbering(spark):
    s = "doc_id long, id string, title string, page int, level int"
    toc = spark.createDataFrame([(1, "1", "A", 1, 1), (1, "1.1", "B", 2, 2), (1, "2", "C", 3, 1), (1, "3", "gone", 9, 1)], s)
    heads = spark.createDataFrame([(1, "1", "A", 1, 1), (1, "1.1", "b", 2, 2), (1, "1.1.1", "fine", 2, 3), (1, "2", "C", 4, 1), (1, "2.1", "extra", 4, 2)], s)
    assert {r.id: r.problem for r in qa.contents_differences(toc, heads).collect()} == {"1.1": "title", "2": "page", "3": "missing", "2.1": "extra"}
    h = spark.createDataFrame([(1, i, n) for n, i in enumerate(["1", "1.1", "1.3", "2", "2.1", "2.1", "4.1", "3"])], "doc_id long, id string, pos int")
    assert sorted((r.id, r.problem) for r in qa.numbering_faults(h).collect()) == [("1.3", "number"), ("2.1", "number"), ("4.1", "parent")]


def test_leaks_patterns_and_sets(spark):
    r = spark.createDataFrame([(1, "a", "Page 4 of 9"), (1, "b", "text"), (2, "c", "Page 1 of 1")], "doc_id long, id string, text string")
    p = spark.createDataFrame([(1, "Page # of #")], "doc_id long, pattern string")
    assert [x.id for x in qa.leaked_running_text(r, p).collect()] == ["a"]
    assert qa.unexpected_patterns(p, p).count() == 0
    a, b = spark.createDataFrame([("1",), ("2",), ("2",)], "s string"), spark.createDataFrame([("2",), ("3",)], "s string")
    assert {(x.s, x.side) for x in qa.set_differences(a, b).collect()} == {("1", "unexpected"), ("3", "missing")}


def test_table_cells(spark):
    t = spark.createDataFrame([(1, "Table 1", ["k", "x", "y"], [["a", "1", "2"], ["b", "3"]]), (2, "Table 1", ["k", "x"], [["a", "7"]])], "doc_id long, table_id string, header array<string>, rows array<array<string>>")
    cells = qa.table_cells(t)
    assert {(r.doc_id, r.row_key, r.column): r.value for r in cells.collect()} == {(1, "a", "x"): "1", (1, "a", "y"): "2", (1, "b", "x"): "3", (1, "b", "y"): None, (2, "a", "x"): "7"}
    assert [(r.row_no, r.n_cells) for r in qa.ragged_rows(t).collect()] == [(1, 2)]
    want = spark.createDataFrame([(1, "Table 1", "a", "x", "1"), (1, "Table 1", "a", "y", "9"), (1, "Table 1", "z", "x", "1"), (2, "Table 1", "a", "x", "1")], "doc_id long, table_id string, row_key string, column string, expected string")
    assert {(r.doc_id, r.row_key, r.column) for r in qa.cell_mismatches(cells, want).collect()} == {(1, "a", "y"), (1, "z", "x"), (2, "a", "x")}


def test_text_counts_and_words(spark):
    a = spark.createDataFrame([(1, "aab-é1"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "ab é2")], "doc_id long, text string")
    assert {(r.ch, r.n_left, r.n_right) for r in qa.character_differences(a, b).collect()} == {("a", 2, 1), ("1", 1, 0), ("2", 0, 1)}
    odd = spark.createDataFrame([(None, "ß\U00020000\U00020000 ٣"), (3, "x" * 50), (3, ""), (3, "x!")], "doc_id long, text string")
    assert {(r.doc_id, r.ch, r.n_left, r.n_right) for r in qa.character_differences(odd, odd.limit(0)).collect()} == {(None, "ß", 1, 0), (None, "\U00020000", 2, 0), (None, "٣", 1, 0), (3, "x", 51, 0)}
    assert qa.character_differences(odd, odd).count() == 0
    parts = qa.character_counts(odd, step=7).groupBy("doc_id", "ch").sum("n").where("ch = 'x'").first()
    assert (parts[0], parts[2]) == (3, 51)
    entries = spark.createDataFrame([(1, "15.1", "a", "glossary_entry"), (1, "15.1", "b", "glossary_entry"), (2, "15.1", "a", "glossary_entry"), (2, "15.1", "a", "glossary_entry"), (3, None, None, "glossary_entry"), (3, "15.1", None, "glossary_entry"), (4, "2", "a", "paragraph")], "doc_id long, section_id string, term string, type string")
    assert sorted(map(tuple, qa.glossary_faults(entries, "15.1").collect())) == [(2, 2, 0, 1), (3, 2, 1, 0)]
    r = spark.createDataFrame([(1, "x", "paragraph", "Parking lot,"), (1, "y", "paragraph", "lower start."), (1, "z", "paragraph", "Fine."), (1, "w", "table", "low"), (1, "v", "paragraph", "List of")], "doc_id long, id string, type string, text string")
    assert {x.id: x.warning for x in qa.paragraph_warnings(r).collect()} == {"x": "ends open", "y": "starts lower-case", "v": "ends open"}
    assert {x.word: x.n_records for x in qa.excluded_words(r, ["parking", "alumni"]).collect()} == {"parking": 1, "alumni": 0}
    lines = spark.createDataFrame([(1, "•"), (1, "•"), (2, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "list_item"), (2, "paragraph")], "doc_id long, type string")
    assert [tuple(x) for x in qa.kind_counts(lines, items, F.col("text") == "•").collect()] == [(1, 2, 1)]


def test_questions_and_pages(spark):
    q = spark.createDataFrame([("a", 1, ["5", "9"])], "query_id string, doc_id long, sections array<string>")
    h = spark.createDataFrame([(1, "5", 3), (2, "5", 1), (2, "9", 2)], "doc_id long, id string, page int")
    r = spark.createDataFrame([(1, "5.1", 4, 5), (1, "5", 3, 3), (1, "52", 9, 9), (1, None, 1, 1), (2, "5.2", 1, 8), (2, "9", 2, 2)], "doc_id long, section_id string, page_start int, page_end int")
    assert {x.section_id: (x.heading_page, x.first_page, x.last_page) for x in qa.question_pages(q, h, r).collect()} == {"5": (3, 3, 5), "9": (None, None, None)}
    n = spark.createDataFrame([("a", 1, "5", "x"), ("a", 1, "7", "y"), ("a", 2, "9", "y")], "query_id string, doc_id long, section_id string, needle string")
    assert sorted(x.section_id for x in qa.unlisted_needles(n, q).collect()) == ["7", "9"]
    lines = spark.createDataFrame([(1, 1, "cover"), (1, 2, "Page 2 of 4"), (1, 3, "Page 3 of 9"), (1, 4, "none")], "doc_id long, page int, text string")
    assert sorted(x.page for x in qa.page_number_faults(lines).collect()) == [3, 4]


def test_summary(spark):
    empty, one = spark.range(0), spark.range(3)
    s = qa.summary([("a", empty, "FAIL"), ("b", one, "WARN")])
    assert {r.check_name: (r.status, r.n_bad) for r in s.collect()} == {"a": ("PASS", 0), "b": ("WARN", 3)}
    assert qa.verdict(s).first().overall == "WARN" and qa.verdict(qa.summary([("c", one, "FAIL")])).first().overall == "FAIL"
