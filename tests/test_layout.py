"""Layout and chunk operators on hand-made rows."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from folioforge.functions import text as tx
from folioforge.operators import chunks, layout

LINE = "doc_id long, page int, line_no int, text string, x0 double, x1 double, y0 double, y1 double, size double, bold boolean, italic boolean, lead string"


def line(n, text, y0, x0=72.0, size=11.0, bold=False, italic=False, lead="", page=1, doc=1):
    return (doc, page, n, text, x0, x0 + 100, float(y0), y0 + 12.0, size, bold, italic, lead)


def one(spark, expr, **cols):
    return spark.createDataFrame([Row(**cols)]).select(expr).first()[0]


def test_norm_and_tokens(spark):
    assert one(spark, tx.norm(F.col("t")), t=" a  b\n\tc ") == "a b c"
    assert one(spark, tx.tokenize(F.col("t")), t="Éa_1, b-b  B") == ["éa_1", "b", "b", "b"]
    assert one(spark, tx.ancestors(F.col("s")), s="5.5.2") == ["5", "5.5", "5.5.2"]
    assert one(spark, tx.clean_cell(F.col("c"), {"of fi ce": "office"}), c="of\nfi  ce") == "office"


def test_section_matching(spark):
    cases = [("5.5", "5.5", True), ("5.5", "5.5.2", True), ("5.5.2", "5", True), ("5.5", "5.52", False), ("5", "see Section 5", True), ("", "5", False), (" 5 ", "5", True), (None, "5", False)]
    got = spark.createDataFrame(cases, "t string, c string, ok boolean").select(tx.sections_match(F.col("t"), F.col("c")).alias("m"), "ok").collect()
    assert all(r.m == r.ok for r in got)


def test_table_markdown(spark):
    got = one(spark, tx.table_markdown(F.lit("Table 1"), F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("1"), F.lit("2")))), x=1)
    assert got == "Table 1\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert one(spark, tx.table_markdown(F.lit("T"), F.array(F.array(F.lit("a")))), x=1) == "T\n| a |\n|---|"


def test_line_from_spans(spark):
    span = "doc_id long, line_no int, spans array<struct<text:string,font:string,size:double>>"
    rows = [
        (1, 1, [(" ", "Serif", 9.0), ("Term. ", "Serif-Bold", 11.04), ("is this", "Serif", 11.0)]),
        (1, 2, [("All ", "Serif-Bold", 14.0), ("bold", "Serif-BoldItal", 14.0)]),
        (1, 3, [("plain ", "Serif-Ital", 11.0), ("bold", "Serif-Bold", 11.0)]),
        (1, 4, [("  ", "Serif", 9.0)]),
    ]
    got = {r.line_no: r for r in layout.line_from_spans(spark.createDataFrame(rows, span)).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].text, got[1].size, got[1].bold, got[1].lead) == ("Term. is this", 11.0, True, "Term.")
    assert (got[2].text, got[2].bold, got[2].italic, got[2].lead) == ("All bold", True, False, "")
    assert (got[3].bold, got[3].italic, got[3].lead) == (False, True, "")


def test_heading_levels_and_ids(spark):
    rows = [line(1, "1 One", 60, size=18.0, bold=True), line(2, "1.1 Two", 80, size=14.0, bold=True), line(3, "1.1.1 Three", 90, size=12.0, bold=True, italic=True), line(4, "Table", 95, size=12.0, bold=True), line(5, "x", 99, size=18.0, bold=True, lead="x")]
    got = spark.createDataFrame(rows, LINE).select(layout.heading_level().alias("l"), tx.heading_id(F.col("text")).alias("i"), tx.heading_title(F.col("text")).alias("t")).collect()
    assert [r.l for r in got] == [1, 2, 3, 0, 0] and got[2].i == "1.1.1" and got[2].t == "Three" and got[4].i == ""


def test_running_lines(spark):
    rows = [line(1, "Header 12", 40), line(2, "body", 55), line(3, "body", 775), line(4, "Page 3 of 41", 800), line(5, "Page 4 of 41", 801, page=2)]
    df = spark.createDataFrame(rows, LINE)
    assert layout.body_lines(df).count() == 2
    assert {(r.pattern, r.n_lines) for r in layout.running_lines(df).collect()} == {("Header #", 1), ("Page # of #", 2)}


def test_contents(spark):
    rows = [line(1, "Table of Contents", 60), line(2, "1 One", 80), line(3, ".......... 5", 81, x0=300.0), line(4, "1.1 Two", 100), line(5, ". . . . 6", 103, x0=300.0), line(6, "2 Three", 60, page=2), line(7, "..... 9", 60, x0=300.0, page=2), line(8, "body", 60, page=3), line(9, "3 No", 60, page=4), line(10, "..... 9", 60, page=4)]
    df = spark.createDataFrame(rows, LINE)
    assert sorted(r.page for r in layout.contents_pages(df).collect()) == [1, 2]
    assert [r.body_start for r in layout.body_start(df).collect()] == [3]
    spaced = df.withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\.", ". "), "  ", " "))  # "1. 1 Two" is no heading then
    assert {(r.id, r.page) for r in layout.contents_entries(spaced).collect()} == {("1", 5), ("2", 9)}
    assert {(r.id, r.title, r.page, r.level) for r in layout.contents_entries(df).collect()} == {("1", "One", 5, 1), ("2", "Three", 9, 1)}


TABLE = "doc_id long, page int, table_no int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"


def test_tables_take_lines_and_captions(spark):
    tables = spark.createDataFrame([(1, 1, 1, 70.0, 200.0, 500.0, 300.0, [["a"]]), (1, 1, 2, 70.0, 230.0, 500.0, 300.0, [["a"]]), (1, 1, 3, 70.0, 500.0, 500.0, 600.0, [["a"]]), (1, 1, 4, 70.0, 700.0, 500.0, 710.0, [["a"]])], TABLE)
    lines = spark.createDataFrame([line(1, "in", 250), line(2, "left", 250, x0=10.0), line(3, "below", 320)], LINE)
    assert sorted(r.line_no for r in layout.outside_tables(lines, tables).collect()) == [2, 3]
    caps = spark.createDataFrame([line(1, "Table 1. Fees", 175), line(2, "Table 3. Dates", 448), line(3, "Table 4. Rest", 647)], LINE)  # bottoms 187, 460, 659
    got = layout.attach_captions(tables, caps)
    # the first table takes the caption that the second could have had; 40 above is near enough, 41 is not
    assert {r.table_no: r.caption for r in got.collect()} == {1: "Table 1. Fees", 2: None, 3: "Table 3. Dates", 4: None}
    assert [r.text for r in layout.unused_captions(caps, got).collect()] == ["Table 4. Rest"]
    assert sorted(r.table_no for r in layout.uncaptioned_tables(got).collect()) == [2, 4]
    rec = {r.table_no: r for r in layout.table_records(got).collect()}
    assert rec[3].table_id == "Table 3" and rec[2].table_id is None and rec[2].text.startswith("Table ?\n")
    assert rec[3].header == ["a"] and rec[3].rows == [] and rec[3].text == "Table 3. Dates\n| a |\n|---|"


def test_sections_reset_deeper_levels(spark):
    rows = [(1, 0, 0, None, None), (1, 1, 1, "1", "A"), (1, 2, 0, None, None), (1, 3, 2, "1.1", "B"), (1, 4, 3, "1.1.1", "C"), (1, 5, 0, None, None), (1, 6, 2, "1.2", "D"), (1, 7, 0, None, None), (1, 8, 1, "2", "E"), (1, 9, 3, "2.0.1", "F"), (1, 10, 1, "", ""), (1, 11, 0, None, None), (2, 1, 0, None, None)]
    got = {(r.doc_id, r.pos): r for r in layout.with_sections(spark.createDataFrame(rows, "doc_id long, pos int, level int, heading_id string, heading_title string")).collect()}
    assert got[1, 0].section_id is None and got[1, 0].section_path == []
    assert got[1, 5].section_path == ["1 A", "1.1 B", "1.1.1 C"] and got[1, 5].section_title == "C"
    assert got[1, 7].section_path == ["1 A", "1.2 D"] and got[1, 8].section_path == ["2 E"] and got[1, 9].section_path == ["2 E", "2.0.1 F"]
    assert got[2, 1].section_id is None
    assert got[1, 11].section_path == ["2 E", "2.0.1 F"]  # a heading without a number is none
    bare = spark.createDataFrame([(1, 1, 4, "Untitled", 2), (1, 1, 5, "3 Titled", 2), (1, 1, 6, "plain", 0)], "doc_id long, page int, line_no int, text string, level int")
    assert [r.text for r in layout.heading_warnings(bare).collect()] == ["Untitled"]


def test_element_kinds(spark):
    rows = [("•", "", "1"), ("x", "AMENDMENT 1 (effective 1 January 2026).", "3"), ("x", "Exception to 5.", "15"), ("x", "Credit..", "15.2"), ("x", "Bold", "150"), ("x", "", "15"), ("x", None, None)]
    df = spark.createDataFrame(rows, "text string, lead string, section_id string")
    got = df.select(layout.element_kind().alias("k"), layout.callout_kind().alias("c"), layout.term().alias("t")).collect()
    assert [r.k for r in got] == ["list_item", "callout", "callout", "glossary_entry", "paragraph", "paragraph", "paragraph"]
    assert got[1].c == "amendment" and got[2].c == "exception" and got[3].t == "Credit"


def test_paragraphs_are_anchored_at_their_first_line(spark):
    def el(pos, text, y0, x0=72.0, kind="paragraph", lead="", page=1):
        return (1, page, pos, kind, lead, text, x0, float(y0))

    rows = [
        el(1, "a", 100), el(2, "b", 121, 76.0), el(3, "c", 142, 80.0),  # drift of 4 + 4 breaks at the anchor
        el(4, "d", 168), el(5, "e", 189, 78.0), el(6, "f", 210, 79.0),  # gap 26; shift 6 stays, 7 breaks
        el(7, "•", 300), el(8, "item", 300, 90.0), el(9, "more", 321, 90.0), el(10, "out", 342, 72.0),
        el(11, "H", 400, kind="heading"), el(12, "after", 421), el(13, "Lead. x", 442, lead="Lead."), el(14, "goes on", 463), el(15, "next page", 60, page=2),
    ]
    got = layout.paragraphs(spark.createDataFrame(rows, "doc_id long, page int, pos long, kind string, lead string, text string, x0 double, y0 double")).orderBy("page", "pos").collect()
    assert [r.text for r in got] == ["a b", "c", "d e", "f", "item more", "out", "after", "Lead. x goes on", "next page"]
    assert [r.page_top for r in got] == [True, False, False, False, False, False, False, False, True]


REC = "doc_id long, pos long, page_start int, page_end int, section_id string, type string, text string, page_top boolean"


def test_page_breaks(spark):
    rows = [
        (1, 1, 1, 1, "1", "paragraph", "This goes", False), (1, 2, 2, 2, "1", "paragraph", "on and", True), (1, 3, 3, 3, "1", "paragraph", "on.", True), (1, 4, 4, 4, "1", "paragraph", "not joined: ended", True),
        (1, 5, 5, 5, "1", "paragraph", "Upper", True), (1, 6, 6, 6, "2", "paragraph", "other section", True), (1, 7, 7, 7, "2", "table", "t", True), (1, 8, 8, 8, "2", "paragraph", "after table", True), (1, 9, 10, 10, "2", "paragraph", "page gap", True), (1, 10, 11, 11, "2", "paragraph", "not top", False),
    ]
    df = spark.createDataFrame(rows, REC)
    got = layout.stitch_pages(df).orderBy("pos").collect()
    assert (got[0].text, got[0].page_start, got[0].page_end) == ("This goes on and on.", 1, 3)
    assert len(got) == 8
    assert [(r.pos, r.joined_at) for r in layout.stitch_log(df).orderBy("pos").collect()] == [(2, "on and"), (3, "on.")]


def test_numbering_and_report(spark):
    df = layout.numbered(spark.createDataFrame([(1, 5, "ab", "paragraph"), (1, 9, "c", "list_item"), (2, 1, "d", "paragraph")], "doc_id long, pos long, text string, type string"))
    assert {(r.doc_id, r.pos): (r.id, r.n_chars) for r in df.collect()} == {(1, 5): ("rec0001", 2), (1, 9): ("rec0002", 1), (2, 1): ("rec0001", 1)}
    heads = spark.createDataFrame([(1, 1), (1, 2), (1, 2)], "doc_id long, level int")
    running = spark.createDataFrame([(2, "Page #", 4)], "doc_id long, pattern string, n_lines long")
    at = spark.createDataFrame([(1, 3)], "doc_id long, page int")
    got = {(r.doc_id, r.part, r.key): r.n for r in layout.parse_report(df, heads, running, at, at).collect()}
    assert got == {(1, "records", "paragraph"): 1, (1, "records", "list_item"): 1, (2, "records", "paragraph"): 1, (1, "headings", "1"): 1, (1, "headings", "2"): 2, (2, "removed", "Page #"): 4, (1, "joins", "3"): 1, (1, "warnings", "3"): 1}


def test_chunks(spark):
    def rec(n, kind, section="1", text=None, callout=None):
        return (1, n, f"rec{n:04d}", n, n, section, "T", ["a", "b"], kind, text or f"t{n}", callout)

    rows = [rec(1, "paragraph"), rec(2, "list_item"), rec(3, "list_item"), rec(4, "list_item"), rec(5, "list_item", "2"), rec(6, "paragraph", "2"), rec(7, "list_item", "2"), rec(8, "callout", "2", "x", "amendment"), rec(9, "list_item", "2")]
    df = spark.createDataFrame(rows, "doc_id long, pos long, id string, page_start int, page_end int, section_id string, section_title string, section_path array<string>, type string, text string, callout_kind string")
    got = chunks.build_chunks(df).orderBy("chunk_no").collect()
    assert [r.source_record_ids for r in got] == [["rec0001"], ["rec0002", "rec0003", "rec0004"], ["rec0005"], ["rec0006"], ["rec0007"], ["rec0008"], ["rec0009"]]
    assert (got[1].display_text, got[1].page_start, got[1].page_end, got[1].n_chars, got[1].chunk_id) == ("t2 t3 t4", 2, 4, 8, "chk0002")
    assert got[5].embed_text == "[AMENDMENT] [a > b]\nx" and got[0].embed_text == "[a > b]\nt1"
    stats = {r.type: r for r in chunks.size_stats(chunks.build_chunks(df)).collect()}
    assert stats["TOTAL"].n == 7 and stats["TOTAL"].n_records == 9 and stats["list_item"].max_chars == 8
