"""Positioned lines to section-tagged records.

Everything is keyed by ``doc_id``; pages are bounded, so a page's lines may be folded as one array, and a
document's records are ordered by ``pos`` within one window partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_id, heading_title, norm, table_markdown, without_digits

HEADER_Y, FOOTER_Y = 55.0, 775.0
HEADING_SIZES = (18.0, 14.0, 12.0)
PARAGRAPH_GAP, INDENT_TOLERANCE = 25.0, 6.0
#: Fixed patterns: a dot leader with its page, and a table's caption.
LEADER = r"^(?:\. ?)+(\d+)$"
CAPTION = r"^(Table \d+)\.\s+(.+)$"
BULLET = "•"
ENDINGS = r"[.!?:;)]$"


def line_from_spans(spans: DataFrame) -> DataFrame:
    """Lines from their spans: text, and the size, bold and italic of the first non-blank span.

    ``lead`` is the leading bold run, kept only if the line also has a span that is not bold. Lines of blank spans alone go.
    """
    full = F.filter("spans", lambda s: F.trim(s["text"]) != "")
    bold = F.transform(full, lambda s: F.contains(s["font"], F.lit("Bold")))
    rest = F.array_position(bold, F.lit(False))  # 1-based; 0: all bold
    lead = F.array_join(F.transform(F.slice(full, 1, F.greatest(rest.cast("int") - 1, F.lit(0))), lambda s: s["text"]), "")
    first = full[0]
    out = spans.where(F.size(full) > 0).withColumns({
        "text": norm(F.array_join(F.transform("spans", lambda s: s["text"]), "")),
        "size": F.round(first["size"], 1),
        "bold": F.contains(first["font"], F.lit("Bold")),
        "italic": first["font"].rlike("Ital|Obli"),
        "lead": norm(lead),
    })
    return out.drop("spans")


def heading_level(sizes: tuple[float, float, float] = HEADING_SIZES) -> Column:
    """1 to 3 by size (3 only in italics) for bold lines without a lead, else 0."""
    size = F.col("size")
    level = F.when(size == sizes[0], 1).when(size == sizes[1], 2).when((size == sizes[2]) & F.col("italic"), 3).otherwise(0)
    return F.when(F.col("bold") & (F.coalesce("lead", F.lit("")) == ""), level).otherwise(0)


def body_lines(lines: DataFrame, top: float = HEADER_Y, bottom: float = FOOTER_Y) -> DataFrame:
    return lines.where(F.col("y0").between(top, bottom))


def running_lines(lines: DataFrame, top: float = HEADER_Y, bottom: float = FOOTER_Y) -> DataFrame:
    """(doc_id, pattern, n_lines) of what ``body_lines`` cuts, digits as ``#``."""
    return lines.where(~F.col("y0").between(top, bottom)).groupBy("doc_id", without_digits(F.col("text")).alias("pattern")).agg(F.count("*").alias("n_lines"))


def contents_pages(lines: DataFrame, title: str = "Table of Contents", leader: str = LEADER) -> DataFrame:
    """(doc_id, page) of the contents: from the titled page while pages hold dot-leader lines."""
    pages = lines.groupBy("doc_id", "page").agg(F.max((F.col("text") == title).cast("int")).alias("titled"), F.max(F.col("text").rlike(leader).cast("int")).alias("led"))
    start = pages.where("titled = 1").groupBy("doc_id").agg(F.min("page").alias("start"))
    after = pages.join(start, "doc_id").where("page >= start")
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.sum(F.when(F.col("led") == 1, 0).otherwise(1)).over(w)
    return after.withColumn("gaps", gap).where("gaps = 0").select("doc_id", "page")


def body_start(lines: DataFrame, title: str = "Table of Contents", leader: str = LEADER) -> DataFrame:
    """(doc_id, body_start): the page after the last page of the contents; documents without contents have no row."""
    return contents_pages(lines, title, leader).groupBy("doc_id").agg((F.max("page") + 1).alias("body_start"))


def contents_entries(lines: DataFrame, title: str = "Table of Contents", leader: str = LEADER, tolerance: float = 2.0) -> DataFrame:
    """(doc_id, id, title, page, level): each dot leader with the first numbered line at its height on its page."""
    here = lines.join(contents_pages(lines, title, leader), ["doc_id", "page"], "left_semi")
    dots = here.where(F.col("text").rlike(leader)).select("doc_id", F.col("page").alias("on"), F.col("y0").alias("ly"), F.col("line_no").alias("leader_no"), F.regexp_extract("text", leader, 1).try_cast("int").alias("target"))
    names = here.where(heading_id(F.col("text")) != "").select("doc_id", F.col("page").alias("on"), "y0", "x0", "line_no", "text")
    pairs = dots.join(names, ["doc_id", "on"]).where((F.abs(F.col("y0") - F.col("ly")) <= tolerance) & (F.col("line_no") != F.col("leader_no")))
    w = Window.partitionBy("doc_id", "on", "leader_no").orderBy(F.round("y0"), "x0", "line_no")
    best = pairs.withColumn("n", F.row_number().over(w)).where("n = 1")
    sid = heading_id(F.col("text"))
    return best.select("doc_id", sid.alias("id"), heading_title(F.col("text")).alias("title"), F.col("target").alias("page"), (F.size(F.split(sid, r"\."))).alias("level"))


def outside_tables(lines: DataFrame, tables: DataFrame, slack: float = 1.0) -> DataFrame:
    """Lines whose centre height and left edge lie in no table region of their page: a range anti-join below (doc, page)."""
    box = tables.select("doc_id", "page", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    centre = (F.col("y0") + F.col("y1")) / 2
    inside = F.col("x0").between(F.col("t_x0") - slack, F.col("t_x1") + slack) & centre.between(F.col("t_y0") - slack, F.col("t_y1") + slack)
    return lines.alias("l").join(box.alias("t"), (F.col("l.doc_id") == F.col("t.doc_id")) & (F.col("l.page") == F.col("t.page")) & inside, "left_anti")


def attach_captions(tables: DataFrame, captions: DataFrame, above: float = 40.0, overlap: float = 3.0) -> DataFrame:
    """Tables with the nearest caption above (``caption``, null if none); each caption serves once, in table order.

    The choice is greedy, so the page's captions are folded along its ordered tables.
    """
    caps = captions.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y1", "line_no", "text"))).alias("caps"))
    regions = tables.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("table_no", "y0"))).alias("regions"))
    pages = regions.join(caps, ["doc_id", "page"], "left")
    cap_type = pages.schema["caps"].dataType.simpleString()
    start = F.struct(F.coalesce("caps", F.array().cast(cap_type)).alias("free"), F.array().cast("array<struct<table_no:int,line_no:int,text:string>>").alias("got"))

    def step(s: Column, t: Column) -> Column:
        near = F.filter(s["free"], lambda c: (c["y1"] <= t["y0"] + overlap) & (t["y0"] - c["y1"] <= above))
        low = F.array_max(F.transform(near, lambda c: c["y1"]))
        pick = F.get(F.filter(near, lambda c: c["y1"] == low), F.lit(0))
        free = F.filter(s["free"], lambda c: pick.isNull() | (c["line_no"] != pick["line_no"]))
        mine = F.struct(t["table_no"].cast("int").alias("table_no"), pick["line_no"].cast("int").alias("line_no"), pick["text"].alias("text"))
        return F.struct(free.alias("free"), F.concat(s["got"], F.array(mine)).alias("got"))

    done = pages.select("doc_id", "page", F.explode(F.aggregate("regions", start, step)["got"]).alias("m"))
    return tables.join(done.select("doc_id", "page", F.col("m.table_no").alias("table_no"), F.col("m.line_no").alias("caption_line"), F.col("m.text").alias("caption")), ["doc_id", "page", "table_no"], "left")


def uncaptioned_tables(attached: DataFrame) -> DataFrame:
    return attached.where("caption_line is null")


def unused_captions(captions: DataFrame, attached: DataFrame) -> DataFrame:
    used = attached.where("caption_line is not null").select("doc_id", "page", F.col("caption_line").alias("line_no"))
    return captions.join(used, ["doc_id", "page", "line_no"], "left_anti")


def with_sections(elements: DataFrame, levels: int = 3) -> DataFrame:
    """Elements (ordered by ``pos``, headings having ``level`` > 0, ``heading_id``, ``heading_title``) with section_id, section_title, section_path.

    A heading replaces its level and clears the deeper ones: a null pair marks the reset, and the last mark of each level holds.
    A heading-styled line without a number is no heading (see ``heading_warnings``).
    """
    level = F.when(F.coalesce("heading_id", F.lit("")) != "", F.col("level")).otherwise(0)
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    none = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("title"))
    own = F.struct(F.col("heading_id").alias("id"), F.col("heading_title").alias("title"))
    stack = [F.last(F.when(level == k, own).when(level.between(1, k - 1), none), ignorenulls=True).over(w) for k in range(1, levels + 1)]
    out = elements.withColumn("_stack", F.array(*stack)).withColumn("_stack", F.filter("_stack", lambda x: x["id"].isNotNull()))
    last = F.get("_stack", F.size("_stack") - 1)
    return out.withColumns({"section_id": last["id"], "section_title": last["title"], "section_path": F.transform("_stack", lambda x: F.concat_ws(" ", x["id"], x["title"]))}).drop("_stack")


def heading_warnings(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text) of heading-styled lines (``level`` > 0) without a number."""
    return lines.where((F.col("level") > 0) & (heading_id(F.col("text")) == "")).select("doc_id", "page", "line_no", "text")


def element_kind(glossary: str = "15") -> Column:
    """Kind of a text line: list_item, callout, glossary_entry (below the glossary section) or paragraph."""
    lead, section = F.coalesce("lead", F.lit("")), F.coalesce("section_id", F.lit(""))
    in_glossary = (section == glossary) | F.startswith(section, F.lit(glossary + "."))
    return (
        F.when(F.col("text") == BULLET, "list_item")
        .when(F.startswith(lead, F.lit("AMENDMENT")) | F.startswith(lead, F.lit("Exception to")), "callout")
        .when((lead != "") & in_glossary, "glossary_entry")
        .otherwise("paragraph")
    )


def callout_kind() -> Column:
    return F.when(F.startswith("lead", F.lit("AMENDMENT")), "amendment").otherwise("exception")


def term() -> Column:
    return F.regexp_replace("lead", r"\.+$", "")


def paragraphs(lines: DataFrame, gap: float = PARAGRAPH_GAP, indent: float = INDENT_TOLERANCE) -> DataFrame:
    """Elements of each page: lines (doc_id, page, pos, kind, lead, text, x0, y0; headings and tables as kind heading, table) folded in order.

    A plain line continues the open element on the same page if it lies 0 to ``gap`` below its last line
    and within ``indent`` of the element's first x (after a bullet, of its first text line). The anchor makes this a
    fold over the page's array, not a lag. Returns (doc_id, page, pos, kind, lead, text, page_top).
    """
    row = F.struct("pos", "kind", F.coalesce("lead", F.lit("")).alias("lead"), "text", F.col("x0").cast("double").alias("x0"), F.col("y0").cast("double").alias("y0"))
    pages = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    item = "struct<pos:bigint,kind:string,lead:string,parts:array<string>,x:double,y:double,top:boolean>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"), F.lit(False).alias("seen"))

    def step(s: Column, r: Column) -> Column:
        closes = r["kind"].isin("heading", "table")
        starts = (r["text"] == BULLET) | (r["lead"] != "")
        o = s["open"]
        near = (r["y0"] - o["y"]).between(0, gap) & (o["x"].isNull() | (F.abs(r["x0"] - o["x"]) <= indent))
        goes_on = ~closes & ~starts & o.isNotNull() & F.coalesce(near, F.lit(False))
        bullet = r["text"] == BULLET
        fresh = F.struct(
            r["pos"].cast("long").alias("pos"), r["kind"].alias("kind"), r["lead"].alias("lead"),
            F.when(bullet, F.array().cast("array<string>")).otherwise(F.array(r["text"])).alias("parts"),
            F.when(~bullet, r["x0"]).alias("x"), r["y0"].alias("y"), (~starts & ~s["seen"]).alias("top"),
        )
        more = F.struct(o["pos"].alias("pos"), o["kind"].alias("kind"), o["lead"].alias("lead"), F.concat(o["parts"], F.array(r["text"])).alias("parts"), F.coalesce(o["x"], r["x0"]).alias("x"), r["y0"].alias("y"), o["top"].alias("top"))
        done = F.when(goes_on | o.isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(o)))
        now = F.when(goes_on, more).when(closes, F.lit(None).cast(item)).otherwise(fresh)
        return F.struct(done.alias("done"), now.cast(item).alias("open"), (s["seen"] | ~closes).alias("seen"))

    end = F.aggregate("rows", start, step, lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    out = pages.select("doc_id", "page", F.explode(end).alias("e")).where(F.size("e.parts") > 0)
    return out.select("doc_id", "page", F.col("e.pos").alias("pos"), F.col("e.kind").alias("kind"), F.col("e.lead").alias("lead"), norm(F.array_join("e.parts", " ")).alias("text"), F.col("e.top").alias("page_top"))


def _joins() -> Column:
    """Whether a record continues its predecessor over a page break. A predecessor that was itself joined still ends like its last part."""
    w = Window.partitionBy("doc_id").orderBy("pos")

    def prev(c: str) -> Column:
        return F.lag(c).over(w)

    first = F.substring("text", 1, 1)
    lower = first.rlike(r"^\p{Ll}")
    fits = prev("type").isin("paragraph", "list_item", "callout") & (prev("page_end") == F.col("page_start") - 1) & prev("section_id").eqNullSafe(F.col("section_id")) & ~prev("text").rlike(ENDINGS)
    return F.coalesce(F.col("page_top") & (F.col("type") == "paragraph") & lower & fits, F.lit(False))


def stitch_pages(records: DataFrame) -> DataFrame:
    """Records with those joined that a page break split: texts joined by a space, the last page taken, the first's other fields kept."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = records.withColumn("_new", F.when(_joins(), 0).otherwise(1)).withColumn("_group", F.sum("_new").over(w))
    keep = [c for c in records.columns if c not in ("doc_id", "text", "page_end")]
    parts = F.array_sort(F.collect_list(F.struct("pos", "text")))
    out = marked.groupBy("doc_id", "_group").agg(*[F.min_by(c, "pos").alias(c) for c in keep], F.max_by("page_end", "pos").alias("page_end"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    return out.select(records.columns)


def stitch_log(records: DataFrame) -> DataFrame:
    """(doc_id, pos, section_id, page, joined_at) of every join."""
    return records.where("true").withColumn("_join", _joins()).where("_join").select("doc_id", "pos", "section_id", F.col("page_start").alias("page"), F.substring("text", 1, 40).alias("joined_at"))


def numbered(records: DataFrame) -> DataFrame:
    """Records with ``id`` (rec0001 ...) in order within the document, and ``n_chars``."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return records.withColumns({"id": F.format_string("rec%04d", n), "n_chars": F.length("text")})


def parse_report(records: DataFrame, headings: DataFrame, patterns: DataFrame, joins: DataFrame, warnings: DataFrame) -> DataFrame:
    """(doc_id, part, key, n): a document's records by type, headings by level, removed lines by pattern, joins over page breaks by page, warnings by page."""

    def part(df: DataFrame, name: str, key: Column, n: Column) -> DataFrame:
        return df.groupBy("doc_id", F.lit(name).alias("part"), key.cast("string").alias("key")).agg(n.cast("long").alias("n"))

    each = [
        part(records, "records", F.col("type"), F.count("*")), part(headings, "headings", F.col("level"), F.count("*")), part(patterns, "removed", F.col("pattern"), F.sum("n_lines")),
        part(joins, "joins", F.col("page"), F.count("*")), part(warnings, "warnings", F.col("page"), F.count("*")),
    ]
    return reduce(DataFrame.unionByName, each)


def touching_page(records: DataFrame, page: int) -> DataFrame:
    return records.where(F.lit(page).between(F.col("page_start"), F.col("page_end")))


def table_records(attached: DataFrame) -> DataFrame:
    """A record for each table: its id ("Table 3", null without a number), caption ("Table ?" without one), header, the rows below it, and text."""
    caption = F.coalesce(F.nullif("caption", F.lit("")), F.lit("Table ?"))
    body = F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    return attached.withColumns({"caption": caption, "table_id": F.nullif(F.regexp_extract(caption, CAPTION, 1), F.lit("")), "header": F.col("rows")[0], "text": table_markdown(caption, F.col("rows")), "rows": body})
