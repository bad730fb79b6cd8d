"""Column expressions on text and section ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def norm(text: Column) -> Column:
    """Every white-space run (no-break spaces too) as one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def flat(text: Column) -> Column:
    return F.lower(norm(text))


def tokenize(text: Column) -> Column:
    """Lower-case Unicode word tokens, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def without_digits(text: Column) -> Column:
    """Runs of digits as ``#``: the pattern of a running header or footer."""
    return F.regexp_replace(text, r"\d+", "#")


def heading_id(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\d+(?:\.\d+)*)\s+(.+)$", 1)


def heading_title(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\d+(?:\.\d+)*)\s+(.+)$", 2)


def ancestors(section: Column) -> Column:
    """A dotted id's own and its ancestors' ids: "5.5.2" gives 5, 5.5, 5.5.2. Turns subtree tests into equi-joins."""
    parts = F.split(section, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def in_subtree(section: Column, root: Column) -> Column:
    return (section == root) | F.startswith(section, F.concat(root, F.lit(".")))


def sections_match(target: Column, candidate: Column) -> Column:
    """Trimmed and non-empty; equal, one the other's dotted ancestor, or the candidate naming "section <target>"."""
    t, c = F.trim(target), F.trim(candidate)
    named = F.contains(F.lower(c), F.concat(F.lit("section "), F.lower(t)))
    return F.coalesce((t != "") & (c != "") & (in_subtree(c, t) | in_subtree(t, c) | named), F.lit(False))


def clean_cell(cell: Column, fixes: dict[str, str] | None = None) -> Column:
    """A table cell's text: null is empty, line breaks are spaces, known misreadings are put right."""
    text = norm(F.regexp_replace(F.coalesce(cell, F.lit("")), "\n", " "))
    if not fixes:
        return text
    table = F.create_map(*[F.lit(x) for pair in fixes.items() for x in pair])
    return F.coalesce(F.element_at(table, text), text)


def table_markdown(caption: Column, rows: Column) -> Column:
    """Caption line, header row, rule row and body rows. The first row is the header."""

    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))

    rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), F.size(rows[0])))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.concat_ws("\n", F.nullif(caption, F.lit("")), line(rows[0]), rule, F.when(F.size(body) > 0, F.array_join(body, "\n")))
