"""Context, prompts, completions, citations and amendments."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CITATION = "struct<chunk_id:string,section_id:string,page:int,quote:string>"
RESPONSE = f"struct<answer:string,citations:array<{CITATION}>,refusal:boolean>"
AMENDMENT = r"AMENDMENT (\d+)"
EFFECTIVE = r"effective (\d{1,2} [A-Z][a-z]+ \d{4})"


def context_block(chunk_id: Column, section_id: Column, title: Column, page_start: Column, page_end: Column, text: Column) -> Column:
    pages = F.when(page_start == page_end, F.concat(F.lit("p. "), page_start.cast("string"))).otherwise(F.concat(F.lit("pp. "), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    return F.concat(F.lit("--- [CHUNK "), chunk_id, F.lit(" | Section "), F.coalesce(section_id, F.lit("Unknown")), F.lit(": "), F.coalesce(title, F.lit("")), F.lit(" | "), pages, F.lit("] ---\n"), text)


def format_context(retrieved: DataFrame, rank: str = "final_rank") -> DataFrame:
    """(query_id, context): the retrieved chunks' blocks in rank order, joined by an empty line. A query has at most its top k chunks.

    A block shows the embed text, which holds tags and section path, else the display text.
    """
    text = F.coalesce("embed_text", "display_text", F.lit(""))
    block = context_block(*[F.col(c) for c in ("chunk_id", "section_id", "section_title", "page_start", "page_end")], text)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), block.alias("block"))))
    return retrieved.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def prompts(queries: DataFrame, contexts: DataFrame, template: tuple[str, str] = ("CONTEXT:\n", "\n\nQUESTION: ")) -> DataFrame:
    """Queries with ``prompt``; a query without context gets an empty one."""
    joined = queries.join(contexts, "query_id", "left")
    return joined.withColumn("prompt", F.concat(F.lit(template[0]), F.coalesce("context", F.lit("")), F.lit(template[1]), F.col("question")))


def complete(prompted: DataFrame, primary: Callable[[str], str], fallback: Callable[[str], str] | None = None, names: tuple[str, str] = ("primary", "fallback"), partitions: int | None = None) -> DataFrame:
    """(query_id, response_json, model_used, latency_sec) from injected completion functions; the fallback answers where the primary fails. Latency counts both."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf["prompt"]:
                start = time.monotonic()
                try:
                    row = primary(p), names[0]
                except Exception:
                    if fallback is None:
                        raise
                    row = fallback(p), names[1]
                rows.append((*row, time.monotonic() - start))
            yield pd.DataFrame({"query_id": pdf["query_id"], "response_json": [r[0] for r in rows], "model_used": [r[1] for r in rows], "latency_sec": [r[2] for r in rows]})

    source = prompted.coalesce(partitions) if partitions else prompted
    return source.select("query_id", "prompt").mapInPandas(run, f"query_id {prompted.schema['query_id'].dataType.simpleString()}, response_json string, model_used string, latency_sec double")


def parse_responses(responses: DataFrame) -> DataFrame:
    """Responses with answer, citations and refusal; absent or malformed parts get '', [] and false."""
    r = F.from_json("response_json", RESPONSE)
    return responses.withColumn("_r", r).withColumns({
        "answer": F.coalesce("_r.answer", F.lit("")),
        "citations": F.coalesce("_r.citations", F.array().cast(f"array<{CITATION}>")),
        "refusal": F.coalesce("_r.refusal", F.lit(False)),
    }).drop("_r")


def citation_rows(responses: DataFrame) -> DataFrame:
    """One row a citation: (query_id, n, chunk_id, section_id, page, quote), page 1 by default."""
    return responses.select("query_id", F.posexplode("citations").alias("n", "c")).select("query_id", "n", "c.chunk_id", "c.section_id", F.coalesce("c.page", F.lit(1)).alias("page"), F.coalesce("c.quote", F.lit("")).alias("quote"))


def enrich_citations(citations: DataFrame, retrieved: DataFrame, rank: str = "final_rank") -> DataFrame:
    """Citations with ``section_title``: of the query's retrieved chunks by section, else by chunk, else "Section x". The last retrieved chunk of a section gives its title; with ``doc_id`` on both sides, a section is one of its document."""
    title = F.nullif(F.col("section_title"), F.lit(""))
    same = ["query_id", "section_id", *(["doc_id"] if "doc_id" in retrieved.columns and "doc_id" in citations.columns else [])]
    by_section = retrieved.groupBy(*same).agg(F.max_by(title, rank).alias("_by_section"))
    by_chunk = retrieved.groupBy("query_id", "chunk_id").agg(F.max_by(title, rank).alias("_by_chunk"))
    out = citations.join(by_section, same, "left").join(by_chunk, ["query_id", "chunk_id"], "left")
    return out.withColumn("section_title", F.coalesce("_by_section", "_by_chunk", F.concat(F.lit("Section "), F.coalesce("section_id", F.lit(""))))).drop("_by_section", "_by_chunk")


def amendments(records: DataFrame) -> DataFrame:
    """(doc_id, number, effective, section_id) of the amendment callouts, read from their lead or text."""
    said = F.concat_ws(" ", "lead_in", "text")
    return records.where(F.col("callout_kind") == "amendment").select("doc_id", F.nullif(F.regexp_extract(said, AMENDMENT, 1), F.lit("")).cast("int").alias("number"), F.try_to_timestamp(F.nullif(F.regexp_extract(said, EFFECTIVE, 1), F.lit("")), F.lit("d MMMM yyyy")).cast("date").alias("effective"), "section_id")


def amended_citations(citations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(query_id, amended): whether any citation (doc_id, section_id, quote) lies in an amended section of its document or names one of the document's amendments in its quote."""
    known = catalogue.select("doc_id", "number", "section_id").distinct()
    by_section = citations.join(known, ["doc_id", "section_id"], "left_semi").select("query_id")
    named = citations.select("query_id", "doc_id", F.explode(F.regexp_extract_all(F.lower("quote"), F.lit(r"amendment (\d+)"), F.lit(1))).alias("n")).withColumn("number", F.col("n").try_cast("int"))
    by_name = named.join(known, ["doc_id", "number"], "left_semi").select("query_id")
    hit = by_section.union(by_name).distinct().withColumn("hit", F.lit(True))
    return citations.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("amended"))
