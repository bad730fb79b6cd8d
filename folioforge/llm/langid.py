"""Language identification by Bayesian evidence fusion.

log P(language | evidence) adds, for every document: the text likelihood (hashed character trigrams of
the whole text, trained on a bounded sample of labelled rows), the declared markup language, the address suffix, the host, and the
corpus's prior. The tables for declaration, suffix and host are counted over all documents by grouped aggregation, from the text's own
verdicts; a host's prior is smoothed towards its domain's, that towards its address suffix's, and that towards the whole corpus's.
The suffix's evidence is what its prior adds to the corpus's, log P(suffix | language) up to a constant; the host's is what its prior
adds to its suffix's. A host determines its suffix, so the host's whole prior beside the suffix would count the suffix twice.

The column that the text model is trained on may be the declaration too if ``folds`` is 2 or more: a text is then judged by a model
without its fold, so that its label does not vouch for itself. Folds go by a text's bytes; exact copies share one. A language with
all its sampled texts in one fold is the exception, as no other texts can tell it: those texts are judged by themselves.

A text's trigrams are not independent: their mean log likelihood counts as at most ``weight`` trigrams.
A document is rejected if it has no letters, or if no language reaches ``min_posterior``.

Edge cases: null or letterless text gives language ``und`` and is rejected; a null
declaration is left out; rows without host or suffix share the prior of all such rows; no labelled rows: every document is ``und`` and rejected, as is
an empty table's (empty) result. Of languages with equal scores the first by name is taken. Texts of any length are read whole.
Decisions carry the id (of any type, null too); repeated rows and ids are judged alike, one by one; other columns are left out,
so none clashes. The sample depends on the texts alone, not on how rows lie in files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stored

BUCKETS = 1 << 16
SOURCES = ("text", "declared", "suffix", "host", "corpus")


def trigram_hash(text: str) -> np.ndarray:
    """Bucket of each trigram of the lower-cased letters, other characters becoming single spaces."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(a < 128, np.where((a >= 97) & (a <= 122), a, 32), a).astype(np.uint32)
    if len(a):
        a = a[~((a == 32) & np.concatenate(([False], a[:-1] == 32)))]
    a = np.concatenate(([np.uint32(32)], a, [np.uint32(32)])).astype(np.uint32)
    h = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def fold_of(text: str, folds: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % folds if folds > 1 else 0


def has_letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", max_rows: int = 3000, seed: int = 5, min_rows: int = 50, folds: int = 1) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities (fold x bucket x language) from about ``max_rows`` labelled rows (documented bound).

    The languages are those of all labelled rows; of each, about ``min_rows`` rows at least (all, if it has no more) are read besides.
    A row is in the sample by a hash of its text. Trigrams are counted in the tasks; a row a language, fold and bucket comes to the driver.
    With several folds, each one's table is counted from the texts of the others, and the sample is larger by so much that both bounds hold for each table.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))
    sizes = {label: k for label, k in rows.groupBy("label").count().toLocalIterator()}  # a row a language
    n = sum(sizes.values())
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((folds, BUCKETS, 0), np.float32)
    if folds > 1:
        max_rows, min_rows = max_rows * folds // (folds - 1), min_rows * folds // (folds - 1)
    if n > max_rows:
        shares = F.create_map(*[F.lit(x) for label, k in sizes.items() for x in (label, 1.0 if k <= min_rows else min(1.0, max(max_rows / n, 2 * min_rows / k)))])
        rows = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) < F.element_at(shares, F.col("label")) * 1_000_000)

    def count(batches):
        for b in batches:
            totals: dict[tuple[str, int], np.ndarray] = {}
            for label, text in zip(b.column("label").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                key, seen = (label, fold_of(text, folds)), np.bincount(trigram_hash(text), minlength=BUCKETS)
                totals[key] = totals[key] + seen if key in totals else seen
            for (label, fold), total in totals.items():
                at = np.nonzero(total)[0]
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(at)), pa.array([fold] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["label", "fold", "bucket", "n"])

    found = rows.mapInArrow(count, "label string, fold int, bucket int, n long").groupBy("label", "fold", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((folds, BUCKETS, len(langs)))
    column = {x: k for k, x in enumerate(langs)}
    counts[found["fold"].to_numpy(), found["bucket"].to_numpy(), [column[x] for x in found["label"].to_pylist()]] += found["n"].to_numpy()
    if folds > 1:
        every = counts.sum(axis=0)
        others = every - counts
        counts = np.where(others.any(axis=1, keepdims=True), others, every)
    table = counts + 0.05
    return langs, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(docs: DataFrame, model, text_col: str = "text", weight: float = 40.0, keep: list[str] | None = None) -> DataFrame:
    """docs with ``ll``: the tempered log likelihood of each language (null without letters)."""
    langs, logp = model
    sent = docs.sparkSession.sparkContext.broadcast(logp)  # folds x BUCKETS x languages

    def task():
        tables = sent.value

        def one(text):
            if not langs or not text or not has_letters(text):
                return None
            h, table = trigram_hash(text), tables[fold_of(text, len(tables))]
            total = np.zeros(len(langs))
            for at in range(0, len(h), 1 << 16):
                total += table[h[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
            total *= min(1.0, weight / len(h))
            return (total - total.max()).tolist()

        return lambda texts: {"ll": [one(t) for t in texts]}

    return map_texts(docs, text_col, task, [T.StructField("ll", T.ArrayType(T.DoubleType()))], keep=keep, drop_text=keep is not None and text_col not in keep)


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """The address suffix; null for a name without dots."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def _best(ll: str, langs: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, langs)) if langs else F.array().cast("array<string>"), F.array_position(ll, F.array_max(ll)).cast("int") - 1)


def _smoothed(counts: DataFrame, key: str, parent: DataFrame | None, parent_key: Column | None, n_langs: int, strength: float) -> DataFrame:
    """(key, prior array): counts shrunk towards the parent's prior by ``strength`` pseudo-documents."""
    if parent is None:
        return counts.select(key, F.transform("n", lambda x: (x + strength / n_langs) / (F.aggregate("n", F.lit(0.0), lambda a, b: a + b) + strength)).alias("prior"))
    up = parent.toDF("_up", "_prior")
    joined = counts.withColumn("_at", parent_key).join(up, F.col("_at").eqNullSafe(F.col("_up")), "left")
    total = F.aggregate("n", F.lit(0.0), lambda a, b: a + b) + strength
    return joined.select(key, F.transform(F.arrays_zip("n", "_prior"), lambda x: (x["n"] + strength * x["_prior"]) / total).alias("prior"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, labelled: DataFrame | None = None, label_col: str = "lang", accept: list[str] | None = None, min_posterior: float = 0.5, strength: float = 20.0, **training) -> DataFrame:
    """(id, ``lang``, ``posterior``, ``text_lang``, ``accepted``, ``evidence``) for every row of docs.

    ``evidence`` has each source's log evidence for the languages in order of their names (zeros: none); the posterior comes from its sum.
    """
    model = train(labelled if labelled is not None else docs, text_col, label_col, **training)
    langs = model[0]
    k = len(langs)
    declared = F.lower(F.substring_index(declared, "-", 1)) if declared is not None else F.lit(None).cast("string")
    host = F.lower(host) if host is not None else F.lit(None).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), declared.alias("declared"), host.alias("host"))
    ev = stored(text_evidence(slim, model, "text", keep=["id", "declared", "host"]).withColumn("text_lang", _best("ll", langs)))
    if not k:
        return ev.select(F.col("id").alias(id_col), F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.col("text_lang"), F.lit(False).alias("accepted"), F.lit(None).cast("struct<" + ",".join(f"{x}:array<double>" for x in SOURCES) + ">").alias("evidence"))

    def tally(keys: list[str], source: DataFrame) -> DataFrame:
        return source.groupBy(*keys).agg(F.array(*[F.sum(F.element_at("n", i + 1)) for i in range(k)]).alias("n"))

    # one count by host and declaration; all coarser tables are sums of it
    fine = stored(ev.where("text_lang is not null").groupBy("host", "declared").agg(F.array(*[F.count_if(F.col("text_lang") == x).cast("double") for x in langs]).alias("n")))
    hosts = tally(["host"], fine).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = tally(["domain", "suffix"], hosts)
    suffixes = tally(["suffix"], hosts)
    everything = tally([], suffixes).where("n[0] is not null").withColumn("all", F.lit(0))
    p_all = _smoothed(everything, "all", None, None, k, strength)
    p_suffix = _smoothed(suffixes, "suffix", p_all, F.lit(0), k, strength)
    p_domain = _smoothed(domains, "domain", p_suffix, F.col("suffix"), k, strength)
    p_host = _smoothed(hosts, "host", p_domain, F.col("domain"), k, strength)
    # P(declaration | language), with a share for what was never seen
    given = _likelihood(tally(["declared"], fine), "declared", k)
    # each host with the priors of its suffix and of the corpus: rows of ev meet them all in one join
    above = p_suffix.toDF("_s", "by_suffix").crossJoin(F.broadcast(p_all.select(F.col("prior").alias("by_all"))))
    places = p_host.toDF("_h", "by_host").join(above, suffix_of(F.col("_h")).eqNullSafe(F.col("_s")), "left")

    fused = (
        ev.join(places, F.col("host").eqNullSafe(F.col("_h")), "left")
        .join(given.toDF("_d", "given"), F.col("declared") == F.col("_d"), "left")
    )
    zero = F.array_repeat(F.lit(0.0), k)
    added = lambda a, b: F.coalesce(F.zip_with(a, b, lambda x, y: F.log(x) - F.log(y)), zero)
    corpus = F.coalesce(F.transform("by_all", lambda x: F.log(x)), zero)
    sources = {"text": F.col("ll"), "declared": F.coalesce("given", zero), "suffix": added("by_suffix", "by_all"), "host": added("by_host", "by_suffix"), "corpus": corpus}
    fused = fused.withColumn("evidence", F.when(F.col("ll").isNotNull(), F.struct(*[sources[x].alias(x) for x in SOURCES])))
    fused = fused.withColumn("score", F.transform(F.arrays_zip(*[F.col(f"evidence.{x}") for x in SOURCES]), lambda e: sum((e[x] for x in SOURCES[1:]), e[SOURCES[0]])))
    fused = fused.withColumn("top", F.array_max("score")).withColumn("best", _best("score", langs))
    posterior = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    ok = F.coalesce(F.col("posterior") >= min_posterior, F.lit(False)) & (F.col("best").isin(accept) if accept else F.lit(True))
    out = fused.withColumn("posterior", F.coalesce(posterior, F.lit(0.0))).withColumn("accepted", F.coalesce(ok, F.lit(False)))
    return out.select(F.col("id").alias(id_col), F.coalesce("best", F.lit("und")).alias("lang"), "posterior", "text_lang", "accepted", "evidence")


def _likelihood(counts: DataFrame, key: str, k: int) -> DataFrame:
    """(key, log P(key | language)) over the non-null keys, add-half smoothed."""
    seen = counts.where(F.col(key).isNotNull())
    total = seen.agg(F.array(*[F.sum(F.element_at("n", i + 1)) for i in range(k)]).alias("sums"), F.count("*").alias("kinds"))
    return seen.crossJoin(F.broadcast(total)).select(key, F.transform(F.arrays_zip("n", "sums"), lambda x: F.log((x["n"] + 0.5) / (x["sums"] + 0.5 * (F.col("kinds") + 1)))).alias("given"))


def op9(spark, sf_dir: str) -> DataFrame:
    """``lang`` is the declaration, ``source`` the host, with its suffix where it has one. ``lang`` labels the training sample too, hence the two folds."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    return identify(docs, declared=F.col("lang"), host=F.col("source"), folds=2).select("doc_id", F.col("lang"), "text_lang", F.round("posterior", 6).alias("posterior"), F.col("accepted").alias("kept"))


def pages_language(spark, sf_dir: str) -> DataFrame:
    """The same fusion over raw pages: markup language, address suffix and host come from the page itself."""
    from .common import table
    from .html_text import blocks

    pages = table(spark, sf_dir, "pages")
    # a tag ends at the next bracket of either kind, so that unclosed ones are read once
    given = F.nullif(F.regexp_extract("html", r"(?i)<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit(""))
    host = F.nullif(F.regexp_extract("url", r"^[a-zA-Z]+://([^/:?#]+)", 1), F.lit(""))
    told = pages.select("page_id", "html", given.alias("declared"), host.alias("host"))
    rows = map_texts(told, "html", lambda: lambda htmls: {"text": ["\n".join(t for _, t in blocks(h)) for h in htmls]}, [T.StructField("text", T.StringType())], drop_text=True)
    labelled = table(spark, sf_dir, "documents").select("text", "lang")
    return identify(rows, "page_id", "text", F.col("declared"), F.col("host"), labelled=labelled).select("page_id", "lang", "text_lang", F.round("posterior", 6).alias("posterior"), F.col("accepted").alias("kept"))
