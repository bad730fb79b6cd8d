"""SimHash near-duplicates: fingerprints, vantage-point shards, exact Hamming links, components.

Fingerprint: A-Z lower-cased, words, 4-word shingles with repeats, XXH64 with seed 42; a bit is set if
more than half of the shingles set it. Two fingerprints link at ``radius`` or fewer differing bits.

Search. Two codes within ``radius`` of one another differ by at most ``radius // parts`` bits in at least
one of ``parts`` bit blocks, and Hamming distance on a block is a metric of its own. So each block has a
vantage-point tree: a node holds a vantage code and a ball radius; a code goes to the ball or to the
outside (its home), and by the triangle bound a code outside can only match inside the ball if it lies
within the block radius of the ball's edge. Such codes are sent to the ball's side as guests, and guests go
on to every shard that their own bounds do not exclude. In a shard home codes meet homes and guests, and
all 64 bits are compared: the links are exact, whatever the trees look like. The trees are built on a
bounded sample of fingerprints (``sample_codes``, at most a quarter of all), which changes the balance only.

Scale. Equal fingerprints are one code. A shard of over ``block_rows`` rows gets a tree of its own, built in a task on a
sample of its home codes (about ``sample_codes``) over its block or over all 64 bits, whichever saves more; its rows are
dealt in parts that each route themselves by it, and shards still too large go through the same again (``levels`` times).
What no tree can split is dealt in pairs of hash blocks of ``block_rows`` rows, each a task of its own. A shard returns a
forest (each code with its local root), never all pairs.

Edge cases: null, empty and wordless texts have fingerprint zero and link like any other; a text of
fewer words than a shingle is one shingle; repeated ids keep one row each; an empty table gives an empty table. Ids may be of any
ordered type. A row without id links like any other and so joins its neighbours; it gets their component, and null if no row there
has an id. Texts are read whole, 16,320 shingles at a time. Other columns are left out, so none clashes.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, stored
from .components import components


#: Shingles hashed at a time, so that a very long text's bits are never held at once.
SHINGLES = 255 * 64


def fingerprint(text: str | None, width: int = 4) -> int:
    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and splits at the six space characters only
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = ends[min(width, len(words)) - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES):
        spans = zip(starts[at : at + SHINGLES].tolist(), stops[at : at + SHINGLES].tolist(), strict=True)
        h = np.array([digest(joined[s:e], 42) for s, e in spans], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), 8), axis=1, bitorder="little")
        for k in range(0, len(h), 255):  # sums of up to 255 bits fit a byte, which keeps them vectorised
            ones += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", width: int = 4, keep: list[str] | None = None) -> DataFrame:
    """docs (or its ``keep`` columns) with ``code``: the fingerprint as a signed 64-bit integer."""

    def task():
        return lambda texts: {"code": [x - (1 << 64) if x >> 63 else x for x in (fingerprint(t, width) for t in texts)]}

    return map_texts(docs, text_col, task, [T.StructField("code", T.LongType())], keep=keep, drop_text=keep is not None and text_col not in keep)


# --- vantage-point trees -------------------------------------------------------------------------


def build_tree(sample: np.ndarray, mask: int, radius: int, leaf: int, seed: int) -> dict[str, np.ndarray]:
    """A vantage-point tree over the block ``mask``: arrays point, ball, inner, outer; leaves are numbered ~k."""
    rng = np.random.default_rng(seed)
    point, ball, inner, outer, leaves = [], [], [], [], [0]

    def grow(codes: np.ndarray) -> int:
        best = None
        for v in codes[rng.integers(len(codes), size=4)] if len(codes) > leaf else ():
            d = np.bitwise_count((codes ^ v) & np.uint64(mask))
            for r in np.unique(d)[:-1]:
                # both sides' sizes, the ball's with the guests from its edge; smaller is a better split
                cost = np.count_nonzero(d <= r + radius) ** 1.5 + np.count_nonzero(d > r) ** 1.5
                if cost < len(codes) ** 1.5 and (best is None or cost < best[0]):
                    best = (cost, r, v, d)
        if best is None:
            leaves[0] += 1
            return -leaves[0]
        _, r, v, d = best
        at = len(point)
        for x, value in ((point, v), (ball, r), (inner, 0), (outer, 0)):
            x.append(value)
        inner[at], outer[at] = grow(codes[d <= r]), grow(codes[d > r])
        return at

    root = grow(sample)
    return {"root": root, "leaves": leaves[0], "point": np.array(point, np.uint64), "ball": np.array(ball, np.int64), "inner": np.array(inner, np.int64), "outer": np.array(outer, np.int64), "mask": np.uint64(mask), "radius": radius}


def route(tree: dict, codes: np.ndarray, at_home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of codes, leaf, home?) for each shard a code belongs to or has to visit; codes that are not ``at_home`` only visit."""
    rows, leaf, home = [], [], []
    own = np.ones(len(codes), bool) if at_home is None else at_home
    todo = [(tree["root"], np.nonzero(own)[0], np.nonzero(~own)[0])]
    while todo:
        node, own, guest = todo.pop()
        if node < 0:
            for x, is_home in ((own, True), (guest, False)):
                rows.append(x)
                leaf.append(np.full(len(x), -node - 1))
                home.append(np.full(len(x), is_home))
            continue
        if not len(own) + len(guest):
            continue
        v, r, slack = tree["point"][node], tree["ball"][node], tree["radius"]
        d = np.bitwise_count((codes[own] ^ v) & tree["mask"]).astype(np.int64)
        g = np.bitwise_count((codes[guest] ^ v) & tree["mask"]).astype(np.int64)
        edge = own[(d > r) & (d <= r + slack)]
        todo.append((tree["inner"][node], own[d <= r], np.concatenate([guest[g <= r + slack], edge])))
        todo.append((tree["outer"][node], own[d > r], guest[g > r - slack]))
    return np.concatenate(rows), np.concatenate(leaf), np.concatenate(home)


def block_masks(parts: int) -> list[int]:
    cuts = np.linspace(0, 64, parts + 1).astype(int)
    return [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def forest(codes: np.ndarray, first: np.ndarray, second: np.ndarray, radius: int, step: int = 256) -> np.ndarray:
    """Local component label (index) of each code, from comparing rows ``first`` with columns ``second``."""
    label = np.arange(len(codes))
    right = codes[second]
    for at in range(0, len(first), step):
        rows = first[at : at + step]
        i, j = np.nonzero(np.bitwise_count(codes[rows][:, None] ^ right[None, :]) <= radius)
        i, j = rows[i], second[j]
        while True:
            x, y = label[i], label[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (up := label[label] != label).any():
                label[up] = label[label[up]]
    return label


def comparisons(tree: dict, codes: np.ndarray) -> int:
    """Pairs of codes that meet in the leaves of a tree."""
    _, leaf, home = route(tree, codes)
    return int(np.bincount(leaf[home], minlength=tree["leaves"]) @ np.bincount(leaf, minlength=tree["leaves"]))


def _few(rows: DataFrame) -> DataFrame:
    """A stored table as the sent side of a join while it is small; beyond that Spark shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= 500_000 else rows


def split_shards(placed: DataFrame, loads: DataFrame, radius: int, parts: int, sample_codes: int, shard_codes: int, block_rows: int) -> tuple[DataFrame, bool]:
    """``placed`` with its ``loads`` shards dealt to the leaves of trees of their own; False if no tree saves at least half."""
    masks = block_masks(parts)

    def grow(key, pdf):
        codes = pdf["code"].to_numpy(np.int64).view(np.uint64)
        leaf = max(8, int(shard_codes * len(codes) / max(1, int(pdf["homes"].iloc[0]))))
        trees = [build_tree(codes, m, r, leaf, seed) for seed, (m, r) in enumerate([(masks[int(pdf["block"].iloc[0])], radius // parts), ((1 << 64) - 1, radius)])]
        cost, best = min((comparisons(t, codes), i) for i, t in enumerate(trees))
        return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(trees[best])]} if 2 * cost < len(codes) ** 2 else {"shard": [], "tree": []})

    rate = F.greatest(F.lit(1), F.floor(F.col("homes") / sample_codes))
    some = placed.join(_few(loads), "shard").where(F.col("home") & (F.pmod(F.xxhash64("code", F.lit(12)), rate) == 0))
    trees = stored(some.select("shard", "block", "code", "homes").groupBy("shard").applyInPandas(grow, "shard long, tree binary"))
    ways = _few(stored(trees.select("shard").join(loads, "shard").select("shard", F.ceil(F.col("rows") / block_rows).cast("int").alias("pieces"))))
    if not ways.head(1):
        return placed, False
    rows = placed.join(ways, "shard").withColumn("piece", F.pmod(F.xxhash64("code", F.lit(13)), F.col("pieces")).cast("int")).drop("pieces")
    sent = trees.join(ways, "shard").select("shard", "tree", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))

    def deal(pdf, sent):
        tree = pickle.loads(sent["tree"].iloc[0])
        at, leaf, home = route(tree, pdf["code"].to_numpy(np.int64).view(np.uint64), pdf["home"].to_numpy(bool))
        return pd.DataFrame({"shard": pdf["shard"].to_numpy()[at], "leaf": leaf, "block": pdf["block"].to_numpy()[at], "code": pdf["code"].to_numpy()[at], "rep": pdf["rep"].to_numpy()[at], "home": home})

    dealt = rows.groupBy("shard", "piece").cogroup(sent.groupBy("shard", "piece")).applyInPandas(deal, "shard long, leaf long, block int, code long, rep long, home boolean")
    # should two shards' hashes ever agree they are one shard, which costs comparisons and no link
    return stored(placed.join(ways, "shard", "left_anti").unionByName(dealt.withColumn("shard", F.xxhash64("shard", "leaf")).drop("leaf"))), True


def links(codes: DataFrame, radius: int = 4, parts: int = 3, sample_codes: int = 20_000, shard_codes: int = 2000, block_rows: int = 30_000, levels: int = 3) -> DataFrame:
    """Links (a, b) between the ``rep`` values of distinct ``code`` rows: a forest with the components of all pairs within ``radius``."""
    spark = codes.sparkSession
    n = codes.count()
    some = [r[0] for r in codes.where(F.pmod(F.xxhash64("code", F.lit(11)), F.lit(max(4, n // sample_codes))) == 0).select("code").limit(2 * sample_codes).collect()]
    sample = np.array(some, np.int64).view(np.uint64)
    share = len(sample) / max(1, n)
    trees = [build_tree(sample, m, radius // parts, max(8, int(shard_codes * share)), seed) for seed, m in enumerate(block_masks(parts))]
    base = np.cumsum([0] + [t["leaves"] for t in trees])
    sent = spark.sparkContext.broadcast(trees)  # bounded by sample_codes

    def shards(batches):
        for pdf in batches:
            c = pdf["code"].to_numpy(np.int64).view(np.uint64)
            for k, t in enumerate(sent.value):
                rows, leaf, home = route(t, c)
                yield pd.DataFrame({"shard": leaf + base[k], "block": k, "code": c[rows].view(np.int64), "rep": pdf["rep"].to_numpy()[rows], "home": home})

    placed = stored(codes.select("code", "rep").mapInPandas(shards, "shard long, block int, code long, rep long, home boolean"))

    def large() -> DataFrame:
        """Shards over ``block_rows``: at most a row for each ``block_rows`` rows of ``placed``."""
        return stored(placed.groupBy("shard").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).where(F.col("rows") > block_rows))

    loads = large()
    for _ in range(levels):
        if not loads.head(1):
            break
        placed, split = split_shards(placed, loads, radius, parts, sample_codes, shard_codes, block_rows)
        if not split:
            break
        loads = large()
    ways = loads.select("shard", F.ceil(F.col("rows") / block_rows).cast("int").alias("blocks"))
    dealt = placed.drop("block").join(_few(ways), "shard", "left").fillna({"blocks": 1})
    own = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    pairs = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = pairs.select("shard", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "code", "rep", "home")

    def compare(key, pdf):
        _, lo, hi = key
        c = pdf["code"].to_numpy(np.int64).view(np.uint64)
        own, home, rep = pdf["own"].to_numpy(), pdf["home"].to_numpy(), pdf["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        c, own, home, rep = c[order], own[order], home[order], rep[order]
        where = np.nonzero
        if lo == hi:
            label = forest(c, where(home)[0], np.arange(len(c)), radius)
        else:
            label = forest(c, where(home & (own == lo))[0], where(own == hi)[0], radius)
            more = forest(c, where(home & (own == hi))[0], where((own == lo) & ~home)[0], radius)
            hit = where(more != np.arange(len(c)))[0]
            got = where(label != np.arange(len(c)))[0]
            return pd.DataFrame({"a": rep[np.concatenate([got, hit])], "b": rep[np.concatenate([label[got], more[hit]])]})
        got = where(label != np.arange(len(c)))[0]
        return pd.DataFrame({"a": rep[got], "b": rep[label[got]]})

    return tasks.groupBy("shard", "lo", "hi").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, width: int = 4, **search) -> DataFrame:
    """(id, ``code``, ``component_id``): the smallest id reachable over links of at most ``radius`` bits."""
    prints = stored(fingerprints(docs, text_col, width, keep=[id_col]).withColumnRenamed(id_col, "id"))
    named = stored(prints.groupBy("code").agg(F.min("id").alias("least")))
    # codes are the nodes, whatever their ids are, so that texts without id link others too
    found = stored(components(links(named.select("code", F.col("code").alias("rep")), radius, **search)))
    least = named.join(found, named.code == found.node).groupBy("component").agg(F.min("least").alias("component_id"))
    linked = found.join(least, "component").select(F.col("node").alias("code"), F.lit(True).alias("linked"), "component_id")
    named = named.join(linked, "code", "left").select("code", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(named, "code", "left").select(F.col("id").alias(id_col), "code", "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")
