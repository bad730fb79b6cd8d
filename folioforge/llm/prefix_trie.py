"""Conversation prefix trie: blocks of turns first, single turns only where siblings part within a block.

Each turn has a digest of its content and place; the digest of a prefix is the running exclusive or of its turns' (two
times 64 bits), so a prefix has one digest in whatever conversation it stands. Every conversation is cut into *blocks* of
``block`` turns. Conversations are first grouped by their successive blocks: a block is known by the digests before and after it.
Where all conversations that share what is before a block go on with one and the same block, its turns are nodes with
the block's members, and no member is looked at again. Only where sibling blocks differ (or one ends early) are
their turns grouped one by one, a row for each distinct block and not for each member.

A node is a distinct sequence of the first turns of a conversation; its id is (conv_id, depth), the smallest member and the
number of turns. Sums over subtrees take no descent: every node counts in the conversation that is its smallest member,
conversations add up their nodes from the end, and what each has below a prefix is added up by prefix.

Scale. Texts are read once and never shuffled, only digests and word counts are; all groups have partial sums. A conversation is sorted as one
window partition, which Spark streams and spills. Lookups of a parent by its children send the parents of over 1/10,000 of all
nodes (so under 10,000 rows) and join the rest. Ids of the conversations that end at a node are joined in ordered pieces, one range a task, and
the pieces of a node pass through its SHA-256 one after another.

Edge cases: rows with a null conv_id are no conversation; a null turn comes first; turns of one number stand in the order of their
content's digests (equal ones are interchangeable); a null role or text is empty; repeated rows are turns of their own; conversations without turns are
members of the root; long conversations and texts are taken whole; an empty table gives no node, not even a root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 4
NODE = ["d", "p1", "p2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, c1, c2, words): the turns in order, with the digest of their content and the number of words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").alias("conv"), "turn", F.xxhash64(role, text).alias("c1"), F.xxhash64(F.lit(77), role, text).alias("c2"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "c1", "c2")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).drop("turn")


def shared_openings(conversations: DataFrame, group: int = 20, longest: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share openings: (turns with their new place ``d``, all conversations).

    Conversation c begins with the first h turns of c - c % group (all, if it has fewer), h = crc32(c) % (longest + 1), and goes on with its own after its first h.
    """
    h: Column = F.crc32(F.col("conv").cast("string")) % (longest + 1)
    turns = turns_of(conversations)
    heads = turns_of(conversations.where(F.col("conv_id") % group == 0)).where(F.col("pos") <= longest).withColumnRenamed("conv", "base")
    convs = conversations.where("conv_id is not null").select(F.col("conv_id").alias("conv")).distinct()
    taken = heads.groupBy("base").agg(F.max("pos").alias("there"))
    based = convs.withColumn("base", F.col("conv") - F.col("conv") % group)
    pre = stored(based.join(taken, "base", "left").select("conv", "base", F.least(h, F.coalesce("there", F.lit(0))).alias("pre")))
    front = pre.join(heads, "base").where(F.col("pos") <= F.col("pre")).select("conv", F.col("pos").alias("d"), "c1", "c2", "words")
    own = turns.where(F.col("pos") > h).join(pre.select("conv", "pre"), "conv").select("conv", (F.col("pos") - h + F.col("pre")).alias("d"), "c1", "c2", "words")
    return front.unionByName(own), pre.select("conv")


def _lookup(many: DataFrame, one: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``many`` joined with the row of ``one`` for its keys; ``weight`` says how many rows of ``many`` a row serves, the heaviest meet them where they are."""
    total = one.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    hot = one.where(F.col(weight) * 10_000 > total)  # under 10,000 rows
    rest = one.where(F.col(weight) * 10_000 <= total)
    return many.join(F.broadcast(hot), keys).unionByName(many.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(rest, keys))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, d, q1, q2, p1, p2, words): every turn with the digests of what is before it and of what ends with it."""
    marks = turns.select("conv", "d", "words", F.xxhash64("d", "c1", "c2").alias("h1"), F.xxhash64(F.lit(77), "c2", "d", "c1").alias("h2"))
    so_far = Window.partitionBy("conv").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    run = marks.withColumns({"p1": F.bit_xor("h1").over(so_far), "p2": F.bit_xor("h2").over(so_far)})
    return run.select("conv", "d", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "p1", "p2", "words")


def nodes_below_root(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(d, p1, p2, q1, q2, words, n, m) for every node: digests of its prefix and of its parent's, words of its last turn, members, smallest member."""
    k = F.floor((F.col("d") - 1) / block).alias("k")
    turn = F.struct("d", "q1", "q2", "p1", "p2", "words")
    inner = F.array_sort(F.collect_list(turn))  # ``block`` turns at most
    blocks = stored(rows.groupBy("conv", k).agg(inner.alias("inner")).select("conv", "k", F.col("inner")[0]["q1"].alias("b1"), F.col("inner")[0]["q2"].alias("b2"), F.element_at("inner", -1)["p1"].alias("e1"), F.element_at("inner", -1)["p2"].alias("e2"), "inner"))
    distinct = stored(blocks.groupBy("k", "b1", "b2", "e1", "e2").agg(F.count("*").alias("n"), F.min("conv").alias("m")))
    siblings = stored(distinct.groupBy("k", "b1", "b2").agg(F.count("*").alias("siblings")))
    told = _lookup(distinct, siblings, ["k", "b1", "b2"], "siblings").select("m", "k", "n", "siblings")
    shown = stored(told.join(blocks.select(F.col("conv").alias("m"), "k", "inner"), ["m", "k"]))
    each = lambda df: df.select(F.explode("inner").alias("t"), "n", "m").select("t.*", "n", "m")
    whole = each(shown.where("siblings = 1"))
    parted = each(shown.where("siblings > 1")).groupBy(NODE).agg(*[F.max(c).alias(c) for c in ("q1", "q2", "words")], F.sum("n").alias("n"), F.min("m").alias("m"))
    return whole.unionByName(parted.select(whole.columns))


def _pieces(ends: DataFrame, ids: int = 4096) -> DataFrame:
    """(d, p1, p2, first, ids): the ids that end at each node in ordered, comma-joined pieces."""

    def run(batches):
        for b in batches:
            keys = list(zip(*[b.column(i).to_pylist() for i in range(3)], strict=True))
            conv, out, at = b.column(3).to_pylist(), [], 0
            while at < len(keys):
                upto = at + 1
                while upto < len(keys) and upto - at < ids and keys[upto] == keys[at]:
                    upto += 1
                out.append((*keys[at], conv[at], ",".join(map(str, conv[at:upto]))))
                at = upto
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)], names=[*NODE, "first", "ids"])

    ordered = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")
    return ordered.select(*NODE, "conv").mapInArrow(run, "d long, p1 long, p2 long, first long, ids string")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(d, p1, p2, ends_sha256) of the nodes at which conversations (column conv) end."""

    def run(batches):
        key, digest = None, None
        for b in batches:
            out = []
            for row in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if row[:3] != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = row[:3], hashlib.sha256(row[3].encode())
                else:
                    digest.update(("," + row[3]).encode())
            if out:
                yield batch(out)
        if key is not None:
            yield batch([(*key, digest.hexdigest())])

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*NODE, "ends_sha256"])

    return _pieces(ends).repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(run, "d long, p1 long, p2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv, d from 1, c1, c2, words); ``convs`` has the ids of all conversations, turnless ones too."""
    rows = stored(prefixes(turns))
    convs = convs.select(F.col("conv").cast("long")).distinct()
    low = stored(nodes_below_root(rows, block))
    children = stored(low.groupBy((F.col("d") - 1).alias("d"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children")))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("m")).where("n > 0").select(*[zero.alias(c) for c in (*NODE, "q1", "q2", "words")], "n", "m")
    nodes = stored(low.unionByName(root).join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    parents = nodes.where("n_children > 0").select((F.col("d") + 1).alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("m").alias("parent"), "n_children")
    parented = _lookup(nodes.select(*NODE, "q1", "q2").where("d > 0"), parents, ["d", "q1", "q2"], "n_children").select(*NODE, "parent")

    counted = stored(nodes.where("d > 0").select(F.col("m").alias("conv"), "d", ((F.col("n") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf")))
    from_end = Window.partitionBy("conv").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    below = rows.select("conv", *NODE).join(counted, ["conv", "d"], "left").withColumns({"saved": F.sum("saved").over(from_end), "leaf": F.sum("leaf").over(from_end)})
    sums = below.where("leaf is not null").groupBy(NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    whole = counted.agg(F.coalesce(F.sum("saved"), zero).alias("saved_tokens"), F.greatest(F.coalesce(F.sum("leaf"), zero), F.lit(1)).cast("long").alias("n_leaves")).select(*[zero.alias(c) for c in NODE], "saved_tokens", "n_leaves")

    last = rows.groupBy("conv").agg(F.max(F.struct(*NODE)).alias("e"))
    ends = stored(convs.join(last, "conv", "left").select("conv", *[F.coalesce(F.col(f"e.{c}"), zero).alias(c) for c in NODE]))
    out = nodes.join(parented, NODE, "left").join(sums.unionByName(whole), NODE, "left").join(ends_digests(ends), NODE, "left")
    return out.select(F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op12(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return prefix_trie(*shared_openings(table(spark, sf_dir, "conversations")))


_CRC_STEPS = ",\n".join(f"s{k + 1} AS (SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END AS v FROM s{k})" for k in range(8))
OP12_SQL = rf"""
WITH s0 AS (SELECT i, i::BIGINT AS v FROM range(256) r(i)),
{_CRC_STEPS},
crc AS (SELECT list(v ORDER BY i) AS l FROM s8),
ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(l[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 AS h FROM ids, crc),
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r0 AS (SELECT h.c, 0 AS part, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.base AND t.pos <= h.h UNION ALL SELECT h.c, 1, t.pos, t.role, t.text FROM h JOIN t ON t.c = h.c AND t.pos > h.h),
r1 AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS d, role, text FROM r0),
r2 AS (SELECT c, d, md5(to_json(list([role, text]) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING))::VARCHAR) AS node, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r1
  UNION ALL SELECT c, 0, 'root', 0 FROM ids),
r AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS ends FROM r2),
n AS (SELECT node, d, min(c) AS m, count(*) AS n, any_value(up) AS up, any_value(words) AS words, string_agg(CASE WHEN ends = d THEN c::VARCHAR END, ',' ORDER BY c) AS ended FROM r GROUP BY node, d),
k AS (SELECT up AS node, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
v AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k USING (node)),
b AS (SELECT r.node, sum((v.n - 1) * v.words) AS saved_tokens, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves FROM v JOIN r ON r.c = v.m AND r.d <= v.d GROUP BY r.node)
SELECT v.m AS conv_id, v.d::BIGINT AS depth, p.m AS parent_conv_id, v.n AS n_convs, v.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ended, '')) AS ends_sha256
FROM v JOIN b USING (node) LEFT JOIN v p ON p.node = v.up
"""
