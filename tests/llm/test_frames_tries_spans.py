"""Fill-in-middle frames, the conversation trie and substring dedup against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import fill_in_middle as fim
from folioforge.llm import prefix_trie, queries, substrings

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_prefix_trie", "op13_substring_dedup"])
def test_queries_match_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations"):
        duck.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf).select(columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and len(got) > 100


# --- frames ---------------------------------------------------------------------------------------

TEXT = st.text(st.sampled_from("ab é\n\tß𝄞<>PSM"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.sampled_from([4, 5, 7, 16, 1000]), st.integers(0, 2**32), st.integers(0, 2**32))
def test_frames_seek_and_restore(text, size, h1, h2):
    x = fim.FramedText.of(text.encode(), size)
    units = UNIT.findall(text)
    assert x.n_units == len(units) and b"".join(x.pieces()).decode() == text
    form, a, b = fim.chosen([h1, h2, 0, 0], len(units), False)
    (*one, c1), (*two, c2) = x.place(a), x.place(b)
    parts = ["".join(units[:a]), "".join(units[a:b]), "".join(units[b:])]
    assert [c1, c2] == [len(parts[0]), len(parts[0] + parts[1])]
    assert [b"".join(x.pieces(*p)).decode() for p in (((0, 0), tuple(one)), (tuple(one), tuple(two)), (tuple(two), None))] == parts
    if any(m in text for m in fim.MARKS) or not text:
        return
    for form, want in (("plain", text), ("psm", "<P>{0}<S>{2}<M>{1}".format(*parts)), ("spm", "<S>{2}<P>{0}<M>{1}".format(*parts))):
        out = fim.FramedText.written(fim.transformed(x, form, tuple(one), tuple(two)), size)
        assert b"".join(out.pieces()).decode() == want and b"".join(fim.restored(out, form)).decode() == text


def test_frames_are_bounded_and_a_cut_opens_one(monkeypatch):
    text = ("word " * 50_000 + "x" * 300_000).encode()
    x = fim.FramedText.of(text, 10_000)
    assert max(len(x.frame(k)) for k in range(len(x.bytes_to))) <= 10_000
    assert zstandard.ZstdDecompressor().stream_reader(x.data, read_across_frames=True).read() == text
    opened = []
    plain = fim.FramedText.frame
    monkeypatch.setattr(fim.FramedText, "frame", lambda self, k: opened.append(k) or plain(self, k))
    assert x.place(30_000)[2] == 5 * 30_000 - 1 and len(opened) == 1


def plain_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = [int(sha(f"42:{'' if i is None else i}")[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle_on_odd_rows(spark):
    rows = [(i, t) for i in range(40) for t in ("alpha  beta\n gamma", "  ", "é𝄞 x " * 30)]
    rows += [(None, "no id here at all"), (None, None), (50, None), (51, ""), (52, "a <P> mark"), (53, "word " * 200_000), (53, "y" * 500_000), (54, "again it is"), (54, "again it is"), (-7, "minus")]
    schema = "doc_id long, text string, data string, n int, form string, marked int, other string"
    docs = spark.createDataFrame([(*r, "d", 1, "f", 0, "kept") for r in rows], schema)
    out = fim.transform(fim.pack(docs, frame_bytes=4096), frame_bytes=4096)
    texts = fim.unpack(out, "output").select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "other").collect()
    assert [tuple(r)[:6] for r in texts] == [(i, *plain_fim(i, t)) for i, t in rows] and {r.other for r in texts} == {"kept"}
    told = fim.digests(out).collect()
    assert [(r.output_sha256, r.restored_sha256) for r in told] == [(sha(plain_fim(i, t)[4]), sha(t or "")) for i, t in rows]
    assert {r.form for r in told} == {"plain", "psm", "spm"}
    assert fim.digests(fim.transform(fim.pack(docs.limit(0)))).count() == 0


# --- conversations ------------------------------------------------------------------------------------


def plain_trie(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    nodes = {}
    for c, x in whole.items():
        for d in range(len(x) + 1):
            nodes.setdefault(tuple(x[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [(k, m) for k, m in nodes.items() if k[: len(key)] == key]
        parents = {k[:-1] for k in nodes if k}
        words = lambda k: len([w for w in re.split(r"[\x20\x09-\x0D]+", k[-1][1]) if w]) if k else 0
        ended = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k, _ in below), sum(k not in parents for k, _ in below), sum((len(m) - 1) * words(k) for k, m in below), sha(ended)))
    return sorted(out, key=repr)


def odd_conversations():
    rng = random.Random(4)
    said = ["hello there", "what is it", "", None, "yes\n no", "the same answer for all"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in [*range(61), 100, 101, 139, -3] for t in range(rng.choice([1, 1, 2, 3, 9, 14]))]
    rows += [(200 + c, t, "user", f"turn {t}") for c in range(30) for t in range(13 if c < 20 else 6)]  # long alike, some ending within a block
    rows += [(300, None, "system", "null first"), (300, 0, "user", "x"), (301, None, "system", "null first"), (302, 0, "user", "dup"), (302, 0, "user", "dup"), (None, 0, "user", "nobody")]
    return rows + [(303, t, "user", "long " * 2000) for t in range(40)]


@pytest.mark.parametrize("block", [1, 2, 4, 50])
def test_trie_matches_plain_version(spark, block):
    rows = odd_conversations()
    talk = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "conv_id long, turn long, role string, text string, d int, n int, conv string")
    got = prefix_trie.prefix_trie(*prefix_trie.shared_openings(talk), block=block).collect()
    assert sorted(map(tuple, got), key=repr) == plain_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    talk = spark.createDataFrame([(20 * c, t, "user", f"said {t}") for c in range(500) for t in range(6)], "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(*prefix_trie.shared_openings(talk)).orderBy("depth").collect()
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(d, 500, int(d < 6), 1, 499 * 2 * (7 - max(1, d))) for d in range(7)]
    assert got[-1].ends_sha256 == sha(",".join(str(20 * c) for c in range(500))) and got[0].ends_sha256 == sha("")
    assert prefix_trie.prefix_trie(*prefix_trie.shared_openings(talk.limit(0))).count() == 0


def test_trie_refines_only_where_siblings_part(spark):
    """Copies are one block each; their turns are counted from the block, without a turn-level group."""
    talk = spark.createDataFrame([(20 * c, t, "user", f"said {t}" if c or t < 5 else "otherwise") for c in range(50) for t in range(8)], "conv_id long, turn long, role string, text string")
    rows = prefix_trie.prefixes(prefix_trie.shared_openings(talk)[0])
    low = prefix_trie.nodes_below_root(rows, 4).collect()
    assert sorted((r.d, r.n) for r in low) == [(1, 50), (2, 50), (3, 50), (4, 50), (5, 50), (6, 1), (6, 49), (7, 1), (7, 49), (8, 1), (8, 49)]


# --- substrings --------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 4)), min_size=1, max_size=6), st.lists(st.integers(-1, 3), min_size=1, max_size=14))
def test_suffix_automaton(seqs, asked):
    words = np.array([w for s, _ in seqs for w in s])
    made = substrings.SuffixAutomaton(words, np.array([len(s) for s, _ in seqs]), np.array([r for _, r in seqs]))
    held = {}
    for i, (s, r) in enumerate(seqs):
        for b in range(len(s)):
            for e in range(b + 1, len(s) + 1):
                held.setdefault(tuple(s[b:e]), set()).add((i, e, r))
    assert len(made.length) - 1 == len({frozenset(v) for v in held.values()})  # a state for each set of end places
    asked = [w if w < made.n_words else -1 for w in asked]
    longest, states = made.matches(np.array(asked), np.array([len(asked)]))
    for e in range(1, len(asked) + 1):
        best = max(k for k in range(e + 1) if not k or tuple(asked[e - k : e]) in held)
        assert longest[e - 1] == best
        for k in range(1, best + 1):
            assert made.lowest(states[e - 1 : e], k)[0] == min(r for _, _, r in held[tuple(asked[e - k : e])])


def plain_spans(rows, width=13):
    keeper = {}
    words = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - width + 1) if i is not None else ():
            x = tuple(w[k : k + width])
            keeper[x] = min(keeper.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - width + 1) if i is not None and keeper[tuple(w[k : k + width])] < i for j in range(width)}
        out.append((i, len(w), len(gone), " ".join(v for k, v in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def span_rows():
    rng = random.Random(1)
    pool = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(3, 40))) for _ in range(12)]
    some = lambda: " ".join(f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 9)))
    rows = [(i * 3 % 97, " \n".join(rng.choice(pool) if rng.random() < 0.6 else some() for _ in range(rng.randint(0, 6)))) for i in range(97)]
    rows += [(None, pool[0]), (None, None), (200, None), (201, ""), (202, " \t"), (203, "same words " * 400), (204, "same words " * 20), (-5, pool[2])]
    rows += [(205, pool[1]), (205, pool[1]), (205, "x " + pool[1]), (206, "x " + pool[1] + " z"), (207, " ".join(pool[1].split()[:13])), (208, "nbsp is no space " * 9), (209, "nbsp is no space " * 9)]
    return rows + [(300 + i, "only twelve words are shared by these two documents and then it " + str(i)) for i in range(2)]


@pytest.mark.parametrize("search", [{}, {"hot_batches": 0}, {"sent_bytes": -1}, {"sent_bytes": -1, "hot_batches": 0, "shard_rows": 3}])
def test_substring_dedup_matches_plain_version(spark, search):
    for kind, name in (("long", lambda i: i), ("string", lambda i: None if i is None else f"d{i + 100:04d}")):
        rows = [(name(i), t) for i, t in span_rows()]
        docs = spark.createDataFrame([(*r, "q", 1, 2, 3) for r in rows], f"doc_id {kind}, text string, n_words string, `row` int, id int, a int")
        got = substrings.dedup(docs, **search)
        assert got.columns == ["doc_id", "text", "row", "id", "a", "n_words", "n_removed"]
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()), key=repr) == plain_spans(rows)


def test_substring_dedup_of_long_texts_and_of_nothing(spark):
    long = " ".join(f"n{i * i % 7919}" for i in range(60_000))
    rows = [(1, "before " + long), (2, long + " after " + "z" * 100_000), (3, "a few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.text) for r in substrings.dedup(docs).collect())) == plain_spans(rows)
    assert substrings.dedup(docs.limit(0)).count() == 0
