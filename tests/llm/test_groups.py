"""Line dedup, SimHash, decontamination and language ID against plain versions, and their edge cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests_llm_plain import plain_components, plain_dedup, plain_fingerprint

from folioforge.llm import components, decontaminate, langid, linededup, simhash

SCHEMA = "doc_id long, text string"


def docs(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


LINES = ["the first shared line", " The First Shared Line\t", "short", "", "UNIQUE LINE NUMBER {}", "éÉ accents stay É", "ÉÉ accents stay É"]


def test_line_dedup_matches_plain_version(spark):
    rng = random.Random(1)
    rows = [(i, "\n".join(rng.choice(LINES).format(rng.randint(0, 99)) for _ in range(rng.randint(0, 8)))) for i in range(80)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "the first shared line\n" * 3000), (None, "the first shared line"), (204, "only in these rows of one id"), (204, "only in these rows of one id")]
    rows += [(205, "one text of an id\nthe first shared line"), (205, "unique line number 7\nthe first shared line\nan entirely other row"), (206, "an entirely other row")]
    for screen in ({}, {"sent_bytes": 0, "shard_rows": 20}):
        got = linededup.dedup(docs(spark, rows), **screen).collect()
        have = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=repr)
        assert have == sorted(plain_dedup(rows), key=repr)
        named = [(None if i is None else f"doc-{i}", t) for i, t in rows]
        got = linededup.dedup(docs(spark, named, "doc_id string, text string"), **screen).collect()
        have = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got), key=repr)
        assert have == sorted(plain_dedup(named), key=repr)


def test_lines_are_dealt_in_bounded_parts(spark):
    """Unique lines only: no filter holds any, and the parts of a shard follow all its lines."""
    rows = [(i, "\n".join(f"unique line {i} {k}" for k in range(50))) for i in range(40)]
    lines = linededup.keyed_lines(docs(spark, rows))
    assert linededup.repeated(lines).count() == 0 and linededup.dropped_lines(lines, linededup.repeated(lines), sent_bytes=0, shard_rows=30).count() == 0
    shards = lines.groupBy(linededup.shard_of(8)).count().collect()
    assert all(-(-r["count"] // 30) >= 2 for r in shards)
    cells = linededup.filters(lines.where("id = 3"), 8)
    for way in ({}, {"sent_bytes": 0, "shard_rows": 30}):
        hits = linededup.screened(lines, cells, 8, **way).collect()
        assert {r.line_no for r in hits if r.id == 3} == set(range(50)) and len(hits) < 80


def test_incremental_line_dedup_equals_a_single_pass(spark, sf):
    assert sorted(linededup.incremental(spark, sf).collect()) == sorted(linededup.op3(spark, sf).collect())


def test_line_references_are_reversible(spark):
    rows = [(1, "a line that repeats\nalone in one here"), (2, "a line that repeats"), (3, "a line that repeats\nsecond shared line")]
    more = [(4, "second shared line\na line that repeats"), (5, "alone in one here")]
    refs = linededup.references(linededup.keyed_lines(docs(spark, rows)))
    grown = linededup.insert_documents(refs, linededup.keyed_lines(docs(spark, more)))
    assert grown.count() == refs.count() + 3
    assert linededup.insert_documents(grown, linededup.keyed_lines(docs(spark, more))).count() == grown.count()
    back = linededup.delete_documents(grown, spark.createDataFrame([(4,), (5,)], "id long"))
    assert sorted(back.collect()) == sorted(refs.collect())
    without = linededup.delete_documents(grown, spark.createDataFrame([(1,)], "id long"))
    assert {r.keeper for r in linededup.repeated(without).collect()} == {2, 3}


def test_filters_follow_insertions_and_deletions(spark):
    text = lambda a, b: "\n".join(f"shared line number {n}" for n in range(a, b))
    lines = {k: linededup.keyed_lines(docs(spark, rows)) for k, rows in {"old": [(1, text(0, 60)), (2, text(20, 80))], "more": [(3, text(0, 300)), (4, text(100, 300))]}.items()}
    refs = linededup.references(lines["old"])
    grown = linededup.insert_documents(refs, lines["more"])
    before, after = linededup.repeated(refs), linededup.repeated(grown)
    start = linededup.filters(before, 3)
    there = linededup.update_filters(start, before, after, 3)
    back = linededup.update_filters(there, after, before, 3)
    for cells, keys in ((there, after), (back, before)):
        held = {r.shard: linededup.CuckooFilter.from_bytes(bytes(r.cells)) for r in cells.collect()}
        rows = keys.select(linededup.shard_of(3).alias("shard"), "k1").collect()
        assert all(held[r.shard].contains(np.array([r.k1]))[0] for r in rows)
        assert sum(np.count_nonzero(f.cells) for f in held.values()) == len(rows)
    everything = lines["old"].unionByName(lines["more"])
    a = linededup.dropped_lines(everything, after, (there, 3)).collect()
    b = linededup.dropped_lines(everything, after).collect()
    assert sorted(a) == sorted(b) and len(a) == 320


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**62), 2**62), max_size=400), st.integers(0, 400))
def test_cuckoo_filter(keys, n):
    keys = np.array(sorted(keys), np.int64)
    f = linededup.CuckooFilter.from_bytes(linededup.CuckooFilter.of(keys).to_bytes())
    assert f.contains(keys).all()
    gone, left = keys[:n], keys[n:]
    f.delete(gone)
    assert f.contains(left).all()
    assert np.count_nonzero(f.cells) == len(left)
    f.insert(gone)
    assert f.contains(keys).all()


def test_cuckoo_filter_rejects_most_strangers():
    rng = np.random.default_rng(1)
    keys, others = rng.integers(-(2**62), 2**62, (2, 20_000))
    f = linededup.CuckooFilter.of(keys)
    assert f.contains(keys).all() and f.contains(others).mean() < 0.001


TEXTS = ["", None, "one", "two words", "Ünï CODE   x", "a b c d", "A B C D", " ".join(f"w{i % 37}" for i in range(500))]


def test_fingerprints_match_plain_version():
    for t in TEXTS:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("search", [{}, {"sample_codes": 60, "shard_codes": 10, "block_rows": 15}, {"parts": 2, "sample_codes": 60, "shard_codes": 10}, {"parts": 5}])
def test_simhash_groups_match_brute_force(spark, search):
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(60)] for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for i in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 9))
        rows.append((100 + i, " ".join(w)))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows), **search).collect()}
    codes = [plain_fingerprint(t) for _, t in rows]
    want = plain_components([i for i, _ in rows], codes)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].code % (1 << 64) == c for (i, _), c in zip(rows, codes, strict=True))


def test_vantage_shards_lose_no_pair():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    near = codes.copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    every = np.unique(np.concatenate([codes, near]))
    met = set()
    for seed, mask in enumerate(simhash.block_masks(3)):
        tree = simhash.build_tree(every[::4], mask, 1, 6, seed)
        assert tree["leaves"] > 4
        rows, leaf, home = simhash.route(tree, every)
        assert len(rows[home]) == len(every)
        for x in np.unique(leaf):
            own, all_ = rows[(leaf == x) & home], rows[leaf == x]
            for a in own:
                met |= {frozenset((int(a), int(b))) for b in all_}
    place = {int(c): k for k, c in enumerate(every)}
    for a, b in zip(codes.tolist(), near.tolist(), strict=True):
        assert frozenset((place[a], place[b])) in met


def test_large_vantage_shards_are_split_and_lose_no_link(spark, monkeypatch):
    """Shards get trees of their own, also where all codes agree on a block, and the components stay those of all pairs."""
    rng = np.random.default_rng(4)
    flips = lambda c, n: np.bitwise_xor.reduce([np.uint64(1) << rng.integers(0, 64, len(c)).astype(np.uint64) for _ in range(n)], axis=0) ^ c
    far = rng.integers(0, 1 << 64, 1500, dtype=np.uint64)
    one_block = (far[:500] & ~np.uint64(simhash.block_masks(3)[0])) | np.uint64(12345)
    near = far[:400]
    every = np.unique(np.concatenate([far, one_block, flips(near, 2), flips(near, 4), flips(one_block[:200], 3)]))
    table = spark.createDataFrame([(int(c), k) for k, c in enumerate(every.view(np.int64).tolist())], "code long, rep long")
    done, split = [], simhash.split_shards
    monkeypatch.setattr(simhash, "split_shards", lambda *a: done.append(split(*a)) or done[-1])
    found = components.components(simhash.links(table, sample_codes=150, shard_codes=40, block_rows=150)).collect()
    assert len(done) >= 2 and done[0][1] and done[1][1]
    want = plain_components(list(range(len(every))), every.tolist())
    got = {r.node: r.component for r in found}
    assert {k: got.get(k, k) for k in want} == want


def test_simhash_edges(spark):
    r = simhash.near_duplicates(docs(spark, [(3, "same text in three rows"), (3, "same text in three rows"), (None, "same text in three rows"), (9, None), (4, "")])).collect()
    assert sorted((x.doc_id or 0, x.component_id) for x in r) == [(0, 3), (3, 3), (3, 3), (4, 4), (9, 4)]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def chain_texts():
    """Three texts of which the first two and the last two link, but not the first and the last."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    code = plain_fingerprint
    differ = lambda a, b: bin(code(" ".join(a)) ^ code(" ".join(b))).count("1")
    while True:
        first, middle, last = list(words), list(words), list(words)
        for t, n in ((first, 14), (last, 14)):
            for _ in range(n):
                t[rng.randrange(len(t))] = f"e{rng.randrange(10**6)}"
        if differ(first, middle) <= 4 and differ(middle, last) <= 4 and differ(first, last) > 4:
            return [" ".join(t) for t in (first, middle, last)]


def test_simhash_links_through_rows_without_id(spark):
    a, b, c = chain_texts()
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs(spark, [(3, a), (None, b), (1, c)])).collect()}
    assert got == {3: 1, None: 1, 1: 1}
    alone = simhash.near_duplicates(docs(spark, [(None, a), (None, b), (7, "something else altogether here")])).collect()
    assert sorted((r.component_id or 0) for r in alone) == [0, 0, 7]


def test_simhash_string_ids_and_clashing_columns(spark):
    a, b, c = chain_texts()
    rows = spark.createDataFrame([("y", a, 1, 2, "n"), ("z", b, 1, 2, "n"), ("x10", c, 1, 2, "n"), ("q", "else", 1, 2, "n")], "doc_id string, text string, code int, component int, node string")
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(rows).collect()} == {"y": "x10", "z": "x10", "x10": "x10", "q": "q"}


def test_fingerprint_of_a_very_long_text():
    text = " ".join(f"w{i * 7919 % 1013}" for i in range(40_000))
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(70, 71), (71, 70), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(50)) and got[71] == got[70] == 70


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=15), st.lists(st.integers(0, 4), max_size=15))
def test_alignment_matches_full_matrix(a, b):
    assert decontaminate.align(np.array(a, np.int64), np.array(b, np.int64)) == plain_align(a, b)


def test_contamination_matches_all_pairs(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = ["the", "of", "and", "to"]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [text(rng.randint(12, 40)) for _ in range(15)] + [["tiny", "item"], []]
    rows = []
    for i in range(120):
        t = text(200)
        if i % 3 == 0:
            leak = list(rng.choice(items[:15]))
            for _ in range(rng.choice([0, 1, 3])):
                leak[rng.randrange(len(leak))] = word()
            if i % 9 == 0 and len(leak) > 6:
                del leak[4]
            t[50:50] = leak
        rows.append((i, " ".join(t)))
    rows += [(500, None), (501, ""), (502, "we have a tiny item here"), (503, " ".join(items[0] * 200))]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    for options in ({}, {"block_chars": 900}):
        got = {r.doc_id: set(r["items"]) for r in decontaminate.contamination(docs(spark, rows), bench, **options).collect()}
        want = {i: {k for k, x in enumerate(items) if x and plain_align((t or "").split(), x) >= len(x)} for i, t in rows if i < 500 or i == 502}
        assert {i: got[i] for i in want} == want
        assert got[500] == got[501] == set() and 0 in got[503]


def test_contamination_of_a_very_common_item(spark):
    item = "a passage which nearly every one of these documents holds word for word today"
    rows = [(i, f"start {i} {item} end {i}") for i in range(300)] + [(900, "a clean one which holds every other word today")]
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [r.contaminated for r in got] == [True] * 300 + [False]
    none = decontaminate.contamination(docs(spark, rows), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated").count() == 0


def test_contamination_by_items_of_any_ids(spark):
    """Null, repeated, text and huge ids; equal items; extra columns named like the results."""
    items = ["one passage that nobody else would ever write like this", "quite another passage of which only the second file holds all"]
    rows = [(1, f"so {items[0]} end", "x"), (2, f"so {items[1]} end {items[0]}", "y"), (3, "a clean one", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, items string")
    got = {r.doc_id: r for r in decontaminate.contamination(d, spark.createDataFrame([(None, items[0]), ("b", items[1]), ("a", items[1]), ("a", items[1])], "item_id string, text string")).collect()}
    assert [got[k].contaminated for k in (1, 2, 3)] == [True, True, False]
    assert got[1].best_item is None and got[1]["items"] == [None] and got[1].n_items == 1
    assert got[2].best_item == "a" and got[2]["items"] == ["a", "a", "b", None]
    big = decontaminate.contamination(d, spark.createDataFrame([(2**63 - 1, items[0])], "item_id long, text string"))
    assert {r.doc_id: r.best_item for r in big.collect()} == {1: 2**63 - 1, 2: 2**63 - 1, 3: None}


def test_contamination_by_edited_copies_in_many_documents(spark):
    items = [[f"{c}{i}" for i in range(20)] for c in "abc"]
    edited = [[f"x{i}" if i in (5, 12) else w for i, w in enumerate(x)] for x in items]
    leaks = [edited[0]] * 300 + [items[1]] * 3 + [edited[1]] * 100 + [edited[2]] * 3 + [["c0", "c1", "c2", "other"]]
    rows = [(i, " ".join([f"start{i}", *x, "end"])) for i, x in enumerate(leaks)]
    got = decontaminate.contamination(docs(spark, rows), spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")).collect()
    want = {i: [k for k, x in enumerate(items) if plain_align(t.split(), x) >= len(x)] for i, t in rows}
    assert {r.doc_id: r["items"] for r in got} == want
    assert sum(map(len, want.values())) == len(leaks) - 1


def test_language_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    out = langid.identify(held, host=F.col("source"), labelled=train).join(held.select("doc_id", F.col("lang").alias("true")), "doc_id").collect()
    assert len(out) == held.count()
    assert sum(r.lang == r.true for r in out) / len(out) > 0.97 and sum(r.accepted for r in out) / len(out) > 0.97


def test_a_rare_language_is_learnt_from_a_sample(spark):
    rows = [(i, "the other house and with", "en") for i in range(3000)] + [(5000 + i, "der und nicht haus", "de") for i in range(3000)] + [(9000, "je suis dans la maison", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(d, max_rows=200)[0] == ["de", "en", "fr"]
    assert langid.identify(d, max_rows=200).where("doc_id = 9000").first().text_lang == "fr"


def test_language_fuses_evidence_and_rejects(spark):
    rng = random.Random(3)
    make = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    en, de = ["the", "and", "with", "house", "other"], ["der", "und", "nicht", "haus", "über"]
    rows = [(i, make(en, 30), "en", "a.example.com") for i in range(40)] + [(100 + i, make(de, 30), "de", "b.example.de") for i in range(40)]
    rows += [(200, "xq", "de", "b.example.de"), (201, "xq", "en", "a.example.com"), (202, None, "en", None), (203, "123 !!", "en", "a"), (204, make(de, 30), None, None), (205, make(de, 30), "de-AT", "b.example.de")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, host string")
    out = {r.doc_id: r for r in langid.identify(d, declared=F.col("lang"), host=F.col("host"), labelled=d.where("doc_id < 200")).collect()}
    assert out[200].lang == "de" and out[201].lang == "en" and out[204].lang == "de" and out[205].lang == "de"
    assert [out[k].accepted for k in (0, 100, 202, 203, 204)] == [True, True, False, False, True] and out[202].lang == out[203].lang == "und"


def plain_fusion(rows, labelled, weight=40.0, strength=20.0):
    """(language, posterior) of rows (id, text, declared, host), with the evidence counted in dictionaries."""
    from math import exp, log

    langs = sorted({x for _, x in labelled})
    counts = {x: np.full(langid.BUCKETS, 0.05) for x in langs}
    for t, x in labelled:
        counts[x] += np.bincount(langid.trigram_hash(t), minlength=langid.BUCKETS)
    logp = {x: np.log(c / c.sum()).astype(np.float32) for x, c in counts.items()}
    ll, best = [], []
    for _, t, _, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            ll.append(None)
            best.append(None)
            continue
        h = langid.trigram_hash(t)
        s = [logp[x][h].astype(float).sum() * min(1.0, weight / len(h)) for x in langs]
        ll.append(s)
        best.append(langs[int(np.argmax(s))])
    low = [(d.split("-")[0].lower() if d else None, h.lower() if h else None) for _, _, d, h in rows]
    tally = lambda keep: [sum(b == x and keep(*k) for b, k in zip(best, low, strict=True)) for x in langs]
    smooth = lambda n, up: [(a + strength * p) / (sum(n) + strength) for a, p in zip(n, up, strict=True)]
    suffix = lambda h: h.rpartition(".")[2] if h and "." in h else None
    domain = lambda h: ".".join(h.split(".")[-2:]) if h else None
    every = smooth(tally(lambda d, h: True), [1 / len(langs)] * len(langs))
    out = []
    for s, (d, h) in zip(ll, low, strict=True):
        if s is None:
            out.append(("und", 0.0))
            continue
        prior = smooth(tally(lambda _, g, h=h: suffix(g) == suffix(h)), every)
        prior = smooth(tally(lambda _, g, h=h: domain(g) == domain(h) and suffix(g) == suffix(h)), prior)
        prior = smooth(tally(lambda _, g, h=h: g == h), prior)
        kinds = {k for (k, _), b in zip(low, best, strict=True) if k and b}
        given = [0.0] * len(langs)
        if d:
            n, total = tally(lambda e, _, d=d: e == d), tally(lambda e, _: e is not None)
            given = [log((a + 0.5) / (z + 0.5 * (len(kinds) + 1))) for a, z in zip(n, total, strict=True)]
        score = [a + log(p) + g for a, p, g in zip(s, prior, given, strict=True)]
        top = int(np.argmax(score))
        out.append((langs[top], 1 / sum(exp(x - score[top]) for x in score)))
    return out


def test_language_matches_plain_fusion(spark):
    """Held-out rows, a fifth of them with a wrong declaration, on hosts of one language and of several."""
    rng = random.Random(13)
    words = {"en": ["the", "and", "with", "house", "other", "no"], "de": ["der", "und", "nicht", "haus", "über", "no"], "fr": ["je", "suis", "dans", "maison", "le", "no"]}
    make = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    labelled = [(make(x, 30), x) for x in words for _ in range(40)]
    rows, true = [], []
    for i in range(300):
        x = rng.choice(sorted(words))
        said = x if rng.random() < 0.8 else rng.choice(sorted(words))
        rows.append((i, make(x, rng.choice([1, 1, 2, 30])), rng.choice([said, said.upper() + "-XX", None]), rng.choice([f"www.{x}.example.{x}", f"a.{x}site.com", "mixed.org", "intranet", None])))
        true.append(x)
    rows += [(900, None, "en", "a.b.de"), (901, "123", "de", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string")
    got = {r.doc_id: r for r in langid.identify(d, declared=F.col("declared"), host=F.col("host"), labelled=spark.createDataFrame(labelled, "text string, lang string")).collect()}
    want = plain_fusion(rows, labelled)
    assert all(got[i].lang == lang and abs(got[i].posterior - p) < 1e-4 for (i, *_), (lang, p) in zip(rows, want, strict=True))
    alone = sum(got[i].text_lang == x for i, x in enumerate(true))
    fused = sum(got[i].lang == x for i, x in enumerate(true))
    assert fused > alone and fused > 0.93 * len(true)


def test_language_sample_does_not_depend_on_the_layout(spark):
    rows = [(i, f"the house number {i} and others" if i % 2 else f"das haus nummer {i} und andere", "en" if i % 2 else "de") for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    a, b = langid.train(d, max_rows=300), langid.train(d.repartition(7).sortWithinPartitions(F.desc("doc_id")), max_rows=300)
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_language_of_pages(spark, sf):
    got = langid.pages_language(spark, sf).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert sorted(r.page_id for r in got) == sorted(pages)
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").collect()
    import re

    def plain(r):
        text = re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", r.html or ""))
        said = re.search(r"""(?i)<html[^>]*?\blang\s*=\s*["']?([A-Za-z-]+)""", r.html or "")
        host = re.search(r"^[a-zA-Z]+://([^/:?#]+)", r.url or "")
        return (r.page_id, text, said and said[1], host and host[1])

    rows = [plain(r) for r in pages.values()]
    want = dict(zip((r[0] for r in rows), plain_fusion(rows, [(r.text, r.lang) for r in docs_ if r.text is not None and r.lang is not None]), strict=True))
    assert all(r.lang == want[r.page_id][0] and abs(r.posterior - want[r.page_id][1]) < 1e-3 for r in got)


def test_language_of_documents_has_declarations_that_the_text_model_has_not_seen(spark, tmp_path):
    """One row of unknown words, labelled one way and the other: the text's verdict stays, the declaration decides."""
    rng = random.Random(7)
    words = {"en": ["the", "and", "with", "house", "other"], "de": ["der", "und", "nicht", "haus", "hier"]}
    rows = [(i, " ".join(rng.choice(words[x]) for _ in range(30)), x, "src0") for i in range(120) for x in [("en", "de")[i % 2]]]
    got = {}
    for said in ("de", "en"):
        spark.createDataFrame([*rows, (900, "xqj", said, "src0"), (901, rows[0][1] + " the", "de", "src0")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{said}/documents.parquet")
        got[said] = {r.doc_id: r for r in langid.op9(spark, f"{tmp_path}/{said}").collect()}
    assert got["de"][900].text_lang == got["en"][900].text_lang
    assert [got[x][900].lang for x in ("de", "en")] == ["de", "en"] and all(got[x][900].posterior > 0.9 and got[x][900].kept for x in got)
    assert got["de"][901].lang == got["en"][901].lang == "en"  # a text with known words is not overruled


def test_language_folds_leave_out_their_own_texts(spark):
    rows = [(f"the house number {i} and others" if i % 2 else f"das haus nummer {i} und andere", "en" if i % 2 else "de") for i in range(60)] + [("je suis dans la maison", "fr")]
    langs, logp = langid.train(spark.createDataFrame(rows, "text string, lang string"), folds=3)
    for fold in range(3):
        for k, x in enumerate(langs):
            others = [t for t, y in rows if y == x and langid.fold_of(t, 3) != fold] or [t for t, y in rows if y == x]
            n = sum((np.bincount(langid.trigram_hash(t), minlength=langid.BUCKETS) for t in others), np.full(langid.BUCKETS, 0.05))
            assert np.allclose(logp[fold, :, k], np.log(n / n.sum()), atol=1e-5)


def test_language_suffix_is_evidence_of_its_own(spark):
    """Suffix and host each add their log evidence; the suffix speaks on a host that has one document, and is not told twice."""
    make = lambda x, i: {"en": f"the house number {i} and others", "de": f"das haus nummer {i} und andere"}[x]
    rows = [(i, make("de" if i % 10 else "en", i), f"h{i % 7}.d{i % 7}.de") for i in range(100)] + [(100 + i, make("en", i), f"h{i}.d{i}.com") for i in range(100)]
    rows += [(900, "xqj", "new.site.de"), (901, "xqj", "new.site.com"), (902, None, "new.site.com")]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string")
    labelled = spark.createDataFrame([(make(x, i), x) for i in range(40) for x in ("en", "de")], "text string, lang string")
    got = {r.doc_id: r for r in langid.identify(d, host=F.col("host"), labelled=labelled).collect()}
    de, com = (got[i].evidence.suffix[0] - got[i].evidence.suffix[1] for i in (900, 901))
    assert de > 0.5 and com < -0.5 and got[902].evidence is None
    smooth = lambda n, up: [(x + 20 * p) / (sum(n) + 20) for x, p in zip(n, up, strict=True)]
    every = smooth([sum(r.text_lang == x for r in got.values()) for x in ("de", "en")], [0.5, 0.5])
    of_de = smooth([sum(got[i].text_lang == x for i, _, h in rows if h.endswith(".de")) for x in ("de", "en")], every)
    assert np.allclose(got[900].evidence.suffix, np.log(of_de) - np.log(every))
    for r in got.values():
        if r.evidence:
            score = sum(np.array(x) for x in r.evidence)
            assert abs(r.posterior - 1 / np.exp(score - score.max()).sum()) < 1e-9 and r.lang == ("de", "en")[int(score.argmax())]


def test_language_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang, r.accepted) for r in langid.identify(d).collect()] == [("und", False)]
    assert langid.identify(d.where("doc_id > 5")).count() == 0


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a line that is shared\nown line one", "i", 5, "c", "d")], "doc_id long, text string, id string, n_dropped int, drops string, code string")
    r = linededup.dedup(d).collect()[0]
    assert (r.id, r.drops, r.n_dropped) == ("i", "d", 0) or (r.id, r.drops, r.n_dropped) == ("i", "c", 0)
    assert simhash.near_duplicates(d).collect()[0].component_id == 1
    assert decontaminate.contamination(d, spark.createDataFrame([(1, "x")], "item_id long, text string")).collect()[0].id == "i"
    assert langid.identify(d.withColumn("lang", F.lit("en"))).count() == 1
