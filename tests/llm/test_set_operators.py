"""Sharding, Jaccard join, BPE, Huffman coding, packing and the pipeline, against brute force on small tables."""

from __future__ import annotations

import random
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from weftgraph.llm import bpe, huffman, jaccard, packing, sharding

from .test_text_operators import brute_languages, clean, docs


# Sharding


def test_matrix_has_exact_margins():
    sizes = np.array([5, 0, 17, 3, 40, 1])
    m = np.array([sharding.matrix_row(sizes, 7, p, 3) for p in range(len(sizes))])
    assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == sharding.shard_sizes(66, 7)).all() and (m >= 0).all()
    assert (m == np.array([sharding.matrix_row(sizes, 7, p, 3) for p in range(len(sizes))])).all()


def test_matrix_is_hypergeometric():
    counts = Counter(int(sharding.matrix_row(np.array([3, 5]), 2, 0, s)[0]) for s in range(4000))
    for k, p in {0: 4 / 56, 1: 24 / 56, 2: 24 / 56, 3: 4 / 56}.items():  # C(4,k) C(4,3-k) / C(8,3)
        assert abs(counts[k] / 4000 - p) < 0.03


def test_large_draws():
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 10**9, 3 * 10**9, 10**8) for _ in range(200)]
    assert abs(np.mean(draws) - 2.5e7) < 2000 and 3000 < np.std(draws) < 5500
    assert sharding.hypergeometric(rng, 0, 5, 3) == 0 and sharding.hypergeometric(rng, 5, 0, 3) == 3
    totals = np.array([2 * 10**9, 10**9])
    assert sharding.split(rng, totals, 10**8).sum() == 10**8


def test_splits_in_runs(monkeypatch):
    """Beyond the limit the law is the same: means and variances of each shard's share, over many small runs."""
    totals, rng = np.array([5, 40, 0, 25, 60, 30, 1, 39]), np.random.default_rng(2)
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 66)
    monkeypatch.setattr(sharding, "hypergeometric", lambda g, good, bad, n: int(g.hypergeometric(good, bad, n)))
    draws = np.array([sharding.split(rng, totals, 80) for _ in range(4000)])
    share = totals / 200
    variance = 80 * share * (1 - share) * 120 / 199
    assert (draws.sum(axis=1) == 80).all() and (draws <= totals).all()
    assert np.abs(draws.mean(axis=0) - 80 * share).max() < 0.25 and np.allclose(draws.var(axis=0), variance, rtol=0.12)


def test_a_row_of_many_bins_is_quick():
    sizes = np.full(1000, 10**7)
    began = time.perf_counter()
    row = sharding.matrix_row(sizes, 64, 137, 20, 3125)
    assert row.sum() == 10**7 and len(row) == 200_000 and time.perf_counter() - began < 5


def test_shards(spark):
    rows = [(i % 50 if i % 7 else None, None if i % 5 else "t" * (i * 100)) for i in range(203)]
    df = docs(spark, [(*r, "s", "p") for r in rows], "doc_id bigint, text string, shard string, SHARD_POS string").repartition(5)
    out = sharding.shard(df, 8, 4).collect()
    sizes = Counter(r["shard"] for r in out)
    assert sorted(sizes.values()) == [25] * 5 + [26] * 3
    assert all(sorted(r["shard_pos"] for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows) and {r["shard_in"] for r in out} == {"s"} and {r["SHARD_POS_in"] for r in out} == {"p"}
    for bin_rows in (1, 4, 10):
        out = sharding.shard(df, 8, 4, bin_rows).collect()
        assert all(sorted(r["shard_pos"] for r in out if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
        assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    assert sharding.shard(docs(spark, []), 3).count() == 0
    few = sharding.shard(docs(spark, [(1, "a"), (2, "b")]), 5).collect()
    assert sorted(r["shard"] for r in few) == [0, 1] and [r["shard_pos"] for r in few] == [0, 0]
    with pytest.raises(ValueError):
        sharding.shard(df, 0)


def test_shuffle_is_uniform(spark):
    df = spark.range(12).repartition(3).select("id")
    first = Counter()
    for seed in range(60):
        for r in sharding.shard(df, 3, seed).filter("shard = 0").collect():
            first[r["id"]] += 1
    assert sum(first.values()) == 240 and all(5 <= first[i] <= 40 for i in range(12))


# Jaccard join


def token_sets(rows, n):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        if i is not None and w:
            out.setdefault(i, set()).update({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or {tuple(w)})
    return out


def brute_pairs(rows, n, t):
    s = token_sets(rows, n)
    return {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) >= t * len(s[a] | s[b]) - 1e-9}


def near_copies(seed, groups=12, words=60, vocabulary=400):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(rng.randint(1, words))]
        for _ in range(rng.randint(1, 7)):
            w = [x if rng.random() > rng.choice([0, 0.02, 0.1]) else f"w{rng.randrange(vocabulary)}" for x in base]
            rows.append((i, "  ".join(w[rng.randint(0, 2) :]) + rng.choice(["", "\n", " "])))
            i += 1
    return rows


def found_pairs(df, *args):
    """The pairs of documents that the pairs of sets and their members stand for."""
    members, pairs = jaccard.similar_sets(df, *args)
    of: dict = {}
    for r in members.collect():
        of.setdefault(r["rep"], set()).add(r["doc_id"])
    out = {p: 1.0 for m in of.values() for p in combinations(sorted(m), 2)}
    for r in pairs.collect():
        out |= {(min(a, b), max(a, b)): r["jaccard"] for a in of[r["rep_a"]] for b in of[r["rep_b"]] if a != b}
    return out


def brute_links(rows, n, t):
    """(class, links, best index) of every id, for rows that have one text an id."""
    pairs, classes = brute_pairs(rows, n, t), groups_of(rows, n, t)
    near: dict = {}
    for (a, b), j in pairs.items():
        near.setdefault(a, []).append(j)
        near.setdefault(b, []).append(j)
    return {i: (classes.get(i, i), len(near.get(i, ())), max(near.get(i, [0])) or None) for i, _ in rows if i is not None}


def told(df):
    got = df.collect()
    assert len({r["doc_id"] for r in got}) == len(got)
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["max_jaccard"]) for r in got}


ODD = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (None, "one"), (None, None), (1006, "a b c"), (1006, "a b c"), (1007, "A  B\tC")]


@pytest.mark.parametrize("seed,n,t,rare", [(1, 3, 0.55, 32), (2, 1, 0.55, 2), (3, 2, 0.7, 3), (4, 1, 0.8, 2), (5, 2, 0.51, 2), (6, 3, 1.0, 2)])
def test_pairs_against_brute_force(spark, seed, n, t, rare):
    rows = near_copies(seed) + ODD
    df = docs(spark, [(*r, "x") for r in rows], "doc_id bigint, text string, class_id string")
    got, want = found_pairs(df, n, t, rare), brute_pairs(rows, n, t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert len(want) >= 10 and told(jaccard.links(df, n, t, rare)) == brute_links(rows, n, t)


def test_pairs_of_split_groups_and_blocks(spark, monkeypatch):
    rows = near_copies(9, groups=6) + [(500 + i, "the same long text again and again " * 3 + f"end{i % 4}") for i in range(40)]
    monkeypatch.setattr(jaccard, "UNIT_TOKENS", 50)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    assert found_pairs(docs(spark, rows)).keys() == brute_pairs(rows, jaccard.N, jaccard.THRESHOLD).keys()
    assert told(jaccard.links(docs(spark, rows))) == brute_links(rows, jaccard.N, jaccard.THRESHOLD)


def test_links_of_ids_with_several_texts(spark):
    x, y, z = "a b c d e f g h", "p q r s t u v w", "l m n o"
    rows = [(1, x), (1, y), (1, x), (2, x), (3, y + " z"), (4, z), (4, z + " k"), (4, None), (5, "none like it"), (None, x), (None, z)]
    rows += [(6, z + " k"), (7, "b b b b b"), (7, "")]
    got = told(jaccard.links(docs(spark, rows)))
    assert {i: g[:2] for i, g in got.items()} == {1: (1, 2), 2: (1, 1), 3: (1, 1), 4: (4, 2), 5: (5, 0), 6: (4, 2), 7: (7, 0)}
    assert got[2][2] == 1.0 and got[3][2] == 6 / 7 and got[5][2] is None
    kept = jaccard.keep_one(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter({1: 3, 4: 3, 5: 1, None: 2, 7: 2})


def large_group(seed, sets, words=40):
    """Copies of one text with a few words changed each."""
    rng = random.Random(seed)
    base = [f"g{k}" for k in range(words)]
    return [" ".join(x if rng.random() > rng.choice([0, 0.03, 0.08]) else f"h{rng.randrange(50)}" for x in base) for _ in range(sets)]


@pytest.mark.parametrize("heavy,tokens,least,dense,n,t", [(2, 1 << 20, 256, 64, 3, 0.55), (2, 60, 1, 1, 3, 0.55), (5, 300, 20, 10**9, 1, 0.8), (32, 1 << 20, 256, 64, 2, 0.6)])
def test_groups_of_heavy_entries_against_brute_force(spark, monkeypatch, heavy, tokens, least, dense, n, t):
    for name, value in {"HEAVY_RUN": heavy, "TILE_TOKENS": tokens, "_LEAST_TOKENS": least, "_DENSE": dense, "_TILE_ROWS": 7, "_LISTED": 50}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies(11, groups=8) + ODD + [(2000 + i, x) for i, x in enumerate(large_group(4, 90))]
    got, want = found_pairs(docs(spark, rows), n, t, 2), brute_pairs(rows, n, t)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert told(jaccard.links(docs(spark, rows), n, t, 2)) == brute_links(rows, n, t)
    assert {r["doc_id"] for r in jaccard.keep_one(docs(spark, rows), n, t, 2).collect()} == {r[0] for r in kept_of(rows, n, t)}


def test_groups_of_ids_with_several_texts(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(60), x) for x in large_group(6, 80) + large_group(7, 20)]
    rows += [(rng.randrange(60), x) for _, x in rng.sample(rows, 20)]
    plain = told(jaccard.links(docs(spark, rows), 2, 0.6, 2))
    monkeypatch.setattr(jaccard, "HEAVY_RUN", 10**9)
    want = told(jaccard.links(docs(spark, rows), 2, 0.6, 2))
    for tokens in (1 << 20, 256 * 5):
        monkeypatch.setattr(jaccard, "HEAVY_RUN", 3)
        monkeypatch.setattr(jaccard, "TILE_TOKENS", tokens)
        assert told(jaccard.links(docs(spark, rows), 2, 0.6, 2)) == want == plain
    assert sum(n for _, n, _ in want.values()) > 1000


def test_a_large_group_is_not_listed_as_pairs(spark, monkeypatch):
    """No table that the join writes has more than some rows a set, however many sets are alike."""
    written, plain = [], jaccard.stash

    def counted(df, name):
        out = plain(df, name)
        written.append((out.count(), name))
        return out

    monkeypatch.setattr(jaccard, "stash", counted)
    rows = list(enumerate(large_group(8, 600)))
    got = told(jaccard.links(docs(spark, rows)))
    assert got == brute_links(rows, jaccard.N, jaccard.THRESHOLD) and sum(n for _, n, _ in got.values()) > 100_000
    assert max(written)[0] < 20 * len(rows), max(written)


def test_the_pipeline_keeps_one_of_a_large_group_without_its_pairs(spark, monkeypatch):
    written, plain = [], jaccard.stash

    def counted(df, name):
        out = plain(df, name)
        written.append((out.count(), name))
        return out

    monkeypatch.setattr(jaccard, "stash", counted)
    rows = list(enumerate(large_group(9, 500)))
    kept = corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "")
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in kept_of(rows)} and max(written)[0] < 20 * len(rows), max(written)


def test_long_texts_that_share_tokens_by_chance_are_not_all_paired(spark, monkeypatch):
    """Unrelated texts, most of whose tokens some other has too; and copies with runs of words changed or cut off, some near the threshold."""
    written, plain = {}, jaccard.stash

    def counted(df, name):
        out = plain(df, name)
        written.setdefault(name, out.count())
        return out

    monkeypatch.setattr(jaccard, "stash", counted)
    rng = np.random.default_rng(5)
    texts = [[f"w{x}" for x in rng.integers(0, 72, 5000)] for _ in range(150)]
    for k, (changed, length) in enumerate([(0, 2800), (0, 2700), (300, 5000), (1400, 5000), (1460, 5000), (1500, 4900), (200, 3100), (2600, 5000)]):
        copy = list(texts[k])
        copy[100 : 100 + changed] = [f"z{k}"] * changed
        texts.append(copy[:length])
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs(spark, rows), "").collect()}
    want = {r[0] for r in kept_of(rows)}
    assert got == want and 150 < len(want) < len(rows) and written["candidates"] < 20 * len(rows), written


def test_shared_tokens_of_two_blocks(monkeypatch):
    rng = np.random.default_rng(4)
    left, right = ([np.unique(rng.zipf(1.3, k) % 500) for k in rng.integers(1, 80, m)] for m in (40, 23))
    want = [[len(np.intersect1d(x, y)) for y in right] for x in left]
    for dense, listed in ((64, 1 << 21), (1, 100), (4, 1), (10**9, 10**6)):
        monkeypatch.setattr(jaccard, "_DENSE", dense)
        monkeypatch.setattr(jaccard, "_LISTED", listed)
        monkeypatch.setattr(jaccard, "_TILE_ROWS", 7)
        got = list(jaccard.shared_tokens(left, right))
        assert np.concatenate([c for _, c in got]).tolist() == want and [lo for lo, _ in got] == [0, *np.cumsum([len(c) for _, c in got])[:-1]]


def test_forest_connects_what_a_matrix_does():
    rng = np.random.default_rng(3)
    for n, m, share in ((30, 30, 0.03), (20, 45, 0.04), (5, 1, 0.5), (4, 4, 0.0)):
        ok = rng.random((n, m)) < share
        edges = [(i, j + n) for i, j in np.argwhere(ok)]
        assert parts_of(n + m, zip(*jaccard.forest(ok, False))) == parts_of(n + m, edges)
        if n == m:
            ok = np.triu(ok, 1) | np.triu(ok, 1).T
            assert parts_of(n, zip(*jaccard.forest(ok, True))) == parts_of(n, np.argwhere(ok))


def parts_of(n, edges):
    at = list(range(n))
    for i, j in edges:
        a, b = at[i], at[j]
        at = [min(a, b) if x in (a, b) else x for x in at]
    return at


def test_pairs_after_many_empty_texts_of_one_partition(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_CHUNK_CHARS", 1)
    monkeypatch.setattr(jaccard, "_BLOCK_TOKENS", 1)
    text = "CASE id WHEN {0} THEN 'a b c d e f g' WHEN {1} THEN 'p q r s t u v' WHEN {2} THEN 'a b c d e f g h' WHEN {3} THEN 'p q r s t u v w' END"
    many = (1 << 20) + 4  # without a bound, place 2^20 of the first block and place 0 of the second are one record
    ids = [(1 << 20) + k for k in range(4)]
    df = spark.range(0, many, 1, 1).selectExpr("id AS doc_id", text.format(*ids) + " AS text")
    assert sorted(found_pairs(df)) == [(ids[0], ids[2]), (ids[1], ids[3])]


def test_pairs_of_long_and_no_texts(spark):
    rng = random.Random(1)
    long = " ".join(f"v{rng.randrange(5000)}" for _ in range(30_000))
    rows = [(1, long), (2, long + " more"), (3, "short one here")]
    assert {i: g[:2] for i, g in told(jaccard.links(docs(spark, rows))).items()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
    assert jaccard.links(docs(spark, [])).count() == 0 and jaccard.keep_one(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        jaccard.links(docs(spark, rows), threshold=0.4)


def groups_of(rows, n, t):
    root = {i: i for i in token_sets(rows, n)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs(rows, n, t):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}


def kept_of(rows, n=jaccard.N, t=jaccard.THRESHOLD):
    g = groups_of(rows, n, t)
    return [r for r in rows if r[0] not in g or g[r[0]] == r[0]]


def test_keep_one_against_brute_force(spark):
    rows = near_copies(11) + ODD
    got = jaccard.keep_one(docs(spark, [(*r, i) for i, r in enumerate(rows)], "doc_id bigint, text string, `gone.x` int")).collect()
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(repr, kept_of(rows)))


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 52), (52, 50), (70, 60), (70, 61), (60, 61), (5, 5)]
    got = {r["node"]: r["root"] for r in jaccard.components(docs(spark, e, "u bigint, v bigint"), "u", "v").collect()}
    assert got == {**dict.fromkeys(range(31), 0), **dict.fromkeys((50, 51, 52), 50), **dict.fromkeys((60, 61, 70), 60)}


# Byte-level BPE

TEXTS = [
    "Hello, world! It's fine.", "", "  two  spaces \n\n\tand tabs ", "naïve café ÜBER straße", "日本語テキスト и русский 🙂👍🏽", "x" * 3000, "a1b22c333 ½ ² Ⅷ ͏", "<|endoftext|> is text", "'s 'LL don't", "_under_score__",
    " nbsp  em space", "\x1c\x1d\x00\x7f", "word " * 20_000, None,
]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()), special_tokens={})


def test_encoding_and_decoding(spark, reference, monkeypatch):
    rows = [(i, t, "d") for i, t in enumerate(TEXTS + TEXTS[:3])] + [(None, "same again", "d"), (3, "naïve", "d")]
    df = docs(spark, rows, "doc_id bigint, text string, decoded string")
    for words in (500_000, 5):
        monkeypatch.setattr(bpe, "BLOCK_WORDS", words)
        out = bpe.encode(df)
        got = Counter((r["doc_id"], None if r["token_ids"] is None else tuple(r["token_ids"]), r["n_tokens"]) for r in out.collect())
        want = Counter((i, None if t is None else tuple(reference.encode_ordinary(t)), None if t is None else len(reference.encode_ordinary(t))) for i, t, _ in rows)
        assert got == want
    by_row = Counter((r["doc_id"], None if r["token_ids"] is None else tuple(np.frombuffer(r["token_ids"], "<u4").tolist())) for r in bpe.encode_rows(df).collect())
    assert by_row == Counter((i, x) for i, x, _ in want.elements())
    assert Counter((r["doc_id"], r["n_tokens"]) for r in bpe.count_rows(df).collect()) == Counter((i, n) for i, _, n in want.elements())
    packed = bpe.encode_rows(df)
    book = huffman.build_book(packed)
    again = huffman.decompress(huffman.compress(packed, book), book)
    assert Counter((r["doc_id"], None if r["token_ids"] is None else tuple(r["token_ids"])) for r in again.collect()) == by_row
    back = bpe.decode(out.withColumnRenamed("n_tokens", "decoded"), bpe.token_table(spark)).collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in back) == Counter((i, t) for i, t, _ in rows) and "decoded_in" in back[0].__fields__


def test_texts_with_and_without_double_spaces(reference):
    rng = random.Random(5)
    ids = bpe.text_encoder(bpe.default_vocabulary())
    for _ in range(3000):
        t = "".join(rng.choice(["a", "Bc", "7", "'s", " ", "\n", "é", "!", " x", "\u3000", "\t", "\xa0", "\x1c", "_"]) for _ in range(rng.randint(0, 12)))
        assert ids(t) == reference.encode_ordinary(t), repr(t)


def test_plain_merge_equals_the_library(reference):
    ranks = bpe.load_ranks(bpe.default_vocabulary())
    for w in ("hello", " unbelievable", "ÄÖ", "zzzzzz", "🙂"):
        assert bpe.merge(w.encode(), ranks) == reference.encode_ordinary(w)


def test_decode_by_either_join(spark, monkeypatch):
    lists = [[-1, 72], [None, 39], [], None, [39, 200, 72, 201], [9, 9], [72] * 3000, [-5, 38, 73]]
    df = docs(spark, list(enumerate(lists)) * 2, "doc_id bigint, token_ids array<int>")
    table = docs(spark, [(72, b"i"), (39, b"H"), (200, b"\xc3"), (201, b"\xa9"), (9, None), (-5, "𝄞".encode())], "id int, bytes binary")
    few = [Counter((r["doc_id"], r["decoded"]) for r in bpe.decode(x, t).collect()) for x in (df, df.repartition(3)) for t in (table, table.union(table.limit(0)))]
    monkeypatch.setattr(bpe, "SLICE", 2)
    few.append(Counter((r["doc_id"], r["decoded"]) for r in bpe.decode(df, table).collect()))
    monkeypatch.setattr(bpe, "BROADCAST_TOKENS", 0)
    assert all(x == Counter((r["doc_id"], r["decoded"]) for r in bpe.decode(df, table).collect()) for x in few)


def test_decode_odd_ids(spark):
    df = docs(spark, [(1, [-1, 72]), (2, [None, 39]), (3, []), (4, None)], "doc_id bigint, token_ids array<int>")
    table = docs(spark, [(72, b"i"), (39, b"H")], "id int, bytes binary")
    assert {r["doc_id"]: r["decoded"] for r in bpe.decode(df, table).collect()} == {1: "�i", 2: "�H", 3: "", 4: None}
    assert bpe.encode(docs(spark, [])).count() == 0 and bpe.decode(df.limit(0), table).count() == 0


# Huffman coding


def optimal_cost(counts, limit):
    """The least cost of a prefix code of at most ``limit`` bits, by trying all lengths that Kraft's sum allows."""
    counts = sorted(counts, reverse=True)
    best = [float("inf")]

    def go(k, least, room, cost):
        if cost >= best[0]:
            return
        if k == len(counts):
            best[0] = cost
            return
        for n in range(least, limit + 1):
            if 2.0**-n <= room + 1e-12:
                go(k + 1, n, room - 2.0**-n, cost + n * counts[k])

    go(0, 1, 1.0, 0)
    return best[0]


def test_code_lengths_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        counts = [rng.choice([1, 1, 2, 5, 30, 1000]) for _ in range(rng.randint(2, 8))]
        for limit in (3, 4, 7):
            lengths = huffman.code_lengths(np.array(counts), limit)
            assert lengths.max() <= limit and sum(2.0**-n for n in lengths.tolist()) <= 1
            assert int((lengths * np.array(counts)).sum()) == optimal_cost(counts, limit)
    assert huffman.code_lengths(np.array([])).tolist() == [] and huffman.code_lengths(np.array([9])).tolist() == [1]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(5, dtype=np.int64), 2)


def test_huffman_round_trip(spark):
    rng = random.Random(8)
    lists = [[int(rng.paretovariate(0.5)) % 3000 for _ in range(n)] for n in (0, 1, 5, 1023, 1024, 1025, 5000)] + [None, [7], [7]]
    df = docs(spark, [(i if i != 3 else None, x, "b") for i, x in enumerate(lists)], "doc_id bigint, token_ids array<int>, bits string")
    book = huffman.build_book(df)
    coded = huffman.compress(df, book)
    assert coded.columns == ["doc_id", "bits_in", "n_tokens", "n_bits", "bits", "checkpoints"]
    back = huffman.decompress(coded, book).collect()
    assert Counter((r["doc_id"], None if r["token_ids"] is None else tuple(r["token_ids"])) for r in back) == Counter((i if i != 3 else None, None if x is None else tuple(x)) for i, x in enumerate(lists))
    for r in coded.filter("n_tokens > 1024").collect():  # any block alone
        x = lists[r["doc_id"]]
        for k, at in enumerate(r["checkpoints"]):
            part = x[k * huffman.BLOCK : (k + 1) * huffman.BLOCK]
            assert huffman.decode_block(bytes(r["bits"]), at, len(part), book) == part
    counts = Counter(v for x in lists for v in x or [])
    bits = sum(r["n_bits"] or 0 for r in coded.collect())
    assert bits == sum(int(n) * counts[int(i)] for i, n in zip(book.ids, book.lengths))


def test_huffman_blocks_of_many_rows(monkeypatch):
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 900, n) for n in (0, 1, 700, 64, 65, 3000, 0, 63)] + [None]
    found, counts = np.unique(np.concatenate(lists[:-1]), return_counts=True)
    for book in (huffman.Book(found, huffman.code_lengths(counts)), huffman.Book(found, huffman.code_lengths(counts, 10))):
        coded = huffman.encode_rows(np.concatenate(lists[:-1]), np.array([len(x) for x in lists[:-1]]), book, 64) + [(None, None, None, None)]
        for ids in (10, 1 << 19):
            monkeypatch.setattr(huffman, "SLICE_IDS", ids)
            got = huffman.decode_rows([c[2] for c in coded], [c[0] for c in coded], [c[3] for c in coded], book, 64)
            assert all((a is None) == (b is None) and (a is None or a.tolist() == b.tolist()) for a, b in zip(got, lists))


def test_huffman_of_many_ids(spark):
    df = docs(spark, [(1, list(range(0, 60_000, 3))), (2, [5_000_000, -7, 0] * 5000), (3, None)], "doc_id bigint, token_ids array<bigint>")
    book = huffman.build_book(df)
    again = huffman.read_book(huffman.book_row(spark, book))
    assert again.codes.tolist() == book.codes.tolist() and again.ids.tolist() == book.ids.tolist()
    back = huffman.decompress(huffman.compress(df, book), again, keep=True)
    assert back.columns == ["doc_id", "n_tokens", "n_bits", "bits", "checkpoints", "token_ids"]
    assert {r["doc_id"]: r["token_ids"] for r in back.collect()} == {r["doc_id"]: r["token_ids"] for r in df.collect()}


def test_huffman_null_ids_and_empty(spark):
    df = docs(spark, [(1, [None, 5, None]), (2, [None]), (3, [])], "doc_id bigint, token_ids array<bigint>")
    book = huffman.build_book(df)
    assert {r["doc_id"]: r["token_ids"] for r in huffman.decompress(huffman.compress(df, book), book).collect()} == {1: [5], 2: [], 3: []}
    none = df.limit(0)
    assert huffman.compress(none, huffman.build_book(none)).count() == 0


# Packing


def brute_best_fit(sizes, capacity):
    bins = []
    for i, s in enumerate(sizes):
        fits = [b for b in bins if b[0] + s <= capacity]
        if fits:
            b = max(fits, key=lambda b: b[0])
            b[0] += s
            b[1].append(i)
        else:
            bins.append([s, [i]])
    return [b[1] for b in bins]


def test_best_fit_against_brute_force():
    rng = random.Random(6)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 40) for _ in range(60)), reverse=True)
        assert packing.best_fit(sizes, 40) == brute_best_fit(sizes, 40)


def check_bins(bins, wanted, capacity):
    """Every item once and whole, no bin over its capacity."""
    pieces: dict = {}
    for b in bins:
        assert 0 < b["used"] <= capacity and b["used"] == sum(b["sizes"]) and b["n_items"] == len(b["doc_ids"]) == len(b["pieces"]) == len(b["sizes"])
        for d, p, z in zip(b["doc_ids"], b["pieces"], b["sizes"]):
            pieces.setdefault(d, []).append((p, z))
    assert len({b["bin_id"] for b in bins}) == len(bins)
    total = Counter()
    for i, s in wanted:
        for p in range(-(-s // capacity)):
            total[i, p, min(capacity, s - p * capacity)] += 1
    assert total == Counter((d, p, z) for d, x in pieces.items() for p, z in x)


@pytest.mark.parametrize("group_items,fan_in", [(20_000, 8), (10, 2), (7, 3)])
def test_packing(spark, group_items, fan_in):
    rng = random.Random(group_items)
    rows = [(i, "é" * rng.choice([0, 1, 10, 49, 120])) for i in range(150)] + [(None, "abc"), (None, "abc"), (7, "abc"), (200, None), (201, ""), (202, "x" * 1000)]
    bins = packing.pack(docs(spark, [(*r, "u") for r in rows], "doc_id bigint, text string, used string"), 100, group_items=group_items, fan_in=fan_in).collect()
    wanted = [(i, len(t.encode()) + 1 if t is not None else 1) for i, t in rows]
    check_bins(bins, wanted, 100)
    assert len(bins) <= 1.15 * sum(s for _, s in wanted) / 100 + 2


def test_packing_of_repeated_rows(spark):
    rows = [(5, 250)] * 3 + [(None, 250), (-1, 250), (None, 250), (7, 100), (7, 100), (None, 1), (None, 1), (8, None)]
    bins = packing.pack(docs(spark, rows, "doc_id bigint, z bigint"), 100, "z", group_items=3, fan_in=2).collect()
    check_bins(bins, [(i, z or 1) for i, z in rows], 100)
    copies = packing.pack(docs(spark, [(1, 40)] * 200, "doc_id bigint, z bigint"), 100, "z", group_items=10).collect()
    check_bins(copies, [(1, 40)] * 200, 100)
    assert len({b["bin_id"].split("-")[1] for b in copies}) > 10 and len(copies) <= 105  # not all in one group


def test_packing_of_items_over_half_a_bin(spark):
    """No two fit together: all bins are final in the first round, in their groups' tasks."""
    rng = random.Random(2)
    rows = [(i, rng.randint(600, 650)) for i in range(2000)]
    bins = packing.pack(docs(spark, rows, "doc_id bigint, z bigint"), 1000, "z", group_items=100).collect()
    check_bins(bins, rows, 1000)
    assert len(bins) == 2000 and {b["bin_id"].split("-")[0] for b in bins} == {"0"} and len({b["bin_id"].split("-")[1] for b in bins}) == 20


def test_packing_of_nothing(spark):
    assert packing.pack(docs(spark, []), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark, []), 0)


# The pipeline

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentences(rng, words, n):
    return "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(6, 14))).capitalize() + "." for _ in range(n))


def pipeline_rows():
    rng = random.Random(12)
    en, de = ("the and of to in cat dog house river walk over under with from near stone tree".split(), "der die das und ist nicht haus fluss baum stein gehen mit von unter ueber nahe".split())
    rows = []
    for i in range(40):
        lang, w = ("en", en) if i % 2 else ("de", de)
        rows.append((i, sentences(rng, w, rng.randint(2, 9)), lang))
    rows += [(50, rows[3][1], "en"), (51, rows[4][1] + "\nread more", "de"), (52, rows[5][1] + "\nOne more sentence stands at the end here.", "en")]
    rows += [(60, "home | about | help | contact", "en"), (61, None, "en"), (62, "", "de"), (63, "12345 67890.", "en"), (None, rows[6][1], "de"), (64, sentences(rng, en, 400), None), (3, rows[3][1], "en"), (65, "ꙮꙮ ꙮꙭ ꙭꙭꙭ ꙮ.", "en")]
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = pipeline_rows()
    d = tmp_path / "sf"
    docs(spark, [(i, t, lang, "s", len(t) if t else 0, "extra") for i, t, lang in rows], DOCUMENTS + ", accepted string").write.parquet(str(d / "documents.parquet"))
    cleaned = [(i, c, lang) for i, t, lang in rows for c, ok in [clean(t)] if ok]
    from weftgraph.llm import langid

    marked = brute_languages([(k, c, lang) for k, (_, c, lang) in enumerate(cleaned)], langid.TOP, langid.MAX_DISTANCE)
    known = [r for k, r in enumerate(cleaned) if marked[k][3]]
    kept = kept_of([(i, c) for i, c, _ in known])
    assert len(kept) < len(known) < len(cleaned) < len(rows)
    bins = corpus_pipeline.run(spark, str(d)).collect()
    check_bins(bins, [(i, len(bpe.encoding(bpe.default_vocabulary()).encode_ordinary(t)) + 1) for i, t in kept], 32768)
    now = spark.read.parquet(str(d / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(d))
        assert out.columns == now.columns, name
        now = out


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs(spark, [], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs(spark, [(1, None, None, None, None), (None, None, None, None, None)], DOCUMENTS).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "n-gram Jaccard join", "best-fit packing"]


# Names that clash


def test_names_that_differ_by_case_only(spark):
    from weftgraph.llm import fingerprints, html_extract, langid, licenses, quality

    schema = "doc_id bigint, text string, TEXT string, Doc_ID string, lang string, url string, URL string, html string, page_id bigint, token_ids array<int>, Token_IDs string"
    df = docs(spark, [(i, "MIT License and a good sentence of words.", "x", "y", "en", "http://a.b/", "z", "<p>t</p>", i, [1, 2], "w") for i in (1, 2)], schema)
    n = len(df.columns)
    assert sharding.shard(df, 2).count() == 2 and len(sharding.shard(df, 2).columns) == n + 2
    assert quality.accepted(df).count() == 2 and langid.accepted(df).count() == 2
    assert fingerprints.fingerprint(df, docs(spark, [(1, "x", "y")], "item_id bigint, text string, TEXT string")).count() == 2
    assert told(jaccard.links(df)) == {1: (1, 1, 1.0), 2: (1, 1, 1.0)} and [r["doc_id"] for r in jaccard.keep_one(df).collect()] == [1]
    assert bpe.encode(df).count() == bpe.encode_rows(df).count() == 2 and licenses.scan(df).count() == 2
    assert html_extract.extract(df).first()["text"] == "t" and packing.pack(df, 100).first()["n_items"] == 2
    book = huffman.build_book(df)
    assert huffman.decompress(huffman.compress(df, book), book).count() == 2


def test_ids_that_are_strings(spark):
    """Strings of integers are ids, any other string is an error, in all operators that return ids."""
    from weftgraph.llm import fingerprints, html_extract, licenses

    runs = (
        lambda d: fingerprints.fingerprint(d), lambda d: jaccard.links(d), lambda d: bpe.encode(d), lambda d: bpe.encode_rows(d), lambda d: bpe.count_rows(d), lambda d: licenses.scan(d),
        lambda d: html_extract.extract(d, "text", "text", "doc_id"), lambda d: packing.pack(d, 100, "1"),
    )
    good, bad = docs(spark, [("7", "MIT License of some words")], "doc_id string, text string"), docs(spark, [("x7", "MIT License of some words")], "doc_id string, text string")
    for run in runs:
        row = run(good).first()
        assert 7 in (row["doc_ids"] if "doc_ids" in row else [row["doc_id" if "doc_id" in row else "page_id"]])
        with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
            run(bad).collect()
