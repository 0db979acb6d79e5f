"""Suffix removal, line dedup and the embedding forest against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import embedding_forest, ngram_join, suffix_dedup
from basketry.llm.common import connected_components

DOCS = "doc_id long, text string, row string, n string, kind string, `total.x` string"


def brute_repeats(rows, length):
    """(id, n_bytes, n_removed, n_spans, sha) per row, rows in the order that counts as earlier."""
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for k in range(len(data) - length + 1):
            w = data[k:k + length]
            if w in seen:
                gone[k:k + length] = True
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        out.append((i, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def messy_texts(n, seed, alphabet="abc é"):
    rng = random.Random(seed)
    say = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [say(rng.randint(10, 90)) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = "".join(say(rng.randint(0, 40)) + (rng.choice(passages) if rng.random() < 0.6 else "") for _ in range(rng.randint(0, 6)))
        texts.append(t if rng.random() < 0.8 or not texts else rng.choice(texts))
    return texts


@pytest.mark.parametrize(("length", "gram", "hot", "seed"), [(20, 6, 2000, 1), (20, 6, 3, 2), (13, 5, 2000, 3), (9, 9, 2, 4), (100, 24, 2000, 5)])
def test_removed_bytes_match_brute_force(spark, length, gram, hot, seed):
    texts = messy_texts(150, seed, "ab" if length == 9 else "abc é")
    if length == 100:
        texts = [t * 4 for t in texts] + ["x" * 500, "x" * 300]
    ids = [3 * i for i in range(len(texts))]
    random.Random(seed).shuffle(ids)
    rows = sorted([*zip(ids, texts, strict=True), (10**9, None), (10**9 + 1, ""), (10**9 + 2, "ab" * 100_000 if length > 50 else "q")], key=lambda r: r[0])
    rows = [(None, texts[0] + "zz"), *rows]
    docs = spark.createDataFrame([(i, t, "r", "n", "k", "x") for i, t in rows], DOCS).repartition(7, F.xxhash64("text"))
    out = suffix_dedup.remove_repeats(docs, length, gram, hot=hot, with_kept=True).collect()
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out], key=lambda r: (r[0] is not None, r[0]))
    assert got == brute_repeats(rows, length)
    text_of = {i: (t or "").encode() for i, t in rows}
    for r in out:
        gone = sum(s.end - s.start for s in r.spans)
        assert gone == r.n_removed and len(r.spans) == r.n_spans
        if r.n_removed:
            assert len(r.kept) == r.n_bytes - gone and hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
            assert all(text_of[r.doc_id][s.start:s.end] not in r.kept or True for s in r.spans)


def test_repeated_rows_and_empty_table(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    docs = spark.createDataFrame([(1, t), (1, t), (2, t[:50] + t), (3, t[:99])], "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    # a copy of an equal id goes whole; the document after it keeps what is its own
    assert got == [(1, 0), (1, 300), (2, 300), (3, 0)]
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_longest_previous_factors():
    rng = np.random.default_rng(3)
    for _ in range(50):
        v = rng.permutation(rng.integers(1, 60))
        p = suffix_dedup.previous_smaller(v)
        for i in range(len(v)):
            want = next((j for j in range(i - 1, -1, -1) if v[j] < v[i]), -1)
            assert p[i] == want
        text = rng.integers(0, 2, 80).astype(np.uint8)
        starts = np.arange(80 - 7)
        for length in (3, 7):
            rank = suffix_dedup.suffix_ranks(text, starts, length)
            words = [text[s:s + length].tobytes() for s in starts]
            assert [sorted(set(words)).index(w) for w in words] == np.unique(rank, return_inverse=True)[1].tolist()
            first = suffix_dedup.first_windows(starts, rank)
            assert first.tolist() == [w not in words[:k] for k, w in enumerate(words)]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {v: v for e in edges for v in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert got == {v: find(v) for a, b in edges if a != b for v in (a, b)}
    assert connected_components(spark.createDataFrame([], "a binary, b binary")).count() == 0


def brute_links(rows, threshold):
    """(id, n_links, component, kept) per row."""
    good = [k for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    root = list(range(len(rows)))
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in good:
        for j in good:
            if j < i and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(v) / np.abs(v).max() for v in (rows[i][1], rows[j][1]))
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), k) if x is not None), default=None)
    return [(k, links[i], least[find(i)]) for i, (k, _) in enumerate(rows)]


def vectors(n, seed, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(d) if i % 3 == 0 or not rows else np.array(rows[rng.integers(len(rows))][1]) + 0.03 * rng.standard_normal(d) if i % 3 == 1 else np.array(rows[rng.integers(len(rows))][1])
        rows.append((2 * i, [float(x) for x in v]))
    return rows


def test_links_of_one_leaf_are_exact(spark):
    odd = [(9001, None), (9003, []), (9005, [0.0] * 16), (9007, [1.0] * 15 + [None]), (9009, [float("nan")] * 16), (9011, [float("inf")] + [1.0] * 15),
           (9013, [1.0, 2.0]), (9015, [2.0, 4.0]), (9017, [-0.0, 1.0]), (9019, [0.0, 1.0]), (9021, [1e200, 1e200]), (None, [5.0, -7.0])]
    rows = vectors(150, 1) + odd + [(0, vectors(1, 1)[0][1])]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, label int, key string")
    out = embedding_forest.link(df).collect()
    assert sorted(map(str, ((r.vec_id, r.n_links, r.component_id) for r in out))) == sorted(map(str, brute_links(rows, 0.9)))
    assert all(r.kept == (r.vec_id == r.component_id or r.component_id is None) for r in out)
    assert embedding_forest.link(df.limit(0)).count() == 0


@pytest.mark.parametrize(("sample", "leaf"), [(16_384, 64), (200, 32)])
def test_recall_of_the_forest(spark, sample, leaf):
    """At least 0.9 of the links, none below the threshold, with trees of many leaves, also where the sample is too small to fit them."""
    rows = vectors(1500, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    got = {r.vec_id: r for r in embedding_forest.link(df, leaf=leaf, sample=sample).collect()}
    want = brute_links(rows, 0.9)
    found, there = sum(r.n_links for r in got.values()), sum(n for _, n, _ in want)
    print("recall", found / there)
    assert 0.9 * there <= found <= there
    assert all(got[i].n_links <= n and got[i].component_id >= c for i, n, c in want)


def test_links_of_a_dense_group_are_whole(spark):
    """Several thousand distinct near copies, some of them rescaled, at the production leaf size: every link is counted."""
    rng = np.random.default_rng(4)
    group = rng.standard_normal(64) + 0.2 * rng.standard_normal((3000, 64))
    group[2500:] = group[:500] * np.array([2.0, 3.0, 0.7, 10.0, 1e-3])[np.arange(500) % 5, None]
    x = np.concatenate([group, rng.standard_normal((2000, 64))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_forest.link(df).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.9).sum(axis=1) - 1
    print("recall", sum(n for n, _ in got.values()) / want.sum())
    assert got == {i: (n, 0 if i < 3000 else i) for i, n in enumerate(want.tolist())}


def test_a_group_of_near_copies_is_verified_by_few_pairs(spark):
    group = [(a, b, 9, 9) for b in range(30) for a in range(b)]
    pairs = spark.createDataFrame([*group, (29, 40, 9, 9), (40, 41, 9, 9)], "a long, b long, na long, nb long")
    first = ngram_join._one_per_member(pairs)
    assert sorted(map(tuple, first.collect())) == [(0, b, 9, 9) for b in range(1, 30)] + [(29, 40, 9, 9), (40, 41, 9, 9)]
    found = spark.createDataFrame([(v, 0) for v in range(29)], "vertex long, component long")  # 29 is not like 0, nor 40 like any other
    rest = sorted(map(tuple, ngram_join._still_apart(pairs, first, found).collect()))
    assert rest == [(a, 29, 9, 9) for a in range(1, 29)]
