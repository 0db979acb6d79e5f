"""Conversation tries, spelling variants and multiset hashes against brute force."""

import collections
import hashlib
import random
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from basketry.llm import multiset_hash, prefix_trie, spelling

TURNS = "conv_id long, turn long, role string, text string, c long, path string, part int, shard int"


# --- trie of conversations --------------------------------------------------------------------------------


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], TURNS)


def random_turns(n, seed, copies=30):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        own = [("user" if k % 2 else None, rng.choice(["hello", "", None, "är"])) for k in range(rng.randint(0, 7))]
        if c % 3 == 0:
            own = [("user", "hi"), ("assistant", "yes"), ("user", "more")][: rng.randint(1, 3)]
        rows += [(c, None if k == 0 and c % 4 == 0 else k, r, t) for k, (r, t) in enumerate(own)]
    for c in range(n, n + copies):  # one conversation many times
        rows += [(c, k, "user", f"turn {k}") for k in range(10)]
    rng.shuffle(rows)
    return [*rows, (None, 0, "user", "belongs to none"), (-7, 0, "user", "hi"), (-5, 0, "user", "hello")]


def brute_paths(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + v[h:]
    return out


def brute_trie(paths):
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -99, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


@pytest.mark.parametrize("shards, sample, depth", [(1, 100, 256), (7, 10_000, 256), (30, 10_000, 256), (12, 20, 256), (30, 10_000, 3)])
def test_trie_matches_brute_force(spark, monkeypatch, shards, sample, depth):
    monkeypatch.setattr(prefix_trie, "DEPTH", depth)  # paths beyond it stay in one shard
    rows = random_turns(90, seed=shards)
    got = prefix_trie.trie(prefix_trie.rebuilt(turns_table(spark, rows)), shards, sample)
    assert sorted(tuple(-99 if x is None else x for x in r) for r in got.collect()) == brute_trie(brute_paths(rows))


def test_trie_of_long_conversations(spark):
    long = [(c, k, "user", f"t{k % 7}") for c in (10, 11, 12) for k in range(700)] + [(20, 0, "user", "x" * 200_000)]
    got = prefix_trie.trie(prefix_trie.rebuilt(turns_table(spark, long)), 5).collect()
    assert sorted(tuple(-99 if x is None else x for x in r) for r in got) == brute_trie(brute_paths(long))


def test_trie_of_no_conversations(spark):
    assert prefix_trie.trie(prefix_trie.rebuilt(turns_table(spark, []))).count() == 0


def test_trie_of_an_input_behind_a_shuffle(spark):
    rows = random_turns(60, seed=5)
    dealt = turns_table(spark, rows).repartition(13, "turn")
    got = prefix_trie.trie(prefix_trie.rebuilt(dealt), 6)
    assert sorted(tuple(-99 if x is None else x for x in r) for r in got.collect()) == brute_trie(brute_paths(rows))


# --- spelling variants ------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, word string, n long, key long, w string"


def docs_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], DOCS)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    import re

    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            n[run] += 1
    words = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    out = {}
    for w in words:
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form = best if best is not None and words[best] >= 10 * words[w] else None
        out[w] = (form, words[w], len(others), words[form] if form else None)
    result = set()
    for w, (form, c, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        result.add((w, form, root, c, k, m))
    return result


def misspelt(seed, n=300, syllables=6):
    rng = random.Random(seed)
    parts = ["an", "the", "tion", "é", "ß", "re", "on", "st", "A"][:syllables + 2]
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(30)]
        for k in range(0, 30, 7):
            w = words[k]
            at = rng.randrange(len(w))
            words[k] = rng.choice([w[:at] + w[at + 1:], w[:at] + "x" + w[at:], w[:at] + "o" + w[at + 1:], w + "s", "z" + w])
        rows.append((i, rng.choice([" ", ", ", "-1"]).join(words)))
    return rows


@pytest.mark.parametrize("seed, places", [(1, spelling.DICTIONARY), (2, 50), (3, 500)])
def test_variants_match_brute_force(spark, seed, places):
    rows = misspelt(seed) + [(None, "nullnull nullnull NULLNULL"), (3, None), (3, ""), (4, "elevenletter " * 40 + "elevenlettr " * 3), (4, "elevenletter")]
    rows += [(5, "a" * 30_000 + " " + "a" * 30_000), (6, "lastword×÷ lastword×÷ sooooooo soooooooo " * 2)]
    got = spelling.variants(docs_table(spark, rows), places=places)
    result = [tuple(r) for r in got.collect()]
    assert len(result) == len(set(result)) and set(result) == brute_variants(rows)
    assert any(r[1] for r in result) and max(r[4] for r in result) > 3


def test_forms_are_followed_to_the_last(spark):
    words = {"abcdefgh": 5000, "abcdefgx": 400, "abcdefyx": 30, "abcdezyx": 2}
    rows = [(1, " ".join(w for w, k in words.items() for _ in range(k)))]
    got = {r.word: r.root for r in spelling.variants(docs_table(spark, rows), damage=0).collect()}
    assert got == {w: "abcdefgh" for w in words}


def test_variants_of_no_words(spark):
    assert spelling.variants(docs_table(spark, [])).count() == 0
    assert spelling.variants(docs_table(spark, [(1, "short words only"), (2, None)])).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(docs_table(spark, []), min_length=3)


# --- multiset hashes --------------------------------------------------------------------------------------


def brute_state(text):
    exact, alike = [0] * multiset_hash.EXACT, [0] * multiset_hash.ALIKE
    for p in text.split("\n"):
        sha = hashlib.sha256(p.encode()).hexdigest()
        exact = [(x + int(sha[8 * i:8 * i + 8], 16)) % 2**32 for i, x in enumerate(exact)]
        words = p.split(" ")
        for i in range(max(1, len(words) - multiset_hash.WORDS + 1)):
            h0 = 42
            for w in words[i:i + multiset_hash.WORDS]:
                h0 = xxhash.xxh64_intdigest(w.encode(), h0)
            h1 = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), xxhash.xxh64_intdigest(h0.to_bytes(8, "little"), 42))
            for k, h in enumerate((h0, h1)):
                for j in range(32):
                    for half in (0, 1):
                        alike[64 * k + 2 * j + half] += 2 * (h >> j + 32 * half & 1) - 1
    return exact, [(x + 2**15) % 2**16 - 2**15 for x in alike]


def as_digits(state):
    return "".join(f"{x:08x}" for x in state[0]) + "".join(f"{x % 2**16:04x}" for x in state[1])


def brute_likeness(a, b):
    if a == b:
        return 1.0
    apart = sum(((x - y + 2**15) % 2**16 - 2**15) ** 2 for x, y in zip(a[1], b[1], strict=True))
    both = sum(x * x for x in a[1]) + sum(x * x for x in b[1])
    return min(1.0, max(0.0, (both - apart) / (both + apart))) if both + apart else 0.0


def brute_edits(rows):
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        new = text[:len(text) - q] + after[:q]
        a, b = brute_state(text), brute_state(new)
        out.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), as_digits(a), as_digits(b), round(brute_likeness(a, b), 9), round(brute_likeness(a, brute_state(after)), 9)))
    return out


def messy(n, seed):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(["ä", "the", "of", "wörd", "𝄞", ""]) for _ in range(rng.randint(0, 14))) for _ in range(40)]
    return [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 9)))) for i in range(n)]


def edits_of(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r[:7]) for r in multiset_hash.edited(df).collect()), key=str)


WIDE = "doc_id long, text string, k1 string, n string, m int, state string, ord int, times int"


def wide(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2, 3) for r in rows], WIDE)


def test_edits_match_brute_force(spark):
    rows = [*messy(60, 4), (60, ""), (61, "\n\n"), (62, "abc\n"), (63, "a\tb " * 30_000 + "\n" + "c" * 1_000), (64, "x")]
    df = wide(spark, rows)
    assert edits_of(df) == sorted(brute_edits(rows), key=str)
    assert edits_of(df.repartition(5, "text")) == sorted(brute_edits(rows), key=str)  # an input behind a shuffle


def test_edits_of_nulls_and_repeated_rows(spark):
    rows = [(None, "first text\nof no id"), (1, "one\ntwo three"), (1, "one\ntwo three"), (1, "one\ntwo three"), (2, None), (3, "last")]
    want = brute_edits([(i, t or "") for i, t in rows])
    assert edits_of(wide(spark, rows)) == sorted(want, key=str)
    got = multiset_hash.edited(wide(spark, rows[1:4])).collect()
    assert len(got) == 3 and all(r.near_next == 1.0 for r in got)
    assert multiset_hash.edited(wide(spark, [(1, "alone")])).first().near_next == 1.0
    assert multiset_hash.edited(wide(spark, [])).count() == 0


def test_paragraphs_are_inserted_and_deleted(spark):
    a, b = "some words of a first one\nsecond\nthird", "added\nsecond one of five words"
    df = spark.createDataFrame([(1, a), (2, b), (3, b + "\n" + a), (4, None)], "doc_id long, text string")
    states = multiset_hash.fingerprints(df)
    row = states.groupBy().agg(*[F.max_by("state", F.col("doc_id") == k).alias(f"s{k}") for k in (1, 2, 3)])
    got = row.select(multiset_hash.insert(F.col("s1"), F.col("s2")) == F.col("s3"), multiset_hash.delete(F.col("s3"), F.col("s2")) == F.col("s1"), F.col("s1") == F.col("s2")).first()
    assert tuple(got) == (True, True, False) and states.count() == 4


def test_likeness_follows_the_share_of_common_paragraphs(spark):
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(12)) for _ in range(200)]
    texts = ["\n".join(lines[:100]), "\n".join(lines[20:100] + lines[100:120]), "\n".join(reversed(lines[:100])), "\n".join(lines[100:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    states = [(r.state["exact"], r.state["alike"]) for r in multiset_hash.fingerprints(df).orderBy("doc_id").collect()]
    near_ = [brute_likeness(states[0], s) for s in states]
    assert near_[2] == 1.0 and abs(near_[1] - 80 / 120) < 0.15 and near_[3] < 0.2
