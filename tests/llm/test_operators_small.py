"""Each operator against a brute-force version and its defined edge cases, on small tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.llm import decontaminate, language, licenses, mixing, ngram_join, sharding, token_output
from basketry.llm.queries import levels, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# columns that clash with names that operators use themselves
CLASHING = DOCS + ", row string, size string, n string, `total.x` string"


def table(spark, texts, schema=DOCS, langs=None):
    extra = ("r", "s", "n", "x") if schema == CLASHING else ()
    rows = [(i, t, (langs or ["en"])[k % len(langs or ["en"])], f"src{k % 7}", len(t or ""), *extra) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def random_texts(n, seed=1, words=60, vocabulary=400):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [" ".join(rng.choice(names) for _ in range(rng.randint(1, words))) for _ in range(n)], rng, names


# --- decontamination -------------------------------------------------------------------------------------


def edit_distance_inside(pattern, text):
    """Least edit distance of ``pattern`` to a substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        above, row = row, [i] + [0] * len(text)
        for j, c in enumerate(text, 1):
            row[j] = min(above[j - 1] + (p != c), above[j] + 1, row[j - 1] + 1)
    return min(row)


def test_myers_is_the_plain_table():
    rng = random.Random(3)
    for _ in range(200):
        pattern = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 70)))
        text = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        masks = collections.defaultdict(int)
        for j, c in enumerate(pattern):
            masks[c] |= 1 << j
        assert decontaminate.myers(masks, len(pattern), text)[0] == edit_distance_inside(pattern, text)


def test_leaks_match_brute_force(spark):
    texts, rng, names = random_texts(60, seed=5)
    items = [" ".join(rng.choice(names) for _ in range(20)) for _ in range(6)]
    for k in range(0, 60, 4):  # plant items with a few edits
        item = list(items[k % 6])
        for _ in range(k % 5):
            item[rng.randrange(len(item))] = rng.choice("xyz ")
        texts[k] = texts[k] + " " + "".join(item) + " " + texts[k]
    docs = table(spark, [*enumerate(texts), (None, items[0]), (7, None), (8, ""), (0, items[1].upper())], CLASHING)
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = set()
    for doc, text in [*enumerate(texts), (None, items[0]), (0, items[1].upper())]:
        for item, pattern in [*enumerate(items), (92, items[0])]:
            p = decontaminate.normalise(pattern)
            d = edit_distance_inside(p, decontaminate.normalise(text))
            if d <= int(0.05 * len(p)):
                want.add((doc, item, d))
    assert got == want and len({d for _, _, d in got}) > 2
    blocked = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.find_leaks(docs, bench, block_bytes=200).collect()}
    assert blocked == want  # a benchmark of several blocks
    hit = {d for d, _, _ in want}
    kept = decontaminate.remove_leaks(docs, bench, block_bytes=400)
    assert kept.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.doc_id) for r in docs.collect() if r.doc_id not in hit or r.text in (None, ""))


def test_leaks_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "some words of a test item that is long enough")], "item_id long, text string")
    assert decontaminate.find_leaks(table(spark, []), bench).count() == 0
    docs = table(spark, [(1, "text")])
    assert decontaminate.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.remove_leaks(docs, bench.limit(0)).count() == 1


# --- licences --------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_licences_match_brute_force(spark):
    texts, rng, names = random_texts(40, seed=9)
    phrases = [p for ps in licenses.TEMPLATES.values() for p in ps] + list(licenses.BASE.values())
    for k in range(40):
        w = texts[k].split()
        for _ in range(k % 4):
            w.insert(rng.randrange(len(w) + 1), rng.choice(phrases).upper() if k % 3 else rng.choice(phrases))
        texts[k] = ("..." if k % 2 else "") + ", ".join(w)
    texts += ["MIT-License MIT\nlicense", "mit mit license license", "É MIT License", "x" * 200_000 + " Apache License", "General Public", "..!"]
    docs = table(spark, [*enumerate(texts), (None, "MIT License"), (3, None), (3, ""), (0, texts[0])], CLASHING)
    got = sorted(tuple(str(x) for x in r[:7]) for r in licenses.scan(docs).collect())
    want = []
    for i, t in [*enumerate(texts), (None, "MIT License"), (3, None), (3, ""), (0, texts[0])]:
        w = words_of(t)
        places = lambda p: [j for j in range(len(w)) if w[j:j + len(p.split())] == p.split()]  # noqa: B023, E731
        base = {k: places(p) for k, p in licenses.BASE.items()}
        all_at = sorted(sum(base.values(), []))
        own = [k for k, v in base.items() if v]
        more = [k for k, ps in licenses.TEMPLATES.items() if all(places(p) for p in ps)]
        want.append(tuple(str(x) for x in (i, len(w), len(all_at), all_at[0] if all_at else None, all_at[-1] if all_at else None, ",".join(sorted(own)), ",".join(sorted({*own, *more})))))
    assert got == sorted(want)
    for r in licenses.scan(docs).collect():
        assert 0 <= r.score <= 1 and (not r.labels or r.score == 1) and (r.score > 0) == bool(r.matches)
    assert licenses.scan(docs.limit(0)).count() == 0


# --- language --------------------------------------------------------------------------------------------


def test_language_mixture(spark):
    rng = random.Random(2)
    spell = {"aa": "abcde", "bb": "fghij", "cc": "éèàùâ"}
    say = lambda lang, n: " ".join("".join(rng.choice(spell[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, say(["aa", "bb", "cc"][i % 3], 40), ["aa", "bb", "cc"][i % 3]) for i in range(300)]
    rows += [(1000, say("aa", 60) + " " + say("bb", 20), None), (1001, None, "aa"), (1002, "", "aa"), (1003, "12 34 !?", "bb"), (None, say("cc", 9), "cc"),
             (1004, "日本", None), (1005, "a", None), (1006, say("bb", 30_000), None), (1006, say("bb", 3), None)]
    docs = spark.createDataFrame([(i, t, lang, "s", "odd") for i, t, lang in rows], "doc_id long, text string, lang string, source string, lang_pred string")
    out = {(r["row"]["doc_id"], r["row"]["text"]): r for r in language.label(docs).collect()}
    assert len(out) == len(rows)
    for i, t, lang in rows[:300]:
        assert out[i, t].lang_pred == lang and out[i, t].score > 0.9
    mixed = out[rows[300][0], rows[300][1]]
    assert mixed.lang_pred == "aa" and abs(mixed.score - 0.75) < 0.1 and "bb:" in mixed.languages
    for i in (1001, 1002, 1003):
        assert next(r.lang_pred for (k, _), r in out.items() if k == i) == "und"
    assert out[1006, rows[-2][1]].lang_pred == "bb" == out[1006, rows[-1][1]].lang_pred
    assert out[1004, "日本"].lang_pred in spell and 0 <= out[1005, "a"].score <= 1
    assert language.label(docs.limit(0)).count() == 0


def test_language_is_learned_from_others_only(spark):
    """Neither labels of held-out documents nor lang, source and doc_id of a document change its prediction."""
    texts, *_ = random_texts(120, seed=4)
    docs = table(spark, enumerate(texts), langs=["aa", "bb"])
    spoiled = docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    one = {r["row"]["doc_id"]: (r.lang_pred, r.score) for r in language.label(docs).collect()}
    two = {r["row"]["doc_id"]: (r.lang_pred, r.score) for r in language.label(spoiled).collect()}
    assert one == two
    folds = {r.doc_id: r.h for r in docs.select("doc_id", language.held_out().alias("h")).collect()}
    assert all(folds[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))


# --- token output ----------------------------------------------------------------------------------------


def test_rans_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 700_000), 50_000).astype(np.uint16)
    code = token_output.Coder(token_output.frequencies(np.bincount(ids, minlength=1 << 16)))
    for n in (0, 1, 63, 64, 1000, 65_536, 700_000):
        block = code.encode(ids[:n])
        assert np.array_equal(code.decode(block), ids[:n])
    n_points = int(np.frombuffer(block, "<u4", 1, 12)[0])
    assert n_points > 1
    for k in range(n_points):  # each checkpoint starts a reader of its own
        at = k * token_output.CHECKPOINT_STEPS * token_output.LANES
        assert np.array_equal(code.decode(block, k), ids[at:])
    entropy = -sum(p * np.log2(p) for p in np.unique(ids, return_counts=True)[1] / len(ids))
    kept_states = 16 + n_points * (8 + 8 * token_output.LANES)
    assert (len(block) - kept_states) * 8 < 1.01 * entropy * len(ids) and kept_states < 0.06 * len(block)
    one = np.full(5000, 7, dtype=np.uint16)
    only = token_output.Coder(token_output.frequencies(np.bincount(one, minlength=1 << 16)))
    assert np.array_equal(only.decode(only.encode(one)), one)


TOKEN_TEXTS = ["two words", " lead", "trail ", "a  b   c", "x\n y\n\n z \n", "don't 've's", "", "tab\tand \tspace", "nbsp   x 　y", "<|endoftext|> end", "é è 日本 語", " ", "  ", "\n", "5 6,7 .,.", "a\x1c b \x1cc \x85 d"]


def test_tokens_are_those_of_the_library(spark):
    library = token_output.Tokenizer(tokenizer_path(), 2).library
    texts = [*TOKEN_TEXTS, *random_texts(30, seed=8)[0]]
    rows = [(len(texts) - i, t) for i, t in enumerate(texts)] + [(500, None), (500, "twice"), (None, "no id"), (10**12, "long " * 40_000)]
    docs = table(spark, rows, CLASHING)
    out = token_output.read_blocks(*token_output.write_blocks(docs, tokenizer_path()), with_ids=True).collect()
    got = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    assert sorted((str(r.doc_id), tuple(r.ids)) for r in got) == sorted((str(i), tuple(ids(t))) for i, t in rows)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
        at += r.n_tokens
    empty = token_output.read_blocks(*token_output.write_blocks(docs.limit(0), tokenizer_path()))
    assert empty.count() == 0


def test_a_damaged_block_is_an_error(spark):
    blocks, freq = token_output.write_blocks(table(spark, [(1, "some text"), (2, "more")]), tokenizer_path())
    bad = blocks.withColumn("data", F.concat(F.expr("substring(data, 1, octet_length(data) - 1)"), F.lit(b"\x01")))
    with pytest.raises(Exception, match="checksum"):
        token_output.read_blocks(bad, freq).collect()


def test_a_forgetful_tokenizer_agrees(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 5)
    tok = token_output.Tokenizer(tokenizer_path(), 2)
    for t in TOKEN_TEXTS * 2:
        ids, n = tok.encode([t])
        assert ids.tolist() == tok.library.encode(t, add_special_tokens=False).ids + [2] and n.tolist() == [len(ids)]


def test_workers_remember_pieces_beyond_a_task(spark):
    docs = table(spark, [(i, t) for i, t in enumerate(random_texts(40)[0])])
    token_output.tokenise(docs, tokenizer_path(), 2, "doc_id", "text").collect()

    def held(batches):
        from basketry.llm import token_output as own

        for batch in batches:
            yield batch.assign(id=max((len(t.number) for t in own._TOKENIZERS.values()), default=0))

    assert spark.range(64).repartition(16).mapInPandas(held, "id long").agg(F.max("id")).first()[0] > 100


def test_added_tokens_are_those_of_the_library_as_loaded():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    mark = "<|endoftext|>"
    texts = [f"{mark} end", "plain text", f"a {mark}", f" x  {mark}{mark} y \n{mark}.", mark, "", f"<|endof {mark[:-1]} text|>", f"it's,{mark}it's, {mark} ", *TOKEN_TEXTS]
    want = [library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert want[0] == [50256, 886, 2]
    tok = token_output.Tokenizer(tokenizer_path(), 2)
    for _ in range(2):
        ids, n = tok.encode(texts)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_a_text_is_judged_alone_wherever_it_lies():
    rng = np.random.default_rng(2)
    counts = rng.integers(1, 50, (3, language.GRAMS)).astype(float)
    logs = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    texts = ["ab", "some words of it", "", "a", "2024 was a year", "12 34", "ends in to a", " it is no", "xy ", "more words, at last b", "  "]

    def judged(some):
        at = np.cumsum([0, *[len(t) for t in some]])
        return language.infer(np.frombuffer("".join(some).encode(), np.uint8), at, logs)

    want = {t: judged([t])[0] for t in texts}
    assert want["ab"].any() and want["a"].any() and not want["12 34"].any() and want["ends in to a"].any()
    for turn in range(len(texts)):
        some = texts[turn:] + texts[:turn]
        for order in (some, some[::-1]):
            for t, row in zip(order, judged(order), strict=True):
                assert np.allclose(row, want[t], atol=1e-6), (t, order)


# --- mixing ----------------------------------------------------------------------------------------------


def fill(budget, children):
    """Water filling by bisection: {name: (capacity, weight)} -> {name: share}."""
    if sum(c for c, w in children.values() if w > 0) <= budget:
        return {k: c if w > 0 else 0.0 for k, (c, w) in children.items()}
    low, high = 0.0, 1e18
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in children.values()) <= budget else (low, mid)
    return {k: min(c, low * w) for k, (c, w) in children.items()}


def test_mixing_matches_brute_force(spark):
    texts, rng, _ = random_texts(400, seed=6)
    rows = [(i, t, rng.choice(["en", "en", "en", "de", None]), rng.choice(["src0", "src0", "src0", "src5", "src9", "web", None]), 0) for i, t in enumerate(texts)]
    rows += [(900, "", "en", "src0", 0), (901, None, "de", "src5", 0), (902, " \n\t", "en", "src9", 0), (5, texts[5], rows[5][2], rows[5][3], 0)]
    docs = spark.createDataFrame(rows, DOCS)
    weights = {("domain0",): 5.0, ("*", "en"): 3.0, ("domain1", "en"): 1.0, ("unknown",): 0.5, ("domain0", "de", "src0"): 0.0}
    got = mixing.mix(docs, levels(), weights, share=0.8, max_epochs=3, seed=4, with_row=True).collect()
    domain = lambda s: f"domain{int(s[3:]) // 5}" if s and s.startswith("src") else "unknown"
    leaf, tokens = collections.defaultdict(list), collections.Counter()
    for r in rows:
        if n := len((r[1] or "").split()):
            leaf[domain(r[3]), r[2] or "unknown", r[3] or "unknown"].append((r[0], n))
            tokens[domain(r[3]), r[2] or "unknown", r[3] or "unknown"] += n

    def weight(path):
        out = 1.0
        for key, w in weights.items():
            if len(key) == len(path) and all(k in ("*", p) for k, p in zip(key, path, strict=True)):
                out = w
        return out

    def spread(prefix, budget):
        if len(prefix) == 3:
            return {prefix: budget}
        names = sorted({p[len(prefix)] for p in tokens if p[: len(prefix)] == prefix})
        own = {n: (sum(3.0 * v for p, v in tokens.items() if p[: len(prefix) + 1] == (*prefix, n)), weight((*prefix, n))) for n in names}
        return {k: v for n, share in fill(budget, own).items() for k, v in spread((*prefix, n), share).items()}

    quota = spread((), min(0.8 * sum(tokens.values()), 3.0 * sum(tokens.values())))
    taken = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in got:
        taken[r.domain, r.lang, r.source][r.epoch].append((r.doc_id, r.n_tokens))
        assert r["row"]["doc_id"] == r.doc_id
    for key, docs_of in leaf.items():
        whole = min(3, int(quota[key] / tokens[key] + 1e-9))
        for e in range(1, whole + 1):
            assert sorted(taken[key][e]) == sorted(docs_of), (key, e)
        rest = quota[key] - whole * tokens[key]
        part = taken[key].get(whole + 1, [])
        assert set(taken[key]) <= set(range(1, whole + 2))
        assert sum(n for _, n in part) <= rest + 1e-3
        if whole < 3 and rest >= 1:  # no more than the next document is missing
            assert rest - sum(n for _, n in part) < 2 * max(n for _, n in docs_of) + 1
    again = mixing.mix(docs.repartition(5), levels(), weights, share=0.8, max_epochs=3, seed=4).collect()
    assert sorted((r.doc_id, r.epoch) for r in again) == sorted((r.doc_id, r.epoch) for r in got)
    other = mixing.mix(docs, levels(), weights, share=0.8, max_epochs=3, seed=5).collect()
    assert sorted((r.doc_id, r.epoch) for r in other) != sorted((r.doc_id, r.epoch) for r in got)
    assert mixing.mix(docs.limit(0), levels(), weights).count() == 0


# --- sharding --------------------------------------------------------------------------------------------


def test_shards(spark):
    texts, rng, _ = random_texts(600, seed=7)
    rows = list(enumerate(texts)) + [(1000 + i, "the same long text " * 30) for i in range(300)] + [(2000, None), (2001, ""), (None, "no id"), (3, "again"), (3, "again")]
    out = sharding.shard(table(spark, rows, CLASHING), n_shards=8).collect()
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sums[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sums.values()) / 8
    assert max(abs(s - mean) for s in sums.values()) < 0.02 * mean
    by_text = collections.defaultdict(set)
    text_of = {i: t for i, t in rows if i is not None}
    for r in out:
        if r.doc_id is not None and (r.doc_id < 1000 or r.doc_id == 3) and r.doc_id != 3:
            by_text[text_of[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    assert sharding.shard(table(spark, []), n_shards=8).count() == 0


# --- n-gram join -----------------------------------------------------------------------------------------


def brute_components(rows, width, num, den):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if least.get(r) is None else least[r] if k is None else min(least[r], k)
    return [(k, len(s), least[find(i)]) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(seed=11, n=60, vocabulary=200):
    texts, rng, names = random_texts(n, seed=seed, words=80, vocabulary=vocabulary)
    for k in range(n):  # chains of copies with a few words changed
        w = texts[k].split()
        for _ in range(k % 6):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(names)
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize(("width", "num", "den", "hot"), [(3, 90, 100, 8192), (5, 80, 100, 8192), (3, 80, 100, 8)])
def test_ngram_join_matches_brute_force(spark, width, num, den, hot):
    texts = near_copies()
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(5, None), (6, ""), (6, " \n"), (7, "One"), (8, "one"), (None, "one"), (9, "one two"), (2, texts[0].upper()), (2, texts[0]), (10**6, "w " * 50_000)]
    docs = table(spark, rows, CLASHING)
    got = ngram_join.join(docs, width, num, den, hot=hot)
    want = brute_components(rows, width, num, den)
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()))) == sorted(map(str, want))
    assert ngram_join.join(docs.limit(0), width, num, den).count() == 0


@pytest.mark.parametrize(("num", "edits", "hot"), [(80, 6, 4096), (90, 5, 4096), (80, 9, 20)])
def test_large_near_groups_match_brute_force(spark, num, edits, hot):
    """Two groups of many near copies around the threshold: several rounds, and lists in blocks."""
    rng = random.Random(21)
    texts = []
    for g in range(2):
        base = [f"{rng.choice('abcdef')}{rng.randrange(10_000)}" for _ in range(150)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = ngram_join.join(table(spark, rows), 3, num, 100, hot=hot)
    want = brute_components(rows, 3, num, 100)
    assert len({c for _, _, c in want}) > 2
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == sorted(want)


def test_keep_first_keeps_one_of_each(spark):
    texts = near_copies(seed=12, n=30)
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, texts[0])]
    docs = table(spark, rows, CLASHING)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = [k for k, n, c in brute_components(rows, 5, 80, 100) if not n or k == c]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
