"""Line deduplication and the corpus pipeline against brute force; registration of the eleven queries."""

import random
import subprocess
import sys

import pytest

import corpus_pipeline
from basketry.llm import decontaminate, language, line_dedup, mixing, ngram_join, token_output
from basketry.llm.queries import QUERIES, WEIGHTS, levels, tokenizer_path

DOCS = "doc_id long, text string, word string, line string, n string, size string, `total.x` string"
SF = "/root/testdata/sf0.001"


def words_of(line):
    return {w for w in line.lower().split(" ") if w}


def brute_lines(rows, num=80, den=100):
    """(id, n_lines, removed line numbers) per row, rows in the order that counts as earlier."""
    earlier, out = [], []
    for i, text in rows:
        gone = []
        lines = (text or "").split("\n")
        for k, line in enumerate(lines):
            if w := words_of(line):
                if any(den * len(w & e) >= num * len(w | e) for e in earlier):
                    gone.append(k)
                earlier.append(w)
        out.append((i, len(lines), gone))
    return out


def lined_texts(n, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    lines = [" ".join(rng.choice(names) for _ in range(rng.randint(1, 30))) for _ in range(n)]
    texts = []
    for _ in range(n):
        own = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(lines).split(" ")
            for _ in range(rng.randint(0, 3)):  # near copies
                w[rng.randrange(len(w))] = rng.choice(names).upper()
            own.append(rng.choice(["", " ", "  "]) + " ".join(w))
        texts.append("\n".join(own))
    return texts


@pytest.mark.parametrize(("long", "hot", "ids"), [(64, 200_000, "plain"), (2, 200_000, "plain"), (64, 200_000, "odd"), (2, 0, "odd")])
def test_lines_match_brute_force(spark, monkeypatch, long, hot, ids):
    monkeypatch.setattr(line_dedup, "SAMPLE_RATE", 0.999)
    texts = lined_texts(120, 4)
    rows = [(5 * i + 2, t) for i, t in enumerate(texts)] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "\n \n"), (10**6 + 3, "x " * 40_000 + "\nA b\na B")]
    if ids == "odd":  # no id, a repeated id, an id that leaves no room for line numbers
        rows = [(None, texts[0] + "\nno id"), (-7, texts[1]), *rows, (2**62, "the end " + texts[3]), (2**62, texts[4])]
    docs = spark.createDataFrame([(i, t, "w", "l", "n", "s", "x") for i, t in rows], DOCS)
    got = line_dedup.find_repeats(docs.coalesce(1), long=long, hot=hot).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_removed, tuple(sorted(r.removed))) for r in got) == sorted((str(i), n, len(g), tuple(g)) for i, n, g in brute_lines(rows))
    assert line_dedup.find_repeats(docs.limit(0)).count() == 0


def test_cleaned_texts(spark):
    rows = [(1, "one two three\n\nfour five"), (2, "four five\nsix\nONE two three"), (3, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "w", "l", "n", "s", "x") for i, t in rows], DOCS)
    out = line_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "one two three\n\nfour five", 2: "six", 3: None, 4: ""}


def test_pipeline_stages_follow_their_operators(spark, tmp_path):
    """Each stage against its operator's effect computed plainly from its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_join", "decontaminate", "mix_sources", "token_output"]
    columns, previous = docs.columns, docs
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, previous, SF).write.parquet(path)
        previous = spark.read.parquet(path)
        outs.append(previous)
        assert k == 4 or previous.columns == columns
    one, two, three, four, five = (x.toPandas() for x in outs)
    told = {r["row"]["doc_id"]: r.lang_pred for r in language.label(docs).collect()}
    assert set(one.doc_id) == {i for i, lang in told.items() if lang != language.UNDETERMINED}
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in zip(one.doc_id, one.text, strict=True)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert set(two.doc_id) == {i for i in ids if find(i) == i}
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, t in zip(two.doc_id, two.text, strict=True) if not any(p in decontaminate.normalise(t) for p in items)}
    assert set(three.doc_id) <= clean and len(set(three.doc_id)) >= 0.99 * len(clean)
    drawn = mixing.mix(outs[2], levels(), WEIGHTS, share=0.5, max_epochs=4, seed=17).collect()
    assert sorted(four.doc_id) == sorted(r.doc_id for r in drawn) and set(four.doc_id) <= set(three.doc_id)
    library = token_output.Tokenizer(tokenizer_path(), 2).library
    want = sorted((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t in zip(four.doc_id, four.text, strict=True))
    assert sorted(zip(five.doc_id, five.n_tokens, strict=True)) == want
    rerun = corpus_pipeline.run(spark, SF).toPandas()
    assert sorted(map(tuple, rerun.values.tolist())) == sorted(map(tuple, five.values.tolist()))


def test_pipeline_of_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, `a.b` string"
    docs = spark.createDataFrame([(1, None, None, None, 0, "r", "x"), (2, "", "en", "src1", 0, "r", "x"), (None, "some words of a text", None, "web", 3, "r", "x"),
                                  (3, "some words of a text", "en", "src0", 3, "r", "x"), (3, "word " * 50_000, "en", "src0", 3, "r", "x")], schema)
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, SF)
            rows = out.collect()
            assert name == "token_output" or (out.columns == docs.columns and len(rows) <= 4 * given.count())


def test_stage_two_keeps_one_of_a_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(i, text + f" end{i % 3}") for i in range(30)] + [(99, "another text of six words here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_first(docs).collect()) == [0, 99]


def test_every_query_is_registered():
    import __spark_entry__ as entry

    known = entry.queries()
    for n in range(1, 14):
        assert len([q for q in known if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in known and set(QUERIES) < set(known)


def test_entry_works_without_this_subpackage():
    """As after the deletion of the folder and of corpus_pipeline.py: the other queries remain."""
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("basketry.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert not [q for q in e.queries() if q.startswith("op") or q == "pipeline"] and len(e.queries()) > 80 and len(e.oracle_sql()) > 70
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])
