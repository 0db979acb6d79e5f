"""Lines whose rare words are shared by many unlike lines: only likely pairs may be verified on their words."""

import random

from basketry.llm import line_dedup


def _lines(n, seed):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(260)]
    return [" ".join(rng.sample(names, rng.randint(8, 130))) for _ in range(n)]


def test_unlike_lines_of_long_lists_are_not_verified(spark, monkeypatch):
    seen, verify = [], line_dedup._verify

    def counted(pairs, words, num, den):
        seen.append(words.count())
        return verify(pairs, words, num, den)

    monkeypatch.setattr(line_dedup, "_verify", counted)
    lines = _lines(1500, 5)
    near = [line.replace(line.split(" ")[3], "other") for line in lines[:20]]
    rows = [(i, "\n".join((lines + near)[4 * i:4 * i + 4])) for i in range(380)]
    got = line_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    gone = sorted(4 * r.doc_id + k for r in got for k in r.removed)
    sets = [set(x.split(" ")) for x in lines + near]
    assert gone == [i for i in range(1500, 1520) if 10 * len(sets[i] & sets[i - 1500]) >= 8 * len(sets[i] | sets[i - 1500])] != []
    assert sum(seen) < 300
