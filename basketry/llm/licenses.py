"""Licence scan with a positional rare-token index, with DataFrame operations only.

Every licence template is a list of mandatory key phrases. One pass over the documents keeps
the positions of the words that occur in any phrase (the postings, far smaller than the texts); their
document frequencies over the whole table give each word's rarity (IDF). For each file and phrase
the two words of highest IDF are looked up first: each occurrence, less the word's offset in the
phrase, proposes a start, and the proposals are intersected. Only where a start survives are the
other words of the phrase checked at their relative positions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import materialize

#: Texts are cut before A-Z are put in lower case, so these are ASCII characters other than letters and digits.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# The base phrases and their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# Key phrases of well-known licence texts, all of which a file has to hold.
TEMPLATES = {
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any"),
    "bsd-text": ("redistribution and use in source and binary forms with or without modification are permitted", "this software is provided by the copyright holders"),
    "apache-2": ("licensed under the apache license version 2 0",),
    "gpl-2": ("general public license version 2",),
    "gpl-3": ("general public license version 3",),
    "gpl-notice": ("free software you can redistribute it and or modify it under the terms of the gnu",),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "mpl-2": ("mozilla public license",),
    "cc-by": ("licensed under cc by",),
    "cc-by-nc": ("licensed under cc by nc",),
    "cc-by-sa": ("licensed under cc by sa",),
    "all-rights-reserved": ("all rights reserved",),
}


def postings(docs: DataFrame, vocabulary: Sequence[str], id_col: str, text_col: str) -> DataFrame:
    """(__row, __id, n_words, __posts): per input row the positions of vocabulary words, from 0."""
    split = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"),
                        F.split(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), SEPARATORS, -1).alias("__arr"))
    lead = (F.col("__arr")[0] == "").cast("int")
    trail = ((F.size("__arr") > 1) & (F.element_at("__arr", -1) == "")).cast("int")
    words = split.select("__row", "__id", lead.alias("__lead"), (F.size("__arr") - lead - trail).cast("long").alias("n_words"), F.posexplode("__arr").alias("__pos", "__word"))
    words = words.withColumn("__word", F.lower("__word"))
    hit = F.col("__word").isin(list(vocabulary))
    words = words.where(hit | (F.col("__pos") == 0))  # the first element, which every text has, carries the row
    return words.groupBy("__row").agg(
        F.first("__id").alias("__id"), F.max("n_words").alias("n_words"),
        F.collect_list(F.when(hit, F.struct((F.col("__pos") - F.col("__lead")).alias("pos"), F.col("__word").alias("word")))).alias("__posts"))


def _starts(word: str, offset: int) -> Column:
    return F.transform(F.filter("__posts", lambda p: p["word"] == word), lambda p: p["pos"] - F.lit(offset))


def scan(docs: DataFrame, base: Mapping[str, str] = BASE, templates: Mapping[str, Sequence[str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. n_base counts all places
    of base phrases; first_word and last_word are their least and greatest starts (else null). ``labels`` adds
    every template whose phrases all occur. score is the largest share, by IDF, of a label's phrases
    that occur (1 for any label given; 0 if no phrase occurs). ``matches`` lists (label, phrase, starts).
    Null texts count as empty; repeated rows and null ids are ordinary rows; an empty table gives an empty
    result. Other columns are ignored.
    """
    phrases = {(label, 0): phrase.split() for label, phrase in base.items()}
    phrases |= {(label, k): p.split() for label, ps in templates.items() for k, p in enumerate(ps)}
    vocabulary = sorted({w for p in phrases.values() for w in p})
    posts = materialize(postings(docs, vocabulary, id_col, text_col))
    seen = posts.select(F.explode(F.array_distinct(F.transform("__posts", lambda p: p["word"]))).alias("w")).groupBy("w").count()
    df = {r[0]: r[1] for r in seen.collect()}  # at most one row per vocabulary word
    n = posts.count()
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in vocabulary}
    none = F.array().cast("array<int>")
    order = {key: sorted(enumerate(words), key=lambda x: (-idf[x[1]], x[0])) for key, words in phrases.items()}
    keys = list(phrases)
    rare = []
    for i, key in enumerate(keys):
        found = _starts(order[key][0][1], order[key][0][0])
        if len(order[key]) > 1:
            found = F.array_intersect(found, _starts(order[key][1][1], order[key][1][0]))
        rare.append(found.alias(f"__rare{i}"))
    out = posts.select("__id", "n_words", "__posts", *rare)
    places = []
    for i, key in enumerate(keys):
        found = F.array_distinct(F.col(f"__rare{i}"))
        for offset, word in order[key][2:]:
            found = F.array_intersect(found, _starts(word, offset))
        places.append(F.when(F.size(F.col(f"__rare{i}")) > 0, F.array_sort(found)).otherwise(none).alias(f"__p{i}"))
    out = out.select("__id", "n_words", *places)
    at = {key: F.col(f"__p{i}") for i, key in enumerate(keys)}
    base_at = F.flatten(F.array(*[at[label, 0] for label in base]))
    shares, labels = [], []
    for label in {k[0]: None for k in keys}:
        own = [k for k in keys if k[0] == label]
        weight = {k: sum(idf[w] for w in phrases[k]) for k in own}
        found = sum((F.when(F.size(at[k]) > 0, F.lit(weight[k])).otherwise(0.0) for k in own), F.lit(0.0))
        shares.append(F.least(F.lit(1.0), found / sum(weight.values())))
        every = F.lit(True)
        for k in own:
            every = every & (F.size(at[k]) > 0)
        labels.append(F.when(every, F.lit(label)))
        if label in base:
            shares[-1] = F.when(every, F.lit(1.0)).otherwise(0.0)
    base_labels = [x for x, label in zip(labels, {k[0]: None for k in keys}, strict=True) if label in base]
    joined = lambda xs: F.array_join(F.array_sort(F.array_compact(F.array(*xs))), ",")
    matches = F.filter(F.array(*[F.struct(F.lit(k[0]).alias("label"), F.lit(" ".join(phrases[k])).alias("phrase"), at[k].alias("starts")) for k in keys]), lambda m: F.size(m["starts"]) > 0)
    return out.select(
        F.col("__id").alias(id_col), "n_words", F.size(base_at).cast("long").alias("n_base"),
        F.array_min(base_at).cast("long").alias("first_word"), F.array_max(base_at).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(labels).alias("labels"), F.greatest(*shares).alias("score"), matches.alias("matches"))
