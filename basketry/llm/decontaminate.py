"""Benchmark decontamination by pigeonhole edit matching.

A test item of n normalised bytes may differ from a document passage by ``floor(error_rate * n)``
edits. Cut into one piece more than that, at least one piece occurs unchanged in any such passage.
All pieces of a block of items form one Aho-Corasick automaton that runs over every whole
document; around each hit Myers' bit-parallel search finds the least distance.

Items too short for an edit (under MIN_BYTES) match exactly, between word boundaries.

Documents never move: each is tested where it was read. The items are broadcast in blocks of at
most about ``block_bytes``; a larger benchmark takes several passes over the documents, each with
one block, so no task ever holds more than one block. Documents are never rewritten for it.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import broadcast_if_small
from basketry.session import materialize

ERROR_RATE = 0.05
#: Items with fewer normalised bytes may differ by no edit, and match as whole words only.
MIN_BYTES = 20
BLOCK_BYTES = 8 << 20
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MATCHES = "array<struct<item:int, n_bytes:int, distance:int, budget:int, first_word:int, last_word:int>>"


def normalise(text: str | None) -> str:
    """Lower case, runs of other ASCII characters than letters and digits as one space; one character per UTF-8 byte."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_SPACED).split()).decode("latin-1")


def _between_words(text: str, i: int) -> bool:
    """Whether a word may end before place i of a normalised text, and one begin there: at spaces, and beside characters
    of scripts that are written without them (U+3000 and above)."""
    if i in (0, len(text)) or text[i - 1] == " " or text[i] == " ":
        return True
    before = i - 1
    while before > 0 and "\x80" <= text[before] < "\xc0":
        before -= 1
    return text[before] >= "\xe3" or text[i] >= "\xe3"


def pieces(text: str, budget: int) -> Iterator[tuple[str, int]]:
    """``budget + 1`` consecutive pieces and where they start."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return ((text[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of ``text``, and where the first such substring ends."""
    full = (1 << m) - 1
    top = 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        x = masks.get(c, 0) | minus
        diagonal = (((plus + (x & plus)) ^ plus) | x) & full
        down = plus & diagonal
        up = minus | (full & ~(plus | diagonal))
        score += bool(up & top) - bool(down & top)
        up = (up << 1) & full
        minus = up & diagonal
        plus = ((down << 1) | ~(up | diagonal)) & full
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """The automaton of one block of items: [(normalised text, index)]."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        self.items = {}
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, text in items:
            if not text:
                continue
            budget = int(error_rate * len(text)) if len(text) >= MIN_BYTES else 0
            masks: dict[str, int] = defaultdict(int)
            for j, c in enumerate(text):
                masks[c] |= 1 << j
            self.items[i] = (text, budget, dict(masks))
            for piece, offset in pieces(text, budget):
                at[piece].append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[dict]:
        if not self.items or not (t := normalise(text)):
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (n, where) in self.automaton.iter(t):
            for i, offset in where:
                starts[i].add(end + 1 - n - offset)
        out = []
        for i, found in starts.items():
            pattern, budget, masks = self.items[i]
            if len(pattern) < MIN_BYTES:
                whole = next((s for s in sorted(found) if _between_words(t, s) and _between_words(t, s + len(pattern))), None)
                if whole is not None:
                    out.append(self._row(t, i, 0, budget, whole, whole + len(pattern)))
                continue
            best = None
            low = high = None
            for s in [*sorted(found), None]:  # neighbouring hits share a window
                if low is not None and (s is None or s > high + 2 * budget):
                    a, b = max(0, low - budget), min(len(t), high + len(pattern) + budget)
                    whole = t.find(pattern, a, b)
                    d, e = (0, whole + len(pattern)) if whole >= 0 else (lambda r: (r[0], a + r[1]))(myers(masks, len(pattern), t[a:b]))
                    if d <= budget and (best is None or d < best[0]):
                        best = (d, max(0, low) if whole < 0 else whole, e)
                    low = None
                if s is not None:
                    low, high = (s if low is None else low), s
            if best:
                out.append(self._row(t, i, best[0], budget, best[1], best[2]))
        return sorted(out, key=lambda r: r["item"])

    def _row(self, t: str, item: int, distance: int, budget: int, start: int, end: int) -> dict:
        first = t.count(" ", 0, start)
        return {"item": item, "n_bytes": len(self.items[item][0]), "distance": distance, "budget": budget, "first_word": first, "last_word": max(first, t.count(" ", 0, end - 1))}


_BUILT: dict[str, Matcher] = {}


def _matches(items: list[tuple[int, str]], error_rate: float, spark, text: Column) -> Column:
    shared = spark.sparkContext.broadcast((items, error_rate))
    name = uuid.uuid4().hex

    @F.pandas_udf(_MATCHES)
    def found(texts: pd.Series) -> pd.Series:
        if name not in _BUILT:  # once per Python worker; the block before it goes
            _BUILT.clear()
            _BUILT[name] = Matcher(*shared.value)
        return pd.Series([_BUILT[name].find(t) for t in texts], dtype=object)

    return found(text)


def blocks(bench: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items [(id, normalised text)], in blocks of about ``block_bytes`` by hashed text; the size is checked first."""
    size = bench.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")) + 16)).first()[0] or 0
    n = -(-size // block_bytes)
    for k in range(n):
        part = bench.where(F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(n)) == k).select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
        yield [(r[0], normalise(r[1])) for r in part.collect()]


def find_leaks(docs: DataFrame, bench: DataFrame, error_rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, n_bytes, distance, budget, first_word, last_word) for every document and item within its budget.

    n_bytes is the length of the normalised item, so that a caller can leave out very short ones; distance is the least over the whole document, the words are counted in the normalised text (for an
    inexact match the first is that of the first unchanged piece's alignment). Null and empty texts and items
    match nothing; repeated documents or items each get their rows, null ids included; other columns are
    ignored. Very long texts are searched whole, in the one task that holds their row. An empty table on either
    side gives an empty result.
    """
    spark = docs.sparkSession
    doc, item = docs.schema[id_col].dataType, bench.schema[item_id_col].dataType
    out = None
    for part in blocks(bench, item_id_col, item_text_col, block_bytes):
        ids = spark.createDataFrame([(i, x[0]) for i, x in enumerate(part)], "item int, item_id " + item.simpleString())
        hits = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).where("__text IS NOT NULL")
        hits = hits.select("__id", F.explode(_matches([(i, x[1]) for i, x in enumerate(part)], error_rate, spark, F.col("__text"))).alias("m"))
        hits = hits.select("__id", "m.*").join(F.broadcast(ids), "item")  # one block's ids
        hits = hits.select(F.col("__id").alias(id_col), F.col("item_id").alias("item_id"), "n_bytes", "distance", "budget", "first_word", "last_word")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        out = spark.createDataFrame([], f"{id_col} {doc.simpleString()}, item_id {item.simpleString()}, n_bytes int, distance int, budget int, first_word int, last_word int")
    return out


def remove_leaks(docs: DataFrame, bench: DataFrame, error_rate: float = ERROR_RATE, text_col: str = "text",
                 item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item within its budget, all columns unchanged; rows without text stay.

    A single block of items filters the rows where they are read. With more, each block gives the hashes of the texts it is
    found in, few rows, and the rows with none of them stay: whether a row goes depends on its text alone.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    leaks = [F.size(_matches([(i, x[1]) for i, x in enumerate(part)], error_rate, spark, text)) > 0
             for part in blocks(bench.withColumn("__item", F.lit(0)), "__item", item_text_col, block_bytes)]
    if len(leaks) < 2:
        return docs.where(~leaks[0]) if leaks else docs
    keys = [F.xxhash64(text).alias("__k1"), F.xxhash64(F.lit(1), text).alias("__k2")]
    gone = None
    for leaked in leaks:
        hit = docs.where(leaked).select(*keys)
        gone = hit if gone is None else gone.unionByName(hit)
    gone = materialize(gone.distinct())
    return docs.withColumns({"__k1": keys[0], "__k2": keys[1]}).join(broadcast_if_small(gone), ["__k1", "__k2"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
