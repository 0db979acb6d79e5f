"""Language identification as multilingual mixture inference.

A language is a distribution over byte trigrams (lower case, hashed to 2^16 values, a separator before and after
every text, so that the shortest word has one), counted on a bounded, seeded sample of labelled documents. A document is a mixture of languages: every word
has a likelihood under each language from its trigrams, and expectation-maximisation estimates the
proportions of words. The language set is the one with the best likelihood less a penalty
per language (half the logarithm of the number of words, times PENALTY).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import byte_buffer, give_back, map_batches

#: Labelled documents that the counts of a language are taken from, about.
SAMPLE = 3000
GRAMS = 1 << 16
#: More languages than this are an error: the tables are broadcast.
MAX_LANGUAGES = 256
PENALTY = 4.0
ROUNDS = 15
#: Likelihoods of a word differ by at most this many nats, so that one odd word can't decide.
CLIP = 12.0
SLICE_BYTES = 1 << 19
UNDETERMINED = "und"

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint8)


def grams(folded: np.ndarray) -> np.ndarray:
    """Hashed trigram that starts at each byte but the last two."""
    b = folded.astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _padded(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes with a separator before and after each text, and the new offsets of the texts."""
    n = len(at) - 1
    out = np.full(len(flat) + 2 * n, 32, dtype=np.uint8)
    out[np.arange(len(flat)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))] = _FOLD[flat]
    return out, at + 2 * np.arange(n + 1)


def _inside(at: np.ndarray, n: int) -> np.ndarray:
    """Whether the trigram that starts at a byte lies within one document."""
    ok = np.ones(max(0, n - 2), dtype=bool)
    for back in (1, 2):
        edge = at[1:-1] - back
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    return ok


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages x GRAMS), from about ``sample`` documents of each."""
    kept = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.col(f"`{lang_col}`").cast("string").alias("__lang"))
    kept = kept.where("__text IS NOT NULL AND __lang IS NOT NULL")
    sizes = {r[0]: r[1] for r in kept.groupBy("__lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    names = sorted(sizes)
    if not names:
        return [], np.zeros((0, GRAMS), dtype=np.float32)
    rate = F.lit(0.0)
    for name in names:
        rate = F.when(F.col("__lang") == name, F.lit(min(1.0, sample / sizes[name]))).otherwise(rate)
    chosen = kept.where(F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(1 << 20)) < rate * (1 << 20)).select("__lang", "__text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(language, gram, n) of the task's documents."""
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for name in sorted(set(lang)):
                own = batch.column(1).filter(pa.array(lang == name))
                counts = held.setdefault(name, np.zeros(GRAMS, dtype=np.int64))
                for k in range(0, len(own), 64):  # a bounded number of sampled texts at once
                    flat, at = _padded(*byte_buffer(own.slice(k, 64)))
                    if len(flat) > 2:
                        counts += np.bincount(grams(flat)[_inside(at, len(flat))], minlength=GRAMS)
        for name, counts in held.items():
            cell = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cell), pa.string()), pa.array(cell.astype(np.int32)), pa.array(counts[cell])], names=["lang", "cell", "n"])
        give_back()

    counted = chosen.mapInArrow(count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()  # at most GRAMS rows a language
    table = np.full((len(names), GRAMS), 0.1)
    at = np.searchsorted(np.array(names), np.array(counted.column("lang").to_pylist(), dtype=str)) if counted.num_rows else np.empty(0, np.int64)
    table[at, counted.column("cell").to_numpy()] += counted.column("n").to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, words: np.ndarray, first: np.ndarray, count: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of documents whose words' likelihoods are rows of ``like``."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        joint = like * share[words]
        joint /= joint.sum(axis=1, keepdims=True)
        share = np.add.reduceat(joint, first, axis=0) / count[:, None]
    return share, np.add.reduceat(np.log((like * share[words]).sum(axis=1) + 1e-300), first)


def infer(flat: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Proportions (documents x languages) over the selected set; a row of zeros for a document without a word.

    The trigrams of a word are those from the separator before it to that before the next one. Only trigrams from the first
    word of a document to its end count, wherever it lies among the others. Equal proportions: the first language by name.
    """
    n_docs, n_langs = len(at) - 1, len(table)
    result = np.zeros((n_docs, n_langs))
    folded, at = _padded(flat, at)
    if len(folded) < 3 or not n_langs:
        starts = np.empty(0, np.int64)
    else:
        solid = folded != 32
        starts = np.flatnonzero(solid[1:] & ~solid[:-1])  # the separator before each word
    if not len(starts):
        return result
    doc_of = np.searchsorted(at, starts, side="right") - 1
    code, inside = grams(folded), _inside(at, len(folded))
    # what precedes a document's first word would count for the document before
    first_word = np.append(starts, len(folded))[np.searchsorted(starts, at[:-1])]
    lead = np.minimum(first_word, at[1:])
    for k in np.flatnonzero(lead > at[:-1]):
        inside[at[k]:lead[k]] = False
    logs = np.empty((len(starts), n_langs), dtype=np.float64)
    for k in range(n_langs):
        logs[:, k] = np.add.reduceat(np.where(inside, table[k][code], np.float32(0)), starts)
    logs -= logs.max(axis=1, keepdims=True)
    np.maximum(logs, -CLIP, out=logs)
    docs, first, words, count = np.unique(doc_of, return_index=True, return_inverse=True, return_counts=True)
    like = np.exp(logs)
    share, full = _em(like, words, first, count, np.ones((len(docs), n_langs)))
    alone = np.add.reduceat(logs, first, axis=0)
    best = alone.argmax(axis=1)
    price = PENALTY * 0.5 * np.log(count + 1.0)
    value = alone.max(axis=1) - price
    chosen = np.zeros_like(share)
    chosen[np.arange(len(docs)), best] = 1.0
    # no larger set can win where even the full likelihood at the price of two languages doesn't
    open_docs = np.flatnonzero(full - 2 * price > value)
    if len(open_docs):
        pick = np.isin(words, open_docs)
        sub, sub_words = like[pick], np.searchsorted(open_docs, words[pick])
        sub_first = np.concatenate([[0], np.cumsum(count[open_docs])[:-1]])
        order = np.argsort(-share[open_docs], axis=1, kind="stable")
        for size in range(2, n_langs + 1):
            allowed = np.zeros((len(open_docs), n_langs))
            np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
            p, ll = _em(sub, sub_words, sub_first, count[open_docs], allowed)
            gain = ll - size * price[open_docs]
            better = gain > value[open_docs]
            value[open_docs[better]] = gain[better]
            chosen[open_docs[better]] = p[better]
    result[docs] = chosen
    return result


def _has_letter(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a document has a letter; the characters are looked at only where no ASCII letter is."""
    out = np.zeros(len(at) - 1, dtype=bool)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        low = flat | 32
        out[full] = np.logical_or.reduceat((low >= 97) & (low <= 122), at[full])
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])):
        out[i] = any(c.isalpha() for c in flat[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` as struct ``row`` with lang_pred, score (its proportion) and languages ("de:0.25,en:0.75").

    "und" with score 0 and no languages for a text that is null or has no letter, or if nothing was learned. Every row is
    judged by its whole text alone, so repeated rows get equal results. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((languages, table))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = docs.select(row.alias("row"))
    text_at = docs.columns.index(text_col)

    def make():
        names, logp = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, at = byte_buffer(batch.column(0).field(text_at))
            share, letters = np.zeros((len(at) - 1, len(names))), np.zeros(len(at) - 1, dtype=bool)
            a = 0
            while a < len(at) - 1:  # slices of bounded size; a longer document is a slice of its own
                b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1)
                part, edges = flat[at[a]:at[b]], at[a:b + 1] - at[a]
                share[a:b], letters[a:b] = infer(part, edges, logp), _has_letter(part, edges)
                a = b
            pred, score, sets = [], [], []
            for i in range(len(letters)):
                if not letters[i] or not share[i].any():
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    sets.append("")
                    continue
                p = share[i]
                k = int(p.argmax())
                pred.append(names[k])
                score.append(min(1.0, float(p[k])))
                sets.append(",".join(f"{n}:{x:.3f}" for n, x in zip(names, p, strict=True) if x >= 0.0005))
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=["row", "lang_pred", "score", "languages"])

        return one

    schema = T.StructType([given.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("languages", T.StringType())])
    return map_batches(given, make, schema)


def held_out(id_col: str = "doc_id"):
    """Held out from training: crc32 of the id as text, modulo 3, is 1 (false for a null id)."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def label(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """``identify`` with a model learned from the labelled documents that have an id and aren't held out. An empty table gives an empty result."""
    learn = docs.where(~held_out(id_col) & F.col(f"`{id_col}`").isNotNull())
    return identify(docs, *train(learn, id_col, text_col, lang_col, sample), text_col=text_col)
