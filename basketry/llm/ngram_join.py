"""Exact Jaccard join of documents on word n-grams by vertical partitioning.

Equal n-gram sets are one vertex. n-grams are ordered globally by estimated rarity (two tables of
2^16 counts over the whole corpus: of words, whose product tells chance n-grams, and of n-grams, which tell copied
ones), then hash. Sets of similarity t share COMMON of their first ``n - ceil(t n) + COMMON`` n-grams in that
order, so documents that meet there so often are candidates. The hash order is cut into fragments at fixed pivots:
the number of a set's n-grams in each of 32 fragments bounds the distance of two sets from below and prunes
candidates exactly; finer fragments, for sets of similar size down to two n-grams each, do so again. The rest is decided by
joining both documents' n-grams fragment by fragment, counting each fragment's overlap on its own and summing per pair:
where there are many, first one pair of each document, then those that the links found leave in different components.

Only components are wanted, so no list emits all its pairs. In a round every member of a list proposes
its nearest ``k`` remaining partners of other components; a list with members that have more comes
again in the next round with the components found so far and eight times ``k``, until no pair of
different components is left untested. A list of more than HOT members is cut into blocks, and the pairs
of blocks are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import Tables, broadcast_if_small, byte_buffer, connected_components, give_back, map_batches, mix64, stable
from basketry.session import materialize, release

TABLE_BITS = 16
#: Fragments of the hash order whose counts a sketch holds (4 bits each), and those that overlaps are counted in.
SKETCH, FRAGMENTS = 32, 8
HOT = 4096
#: Sets that match share so many of their first n-grams (or all they have to share, if fewer): in lists of at most SHORT
#: members pairs are counted, in longer ones a single meeting suffices.
COMMON, SHORT = 3, 8
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D)
_BACK = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_STEP = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)
_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the next slice."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, r in (("up", _BASE), ("down", _BACK)):
            p = np.full(size, r, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z in lower case) and the document of each."""
    if not len(flat):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    solid = ~_SPACE[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(flat), dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(flat), dtype=bool)
    after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _power(len(flat))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[flat]] * up, dtype=np.uint64)])
    return mix64((total[ends] - total[starts]) * down[starts]), np.searchsorted(at, starts, side="right") - 1


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, index of the first word, offsets of documents): runs of ``width`` words, the whole text where it has fewer."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.cumsum(count) - count
    n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(n)])
    start = np.repeat(first - offsets[:-1], n) + np.arange(offsets[-1])
    length = np.minimum(np.repeat(count, n), width)
    h = length.astype(np.uint64) * _STEP[0]
    for k in range(width):
        inside = length > k
        h += np.where(inside, words[np.minimum(start + k, len(words) - 1)], np.uint64(0)) * _STEP[k + 1] if len(words) else np.uint64(0)
    return mix64(h), start, offsets


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1)
        yield a, b
        a = b


def _tables(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """How often words and n-grams fall on each of 2^16 values, over the whole corpus."""

    def run(batches):
        counts = np.zeros((2, 1 << TABLE_BITS), dtype=np.int64)
        shift = np.uint64(64 - TABLE_BITS)
        for batch in batches:
            flat, at = byte_buffer(batch.column(0))
            for a, b in _slices(at):
                words, doc = word_hashes(flat[at[a]:at[b]], at[a:b + 1] - at[a])
                h, _, _ = shingles(words, doc, b - a, width)
                for k, x in enumerate((words, h)):
                    counts[k] += np.bincount((x >> shift).astype(np.int64), minlength=1 << TABLE_BITS)
        cell = np.flatnonzero(counts.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(counts.ravel()[cell])], names=["cell", "n"])

    summed = docs.select("__text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # at most 2^17 rows
    table = np.zeros(2 << TABLE_BITS, dtype=np.float64)
    table[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return table[: 1 << TABLE_BITS], table[1 << TABLE_BITS:]


def _pack(h: np.ndarray) -> np.ndarray:
    """Counts of the sorted hashes per fragment of their order, modulo 16, as 16 bytes."""
    cut = np.searchsorted(h, np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - 5))
    counts = np.diff(np.append(cut, len(h))) & 15
    return (counts[0::2] | (counts[1::2] << 4)).astype(np.uint8)


def _fine(h: np.ndarray) -> bytes:
    """The same with one fragment for about two hashes (a power of two from 32 to 16,384)."""
    bits = min(14, max(5, (len(h) // 2).bit_length()))
    counts = np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 15
    return (counts[0::2] | (counts[1::2] << 4)).astype(np.uint8).tobytes()


def _counts(sketch: bytes) -> np.ndarray:
    packed = np.frombuffer(sketch, np.uint8)
    return np.stack([packed & 15, packed >> 4], axis=1).ravel()


def _folded(counts: np.ndarray, fragments: int) -> np.ndarray:
    """Counts of coarser fragments, modulo 16."""
    return (counts.reshape(*counts.shape[:-1], fragments, -1).sum(axis=-1) & 15).astype(np.uint8)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A lower bound of the symmetric difference from counts modulo 16 along the last axis."""
    gap = (a - b) & 15
    return np.minimum(gap, 16 - gap).sum(axis=-1, dtype=np.int64)


def _sets(docs: DataFrame, width: int, num: int, den: int, tables: Tables) -> DataFrame:
    """The written table (__row, __id, n, digest, sketch, fine, prefix): the n-gram set of each row, and its rarest n-grams as keys of the global order."""
    by_word, by_gram = _tables(docs, width)
    n_words, n_grams = max(1.0, by_word.sum()), max(1.0, by_gram.sum())
    log_word = np.log2(np.maximum(by_word, 1.0) / n_words)
    mean = n_grams / len(by_gram)
    excess = np.log2(np.maximum(by_gram - mean - 5 * np.sqrt(mean), 1.0))
    shared = docs.sparkSession.sparkContext.broadcast((log_word, excess, np.log2(n_grams)))
    schema = T.StructType([T.StructField("__row", T.LongType()), docs.schema["__id"], T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()),
                           T.StructField("sketch", T.BinaryType()), T.StructField("fine", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def make():
        log_w, log_g, total = shared.value
        shift = np.uint64(64 - TABLE_BITS)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, at = byte_buffer(batch.column(2))
            sizes, digests, sketches, fines, prefixes = [], [], [], [], []
            for a, b in _slices(at):
                words, doc = word_hashes(flat[at[a]:at[b]], at[a:b + 1] - at[a])
                h, start, offsets = shingles(words, doc, b - a, width)
                lw = log_w[(words >> shift).astype(np.int64)]
                guess = np.full(len(h), total)
                for k in range(width):
                    place = start + k
                    guess += np.where(place < len(lw), lw[np.minimum(place, len(lw) - 1)], 0.0) if len(lw) else 0.0
                rank = np.clip(np.maximum(guess, log_g[(h >> shift).astype(np.int64)]) * 4, 0, 127).astype(np.uint64)
                keys = (rank << np.uint64(56)) | (h >> np.uint64(8))
                for k in range(b - a):
                    own, where = np.unique(h[offsets[k]:offsets[k + 1]], return_index=True)
                    sizes.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    sketches.append(_pack(own).tobytes())
                    fines.append(_fine(own))
                    keep = min(len(own), len(own) - -(-num * len(own) // den) + COMMON)
                    own_keys = keys[offsets[k]:offsets[k + 1]][where]
                    prefixes.append(np.sort(np.partition(own_keys, keep - 1)[:keep]) if 0 < keep < len(own) else np.sort(own_keys))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            values = np.concatenate(prefixes).view(np.int64) if prefixes else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()),
                                               pa.array(fines, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=schema.names)

        return one

    sets = tables.write(map_batches(docs.select("__row", "__id", "__text"), make, schema))
    shared.destroy()
    return sets


_OUT = "kind int, a long, b long, na long, nb long, h long, sketch binary, blk long"
_PAIR, _MEMBER, _LARGE = 0, 1, 2


def _propose(vid, n, sketch, comp, blk, k: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one list: for each member its ``k`` nearest partners that may match (as pairs of indices), and how many there are."""
    m = len(vid)
    full = [_counts(x) for x in sketch]
    sizes = np.array([len(x) for x in full])
    coarse = np.stack([_folded(x, SKETCH) for x in full])
    cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(fragments: int) -> tuple[np.ndarray, np.ndarray]:
        if fragments not in cache:
            own = np.flatnonzero(sizes >= fragments)
            place = np.full(m, -1)
            place[own] = np.arange(len(own))
            cache[fragments] = np.stack([_folded(full[i], fragments) for i in own]), place
        return cache[fragments]

    left, right, count = [np.empty(0, np.int64)], [np.empty(0, np.int64)], np.zeros(m, dtype=np.int64)
    for a in range(0, m, 64):
        b = min(m, a + 64)
        both = n[a:b, None] + n[None, :]
        ok = (np.minimum(n[a:b, None], n[None, :]) * den >= np.maximum(n[a:b, None], n[None, :]) * num) & (comp[a:b, None] != comp[None, :])
        ok &= (blk[a:b, None] < 0) | (blk[a:b, None] != blk[None, :])
        far = _gap(coarse[a:b, None, :], coarse[None, :, :])
        ok &= far * (den + num) <= both * (den - num)
        i, j = np.nonzero(ok)
        far = far[i, j]
        i = i + a
        done = SKETCH
        for fragments in (4 * SKETCH, 16 * SKETCH, 1 << 14):  # finer and finer, for the pairs that are left
            level = np.minimum(np.minimum(sizes[i], sizes[j]), fragments)
            for f in np.unique(level[level > done]).tolist():
                table, place = at(f)
                some = np.flatnonzero(level == f)
                for c in range(0, len(some), max(1, (4 << 20) // f)):
                    own = some[c:c + max(1, (4 << 20) // f)]
                    far[own] = _gap(table[place[i[own]]], table[place[j[own]]])
            done = fragments
            good = far * (den + num) <= (n[i] + n[j]) * (den - num)
            i, j, far = i[good], j[good], far[good]
        count[a:b] = np.bincount(i - a, minlength=b - a)
        order = np.lexsort((vid[j], far, i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        left.append(i[rank < k])
        right.append(j[rank < k])
    return np.concatenate(left), np.concatenate(right), count


def _lists(k: int, num: int, den: int, hot: int, first: bool):
    """Over rows (h, vid, n, sketch), after the first round with (comp, blk), sorted by h: pairs, the lists that have more of them, and lists too large to hold."""

    def runs(batches) -> Iterator[tuple]:
        """Whole lists, several at once; of a list of more than ``hot`` members only its h."""
        held, skipping = None, None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            cols += [cols[1], np.full(len(cols[1]), -1)] if first else [batch.column(i).to_numpy(zero_copy_only=False) for i in (4, 5)]
            cols.append(np.array([*batch.column(3).to_pylist(), None], dtype=object)[:-1])
            if skipping is not None:
                rest = cols[0] != skipping
                cols = [c[rest] for c in cols]
                skipping = skipping if not rest.any() else None
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols, strict=True)]
            if not len(cols[0]):
                held = None
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on
            if last:
                yield [c[:last] for c in cols]
            held = [c[last:] for c in cols]
            if len(held[0]) > hot:
                skipping = held[0][0]
                yield int(skipping)
                held = None
        if held is not None:
            yield held

    def run(batches):
        for got in runs(batches):
            if isinstance(got, int):
                yield _rows(_LARGE, h=np.array([got]))
                continue
            h, vid, n, comp, blk, sketch = got
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            sizes = np.diff(np.append(starts, len(h)))
            i, j = [], []
            short = SHORT if first else 2
            for m in range(2, short + 1):
                upper = np.triu_indices(m, 1)
                i += [(starts[sizes == m][:, None] + upper[0]).ravel()]
                j += [(starts[sizes == m][:, None] + upper[1]).ravel()]
            i, j = np.concatenate(i), np.concatenate(j)
            ok = (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num) & (comp[i] != comp[j]) & ((blk[i] < 0) | (blk[i] != blk[j]))
            i, j = i[ok], j[ok]
            if len(i):
                x, y = (np.frombuffer(b"".join(_short(v) for v in sketch[p]), np.uint8).reshape(-1, SKETCH // 2) for p in (i, j))
                ok = (_gap(x & 15, y & 15) + _gap(x >> 4, y >> 4)) * (den + num) <= (n[i] + n[j]) * (den - num)
                i, j = i[ok], j[ok]
            meetings = [np.full(len(i), 1 if first else COMMON)]
            left, right, again, sigs = [i], [j], [], []
            for s, m in zip(starts[sizes > short].tolist(), sizes[sizes > short].tolist(), strict=True):
                if m > hot:
                    yield _rows(_LARGE, h=h[s:s + 1])
                    continue
                own = slice(s, s + m)
                x, y, count = _propose(vid[own], n[own], sketch[own], comp[own], blk[own], k, num, den)
                left.append(x + s)
                right.append(y + s)
                meetings.append(np.full(len(x), COMMON))
                if (count > k).any():
                    again.append(s + np.flatnonzero(count))
                    sigs.append(np.full(len(again[-1]), int.from_bytes(hashlib.blake2b(np.sort(vid[again[-1]]).tobytes(), digest_size=8).digest(), "little", signed=True)))
            i, j = np.concatenate(left), np.concatenate(right)
            if len(i):
                swap = vid[i] > vid[j]
                i, j = np.where(swap, j, i), np.where(swap, i, j)
                pair, which = np.unique(np.stack([vid[i], vid[j], n[i], n[j]], axis=1), axis=0, return_inverse=True)
                met = np.bincount(which.ravel(), weights=np.concatenate(meetings)).astype(np.int64)
                yield _rows(_PAIR, a=pair[:, 0], b=pair[:, 1], na=pair[:, 2], nb=pair[:, 3], h=met)
            if again:
                i = np.concatenate(again)
                yield _rows(_MEMBER, a=vid[i], b=np.concatenate(sigs), na=n[i], h=h[i], sketch=sketch[i], blk=blk[i])
        give_back()

    return run


def _short(sketch: bytes) -> bytes:
    """The sketch in SKETCH fragments."""
    if len(sketch) == SKETCH // 2:
        return sketch
    counts = _folded(_counts(sketch), SKETCH)
    return (counts[0::2] | (counts[1::2] << 4)).astype(np.uint8).tobytes()


def _rows(kind: int, sketch: np.ndarray | None = None, **cols: np.ndarray) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    none = pa.nulls(n, pa.int64())
    long = {c: pa.array(cols[c].astype(np.int64)) if c in cols else none for c in ("a", "b", "na", "nb", "h", "blk")}
    packed = pa.nulls(n, pa.binary()) if sketch is None else pa.array(list(sketch), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int32)), long["a"], long["b"], long["na"], long["nb"], long["h"], packed, long["blk"]],
                                      names=["kind", "a", "b", "na", "nb", "h", "sketch", "blk"])


def _segments(docs: DataFrame, active: DataFrame, width: int) -> DataFrame:
    """(vid, fragment, grams): the sorted n-gram hashes of the active documents (vid, __row), cut at the pivots."""

    def make():
        pivots = np.arange(FRAGMENTS, dtype=np.uint64) << np.uint64(64 - 3)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, at = byte_buffer(batch.column(1))
            vids, fragments, grams = [], [], []
            ids = batch.column(0).to_pylist()
            for a, b in _slices(at):
                words, doc = word_hashes(flat[at[a]:at[b]], at[a:b + 1] - at[a])
                h, _, offsets = shingles(words, doc, b - a, width)
                for k in range(b - a):
                    own = np.unique(h[offsets[k]:offsets[k + 1]])
                    cut = np.append(np.searchsorted(own, pivots), len(own))
                    for f in range(FRAGMENTS):
                        if cut[f] < cut[f + 1]:
                            vids.append(ids[a + k])
                            fragments.append(f)
                            grams.append(own[cut[f]:cut[f + 1]].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(vids, pa.int64()), pa.array(fragments, pa.int32()), pa.array(grams, pa.binary())], names=["vid", "fragment", "grams"])

        return one

    rows = docs.select("__row", "__text").join(broadcast_if_small(active.select("vid", "__row")), "__row")
    return map_batches(rows.select("vid", "__text"), make, "vid long, fragment int, grams binary")


def _prune(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose fine sketches don't rule them out."""
    left = pairs.join(reps.select(F.col("vid").alias("a"), F.col("fine").alias("fine_a")), "a")
    both = left.join(reps.select(F.col("vid").alias("b"), F.col("fine").alias("fine_b")), "b")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            far = np.empty(len(na), dtype=np.int64)
            for k, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = _counts(x), _counts(y)
                f = min(len(x), len(y))
                far[k] = _gap(_folded(x, f), _folded(y, f))
            return batch.select([0, 1, 2, 3]).filter(pa.array(far * (den + num) <= (na + nb) * (den - num)))

        return one

    return map_batches(both.select("a", "b", "na", "nb", "fine_a", "fine_b"), make, "a long, b long, na long, nb long")


def _verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, width: int, num: int, den: int, tables: Tables) -> DataFrame:
    """The written table of the pairs (a, b) whose similarity reaches the threshold; only the segments of their documents are written and dealt out."""
    own = pairs.select(F.col("a").alias("vid")).unionByName(pairs.select(F.col("b").alias("vid"))).distinct()
    own = tables.write(reps.select("vid", "__row").join(own, "vid"))
    segments = tables.write(_segments(docs, own, width))
    left = pairs.join(segments.select(F.col("vid").alias("b"), "fragment", F.col("grams").alias("of_b")), "b")
    both = left.join(segments.select(F.col("vid").alias("a"), "fragment", F.col("grams").alias("of_a")), ["a", "fragment"])

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            common = []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                p, q = (p, q) if len(p) >= len(q) else (q, p)
                at = np.searchsorted(p, q)
                common.append(int((p[np.minimum(at, len(p) - 1)] == q).sum()))
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])

        return one

    partial = map_batches(both.select("a", "b", "na", "nb", "of_a", "of_b"), make, "a long, b long, na long, nb long, common long")
    overlap = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("both"))
    found = tables.write(overlap.where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b"))
    tables.free(own, segments)
    return found


def _one_per_member(pairs: DataFrame) -> DataFrame:
    """For each b the pair with its least a."""
    return pairs.groupBy("b").agg(F.min(F.struct("a", "na", "nb")).alias("p")).select("p.a", "b", "p.na", "p.nb")


def _still_apart(pairs: DataFrame, tried: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs not tried yet whose members the links found so far leave in different components."""
    left = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    left = left.join(comps.select(F.col("vertex").alias("a"), F.col("component").alias("__a")), "a", "left")
    both = left.join(comps.select(F.col("vertex").alias("b"), F.col("component").alias("__b")), "b", "left")
    return both.where(F.coalesce("__a", "a") != F.coalesce("__b", "b")).select("a", "b", "na", "nb")


def join(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: __row (its number in the scan), id, n_shingles, component_id.

    Two rows link if ``den * intersection >= num * union`` of their distinct ``width``-word n-grams (a text with fewer
    words is one n-gram); component_id is the least id reachable. Null and empty texts and texts without words have
    no n-grams and link with nothing. Repeated rows and repeated ids are vertices of their own; null ids link as
    others but are no component's name unless alone (null). An empty table gives an empty result. Whole texts count,
    however long; one is cut into segments of its n-grams by FRAGMENTS. An input that is not a plain scan of files is
    written once, so that its rows keep their numbers.
    """
    return _join(stable(docs), width, num, den, id_col, text_col, hot)[0]


def _join(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str, hot: int) -> tuple[DataFrame, Tables]:
    """The result of ``join`` for stable rows, and the written tables it reads."""
    given = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    tables = Tables()
    sets = _sets(given, width, num, den, tables)
    one = F.first(F.struct("__row", "n", "sketch", "fine", "prefix")).alias("x")
    reps = sets.where("n > 0").groupBy("digest").agg(F.min("__id").alias("least"), one)
    reps = tables.write(reps.select(F.monotonically_increasing_id().alias("vid"), "digest", "least", "x.*"))
    wide, sets = sets, tables.write(sets.select("__row", "__id", "n", "digest"))  # sketches and prefixes are in reps
    tables.free(wide)
    posted = reps.select(F.explode("prefix").alias("h"), "vid", "n", "sketch")  # each its own component, in no block
    links = None
    comps = None
    rows, k = posted, 2
    spent: list[DataFrame] = []  # what the round before left for this one
    while True:
        ordered = rows.repartition("h").sortWithinPartitions("h")
        out = tables.write(ordered.mapInArrow(_lists(k, num, den, hot, links is None), _OUT))
        tables.free(*spent)
        spent = [out]
        pairs = out.where(f"kind = {_PAIR}").groupBy("a", "b", "na", "nb").agg(F.sum("h").alias("met"))
        shared = F.least(F.lit(COMMON), F.ceil(F.greatest("na", "nb") * F.lit(num) / F.lit(den)))
        pairs = pairs.where(F.col("met") >= shared).select("a", "b", "na", "nb")
        pairs = tables.write(_prune(pairs, reps, num, den) if links is None else pairs)
        again = out.where(f"kind = {_MEMBER}").select("h", F.col("a").alias("vid"), F.col("na").alias("n"), "sketch", "blk")
        if links is None:
            one = tables.write(_one_of_each(out))
            again = _distinct_lists(out, one, reps)
            large = out.where(f"kind = {_LARGE}").select("h").distinct()  # met in the first round only: blocks are smaller
            spent = [out, one]
            if large.take(1):
                large = tables.write(large)
                number = tables.write(_numbers_of_blocks(posted, large, hot))
                spent += [large, number]
                again = again.unionByName(_blocks(posted, reps, large, number))
            again = tables.write(again)
            tables.free(*spent)
            spent = [again]
        first = tables.write(_one_per_member(pairs))
        dense = pairs.count() > 2 * first.count()  # a group of near copies, which one pair of each member links nearly whole
        found = _verify(first if dense else pairs, given, reps, width, num, den, tables)
        links = found if links is None else links.unionByName(found)
        if comps is not None:
            release(comps)
        comps = connected_components(links)
        if dense:
            rest = tables.write(_still_apart(pairs, first, comps))
            if rest.take(1):
                links = links.unionByName(_verify(rest, given, reps, width, num, den, tables))
                release(comps)
                comps = connected_components(links)
            tables.free(rest)
        tables.free(pairs, first)
        if not again.take(1):
            break
        rows = again.join(comps.select(F.col("vertex").alias("vid"), F.col("component").alias("comp")), "vid", "left")
        rows = rows.select("h", "vid", "n", "sketch", F.coalesce("comp", "vid").alias("comp"), "blk")
        k *= 8
    named = reps.select("vid", "digest", "least").join(comps.withColumnRenamed("vertex", "vid"), "vid", "left").withColumn("component", F.coalesce("component", "vid"))
    named = tables.write(named)
    label = tables.write(named.groupBy("component").agg(F.min("least").alias("component_id")))  # written, so that the join can split a large component
    label = tables.write(named.join(label, "component").select("digest", "component_id"))
    release(comps)
    tables.drop(sets, label)
    out = sets.select("__row", "__id", "n", "digest").join(label, "digest", "left")
    return out.select("__row", F.col("__id").alias(id_col), F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("__id")).alias("component_id")), tables


def _one_of_each(out: DataFrame) -> DataFrame:
    """(h): one of the lists that come again with the same members."""
    return out.where(f"kind = {_MEMBER}").groupBy(F.col("b").alias("sig")).agg(F.min("h").alias("h")).select("h")


def _distinct_lists(out: DataFrame, one: DataFrame, reps: DataFrame) -> DataFrame:
    """The members of the lists ``one``, with their fine sketches."""
    again = out.where(f"kind = {_MEMBER}").select("h", F.col("a").alias("vid"), F.col("na").alias("n"), "blk")
    return again.join(one, "h", "left_semi").join(reps.select("vid", F.col("fine").alias("sketch")), "vid").select("h", "vid", "n", "sketch", "blk")


def _numbers_of_blocks(posted: DataFrame, large: DataFrame, hot: int) -> DataFrame:
    return posted.select("h").join(large, "h").groupBy("h").agg(F.ceil(F.count(F.lit(1)) * 4 / hot).alias("__n"))


def _blocks(posted: DataFrame, reps: DataFrame, large: DataFrame, number: DataFrame) -> DataFrame:
    """The members of large lists, dealt into blocks of about hot/4; every pair of blocks is a list of its own."""
    rows = posted.drop("sketch").join(large, "h").join(reps.select("vid", F.col("fine").alias("sketch")), "vid")
    rows = rows.join(number, "h").withColumn("__b", F.pmod(F.xxhash64("vid", F.lit(13)), F.col("__n")))
    rows = rows.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    return rows.select(F.xxhash64("h", F.least("__b", "__o"), F.greatest("__b", "__o")).alias("h"), "vid", "n", "sketch",
                       F.when(F.col("__b") == F.col("__o"), F.lit(-1)).otherwise(F.col("__b")).cast("long").alias("blk"))


def keep_first(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less all but the first (least id, then first in the scan) of each component; columns unchanged.

    Rows without n-grams (null, empty or blank texts) all stay. An input that is not a plain scan of files is written once.
    """
    docs = stable(docs)
    linked, tables = _join(docs, width, num, den, id_col, text_col, HOT)
    alone = F.when((F.col("n_shingles") > 0) & F.col("component_id").isNotNull(), F.col("component_id").cast("string"))
    first = linked.where(alone.isNotNull()).groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("__row").alias("r"))).alias("f"))
    others = linked.where(alone.isNotNull()).select("__row").join(first.select(F.col("f.r").alias("__row")), "__row", "left_anti")
    others = materialize(others)
    tables.drop()
    return docs.withColumn("__row", F.monotonically_increasing_id()).join(broadcast_if_small(others), "__row", "left_anti").drop("__row")
