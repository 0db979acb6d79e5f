"""Removal of repeated byte strings with longest-previous-factor arrays.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier (smaller id, or same
document and earlier start). Suffix arrays of a whole corpus don't fit a task, so its windows of LENGTH
bytes are dealt out such that equal windows meet:

1. Equal texts are one text; every copy but the first goes whole.
2. Each window has an anchor, the GRAM bytes of least hash in it (the leftmost). Anchors depend on the
   window's bytes alone, and neighbouring windows mostly share theirs, so a text has one per about
   40 bytes. Anchors that occur once in the corpus can't be in a repeat; their places go back to the
   documents, and only contexts (the bytes of all windows of an anchor) of other anchors go on.
3. Contexts are dealt by anchor. Each task sorts the suffixes at the windows' starts to depth LENGTH by
   prefix doubling, and takes the previous and next smaller position of each in suffix order. These hold the
   longest previous factor; a window is a repeat if it reaches LENGTH with either. The others are the
   first of their kind, and go back to their documents.
4. Each document with repeated anchors removes the bytes of all windows that aren't first.

Equal contexts are merged before they are dealt. An anchor with more than HOT different batches of contexts is
not dealt to one task (so a task holds a few MB of them): its windows are compared by digest in an aggregation that Spark combines on the map side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import byte_buffer, dense_order, map_batches, mix64, stable
from basketry.session import materialize, release

LENGTH, GRAM = 100, 24
HOT = 20_000
SLICE_BYTES = 2 << 20
#: Contexts whose suffixes are sorted together, about.
CHUNK = 8192
_PLACE = np.uint64(28)  # bits of a place in a slice; a longer text is an error

_rng = np.random.default_rng(20230707)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x2545F4914F6CDD1D
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers.clear()
        for r in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(max(n, SLICE_BYTES + 1), r, dtype=np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0][:n], _powers[1][:n]


def anchors(flat: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, first start, last start, hash) of every run of windows with the same anchor; places within their text."""
    n = len(flat)
    empty = np.empty(0, np.int64)
    sizes = np.diff(at)
    if n < length or not (sizes >= length).any():
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    if n >= 1 << int(_PLACE):
        raise ValueError("a text of 2^28 bytes or more")
    up, down = _power(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * up, dtype=np.uint64)])
    g = mix64((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    low = ((g >> _PLACE) << _PLACE) | np.arange(len(g), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach:])
    usable = np.maximum(sizes - length + 1, 0)
    ends = np.cumsum(usable)
    text = np.repeat(np.arange(len(sizes)), usable)
    start = np.arange(ends[-1]) - np.repeat(ends - usable, usable)
    anchor = (low[start + at[text]] & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    return text[new], anchor[new] - at[text[new]], start[new], start[last], g[anchor[new]]


def _emit_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            flat, at = byte_buffer(batch.column(1))
            row = batch.column(0).to_numpy()
            rows, places, hashes = [], [], []
            for a, b in _slices(at):
                text, anchor, _, _, h = anchors(flat[at[a]:at[b]], at[a:b + 1] - at[a], length, gram)
                rows.append(row[a + text])
                places.append(anchor)
                hashes.append(h.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(places).astype(np.int32))], names=["h", "__row", "place"])

        return one

    return map_batches(docs.select("__row", "__text"), make, "h long, __row long, place int")


def _slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + SLICE_BYTES, side="right")) - 1)
        yield a, b
        a = b


_REP, _SINGLE, _TEXT = 0, 1, 2
_CONTEXT, _DOCUMENT = 0, 1
_FOUND = T.StructType([T.StructField(n, t) for n, t in (("kind", T.IntegerType()), ("h", T.LongType()), ("loc", T.LongType()), ("windows", T.IntegerType()),
                                                        ("data", T.BinaryType()), ("__row", T.LongType()), ("ord", T.LongType()), ("runs", T.BinaryType()))])


def _contexts(bits: int, length: int, gram: int):
    """Over rows (__row, kind, a, blob) sorted by __row and kind: contexts of anchors that aren't single, and their documents."""

    def flush(held: list[tuple[int, int, bytes, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        at = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])]).astype(np.int64)
        whole = b"".join(x[2] for x in held)
        text, anchor, first, last, h = anchors(np.frombuffer(whole, np.uint8), at, length, gram)
        single = np.concatenate([(np.int64(k) << 32) + x[3] for k, x in enumerate(held)])
        repeated = np.flatnonzero(~np.isin((text << 32) + anchor, single))
        if not len(repeated):
            return
        text, first, last, h = text[repeated], first[repeated], last[repeated], h[repeated].view(np.int64)
        ords = np.array([x[1] for x in held], dtype=np.int64)
        loc = (ords[text] << bits) + first
        best: dict[bytes, int] = {}
        begin, end = (at[text] + first).tolist(), (at[text] + last + length).tolist()
        for i in np.argsort(loc, kind="stable").tolist():  # equal contexts of this batch: the earliest stands for all
            best.setdefault(whole[begin[i]:end[i]], i)
        keep = np.fromiter(best.values(), np.int64, len(best))
        yield _found(_CONTEXT, len(keep), h=h[keep], loc=loc[keep], windows=(last - first + 1)[keep].astype(np.int32), data=list(best))
        breaks = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)]))
        stops = np.append(breaks[1:], len(text)) - 1
        run = np.stack([first[breaks], last[stops]], axis=1).astype("<i4")
        owner = text[breaks]
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        whose = owner[edge]
        runs = [r.tobytes() for r in np.split(run, edge[1:])]
        pack = zstandard.ZstdCompressor(level=1)
        yield _found(_DOCUMENT, len(whose), row=np.array([held[k][0] for k in whose]), ord=ords[whose], runs=runs, data=[pack.compress(held[k][2]) for k in whose])

    def run(batches):
        rank, singles = None, []
        held, size = [], 0
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            row, kind, a = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
            done = 0
            for i in np.flatnonzero(kind == _TEXT).tolist():
                if i > done and kind[done] == _REP:
                    rank, done = int(a[done]), done + 1
                if i > done:
                    singles.append(a[done:i].astype(np.int64))
                done = i + 1
                if rank is not None:
                    text = unpack.decompress(batch.column(3)[i].as_py())
                    held.append((int(row[i]), rank, text, np.concatenate(singles) if singles else np.empty(0, np.int64)))
                    size += len(text)
                rank, singles = None, []
                if size >= SLICE_BYTES:
                    yield from flush(held)
                    held, size = [], 0
            if done < len(kind) and kind[done] == _REP:
                rank, done = int(a[done]), done + 1
            if done < len(kind):
                singles.append(a[done:].astype(np.int64))
        if held:
            yield from flush(held)

    return run


def _found(kind: int, n: int, h=None, loc=None, windows=None, data=None, row=None, ord=None, runs=None) -> pa.RecordBatch:
    long = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x, dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), long(h), long(loc), pa.nulls(n, pa.int32()) if windows is None else pa.array(windows),
                                       pa.nulls(n, pa.binary()) if data is None else pa.array(data, pa.binary()), long(row), long(ord),
                                       pa.nulls(n, pa.binary()) if runs is None else pa.array(runs, pa.binary())], names=_FOUND.names)


def previous_smaller(v: np.ndarray) -> np.ndarray:
    """For each place the nearest earlier one with a smaller value, or -1; all places follow their pointers at once."""
    p = np.arange(-1, len(v) - 1)
    todo = np.arange(len(v))
    while True:
        todo = todo[p[todo] >= 0]
        todo = todo[v[p[todo]] >= v[todo]]
        if not len(todo):
            return p
        p[todo] = p[p[todo]]  # everything between a place and its pointer is at least as large


def suffix_ranks(flat: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the strings of ``length`` bytes at ``starts`` in suffix order, equal for equal strings, by prefix doubling."""
    padded = np.concatenate([flat, np.zeros(2 * length + 16, np.uint8)])
    n = len(flat) + length
    depth = 1
    rank = padded[:n].astype(np.uint64)
    while depth < 8 and depth * 2 <= length:  # the first eight bytes fit one number
        rank = (rank << np.uint64(8 * depth)) | np.append(rank[depth:], np.zeros(depth, np.uint64))
        depth *= 2
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while depth < length:
        step = min(depth, length - depth)
        second = np.append(rank[step:], np.zeros(step, np.int64))
        rank = np.unique(rank * (int(rank.max()) + 1) + second, return_inverse=True)[1].astype(np.int64)
        depth += step
    return rank[starts]


def first_windows(loc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Whether no equal window lies earlier, from the longest previous factors of the windows at ``loc``."""
    order = np.lexsort((loc, rank))
    place, equal = loc[order], rank[order]
    before = previous_smaller(place)
    after = len(place) - 1 - previous_smaller(place[::-1])[::-1]  # next smaller; len(place) if there is none
    reaches = (before >= 0) & (equal[before] == equal)
    inside = after < len(place)
    reaches |= inside & (equal[np.minimum(after, len(place) - 1)] == equal)
    first = np.empty(len(loc), dtype=bool)
    first[order] = ~reaches
    return first


def _firsts(bits: int, length: int):
    """Over contexts (h, loc, windows, data) sorted by h: (ord, a, b), the runs of first windows."""

    def solve(h: np.ndarray, loc: np.ndarray, windows: np.ndarray, data: list[bytes]) -> pa.RecordBatch:
        best: dict[bytes, int] = {}
        for i in np.argsort(loc, kind="stable").tolist():
            best.setdefault(data[i], i)
        keep = np.sort(np.fromiter(best.values(), np.int64, len(best)))
        h, loc, windows = h[keep], loc[keep], windows[keep]
        _, group, size = np.unique(h, return_inverse=True, return_counts=True)
        alone = size[group] == 1  # one context only: its windows differ, unless they repeat within it
        owner = np.repeat(np.arange(len(keep)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        texts = [data[i] for i in keep.tolist()]
        sizes = np.array([len(x) for x in texts])
        base = np.cumsum(sizes) - sizes
        first = np.ones(len(owner), dtype=bool)
        mixed = ~alone[owner]
        if mixed.any():
            some = np.flatnonzero(~alone)
            flat = np.frombuffer(b"".join(texts[i] for i in some), np.uint8)
            place = np.zeros(len(texts), np.int64)
            place[some] = np.cumsum(sizes[some]) - sizes[some]
            starts = place[owner[mixed]] + offset[mixed]
            first[mixed] = first_windows(loc[owner[mixed]] + offset[mixed], suffix_ranks(flat, starts, length))
        del base
        at = np.sort(loc[owner[first]] + offset[first])
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]))
        a, b = at[new], at[np.append(new[1:], len(at)) - 1]
        mask = (1 << bits) - 1
        return pa.RecordBatch.from_arrays([pa.array(a >> bits), pa.array((a & mask).astype(np.int32)), pa.array((b & mask).astype(np.int32))], names=["ord", "a", "b"])

    def run(batches):
        held: list = [np.empty(0, np.int64)] * 3 + [[]]
        for batch in batches:
            more = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            held = [np.concatenate([x, y]) for x, y in zip(held[:3], more, strict=True)] + [held[3] + batch.column(3).to_pylist()]
            last = int(np.searchsorted(held[0], held[0][-1]))  # the last anchor may go on
            if last >= CHUNK:
                yield solve(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield solve(*held)

    return run


def _windows(length: int):
    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            digests, locs = [], []
            for loc, n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for k in range(n):
                    digests.append(hashlib.blake2b(data[k:k + length], digest_size=16).digest())
                    locs.append(loc + k)
            high = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(high[:, 0]), pa.array(high[:, 1]), pa.array(locs, pa.int64())], names=["d0", "d1", "loc"])

        return one

    return make


def covered(runs: np.ndarray, firsts: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed spans (start, end) from the runs of windows that may repeat, less the first ones."""
    if not len(runs):
        return np.empty((0, 2), np.int64)
    points = np.concatenate([runs[:, 0], runs[:, 1] + 1, firsts[:, 0], firsts[:, 1] + 1]).astype(np.int64)
    change = np.concatenate([np.ones(len(runs)), -np.ones(len(runs)), -np.ones(len(firsts)), np.ones(len(firsts))])
    order = np.argsort(points, kind="stable")
    points, level = points[order], np.cumsum(change[order])
    final = np.append(points[1:] != points[:-1], True)
    points, level = points[final], level[final]
    on = np.flatnonzero(level[:-1] > 0)
    a, b = points[on], points[on + 1] + length - 1  # windows a..b' cover the bytes up to b' + length - 1
    if not len(a):
        return np.empty((0, 2), np.int64)
    new = np.flatnonzero(np.concatenate([[True], a[1:] > np.maximum.accumulate(b)[:-1]]))
    return np.stack([a[new], np.maximum.accumulate(b)[np.append(new[1:], len(a)) - 1]], axis=1)


_RESULT = T.StructType([T.StructField("__row", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()),
                        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])


def _remove(length: int, with_kept: bool):
    """Over rows (ord, kind, a, b, __row, runs, blob) sorted by ord and kind: the result of each document that loses bytes."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        firsts: list[np.ndarray] = []
        for batch in batches:
            kind, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            out, done = [], 0
            for i in np.flatnonzero(kind == 1).tolist():
                firsts.append(np.stack([a[done:i], b[done:i]], axis=1).astype(np.int64))
                done = i + 1
                runs = np.frombuffer(batch.column(5)[i].as_py(), "<i4").reshape(-1, 2)
                spans = covered(runs, np.concatenate(firsts), length)
                firsts = []
                if len(spans):
                    text = unpack.decompress(batch.column(6)[i].as_py())
                    cuts = [0, *spans.ravel().tolist(), len(text)]
                    kept = b"".join(text[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))
                    out.append({"__row": batch.column(4)[i].as_py(), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(),
                                "spans": [{"start": x, "end": y} for x, y in spans.tolist()], "kept": kept if with_kept else None})
            firsts.append(np.stack([a[done:], b[done:]], axis=1).astype(np.int64))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    arrow = pa.schema([("__row", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, with_kept: bool = False) -> DataFrame:
    """Per input row: id, n_bytes, n_removed, n_spans, kept_sha256, spans [(start, end)], with_kept: and the kept bytes where some were removed (else null).

    Null texts count as empty; texts shorter than ``length`` lose nothing. Rows with equal ids are ordered as in the
    scan, rows with null ids come first. An empty table gives an empty result; other columns are ignored. Texts of
    2^28 bytes or more are an error. An input that is not a plain scan of files is written once.
    """
    spark = docs.sparkSession
    docs = stable(docs)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"), text.alias("__text"))
    rows = materialize(given.select("__row", "__id", F.octet_length("__text").cast("long").alias("n"), F.sha2(F.encode("__text", "UTF-8"), 256).alias("sha")))
    longest = rows.agg(F.max("n")).first()[0] or 0
    bits = max(1, int(longest).bit_length())
    # the first of each group of equal texts, in the order of ids
    place = F.struct(F.col("__id").isNotNull().alias("f"), F.col("__id").alias("i"), F.col("__row").alias("r"))
    reps = rows.where(F.col("n") >= length).groupBy("sha").agg(F.min(place).alias("p")).select(F.col("p.r").alias("__row"), F.col("p.i").alias("__id"))
    reps = dense_order(reps)
    if bits + int(reps.count()).bit_length() > 62:
        raise ValueError("ids of places need more than 62 bits")
    copies = materialize(rows.where(F.col("n") >= length).select("__row").join(reps, "__row", "left_anti"))
    texts = given.select("__row", "__text").where(F.octet_length("__text") >= length).join(copies, "__row", "left_anti")

    by_hash = _emit_anchors(texts, length, gram).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("__row"), F.min("place").alias("place"))
    none = F.lit(None).cast("binary")
    single = by_hash.where("n = 1").select("__row", F.lit(_SINGLE).alias("kind"), F.col("place").cast("long").alias("a"), none.alias("blob"))

    def pack():
        compress = zstandard.ZstdCompressor(level=1).compress

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            blobs = [compress(t.encode("utf-8")) for t in batch.column(1).to_pylist()]
            n = batch.num_rows
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, _TEXT, np.int32)), pa.nulls(n, pa.int64()), pa.array(blobs, pa.binary())], names=["__row", "kind", "a", "blob"])

        return one

    blobs = map_batches(texts, pack, "__row long, kind int, a long, blob binary")
    stream = blobs.unionByName(single).unionByName(reps.select("__row", F.lit(_REP).alias("kind"), F.col("ord").alias("a"), none.alias("blob")))
    stream = stream.repartition("__row").sortWithinPartitions("__row", "kind")
    found = materialize(stream.mapInArrow(_contexts(bits, length, gram), _FOUND))

    contexts = found.where(F.col("kind") == _CONTEXT).select("h", "loc", "windows", "data")
    large = materialize(contexts.groupBy("h").count().where(F.col("count") > hot).select("h"))
    some_large = bool(large.take(1))
    cold = contexts.join(large, "h", "left_anti") if some_large else contexts
    firsts = cold.repartition("h").sortWithinPartitions("h").mapInArrow(_firsts(bits, length), "ord long, a int, b int")
    if some_large:
        windows = map_batches(contexts.join(large, "h"), _windows(length), "d0 long, d1 long, loc long").groupBy("d0", "d1").agg(F.min("loc").alias("loc"))
        at = F.col("loc").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        firsts = firsts.unionByName(windows.select(F.shiftright("loc", bits).alias("ord"), at.alias("a"), at.alias("b")))
    documents = found.where(F.col("kind") == _DOCUMENT).select("ord", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), "__row", "runs", F.col("data").alias("blob"))
    firsts = firsts.select("ord", F.lit(0).alias("kind"), "a", "b", F.lit(None).cast("long").alias("__row"), none.alias("runs"), none.alias("blob"))
    both = documents.unionByName(firsts).repartition("ord").sortWithinPartitions("ord", "kind")
    results = materialize(both.mapInArrow(_remove(length, with_kept), _RESULT))
    release(found)

    out = rows.join(results, "__row", "left").join(copies.withColumn("copy", F.lit(True)), "__row", "left")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    copy = F.col("copy").isNotNull()
    columns = [
        F.col("__id").alias(id_col), F.col("n").alias("n_bytes"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, all_of_it).otherwise(F.coalesce("spans", F.array().cast(_RESULT["spans"].dataType))).alias("spans"),
    ]
    return out.select(*columns, *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_kept else []))
