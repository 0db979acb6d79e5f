"""Token-ID output in blocks coded by a range asymmetric numeral system (rANS).

Documents are tokenised in ascending id order and cut into blocks of whole documents. One static
frequency table, counted over all ids, is shared by all blocks. A block interleaves up to LANES
coder states: step t codes ids t*lanes .. t*lanes+lanes-1, one per state. Every CHECKPOINT_STEPS steps the
states and the place in the stream are kept, so that a reader can start there; a block has
a checksum of its bytes. Blocks are rows of a Parquet table, read and decoded in parallel.

A block's bytes, little-endian: magic 'RA64', uint32 lanes, uint32 ids, uint32 checkpoints, then per
checkpoint uint32 step and uint32 word offset and uint64 states, then the uint32 words in reading order.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import map_batches
from basketry.session import materialize, release

#: Frequencies sum to 2 ** SCALE; states stay in [2**31, 2**63).
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 2048
CHECKPOINT_STEPS = 256
#: A block is closed at the end of the document that brings it to so many ids.
BLOCK_IDS = 1 << 20
#: Pieces of text whose ids a worker remembers, some 200 bytes each; beyond, it starts anew. Rare pieces keep coming, and
#: learning one takes far longer than finding it, so this holds those of several tasks.
REMEMBERED = 1_000_000
MAGIC = b"RA64"

_ODD_SPACE = re.compile(r" \s| $")
_CUT = re.compile(r" (?=\S)")


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself where it is printable in Latin-1, else the next of U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(others)}


class Tokenizer:
    """The library's ids, asking it only once per piece of text.

    A text is cut before each space that precedes another character than white space. The tokenizer's own
    splitting never joins what such a cut separates, so the ids of a text are those of its pieces. A piece of
    letters is one word to the tokenizer and goes to the library's model directly; stops and commas behind
    letters are a word of their own. A text that holds one of the tokenizer's added tokens isn't cut: the
    library takes such a token out before it splits, so it is asked for the whole text, which isn't remembered.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer as Library

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
        self.library = Library.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.model = self.library.model
        self.characters = str.maketrans(_byte_characters())
        self.space = _byte_characters()[32]
        self.end_id = end_id
        self._reset()

    def _reset(self) -> None:
        """Numbers of pieces: after a space by their text, first ones of a text by a tuple of it; None is the end of a text."""
        self.number: dict[str | tuple[str] | None, int] = {None: 0}
        self.tails: dict[str, list[int]] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint16)
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.ids[0], self.length[0], self.used = self.end_id, 1, 1

    def _plain(self, word: str) -> list[int]:
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(self.space + mapped)]

    def _learn(self, pieces: list[str | tuple[str]]) -> None:
        known: list[list[int] | None] = []
        rest: list[str] = []
        for p in pieces:
            if isinstance(p, tuple):
                known.append(None)
                rest.append(p[0])
                continue
            stem = p.rstrip(".,")
            if stem.isalpha() and (stem.isascii() or max(stem) < "\u0250"):
                ids = self._plain(stem)
                if tail := p[len(stem):]:
                    if tail not in self.tails:
                        self.tails[tail] = self.library.encode(tail, add_special_tokens=False).ids
                    ids = ids + self.tails[tail]
                known.append(ids)
            else:
                known.append(None)
                rest.append(" " + p)
        others = iter([e.ids for e in self.library.encode_batch_fast(rest, add_special_tokens=False)])
        coded = [next(others) if x is None else x for x in known]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.uint16, int(lengths.sum()))
        a, n = len(self.number), len(pieces)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while a + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.ids[self.used:self.used + len(flat)] = flat
        self.length[a:a + n] = lengths
        self.start[a:a + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)
        self.number.update(zip(pieces, range(a, a + n), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, each text's followed by the end id, and the number of ids per text."""
        if len(self.number) > REMEMBERED:
            self._reset()
        pieces: list[str | tuple[str] | None] = []
        counts = np.empty(len(texts), np.int64)
        whole: list[int] = []
        for k, t in enumerate(texts):
            if any(a in t for a in self.added):
                whole.append(k)
                pieces.append(None)
                counts[k] = 1
                continue
            own = t.split(" ") if _ODD_SPACE.search(t) is None else _CUT.split(t)
            own[0] = (own[0],)
            own.append(None)
            pieces += own
            counts[k] = len(own)
        get = self.number.get
        index = np.fromiter(map(get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(index < 0).tolist()
        if new:
            self._learn(list(dict.fromkeys([pieces[i] for i in new])))
            index[new] = [get(pieces[i]) for i in new]
        length = self.length[index]
        ends = np.cumsum(length)
        place = np.repeat(self.start[index] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        per_text = np.add.reduceat(length, np.cumsum(counts) - counts) if len(counts) else counts
        ids = self.ids[place]
        if whole:
            coded = [e.ids for e in self.library.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)]
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            ids = np.insert(ids, np.repeat((np.cumsum(per_text) - per_text)[whole], lengths), np.fromiter(chain.from_iterable(coded), np.uint16, int(lengths.sum())))
            per_text[whole] += lengths
        return ids, per_text


_TOKENIZERS: dict[tuple[str, int], Tokenizer] = {}


def _tokenizer(path: str, end_id: int) -> Tokenizer:
    """One per Python worker: loading the vocabulary takes a while, and the pieces of a worker's earlier tasks, REMEMBERED at most
    and a batch, needn't be learnt again."""
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = Tokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Integer frequencies that sum to 2 ** SCALE, at least 1 for each id that occurs."""
    total, whole = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    scaled = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * whole // total), 0).astype(np.int64)
    spare = whole - int(scaled.sum())
    while spare:  # give to or take from the most frequent, where a step matters least
        order = np.argsort(-scaled, kind="stable")
        top = order[: max(1, min(len(order), abs(spare)))]
        top = top[scaled[top] > 1] if spare < 0 else top
        scaled[top] += np.sign(spare)
        spare = whole - int(scaled.sum())
    return scaled


class Coder:
    """rANS with one static table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = int(min(LANES, max(1, n // 64)))
        steps = -(-n // lanes)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words, points = [], []
        scale, half = np.uint64(SCALE), np.uint64(32)
        limit = np.uint64(63 - SCALE)
        written = 0
        for t in range(steps - 1, -1, -1):
            own = ids[t * lanes:(t + 1) * lanes]
            x, f = state[: len(own)], self.freq[own]
            full = x >= (f << limit)
            if full.any():
                words.append(x[full].astype(np.uint32))
                written += len(words[-1])
                x = np.where(full, x >> half, x)
            q = x // f
            state[: len(own)] = (q << scale) + (x - q * f) + self.first[own]
            if t % CHECKPOINT_STEPS == 0:
                points.append((t, written, state.copy()))
        head = MAGIC + np.array([lanes, n, len(points)], dtype="<u4").tobytes()
        kept = b"".join(np.array([t, written - w], dtype="<u4").tobytes() + s.astype("<u8").tobytes() for t, w, s in reversed(points))
        return head + kept + b"".join(w.astype("<u4").tobytes() for w in reversed(words))

    def decode(self, block: bytes, checkpoint: int = 0) -> np.ndarray:
        """The ids from a checkpoint (0: the start) to the block's end."""
        if block[:4] != MAGIC:
            raise ValueError("not a block of ids")
        lanes, n, points = (int(x) for x in np.frombuffer(block, "<u4", 3, 4))
        size = 8 + 8 * lanes
        words = np.frombuffer(block, "<u4", offset=16 + points * size)
        out = np.empty(n, dtype=np.uint16)
        if not n:
            return out
        at = 16 + checkpoint * size
        step, place = (int(x) for x in np.frombuffer(block, "<u4", 2, at))
        state = np.frombuffer(block, "<u8", lanes, at + 8).astype(np.uint64)
        scale, half, mask = np.uint64(SCALE), np.uint64(32), np.uint64((1 << SCALE) - 1)
        for t in range(step, -(-n // lanes)):
            m = min(lanes, n - t * lanes)
            x = state[:m]
            slot = x & mask
            own = self.symbol[slot]
            out[t * lanes:t * lanes + m] = own
            x = self.freq[own] * (x >> scale) + slot - self.first[own]
            empty = np.flatnonzero(x < LOW)
            if len(empty):
                x[empty] = (x[empty] << half) | words[place:place + len(empty)]
                place += len(empty)
            state[:m] = x
        return out[step * lanes:]


def tokenise(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks in ascending id order: (part, block, first, ids_of, lengths, ids as uint16), and one row per task that has
    the frequencies of its ids in ``counts`` only; equal document ids keep the order of their texts' hashes."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    given = docs.select(F.col(f"`{id_col}`").alias("__id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"))
    given = given.repartitionByRange(parts, "__id").sortWithinPartitions("__id", F.xxhash64("__text"), "__text")
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("first", T.LongType()),
                           T.StructField("ids_of", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])

    def run(batches):
        part, block, first = TaskContext.get().partitionId(), 0, 0
        tokenizer = _tokenizer(path, end_id)
        owners: list = []
        lengths: list[int] = []
        held: list[np.ndarray] = []
        size = 0
        counts = np.zeros(1 << 16, dtype=np.int64)

        def close():
            ids = np.concatenate(held)
            np.add(counts, np.bincount(ids, minlength=1 << 16), out=counts)
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": first, "ids_of": owners, "lengths": lengths, "ids": ids.astype("<u2").tobytes(), "counts": None}], schema=arrow)

        arrow = None
        for batch in batches:
            if arrow is None:
                arrow = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("ids_of", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("counts", pa.binary())])
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                ids, sizes = tokenizer.encode(some.column(1).to_pylist())
                at = 0
                for owner, n in zip(some.column(0).to_pylist(), sizes.tolist(), strict=True):
                    owners.append(owner)
                    lengths.append(n)
                    held.append(ids[at:at + n])
                    at += n
                    size += n
                    if size >= BLOCK_IDS:
                        yield close()
                        block, first = block + 1, first + size
                        owners, lengths, held, size = [], [], [], 0
        if owners:
            yield close()
        if arrow is not None:
            yield pa.RecordBatch.from_pylist([{"part": part, "counts": counts.tobytes()}], schema=arrow)

    return given.mapInArrow(run, schema)


def write_blocks(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, np.ndarray]:
    """The written table of blocks (ids_of, lengths, start, n_ids, data, checksum) and the shared frequencies.

    ``start`` counts the ids of all documents before the block. Null texts count as empty (only the end id);
    repeated ids and null ids (which come first) are documents of their own. An empty table gives no block.
    """
    spark = docs.sparkSession
    tokens = materialize(tokenise(docs, path, end_id, id_col, text_col))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts = sum(np.frombuffer(x.as_py(), np.int64) for x in batch.column(0))
            seen = np.flatnonzero(counts)
            return pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[seen].astype(np.int64))], names=["id", "n"])

        return one

    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in map_batches(tokens.where("counts IS NOT NULL").select("counts"), make, "id int, n long").groupBy("id").agg(F.sum("n")).collect():  # at most one row per id of the vocabulary
        counts[r[0]] = r[1]
    freq = frequencies(counts)
    coded = tokens.where("ids IS NOT NULL")
    sizes = coded.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n).alias("n")).groupBy("part").agg(F.sum("n")).collect()  # one row per task
    before, total = {}, 0
    for part, n in sorted(sizes):
        before[part], total = total, total + n
    shared = spark.sparkContext.broadcast((freq, before))
    ids_of = tokens.schema["ids_of"]
    schema = T.StructType([ids_of, T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("start", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("checksum", T.LongType())])

    def coder():
        code = Coder(shared.value[0])

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            start, n, data = [], [], []
            for part, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4), strict=True):
                ids = np.frombuffer(raw.as_py(), "<u2")
                start.append(shared.value[1][part] + first)
                n.append(len(ids))
                data.append(code.encode(ids))
            return pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary()), pa.array([zlib.crc32(x) for x in data], pa.int64())],
                                              names=["ids_of", "lengths", "start", "n_ids", "data", "checksum"])

        return one

    blocks = materialize(map_batches(coded.select("part", "first", "ids_of", "lengths", "ids"), coder, schema))
    release(tokens)
    return blocks, freq


def read_blocks(blocks: DataFrame, freq: np.ndarray, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document from the written blocks: id, start, n_tokens, ids_crc32 (of little-endian uint32), with_ids: and ``ids``.

    A block whose checksum or length doesn't hold is an error.
    """
    shared = blocks.sparkSession.sparkContext.broadcast(freq)
    kind = blocks.schema["ids_of"].dataType.elementType
    fields = [T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    schema = T.StructType(fields + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []))

    def run(batches):
        code = Coder(shared.value)
        for batch in batches:
            for k in range(batch.num_rows):  # one block at a time
                data = batch.column(4)[k].as_py()
                if zlib.crc32(data) != batch.column(5)[k].as_py():
                    raise ValueError("a block's checksum doesn't hold")
                ids = code.decode(data).astype("<u4")
                lengths = np.array(batch.column(1)[k].as_py(), dtype=np.int64)
                if len(ids) != batch.column(3)[k].as_py() or len(ids) != lengths.sum():
                    raise ValueError("a block's length doesn't hold")
                ends = np.cumsum(lengths)
                owners = batch.column(0)[k].values
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(ends - lengths, ends, strict=True)]
                columns = [owners, pa.array(batch.column(2)[k].as_py() + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return blocks.select("ids_of", "lengths", "start", "n_ids", "data", "checksum").mapInArrow(run, schema)
