"""The trie of all prefixes of conversations, by sorted shards and a skeleton of splitter paths.

A turn is a 16-byte digest of its role and text, a conversation the string of its digests (its path); prefixes of
paths are the nodes of the trie, and in sorted order the members of a node stand together.

1. Splitters. A sample of paths, of at most SAMPLE rows, is sorted on the driver and gives the bounds of the shards.
   Copies of one path are told apart by conversation id, so a group of copies may be dealt to many shards.
2. Skeleton. Only prefixes of splitters can have members in more than one shard. The trie of these prefixes goes to
   every task: at most SPLITTERS * DEPTH nodes of 16 bytes.
3. Shards. Each shard is sorted and read once, row by row, with a stack of the open nodes. A node outside
   of the skeleton is finished where it closes; one of the skeleton gives a partial aggregate.
4. Reduction. Partial aggregates of skeleton nodes are summed by node and folded from the deepest to the root, on at most
   as many rows as the skeleton has nodes.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Tables
from basketry.session import materialize

WIDTH = 16
#: Bounds of the skeleton: the number of splitters, and the turns of each that are compared.
SPLITTERS, DEPTH = 1023, 256
SAMPLE = 20_000
NODE = "id binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, bytes long, part int"
_ARROW = pa.schema([("id", pa.binary()), ("parent", pa.binary()), *[(c, pa.int64()) for c in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("bytes", pa.int64()), ("part", pa.int32())])
#: Kinds of rows: a finished node, a finished child of a skeleton node, a partial aggregate, and a conversation that ends in a skeleton node.
INSIDE, BELOW, PARTIAL, END = 0, 1, 2, 3
ROOT = hashlib.md5(b"").digest()


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, turns): the turns of each conversation in order, as (digest in hexadecimal digits, bytes of the text).

    Null turn numbers come first, ties are ordered by digest; a null role or text counts as empty. Rows without a
    conversation id belong to no conversation and are left out.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    role = F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turn = F.col(f"`{turn_col}`")
    rows = turns.select(F.col(f"`{conv_col}`").cast("long").alias("c"), F.struct(turn.isNotNull().alias("told"), turn.alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    lists = rows.where("c IS NOT NULL").groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return lists.select("c", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 5, modulus: int = 9, **columns: str) -> DataFrame:
    """(c, turns): each conversation with its first h turns replaced by those of conversation ``c - c % group``.

    h is the CRC-32 of the decimal id modulo ``modulus``. If that conversation has fewer turns, all of them are
    taken, if there is none, no turn; own turns follow from the h-th on.
    """
    lists = materialize(ordered_turns(turns, **columns))
    heads = lists.select(F.col("c").alias("__b"), F.slice("turns", 1, modulus).alias("__head"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % modulus).cast("int")
    joined = lists.withColumn("__b", F.col("c") - F.col("c") % group).withColumn("__h", h).join(heads, "__b", "left")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<digest: STRING, bytes: BIGINT>>)")
    head = F.when(F.col("__h") > 0, F.slice(F.coalesce("__head", none), F.lit(1), F.greatest("__h", F.lit(1)))).otherwise(none)
    own = F.slice("turns", F.col("__h") + 1, F.size("turns"))
    return joined.select("c", F.concat(head, own).alias("turns"))


def _place(path: bytes, conv: int) -> tuple[bytes, float]:
    """What the shards are dealt by. Paths beyond DEPTH turns that agree so far stay together."""
    return (path, conv) if len(path) <= DEPTH * WIDTH else (path[:DEPTH * WIDTH], float("inf"))


def splitters_of(paths: DataFrame, shards: int, sample: int = SAMPLE) -> list[tuple[bytes, float]]:
    """Bounds that cut ``paths`` (c, path) into about equal shards, from a sample of about ``sample`` rows at most."""
    n = paths.count()
    some = paths.sample(min(1.0, sample / max(1, n)), seed=11) if n > sample else paths
    rows = sorted(_place(bytes(r[1]), r[0]) for r in some.select("c", F.substring("path", 1, (DEPTH + 1) * WIDTH)).limit(2 * sample).collect())
    return sorted({rows[k * len(rows) // shards] for k in range(1, shards)}) if rows else []


class _Shard:
    """Reads the sorted rows of a shard and gives the rows of nodes that close."""

    def __init__(self, skeleton: set[bytes]) -> None:
        self.skeleton = skeleton
        self.out: list[tuple] = []
        self.path = b""
        self.stack: list[list] = []

    def open(self, path: bytes, end: int, size: int) -> None:
        """Node: id, whether it is of the skeleton, members, smallest member, children, leaves, saved, hash of ends, bytes, ends."""
        if not end:
            self.stack.append([ROOT, True, 0, None, 0, 0, 0, hashlib.sha256(), 0, 0])
            return
        above = self.stack[-1]
        ident = hashlib.md5(above[0] + path[end - WIDTH:end]).digest()
        # a prefix of a splitter has at most DEPTH turns, so no longer one is looked for
        bones = above[1] and end <= DEPTH * WIDTH and path[:end] in self.skeleton
        self.stack.append([ident, bones, 0, None, 0, 0, 0, hashlib.sha256(), size, 0])

    def close(self) -> None:
        ident, bones, n, least, children, leaves, saved, ends, size, _ = self.stack.pop()
        depth = len(self.stack)
        parent = self.stack[-1] if self.stack else None
        above = parent[0] if parent else None
        if bones:
            self.out.append((ident, above, depth, least, n, children, leaves, saved, None, size, PARTIAL))
            return
        leaves, saved = leaves or 1, saved + (n - 1) * size
        self.out.append((ident, above, depth, least, n, children, leaves, saved, ends.hexdigest(), size, BELOW if parent[1] else INSIDE))
        parent[2] += n
        parent[3] = least if parent[3] is None else min(parent[3], least)
        parent[4] += 1
        parent[5] += leaves
        parent[6] += saved

    def row(self, conv: int, path: bytes, sizes: list[int]) -> None:
        if not self.stack:
            self.open(b"", 0, 0)
        same, most = 0, min(len(self.path), len(path))
        while same < most and self.path[same:same + WIDTH] == path[same:same + WIDTH]:
            same += WIDTH
        while len(self.stack) > same // WIDTH + 1:
            self.close()
        for at in range(same, len(path), WIDTH):
            self.open(path, at + WIDTH, sizes[at // WIDTH])
        self.path = path
        node = self.stack[-1]
        node[2] += 1
        node[3] = conv if node[3] is None else min(node[3], conv)
        if node[1]:
            self.out.append((node[0], None, len(self.stack) - 1, conv, None, None, None, None, None, None, END))
        else:  # rows of a path come in ascending order of conversations
            node[7].update(f",{conv}".encode() if node[9] else str(conv).encode())
            node[9] += 1

    def end(self) -> None:
        while self.stack:
            self.close()
        self.path = b""


def _fold(partial: list, sha: dict[bytes, str]) -> list[tuple]:
    """The nodes of the skeleton from their summed partial aggregates, folded from the deepest to the root."""
    nodes = {bytes(r["id"]): [bytes(r["parent"]) if r["parent"] is not None else None, r["depth"], r["conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["bytes"]] for r in partial}
    for ident, node in sorted(nodes.items(), key=lambda x: -x[1][1]):
        node[5] = node[5] or 1
        node[6] += (node[3] - 1) * node[7]
        if node[0] is not None:
            above = nodes[node[0]]
            above[2] = min(x for x in (above[2], node[2]) if x is not None)
            above[3] += node[3]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    none = hashlib.sha256().hexdigest()
    return [(ident, v[0], v[1], v[2], nodes[v[0]][2] if v[0] is not None else None, v[3], v[4], v[5], v[6], sha.get(ident, none)) for ident, v in nodes.items()]


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the conversations of each node; rows come sorted by node and conversation."""
    now, hashed = None, None
    for batch in batches:
        ids, sha = [], []
        for ident, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ident != now:
                if now is not None:
                    ids.append(now)
                    sha.append(hashed.hexdigest())
                now, hashed = ident, hashlib.sha256(str(conv).encode())
            else:
                hashed.update(f",{conv}".encode())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sha, pa.string())], names=["id", "sha"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([hashed.hexdigest()], pa.string())], names=["id", "sha"])


def trie(conversations: DataFrame, shards: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Per node of the trie of (c, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest member, parent_conv_id that of the parent (null at the root), saved_tokens the sum over the
    subtree of (members - 1) times the bytes of the node's last text, ends_sha256 the hash of the comma-joined
    ids of the conversations that end there, in ascending order. Conversations without turns end in the root.

    An empty table gives an empty result. A conversation travels as one row of 24 bytes a turn, without its texts.
    The hash over the ends of one node is sequential by definition: those of a skeleton node pass one task as a
    sorted stream that is not collected. Conversations that agree in their first DEPTH turns and go on share a shard.
    """
    spark = conversations.sparkSession
    tables = Tables()
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    paths = tables.write(conversations.select("c", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")))
    shards = min(SPLITTERS + 1, shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = splitters_of(paths, shards, sample)
    skeleton = {p[:k] for p, _ in bounds for k in range(0, len(p) + 1, WIDTH)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = [bisect.bisect_right(bounds, _place(p, c)) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, _Shard(skeleton)

        def rows() -> pa.RecordBatch:
            out, shard.out = shard.out, []
            return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in out], schema=_ARROW)

        for batch in batches:
            for k, c, p, sizes in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if k != at:
                    shard.end()
                    at = k
                shard.row(c, p, sizes)
                if len(shard.out) >= 10_000:
                    yield rows()
        shard.end()
        yield rows()

    dealt = paths.mapInArrow(deal, "shard int, c long, path binary, sizes array<long>")
    sorted_ = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "path", "c")
    nodes = tables.write(sorted_.mapInArrow(read, NODE))
    partial = nodes.where(F.col("part") == PARTIAL).groupBy("id").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("bytes").alias("bytes"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]).collect()  # at most SPLITTERS * DEPTH + 1 rows
    ends = nodes.where(F.col("part") == END).select("id", "conv_id").repartition("id").sortWithinPartitions("id", "conv_id")
    sha = {bytes(r[0]): r[1] for r in ends.mapInArrow(_ends, "id binary, sha string").collect()}  # as many rows at most
    bones = spark.createDataFrame(_fold(partial, sha), "id binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = nodes.where(F.col("part") == BELOW).join(F.broadcast(bones.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))), "parent")
    above = nodes.where(F.col("part") < PARTIAL).select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inside = nodes.where(F.col("part") == INSIDE).join(above, "parent")
    tables.drop(nodes)
    return bones.select(*out).unionByName(below.select(*out)).unionByName(inside.select(*out))
