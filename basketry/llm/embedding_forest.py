"""Near-duplicate embeddings with a forest of random-projection trees.

Vectors of equal direction are one vertex. Every tree splits its nodes by the projection on a random direction,
near the median; the SPILL share of a node's vectors around the median goes to both sides. The top of the
trees is fitted on a bounded sample of the vectors, and every vector is routed; a leaf that still has more
than LEAF vectors is split further, level by level, with quantiles over all its vectors, until no
leaf is larger. Leaves only tell what hangs together: each gives one row per vector that has a
link in it, with the root of its component in the leaf, and leaves with their roots as edges make the
components. Links are then counted over all pairs of a component, however many leaves a dense group was
split over: small components several to a task, those of more than BLOCK vectors in blocks, every pair of
blocks in a task of its own. So a link is missed only where the forest leaves its ends in different components.

With TREES = 10, LEAF = 512 and SPILL = 0.1 the recall of links is measured in tests/llm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.common import connected_components, map_batches
from basketry.session import materialize, release

TREES, LEAF, SPILL = 10, 512, 0.10
#: Vectors that the top of the trees is fitted on, about.
SAMPLE = 16_384
#: A node with fewer vectors of the sample isn't split by it.
LEAST = 64
#: Vectors of a component whose pairs are counted in one task; a larger component is dealt into blocks.
BLOCK = 1024


def _normal(raw: pa.Array) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Per dimension: the rows of that dimension, and their vectors at length 1 in double precision."""
    sizes = np.array([len(x) // 8 for x in raw.to_pylist()])
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        x = np.frombuffer(b"".join(raw[int(i)].as_py() for i in rows), dtype=np.float64).reshape(len(rows), d)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out, len(sizes)


def _direction(name: str, d: int) -> np.ndarray:
    seed = int.from_bytes(hashlib.blake2b(f"{name}/{d}".encode(), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).standard_normal(d)


def grow(x: np.ndarray, per_sample: float, tree: int, leaf: int, spill: float) -> list[tuple]:
    """Nodes (direction, low, high, left, right), or () for a leaf, of one tree over the sample ``x``."""
    nodes: list = [None]
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if len(rows) * per_sample <= leaf * 0.8 or len(rows) < LEAST:
            nodes[at] = ()
            continue
        w = _direction(f"{tree}:{at}", x.shape[1])
        p = x[rows] @ w
        low, high = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
        if low == p.min() or high == p.max():  # too many equal projections: later levels break ties
            nodes[at] = ()
            continue
        nodes[at] = (w, low, high, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), rows[p <= high]), (len(nodes) + 1, rows[p >= low])]
        nodes += [None, None]
    return nodes


def route(x: np.ndarray, nodes: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, leaves) of all vectors, spilled ones several times."""
    rows, leaves = [], []
    todo = [(0, np.arange(len(x)))]
    while todo:
        at, own = todo.pop()
        if not len(own):
            continue
        if not nodes[at]:
            rows.append(own)
            leaves.append(np.full(len(own), at, dtype=np.int64))
            continue
        w, low, high, left, right = nodes[at]
        p = x[own] @ w
        todo += [(left, own[p <= high]), (right, own[p >= low])]
    return np.concatenate(rows), np.concatenate(leaves)


def _route_all(reps: DataFrame, n: int, trees: int, leaf: int, spill: float, sample: int) -> DataFrame:
    """(key, codes): the leaves of each vector under the trees fitted on the sample."""
    forest: dict[int, list] = {}
    if n > leaf:
        rate = min(1.0, sample / n)
        some = reps.where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 20)) < F.lit(rate * (1 << 20))).select("vec").toArrow()
        if some.num_rows:
            for _, x in _normal(some.column(0).combine_chunks())[0]:
                forest[x.shape[1]] = [grow(x, 1 / rate, t, leaf, spill) for t in range(trees)]
    shared = reps.sparkSession.sparkContext.broadcast(forest)  # at most about 2 * sample / LEAST nodes per tree

    def make():
        known = shared.value

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            groups, n_rows = _normal(batch.column(1))
            rows, codes = [], []
            for at, x in groups:
                d = x.shape[1]
                for t in range(trees):
                    r, c = route(x, known[d][t]) if d in known else (np.arange(len(x)), np.zeros(len(x), np.int64))
                    rows.append(at[r])
                    codes.append((np.int64(d) << 40) + (np.int64(t) << 32) + c)
            r, c = np.concatenate(rows), np.concatenate(codes)
            order = np.lexsort((c, r))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n_rows))]).astype(np.int32)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(c[order]))], names=["key", "codes"])

        return one

    return map_batches(reps.select("key", "vec"), make, "key binary, codes array<long>")


def _split_large(reps: DataFrame, placed: DataFrame, leaf: int, spill: float) -> DataFrame:
    """(key, code) after splitting, level by level, every leaf of more than ``leaf`` vectors."""
    done = None
    while True:
        sizes = placed.groupBy("code").count()
        large = materialize(sizes.where(F.col("count") > leaf).select("code"))
        if not large.take(1):
            return placed if done is None else done.unionByName(placed)
        rest = materialize(placed.join(large, "code", "left_anti"))
        done = rest if done is None else done.unionByName(rest)
        wide = placed.join(large, "code").join(reps.select("key", "vec"), "key").select("key", "code", "vec")

        def make():
            def one(batch: pa.RecordBatch) -> pa.RecordBatch:
                groups, n_rows = _normal(batch.column(2))
                code = batch.column(1).to_numpy()
                p = np.zeros(n_rows)
                for at, x in groups:
                    for c in np.unique(code[at]):
                        own = code[at] == c
                        p[at[own]] = x[own] @ _direction(str(c), x.shape[1])
                tie = np.array([int.from_bytes(hashlib.blake2b(k.as_py(), digest_size=4).digest(), "little") for k in batch.column(0)])
                return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p + tie * 1e-18)], names=["key", "code", "p"])

            return one

        projected = materialize(map_batches(wide, make, "key binary, code long, p double"))
        cuts = materialize(projected.groupBy("code").agg(F.percentile_approx("p", [0.5 - spill / 2, 0.5 + spill / 2], 1000).alias("q")))
        sides = projected.join(cuts, "code")
        left = sides.where(F.col("p") <= F.col("q")[1]).select("key", F.xxhash64("code", F.lit(0)).alias("code"))
        right = sides.where((F.col("p") >= F.col("q")[0])).select("key", F.xxhash64("code", F.lit(1)).alias("code"))
        placed = materialize(left.unionByName(right))


def _compare(threshold: float):
    def one(group: pa.Table) -> pa.Table:
        key = group.column("key").combine_chunks()
        (_, x), *_ = _normal(group.column("vec").combine_chunks())[0]
        near = (x @ x.T) >= threshold
        np.fill_diagonal(near, False)
        root = np.arange(len(x))
        while True:  # least label of a component
            low = np.minimum(root, np.where(near, root[None, :], len(x)).min(axis=1))
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = np.flatnonzero(near.any(axis=1))
        return pa.table({"key": key.take(pa.array(some)), "root": key.take(pa.array(root[some]))})

    return one


def _tasks(members: DataFrame, block: int) -> DataFrame:
    """``members`` (key, component, ..) with the ``task`` that counts them: small components share one, and in a
    large one every pair of blocks has its own; ``blk`` is the row's block there, or -1 where all pairs are to be counted."""
    sizes = materialize(members.groupBy("component").agg(F.count(F.lit(1)).alias("__n")))
    shared = max(1, -(-(sizes.where(F.col("__n") <= block).agg(F.sum("__n")).first()[0] or 0) // block))
    rows = members.join(sizes, "component")
    few = rows.where(F.col("__n") <= block).withColumn("task", F.pmod(F.xxhash64("component", F.lit(17)), F.lit(shared))).withColumn("blk", F.lit(-1).cast("long"))
    many = rows.where(F.col("__n") > block).withColumn("__k", F.ceil(F.col("__n") / block)).withColumn("__b", F.pmod(F.xxhash64("key", F.lit(13)), F.col("__k")))
    many = many.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1)))
    many = many.withColumn("task", F.xxhash64("component", F.least("__b", "__o"), F.greatest("__b", "__o")))
    many = many.withColumn("blk", F.when(F.col("__b") == F.col("__o"), F.lit(-1)).otherwise(F.col("__b")).cast("long"))
    names = [*members.columns, "task", "blk"]
    return few.select(names).unionByName(many.select(names))


def _count(threshold: float):
    """(key, n_links) over the pairs of a component: all, or those between its two blocks."""

    def one(group: pa.Table) -> pa.Table:
        names, number = np.unique(np.array([c.as_py() for c in group.column("component")], dtype=object), return_inverse=True)
        blk, mult = group.column("blk").to_numpy(), group.column("mult").to_numpy()
        vec = group.column("vec").combine_chunks()
        n_links = np.zeros(len(blk), dtype=np.int64)
        # tasks of different components may share a number
        unit = number * 2 + (blk >= 0)
        order = np.argsort(unit, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
            (_, x), *_ = _normal(vec.take(pa.array(own)))[0]
            for a in range(0, len(own), 1024):  # bounded: so many rows of the matrix at once
                near = (x[a:a + 1024] @ x.T) >= threshold
                if blk[own[0]] >= 0:
                    near &= blk[own[a:a + 1024], None] != blk[own][None, :]
                else:
                    near[np.arange(len(near)), np.arange(a, a + len(near))] = False
                n_links[own[a:a + 1024]] = near @ mult[own]
        some = np.flatnonzero(n_links)
        return pa.table({"key": group.column("key").combine_chunks().take(pa.array(some)), "n_links": pa.array(n_links[some])})

    return one


def link(vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE,
         block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id (least id reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do
    vectors of different dimension. Vectors of equal direction always link; repeated rows count as others. A row with a null
    id links as any other, but names its component only if no id is there (component_id null, kept true).
    An empty table gives an empty result; other columns are ignored.
    """
    given = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))

    def clean():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw: list[bytes | None] = []
            for v in batch.column(1).to_pylist():
                a = np.array(v, dtype=np.float64) if v and None not in v else None
                # as _normal begins, so that vectors of one key have the same links; + 0.0: no negative zeros
                raw.append((a / np.abs(a).max() + 0.0).tobytes() if a is not None and np.isfinite(a).all() and a.any() else None)
            key = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["id", "key", "vec"])

        return one

    schema = T.StructType([given.schema["id"], T.StructField("key", T.BinaryType()), T.StructField("vec", T.BinaryType())])
    rows = materialize(map_batches(given, clean, schema))
    reps = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("mult"))
    reps = materialize(reps)
    routed = _route_all(reps, reps.count(), trees, leaf, spill, sample)
    placed = materialize(routed.select("key", F.explode("codes").alias("code")))
    final = _split_large(reps, placed, leaf, spill).distinct()
    final = materialize(final)
    wide = final.join(reps, "key").select("key", "vec", "code")
    found = materialize(wide.groupBy("code").applyInArrow(_compare(threshold), "key binary, root binary"))
    release(final)
    parts = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    members = materialize(parts.withColumnRenamed("vertex", "key").join(reps.select("key", "vec", "mult"), "key"))
    counted = _tasks(members, block).groupBy("task").applyInArrow(_count(threshold), "key binary, n_links long")
    counts = counted.groupBy("key").agg(F.sum("n_links").alias("n"))
    named = reps.select("key", "id", "mult").join(counts, "key", "left").join(parts.withColumnRenamed("vertex", "key"), "key", "left")
    named = materialize(named.withColumn("component", F.coalesce("component", "key")))
    least = materialize(named.groupBy("component").agg(F.min("id").alias("component_id")))  # written, so that the join can split a large component
    result = materialize(named.join(least, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id"))
    out = rows.select("id", "key").join(result, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))

