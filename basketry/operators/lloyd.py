"""Batched k-means (C2, C3, C12): all restarts and all k advance together in one scan per iteration.

1. Blocks. Equal points become one weighted point; points are sorted along a Z-order curve and written once as
   blocks of up to BLOCK neighbours, each with its weight, sum, mean, radius around the mean, and inner square sum.
2. Seeds. Each restart gathers one candidate set by k-means|| (D² sampling without replacement, top keys by
   a hash of the point, so that the draw does not depend on how rows lie in partitions), large enough for the greatest
   k; weighted k-means++ on the candidates gives the first centres of each (restart, k).
3. Lloyd steps. One scan serves all runs that still move. A centre farther from a block's mean than the nearest
   one by more than twice the radius can't own any point of the block; where only one is left, the whole block
   is added to it without looking at its points. Each task gives one partial sum per centre, Spark adds them
   up, and only ``sum of k`` rows reach the driver.

A block table is read once per iteration whatever the number of runs, in as many tasks as it has partitions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.session import materialize, release

BLOCK = 256
#: Rounds of candidate sampling, and candidates per round as a multiple of the greatest k.
ROUNDS, OVERSAMPLE = 3, 2
#: Standard deviations to each side of 0 that the Z-order grid covers; points beyond share its outer cells.
SPAN = 8.0

_BLOCKS = "n double, mean array<double>, radius double, inner double, xs binary, ws binary"


def block_table(points: DataFrame, features: str = "features", size: int = BLOCK) -> DataFrame:
    """The written table of blocks of the vectors in ``features``."""
    x = points.select(vector_to_array(features).alias("x")).where(F.col("x").isNotNull())
    weighted = x.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("w"))
    first = x.first()
    d = len(first[0]) if first else 1
    bits = max(1, min(10, 62 // d))
    cells = [F.floor((F.least(F.greatest(F.col("x")[i], F.lit(-SPAN)), F.lit(SPAN)) + SPAN) * ((2**bits - 1) / (2 * SPAN))) for i in range(d)]
    spread = [F.shiftleft(F.shiftright(c, j).bitwiseAND(F.lit(1)), j * d + i) for i, c in enumerate(cells) for j in range(bits) if j * d + i < 63]
    code = spread[0]
    for s in spread[1:]:
        code = code.bitwiseOR(s)
    dealt = weighted.withColumn("z", code).repartitionByRange("z").sortWithinPartitions("z", "x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            weight = batch.column(1).to_numpy(zero_copy_only=False)
            out = [[], [], [], [], [], []]
            for at in range(0, batch.num_rows, size):
                xs, ws = np.ascontiguousarray(flat[at:at + size]), np.ascontiguousarray(weight[at:at + size])
                mean = (xs * ws[:, None]).sum(axis=0) / ws.sum()
                far = ((xs - mean) ** 2).sum(axis=1)
                for column, v in zip(out, (float(ws.sum()), mean, float(np.sqrt(far.max())), float((far * ws).sum()), xs.tobytes(), ws.tobytes()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.float64()), pa.array([m.tolist() for m in out[1]], pa.list_(pa.float64())), pa.array(out[2], pa.float64()),
                                              pa.array(out[3], pa.float64()), pa.array(out[4], pa.binary()), pa.array(out[5], pa.binary())],
                                             names=["n", "mean", "radius", "inner", "xs", "ws"])

    return materialize(dealt.select("x", "w").mapInArrow(cut, _BLOCKS))


def step(blocks: DataFrame, runs: Sequence[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per run, for its centres: the weights and sums of the points they own (the first on ties), and the run's cost."""
    centres = np.concatenate(runs)
    starts = np.cumsum([0, *map(len, runs)])
    d = centres.shape[1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.diff(starts)
        run_of = np.repeat(np.arange(len(count)), count)
        total = np.zeros((len(centres), d + 2))
        for whole in batches:
            for low in range(0, whole.num_rows, 64):
                batch = whole.slice(low, 64)
                n = batch.column(0).to_numpy()
                mean = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, d)
                radius, inner = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                d2 = ((mean[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2)
                far = np.sqrt(d2)
                reach = np.minimum.reduceat(far, starts[:-1], axis=1) + 2 * radius[:, None]
                near = far <= reach[:, run_of] * (1 + 1e-9) + 1e-12
                sure = np.add.reduceat(near, starts[:-1], axis=1, dtype=np.int64) == 1
                b, c = np.nonzero(near & sure[:, run_of])
                np.add.at(total, c, np.column_stack([n[b], mean[b] * n[b][:, None], inner[b] + n[b] * d2[b, c]]))
                for i in np.flatnonzero(~sure.all(axis=1)).tolist():
                    xs = np.frombuffer(batch.column(4)[i].as_buffer()).reshape(-1, d)
                    ws = np.frombuffer(batch.column(5)[i].as_buffer())
                    some = np.flatnonzero(near[i] & ~sure[i][run_of])
                    apart = ((xs[:, None, :] - centres[some][None, :, :]) ** 2).sum(axis=2)
                    edges = np.flatnonzero(np.concatenate([[True], run_of[some][1:] != run_of[some][:-1]])).tolist()
                    for lo, hi in zip(edges, [*edges[1:], len(some)], strict=True):
                        own = apart[:, lo:hi]
                        pick = own.argmin(axis=1)
                        rows = np.column_stack([ws, xs * ws[:, None], ws * own[np.arange(len(xs)), pick]])
                        np.add.at(total, some[lo + pick], rows)
        owned = np.flatnonzero(total[:, 0] > 0)
        yield pa.RecordBatch.from_arrays([pa.array(owned.astype(np.int32)), *[pa.array(total[owned, j]) for j in range(d + 2)]], names=["c", *[f"s{j}" for j in range(d + 2)]])

    sums = ", ".join(f"s{j} double" for j in range(d + 2))
    rows = blocks.mapInArrow(scan, f"c int, {sums}").groupBy("c").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(d + 2)]).collect()  # one row per centre
    total = np.zeros((len(centres), d + 2))
    for r in rows:
        total[r[0]] = r[1:]
    return [(total[a:b, 0], total[a:b, 1:-1], float(total[a:b, -1].sum())) for a, b in zip(starts[:-1], starts[1:], strict=True)]


def _draw(blocks: DataFrame, held: Sequence[np.ndarray], seeds: Sequence[int], size: int, round_: int) -> list[np.ndarray]:
    """Per restart ``size`` further points, drawn with probability by weight and squared distance to those it holds (by weight alone if none)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def mixed(x: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
                return x ^ (x >> np.uint64(31))

        best: list[list] = [[] for _ in seeds]
        for batch in batches:
            for i in range(batch.num_rows):
                ws = np.frombuffer(batch.column(5)[i].as_buffer())
                xs = np.frombuffer(batch.column(4)[i].as_buffer()).reshape(len(ws), -1)
                h = np.zeros(len(ws), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(xs.shape[1]):
                        h = mixed(h + (xs[:, j] + 0.0).view(np.uint64) + np.uint64(j + 1))
                for r, seed in enumerate(seeds):
                    power = ws
                    if len(held[r]):
                        power = ws * ((xs[:, None, :] - held[r][None, :, :]) ** 2).sum(axis=2).min(axis=1)
                    with np.errstate(over="ignore"):
                        u = (mixed(h ^ mixed(np.full(1, seed * 1009 + round_ + 1, dtype=np.uint64))) >> np.uint64(11)).astype(np.float64)
                    with np.errstate(divide="ignore"):
                        key = np.where(power > 0, np.log((u + 0.5) / 2.0**53) / power, -np.inf)
                    some = np.argsort(-key, kind="stable")[:size]
                    best[r] = sorted([*best[r], *[(float(key[k]), xs[k].tolist()) for k in some if key[k] > -np.inf]], reverse=True)[:size]
        out = [(r, key, x) for r, rows in enumerate(best) for key, x in rows]
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["r", "key", "x"])

    found = blocks.mapInArrow(scan, "r int, key double, x array<double>")
    order = Window.partitionBy("r").orderBy(F.desc("key"), F.asc("x"))
    rows = found.withColumn("__at", F.row_number().over(order)).where(F.col("__at") <= size).select("r", "__at", "x").collect()  # size rows per restart
    picked = [[r[2] for r in sorted(rows, key=lambda r: r[1]) if r[0] == k] for k in range(len(seeds))]
    return [np.array(p) if p else np.empty((0, len(rows[0][2]) if rows else 1)) for p in picked]


def _plus_plus(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Weighted k-means++ with a few local steps on the candidates of one restart."""
    picked = [int(rng.choice(len(points), p=weight / weight.sum()))]
    near = ((points - points[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k and (near * weight).sum() > 0:
        tries = rng.choice(len(points), size=2 + int(np.log(k)), p=near * weight / (near * weight).sum())
        gains = [np.minimum(near, ((points - points[t]) ** 2).sum(axis=1)) for t in tries]
        best = int(np.argmin([(g * weight).sum() for g in gains]))
        picked.append(int(tries[best]))
        near = gains[best]
    centres = points[picked]
    for _ in range(20):
        own = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        mass = np.bincount(own, weights=weight, minlength=len(centres))
        moved = np.stack([np.bincount(own, weights=weight * points[:, j], minlength=len(centres)) for j in range(points.shape[1])], axis=1)
        centres = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-300)[:, None], centres)
    return centres


def fit_all(points: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
            features: str = "features") -> dict[int, list[tuple[np.ndarray, float]]]:
    """Per k, for the restarts of seeds seed .. seed + n_init - 1: (centres, cost). Fewer distinct points than k give as many centres.

    A run ends when no centre moves by more than ``tol``, or after ``max_iter`` steps; its cost is that of its final centres.
    """
    blocks = block_table(points, features)
    try:
        seeds = [seed + i for i in range(n_init)]
        held = _draw(blocks, [np.empty((0, 1))] * n_init, seeds, 1, 0)
        if not len(held[0]):
            raise ValueError("no points to cluster")
        most = OVERSAMPLE * max(ks)
        for round_ in range(1, ROUNDS + 1):
            more = _draw(blocks, held, seeds, most, round_)
            held = [np.concatenate([a, b]) if len(b) else a for a, b in zip(held, more, strict=True)]
        weights = [w for w, _, _ in step(blocks, held)]
        runs = {(k, i): _plus_plus(held[i], weights[i], k, np.random.default_rng([seeds[i], k])) for k in ks for i in range(n_init)}
        moving = sorted(runs)
        for _ in range(max_iter):
            if not moving:
                break
            after = step(blocks, [runs[key] for key in moving])
            left = []
            for key, (mass, sums, _) in zip(moving, after, strict=True):
                new = np.where(mass[:, None] > 0, sums / np.maximum(mass, 1e-300)[:, None], runs[key])
                if ((new - runs[key]) ** 2).sum(axis=1).max() > tol * tol:
                    left.append(key)
                runs[key] = new
            moving = left
        order = sorted(runs)
        costs = dict(zip(order, (c for _, _, c in step(blocks, [runs[key] for key in order])), strict=True))
    finally:
        release(blocks)
    return {k: [(runs[k, i], costs[k, i]) for i in range(n_init)] for k in ks}
