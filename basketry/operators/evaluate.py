"""Cluster-quality measures (C4 silhouette, C5 Davies-Bouldin) on labelled points.

``points`` is any DataFrame with an id column, numeric feature columns and an integer label.
Both measures use plain Euclidean distance, like the analysed application.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.distance_tree import mean_silhouette
from basketry.session import materialize

_TILE_SCHEMA = "id long, own int, w long, cluster int, s double, c long"

#: Points of more blocks than this go through a tree.
BLOCKS = 16


def _tile_sums(cols: Sequence[str]):
    """Per tile: for every point, the sum of distances to (and count of) each cluster's points in
    the other block of the tile (or its own block on the diagonal). Pairs stay inside numpy."""

    def run(key, pdf):
        lo, hi = int(key[0]), int(key[1])
        x = pdf[list(cols)].to_numpy(dtype=np.float64)
        lab = pdf["_lab"].to_numpy()
        ids = pdf["_id"].to_numpy()
        blk = pdf["_blk"].to_numpy()
        weight = pdf["_w"].to_numpy(dtype=np.float64)
        clusters = np.unique(lab)
        out = []

        def onehot(idx):
            return np.where(lab[idx][:, None] == clusters[None, :], weight[idx][:, None], 0.0)

        def emit(src_idx, sums, counts):
            keep = counts > 0
            n_src, n_cl = len(src_idx), int(keep.sum())
            out.append(pd.DataFrame({
                "id": np.repeat(ids[src_idx], n_cl),
                "own": np.repeat(lab[src_idx], n_cl).astype(np.int32),
                "w": np.repeat(weight[src_idx], n_cl).astype(np.int64),
                "cluster": np.tile(clusters[keep], n_src).astype(np.int32),
                "s": sums[:, keep].reshape(-1),
                "c": np.tile(counts[keep], n_src).astype(np.int64),
            }))

        left = np.flatnonzero(blk == lo)
        right = left if lo == hi else np.flatnonzero(blk == hi)
        oh_l, oh_r = onehot(left), onehot(right)
        sums_l = np.zeros((len(left), len(clusters)))
        sums_r = np.zeros((len(right), len(clusters)))
        a, b = x[left], x[right]
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        step = max(1, 4_000_000 // max(1, len(right)))
        for s in range(0, len(left), step):
            # |a|² + |b|² - 2·a·b (a matrix product), clipped at 0; one distance block serves
            # both directions of the tile
            d2 = aa[s:s + step, None] + bb[None, :] - 2.0 * (a[s:s + step] @ b.T)
            d = np.sqrt(np.maximum(d2, 0.0))
            if lo == hi:
                np.fill_diagonal(d[:, s:s + step], 0.0)
            sums_l[s:s + step] = d @ oh_r
            if lo != hi:
                sums_r += d.T @ oh_l[s:s + step]
        emit(left, sums_l, oh_r.sum(axis=0))
        if lo != hi:
            emit(right, sums_r, oh_l.sum(axis=0))
        return pd.concat(out, ignore_index=True)

    return run


def silhouette_exact(points: DataFrame, cols: Sequence[str], label: str, id_col: str | None = None,
                     block_size: int = 2048) -> DataFrame:
    """Exact mean silhouette with Euclidean distance; one-row DataFrame ``silhouette``.

    Points with equal coordinates and label are one weighted point. More than ``BLOCKS`` blocks of them, in at most three columns,
    go through a tree (:mod:`basketry.operators.distance_tree`), whose work grows in proportion to the points and whose sums
    of distances are met within 1e-8 of their size, most within 1e-10. Otherwise points get a row id and are hashed into
    ``nb = ceil(n / block_size)`` blocks; every unordered
    block pair is a tile processed by one ``applyInPandas`` group holding at most two blocks (row
    ids are unique, so hash blocks cannot be skewed; ``id_col`` is accepted but not needed). Each point is shipped to ``nb`` tiles and only per-cluster
    distance sums leave a tile — no pair is ever a row. So in more than three columns, or with a coordinate that is null, NaN or
    infinite, work is quadratic; :func:`silhouette_linear` is a linear measure.
    Singleton clusters score 0, and fewer than two clusters give null, as in scikit-learn.
    """
    pts = points.select(
        F.col(label).cast("int").alias("_lab"),
        *[F.col(c).cast("double").alias(c) for c in cols],
    ).where(F.col("_lab").isNotNull())
    # a row id fixed by writing the points once (they are read several times below), so duplicate or missing ids in the
    # input cannot merge points
    pts = pts.groupBy("_lab", *cols).agg(F.count(F.lit(1)).alias("_w"))
    pts = materialize(pts.withColumn("_id", F.monotonically_increasing_id()))
    n = pts.count()
    if n > BLOCKS * block_size and len(cols) <= 3:
        finite = [F.max(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) for c in cols]
        ends = pts.agg(*finite, *[F.min(c) for c in cols], *[F.max(c) for c in cols]).first()
        totals = {r[0]: r[1] for r in pts.groupBy("_lab").agg(F.sum("_w")).collect()}
        if not any(ends[:len(cols)]):
            if len(totals) < 2:
                return points.sparkSession.createDataFrame([(None,)], "silhouette double")
            parts = mean_silhouette(pts, cols, totals, ends[len(cols):2 * len(cols)], ends[2 * len(cols):], n, block_size)
            return parts.agg((F.sum("s") / F.sum("w")).alias("silhouette"))
    nb = max(1, math.ceil(n / block_size))
    blk = F.pmod(F.xxhash64("_id"), F.lit(nb)).cast("int")
    tiles = (
        pts.withColumn("_blk", blk)
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
        .withColumn("_lo", F.least("_blk", "_j"))
        .withColumn("_hi", F.greatest("_blk", "_j"))
        .drop("_j")
    )
    sums = tiles.groupBy("_lo", "_hi").applyInPandas(_tile_sums(list(cols)), _TILE_SCHEMA)
    per = sums.groupBy("id", "own", "w", "cluster").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    per_point = per.groupBy("id", "own", "w").agg(
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("s"))).alias("s_own"),
        F.max(F.when(F.col("cluster") == F.col("own"), F.col("c"))).alias("c_own"),
        F.min(F.when(F.col("cluster") != F.col("own"), F.col("s") / F.col("c"))).alias("b"),
    )
    a = F.col("s_own") / (F.col("c_own") - 1)
    sil = F.when(F.col("c_own") <= 1, F.lit(0.0)).otherwise(
        F.when(F.greatest(a, F.col("b")) == 0, F.lit(0.0)).otherwise((F.col("b") - a) / F.greatest(a, F.col("b")))
    )
    n_clusters = pts.agg(F.count_distinct("_lab").alias("k")).scalar()
    return per_point.agg(
        F.when(n_clusters >= 2, F.sum(sil * F.col("w")) / F.sum("w")).alias("silhouette")
    )


def silhouette_linear(points: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Linear-time silhouette with squared Euclidean distance (Spark's ClusteringEvaluator measure).

    Mean squared distance from x to cluster C = |x|² - 2·x·mean(C) + mean(|y|²) over C, so only
    per-cluster sums are needed: k structs in one scalar subquery (k is a parameter, not data).
    The own-cluster mean is rescaled by n/(n-1) to leave the point itself out. Not the same
    number as the exact Euclidean silhouette; offered for inputs too large for a quadratic measure.
    """
    pts = points.select(F.col(label).cast("int").alias("_own"), *[F.col(c).cast("double").alias(c) for c in cols]).where(
        F.col("_own").isNotNull())
    sq = sum(F.col(c) ** 2 for c in cols)
    stats = pts.groupBy(F.col("_own").alias("_cl")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(cols)], F.avg(sq).alias("_q"))
    cs = stats.agg(F.collect_list(F.struct("_cl", "_n", *[f"_m{i}" for i in range(len(cols))], "_q")).alias("cs")).scalar()

    def dist_to(s):
        dot = sum(F.col(c) * s.getField(f"_m{i}") for i, c in enumerate(cols))
        return sq - 2 * dot + s.getField("_q")

    with_cs = pts.withColumn("_cs", cs)
    mine = F.filter("_cs", lambda s: s["_cl"] == F.col("_own"))[0]
    n_own = mine.getField("_n")
    a = dist_to(mine) * n_own / (n_own - 1)
    b = F.array_min(F.transform(F.filter("_cs", lambda s: s["_cl"] != F.col("_own")), dist_to))
    sil = F.when(n_own <= 1, F.lit(0.0)).when(F.greatest(a, b) == 0, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return with_cs.agg(F.when(F.size(F.first("_cs")) >= 2, F.avg(sil)).alias("silhouette"))


def davies_bouldin(points: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Davies-Bouldin index, one-row DataFrame ``davies_bouldin``.

    Centroids and mean member-to-centroid distances are two group-bys; the k × k comparison runs
    inside one row over a k-element array (k is a parameter, not data), with higher-order
    functions — no self join. Coincident centroids contribute 0, as in scikit-learn.
    """
    lab = F.col(label).cast("int")
    pts = points.select(lab.alias("_cl"), *[F.col(c).cast("double").alias(c) for c in cols]).where(
        F.col("_cl").isNotNull())
    cent = pts.groupBy("_cl").agg(*[F.avg(c).alias(f"_c{i}") for i, c in enumerate(cols)])
    # k rows, bounded by the number of clusters: a safe broadcast.
    dist = F.sqrt(sum((F.col(c) - F.col(f"_c{i}")) ** 2 for i, c in enumerate(cols)))
    spread = pts.join(F.broadcast(cent), "_cl").groupBy("_cl", *[f"_c{i}" for i in range(len(cols))]).agg(
        F.avg(dist).alias("_s"))
    arr = spread.agg(F.collect_list(F.struct("_cl", "_s", *[f"_c{i}" for i in range(len(cols))])).alias("cs"))

    def ratio(a, b):
        d = F.sqrt(sum((a.getField(f"_c{i}") - b.getField(f"_c{i}")) ** 2 for i in range(len(cols))))
        return F.when(d == 0, F.lit(0.0)).otherwise((a.getField("_s") + b.getField("_s")) / d)

    worst = F.transform("cs", lambda a: F.array_max(F.transform(F.filter("cs", lambda b: b["_cl"] != a["_cl"]),
                                                                lambda b: ratio(a, b))))
    total = F.aggregate(worst, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return arr.select(F.when(F.size("cs") >= 2, total / F.size("cs")).alias("davies_bouldin"))
