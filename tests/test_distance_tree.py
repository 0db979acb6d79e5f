"""The tree of the exact silhouette against all pairs, and the number of pairs it forms."""

import numpy as np
import pandas as pd
import pytest

from basketry.operators import distance_tree as DT
from basketry.operators import evaluate as EV
from tests.test_cluster import _np_silhouette

COLS = ["a", "b", "c"]


def _skewed(n, seed):
    """Whole days, few counts and a long tail, like recency, frequency and sales; some rows twice, one label alone."""
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 700, n) / 200, rng.geometric(0.2, n) / 4, np.exp(rng.normal(0, 2, n))])
    lab = np.where(x[:, 2] > 8, 0, np.where(x[:, 0] > 1.5, 1, 5))
    lab[0] = 9
    x[1:40], lab[1:40] = x[40:79], lab[40:79]
    return x, lab


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_tree_matches_all_pairs(spark, monkeypatch, dims):
    x, lab = _skewed(2500, 2)
    x = x[:, 3 - dims:]
    calls, real = [], EV.mean_silhouette
    monkeypatch.setattr(EV, "mean_silhouette", lambda *a: calls.append(a) or real(*a))
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLS[:dims]).assign(id=1, label=lab.astype("int32"))).repartition(3)
    got = EV.silhouette_exact(df, COLS[:dims], "label", "id", block_size=40).first()[0]
    assert len(calls) == 1
    assert got == pytest.approx(_np_silhouette(x, lab), rel=1e-9)


def _formed(n, most):
    """Pairs of points in cubes too near each other, and pairs of cubes far from each other."""
    x, _ = _skewed(n, 3)
    low = x.min(axis=0)
    side = (x.max(axis=0) - low).max() * (1 + 1e-9)
    codes = DT._coder(low, side)(x)

    def count(level, cells):
        at = codes >> (3 * (DT.DEPTH - level))
        return np.unique(at[np.isin(at >> 6, cells)], return_counts=True)

    tree = DT.Tree(3, low, side, count, n, most)
    assert tree.count[tree.leaves].sum() == n
    far, over, near = tree.meet(300)
    return int((tree.count[near[0]] * tree.count[near[1]]).sum()), far.shape[1] + over.shape[1]


def test_pairs_grow_with_the_points():
    few, many = _formed(20_000, 200), _formed(80_000, 200)
    assert many[0] <= 6 * few[0] and many[1] <= 8 * few[1]
    assert many[0] < 0.1 * 80_000**2


def test_one_label_in_the_tree(spark):
    x, _ = _skewed(200, 2)
    df = spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(label=1))
    assert EV.silhouette_exact(df, COLS, "label", block_size=4).first()[0] is None
