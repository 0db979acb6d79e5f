"""Clustering and evaluation checked against numpy on small data (scikit-learn is not installed)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketry.operators import cluster as CL
from basketry.operators import dbscan as DB
from basketry.operators import evaluate as EV

COLS = ["a", "b", "c"]


def _blobs(n=600, k=3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 4, (k, 3))
    lab = rng.integers(0, k, n)
    x = centres[lab] + rng.normal(0, 1, (n, 3))
    return x, lab


def _np_silhouette(x, lab):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = np.zeros(len(x))
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() <= 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in np.unique(lab) if c != lab[i])
        s[i] = (b - a) / max(a, b)
    return s.mean()


def _np_davies_bouldin(x, lab):
    cl = np.unique(lab)
    cent = np.array([x[lab == c].mean(0) for c in cl])
    spread = np.array([np.sqrt(((x[lab == c] - cent[i]) ** 2).sum(1)).mean() for i, c in enumerate(cl)])
    dist = np.sqrt(((cent[:, None] - cent[None]) ** 2).sum(-1))
    dist[dist == 0] = np.inf
    r = (spread[:, None] + spread[None]) / dist
    np.fill_diagonal(r, -np.inf)
    return r.max(1).mean()


@pytest.fixture(scope="module")
def labelled(spark):
    x, lab = _blobs()
    pdf = pd.DataFrame(x, columns=COLS).assign(id=np.arange(len(x)), label=lab.astype("int32"))
    return x, lab, spark.createDataFrame(pdf)


@pytest.mark.parametrize("block", [2048, 97])  # one tile, and many tiles
def test_exact_silhouette_matches_numpy(labelled, block):
    x, lab, df = labelled
    got = EV.silhouette_exact(df, COLS, "label", "id", block_size=block).first()[0]
    assert got == pytest.approx(_np_silhouette(x, lab), rel=1e-9)


def test_linear_silhouette_matches_squared_definition(labelled):
    x, lab, df = labelled
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, lab == c].mean() for c in np.unique(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    got = EV.silhouette_linear(df, COLS, "label").first()[0]
    assert got == pytest.approx(np.mean(s), rel=1e-9)


def test_davies_bouldin_matches_numpy(labelled):
    x, lab, df = labelled
    got = EV.davies_bouldin(df, COLS, "label").first()[0]
    assert got == pytest.approx(_np_davies_bouldin(x, lab), rel=1e-9)


def test_kmeans_invariants(spark, labelled):
    x, lab, df = labelled
    z = CL.standardize(df, COLS)
    feats = CL.with_features(z, [f"z{c}" for c in COLS], id_col="id").cache()
    fit = CL.fit_kmeans(feats, k=3, n_init=3, seed=42, max_iter=100)
    assert fit.cost == min(fit.costs)
    pred = fit.predict(feats)
    assert pred.count() == len(x)
    # every point sits at its nearest centre
    centres = np.array(fit.model.clusterCenters())
    pz = pred.select(*[f"z{c}" for c in COLS], "Cluster").toPandas()
    nearest = np.argmin(((pz.iloc[:, :3].to_numpy()[:, None] - centres[None]) ** 2).sum(-1), axis=1)
    assert (nearest == pz.Cluster.to_numpy()).all()
    # the same seed repeats exactly on the same layout
    again = CL.fit_kmeans(feats, k=3, n_init=1, seed=fit.seed, max_iter=100)
    assert again.cost == pytest.approx(fit.cost, rel=1e-12)
    # population standardisation: mean 0, std 1
    st = z.agg(*[F.stddev_pop(f"z{c}") for c in COLS], *[F.avg(f"z{c}") for c in COLS]).first()
    assert all(v == pytest.approx(1.0) for v in st[:3]) and all(abs(v) < 1e-9 for v in st[3:])


def _spread(seed=5, n=3000):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 3, (7, 3))
    x = centres[rng.integers(0, 7, n)] + rng.normal(0, 0.7, (n, 3))
    return np.concatenate([x, np.repeat(x[:5], 80, axis=0)])  # some points many times


def _vectors(spark, x, partitions):
    pdf = pd.DataFrame(x, columns=COLS).assign(id=np.arange(len(x)))
    return CL.with_features(spark.createDataFrame(pdf).repartition(partitions, "id"), COLS, id_col="id")


def _np_kmeans(x, k, restarts):
    """Least cost of plain k-means++ and Lloyd, one restart after the other."""
    best = np.inf
    for r in range(restarts):
        rng = np.random.default_rng(r)
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            c = np.concatenate([c, x[[rng.choice(len(x), p=d / d.sum())]]])
        for _ in range(100):
            own = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
            if np.allclose(new, c):
                break
            c = new
        best = min(best, ((x[:, None] - c[None]) ** 2).sum(-1).min(1).sum())
    return best


def test_batched_fits_cost_no_more_than_single_ones(spark):
    """Every k and restart in the same scans, against as many restarts one by one."""
    x = _spread()
    ks = (2, 4, 6)
    for k, fit in CL.fit_each(_vectors(spark, x, 3), ks, n_init=10, max_iter=100).items():
        assert fit.cost <= _np_kmeans(x, k, 10) * 1.001, k
        centres = np.array(fit.model.clusterCenters())
        d2 = ((x[:, None] - centres[None]) ** 2).sum(-1)
        assert fit.cost == pytest.approx(d2.min(1).sum(), rel=1e-9) and fit.cost == min(fit.costs) and len(fit.costs) == 10
        mean = np.array([x[d2.argmin(1) == j].mean(0) for j in range(k)])
        assert np.abs(mean - centres).max() < 1e-3  # a fixed point of Lloyd's step


def test_a_fit_does_not_depend_on_the_layout(spark):
    x = _spread(seed=8, n=900)
    one = CL.fit_kmeans(_vectors(spark, x, 1), k=4, n_init=2)
    for partitions in (3, 11):
        again = CL.fit_kmeans(_vectors(spark, x, partitions), k=4, n_init=2)
        assert again.seed == one.seed and np.allclose(np.array(again.model.clusterCenters()), np.array(one.model.clusterCenters()), atol=1e-9)


def test_fewer_points_than_centres(spark):
    fit = CL.fit_kmeans(_vectors(spark, np.array([[0.0, 0, 0], [1, 1, 1], [1, 1, 1]]), 2), k=4, n_init=2)
    assert sorted(fit.centres.values()) == [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)] and fit.cost == 0.0


@pytest.mark.parametrize("block", [256, 7])
def test_a_step_on_blocks_is_lloyds_step(spark, monkeypatch, block):
    from basketry.operators import lloyd

    x = _spread(seed=3, n=700)
    rng = np.random.default_rng(0)
    runs = [x[rng.choice(len(x), k, replace=False)] for k in (2, 5, 9)]
    blocks = lloyd.block_table(_vectors(spark, x, 2), size=block)
    for centres, (mass, sums, cost) in zip(runs, lloyd.step(blocks, runs), strict=True):
        d2 = ((x[:, None] - centres[None]) ** 2).sum(-1)
        own = d2.argmin(1)
        assert np.allclose(mass, np.bincount(own, minlength=len(centres)))
        assert np.allclose(sums, [x[own == j].sum(0) for j in range(len(centres))]) and cost == pytest.approx(d2.min(1).sum(), rel=1e-9)


def test_bisecting_needs_shift(spark, labelled):
    x, lab, df = labelled
    z = CL.standardize(df, COLS)
    feats = CL.with_features(z, [f"z{c}" for c in COLS], shift=10.0, id_col="id")
    model = CL.fit_bisecting(feats, k=3)
    assert len(model.clusterCenters()) == 3


def test_name_clusters_rule(spark):
    rows = [(0, 10, 2, 100.0), (1, 300, 1, 50.0), (2, 5, 30, 9000.0), (3, 20, 12, 400.0)]
    df = spark.createDataFrame(rows, "Cluster int, Recency int, Frequency long, Monetary double")
    assert CL.name_clusters(df) == {2: "VIP", 1: "Lost", 3: "Loyal", 0: "Regular"}


def test_split_is_deterministic_and_near_20pct(spark):
    df = spark.range(5000).withColumnRenamed("id", "CustomerID")
    train, test = CL.split(df)
    n_test = test.count()
    assert train.count() + n_test == 5000 and 800 < n_test < 1200
    assert test.join(train, "CustomerID").count() == 0


def _brute_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= m
    lab = -np.ones(len(x), int)
    c = 0
    for i in np.flatnonzero(core):
        if lab[i] != -1:
            continue
        stack, lab[i] = [i], c
        while stack:
            j = stack.pop()
            for t in np.flatnonzero(nb[j] & core):
                if lab[t] == -1:
                    lab[t] = c
                    stack.append(t)
        c += 1
    noise = (~core) & ~nb[:, core].any(1)
    return c, int(noise.sum()), core, lab


@pytest.mark.parametrize("eps,min_pts", [(0.5, 5), (1.2, 8)])
def test_dbscan_matches_brute_force(spark, eps, min_pts):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.3, (300, 3)), rng.normal(3, 0.6, (200, 3)), rng.uniform(-4, 8, (80, 3)),
                        np.zeros((40, 3))])  # 40 copies of one point
    pdf = pd.DataFrame(x, columns=COLS).assign(id=np.arange(len(x)))
    out = DB.dbscan(spark.createDataFrame(pdf), COLS, "id", eps, min_pts).toPandas().sort_values("id")
    k, noise, core, lab = _brute_dbscan(x, eps, min_pts)
    assert out.label[out.label != -1].nunique() == k
    assert int((out.label == -1).sum()) == noise
    assert (out.is_core.to_numpy() == core).all()
    # identical partition of the core points
    pairs = set(zip(lab[core], out.label.to_numpy()[core]))
    assert len(pairs) == len(set(lab[core])) == len(set(out.label.to_numpy()[core]))
    s = DB.dbscan_summary(spark.createDataFrame(out)).first()
    assert s.clusters == k and s.points == len(x)


@pytest.mark.parametrize("d", [1, 2, 4, 7])
def test_dbscan_of_any_number_of_columns(spark, d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(0, 0.35 / np.sqrt(d), (150, d)), rng.normal(2, 0.5 / np.sqrt(d), (120, d)), rng.uniform(-3, 6, (60, d)), np.full((9, d), 5e6)])
    cols = [f"v{i}" for i in range(d)]
    pdf = pd.DataFrame(x, columns=cols).assign(id=np.arange(len(x)))
    out = DB.dbscan(spark.createDataFrame(pdf), cols, "id", 0.5, 6).toPandas().sort_values("id")
    k, noise, core, lab = _brute_dbscan(x, 0.5, 6)
    assert k >= 2 and out.label[out.label != -1].nunique() == k and int((out.label == -1).sum()) == noise
    assert (out.is_core.to_numpy() == core).all()
    pairs = set(zip(lab[core], out.label.to_numpy()[core]))
    assert len(pairs) == len(set(lab[core])) == len(set(out.label.to_numpy()[core]))


def test_dbscan_pairs_grow_with_the_points(spark, monkeypatch):
    """Pairs of boxes and points that are formed, over Gaussian points: four times the points, at most five times the pairs."""
    formed = []
    write = DB.materialize

    def counted(df):
        table = write(df)
        if "full" in table.columns:
            formed[-1] += table.count()
        return table

    monkeypatch.setattr(DB, "materialize", counted)
    for n in (5_000, 20_000):
        formed.append(0)
        x = np.random.default_rng(3).normal(0, 1, (n, 3))
        df = spark.createDataFrame(pd.DataFrame(x, columns=COLS).assign(id=np.arange(n)))
        assert DB.dbscan(df, COLS, "id").count() == n
    assert formed[1] <= 5 * formed[0]


def test_dbscan_of_an_empty_table(spark):
    assert DB.dbscan(spark.createDataFrame([], "a double, b double, id long"), ["a", "b"], "id").count() == 0


def test_exact_silhouette_ignores_duplicate_ids(labelled):
    x, lab, df = labelled
    same_id = df.withColumn("id", F.lit(1))
    got = EV.silhouette_exact(same_id, COLS, "label", "id", block_size=97).first()[0]
    assert got == pytest.approx(_np_silhouette(x, lab), rel=1e-9)


@pytest.mark.parametrize("n, pct", [(5000, 20), (7, 20), (1, 20), (301, 33)])
def test_split_has_its_exact_size(spark, n, pct):
    df = spark.range(n).withColumnRenamed("id", "CustomerID")
    train, test = CL.split(df, pct)
    want = -(-pct * n // 100)
    assert (train.count(), test.count()) == (n - want, want)
    other = CL.split(df.repartition(7), pct)[1]
    assert sorted(r[0] for r in other.collect()) == sorted(r[0] for r in test.collect())
    assert n < 100 or sorted(r[0] for r in CL.split(df, pct, seed=7)[1].collect()) != sorted(r[0] for r in test.collect())


def test_split_of_no_rows(spark):
    train, test = CL.split(spark.range(0).withColumnRenamed("id", "CustomerID"))
    assert train.count() == test.count() == 0
