"""Standardisation, k-means with restarts, model selection and hold-out validation (C1-C3, C6-C7,
C9-C14, A18-A19, M4).

Features are the standardised Recency / Frequency / Monetary columns. k-means fits run in
:mod:`basketry.operators.lloyd`, all restarts and all k in one scan per iteration; hierarchical fits use
Spark ML; all other steps are DataFrame plans. Only k-row summaries (centroids, per-k scores) are ever
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import advice, health_label, health_score
from basketry.functions.quantiles import value_at
from basketry.operators.evaluate import davies_bouldin, silhouette_exact, silhouette_linear
from basketry.operators.lloyd import fit_all

RFM_COLS = ("Recency", "Frequency", "Monetary")
Z_COLS = tuple(f"z{c}" for c in RFM_COLS)

# Segment names of the analysed application (VIP, Lost, Loyal, Regular) and the
# generalisation-gap threshold of its hold-out verdict.
NAME_VIP, NAME_LOST, NAME_LOYAL, NAME_REGULAR = "VIP", "Lost", "Loyal", "Regular"
GAP_THRESHOLD = 0.05
#: The silhouette used unless another is asked for: linear in the rows, the same at every size.
SILHOUETTE = "squared_euclidean"


# --- C1 standardisation ------------------------------------------------------------------------

def scaler_stats(df: DataFrame, cols: Sequence[str] = RFM_COLS) -> DataFrame:
    """Population mean and standard deviation per column (one row); a zero std becomes 1."""
    aggs = []
    for c in cols:
        aggs.append(F.avg(c).alias(f"mean_{c}"))
        sd = F.stddev_pop(c)
        aggs.append(F.when((sd.isNull()) | (sd == 0), F.lit(1.0)).otherwise(sd).alias(f"std_{c}"))
    return df.agg(*aggs)


def standardize(df: DataFrame, cols: Sequence[str] = RFM_COLS, stats: DataFrame | None = None,
                prefix: str = "z") -> DataFrame:
    """Adds ``z<col> = (col - mean) / std_pop``; ``stats`` defaults to ``df``'s own.

    The statistics are one scalar subquery (a struct), so no join and nothing collected.
    """
    stats = scaler_stats(df, cols) if stats is None else stats
    s = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    out = df.withColumn("_s", s)
    for c in cols:
        out = out.withColumn(f"{prefix}{c}", (F.col(c) - F.col(f"_s.mean_{c}")) / F.col(f"_s.std_{c}"))
    return out.drop("_s")


def with_features(df: DataFrame, cols: Sequence[str] = Z_COLS, out: str = "features", shift: float = 0.0,
                  id_col: str = "CustomerID", partitions: int | None = None) -> DataFrame:
    """Assemble the ML vector. ``shift`` moves every coordinate (see :func:`fit_bisecting`). With ``partitions`` the row
    layout is fixed (so many hash partitions sorted by id): a bisecting fit, whose draws follow the layout, then
    repeats exactly under any session settings; k-means fits don't need it. Raise it with the data."""
    src = df if shift == 0 else df.select("*", *[(F.col(c) + shift).alias(f"_sh_{c}") for c in cols])
    in_cols = list(cols) if shift == 0 else [f"_sh_{c}" for c in cols]
    vec = VectorAssembler(inputCols=in_cols, outputCol=out).transform(src)
    if shift:
        vec = vec.drop(*in_cols)
    return vec.repartition(partitions, id_col).sortWithinPartitions(id_col) if partitions else vec


# --- nearest centre -----------------------------------------------------------------------------

def assign_nearest(df: DataFrame, centres: dict[int, Sequence[float]], cols: Sequence[str] = Z_COLS,
                   out: str = "Cluster") -> DataFrame:
    """Label of the nearest centre, the lower label on ties: one expression over the k centres (built-ins
    only, no assembled vector), so any centres can be used, fitted or given."""
    options = []
    for label, centre in sorted(centres.items()):
        d2 = sum((F.col(c) - F.lit(float(v))) ** 2 for c, v in zip(cols, centre, strict=True))
        options.append(F.struct(d2.alias("d2"), F.lit(int(label)).alias("label")))
    return df.withColumn(out, F.array_min(F.array(*options))["label"].cast("int"))


@dataclass
class CentreModel:
    """Given centres with the interface of a fit."""

    centres: dict[int, Sequence[float]]

    def assign(self, df: DataFrame, out: str = "Cluster") -> DataFrame:
        return assign_nearest(df, self.centres, out=out)

    def clusterCenters(self) -> list[Sequence[float]]:  # noqa: N802 - the name that Spark ML's models use
        return [self.centres[i] for i in sorted(self.centres)]


def label_centres(labelled: DataFrame, label: str, cols: Sequence[str] = Z_COLS) -> CentreModel:
    """The mean of each label as a centre; one row per label is collected, for a label of few values."""
    rows = labelled.groupBy(label).agg(*[F.avg(c).alias(c) for c in cols]).collect()
    return CentreModel({int(r[label]): tuple(r[c] for c in cols) for r in rows if r[label] is not None})


def inertia(points: DataFrame, label: str = "Cluster", cols: Sequence[str] = Z_COLS) -> DataFrame:
    """One row ``inertia``: the sum of squared distances to the mean of the own label (per label, population variance times size)."""
    per = points.where(F.col(label).isNotNull()).groupBy(label).agg(sum(F.var_pop(c) * F.count(c) for c in cols).alias("ss"))
    return per.agg(F.sum("ss").alias("inertia"))


# --- C2 k-means with restarts ------------------------------------------------------------------

@dataclass
class KMeansFit:
    model: CentreModel
    cost: float
    seed: int
    k: int
    costs: list = field(default_factory=list)
    features: str = "features"

    @property
    def centres(self) -> dict[int, Sequence[float]]:
        return self.model.centres

    def assign(self, df: DataFrame, out: str = "Cluster") -> DataFrame:
        """Labels from the standardised columns, without a feature vector."""
        return assign_nearest(df, self.centres, out=out)

    def predict(self, df: DataFrame, out: str = "Cluster") -> DataFrame:
        """Labels from the feature vector, whatever columns it was made of."""
        own = [f"__x{i}" for i in range(len(self.centres[0]))]
        split = df.withColumn("__x", vector_to_array(self.features))
        split = split.select(*df.columns, *[F.col("__x")[i].alias(c) for i, c in enumerate(own)])
        return assign_nearest(split, self.centres, own, out).drop(*own)


def fit_kmeans(feats: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 300,
               tol: float = 1e-4, features: str = "features") -> KMeansFit:
    """Best of ``n_init`` seeded fits (seeds seed..seed+n_init-1) by cost; ties go to the lower seed.

    The restarts advance together, one scan of the points per iteration. The same seed gives the same fit
    however the rows lie in partitions (up to the order in which floating-point sums are added).
    """
    return fit_each(feats, [k], n_init, seed, max_iter, tol, features)[k]


def fit_each(feats: DataFrame, ks: Sequence[int], n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
             features: str = "features") -> dict[int, KMeansFit]:
    """The best fit of every k, all of them in the same scans."""
    out = {}
    for k, runs in fit_all(feats, ks, n_init, seed, max_iter, tol, features).items():
        costs = [cost for _, cost in runs]
        best = min(range(len(runs)), key=lambda i: (costs[i], i))
        centres = {j: tuple(float(v) for v in c) for j, c in enumerate(runs[best][0])}
        out[k] = KMeansFit(CentreModel(centres), costs[best], seed + best, k, costs, features)
    return out


def fit_bisecting(feats_shifted: DataFrame, k: int = 4, seed: int = 42, features: str = "features",
                  max_iter: int = 20):
    """Divisive hierarchical clustering (bisecting k-means) on all rows.

    Replaces agglomerative clustering on a 500-row prefix. Spark's bisecting split degenerates on
    centred data, so pass features built with ``with_features(..., shift=10)``: a shift changes
    no distance.
    """
    return BisectingKMeans(k=k, seed=seed, featuresCol=features, maxIter=max_iter).fit(feats_shifted)


# --- C3-C7 model selection -------------------------------------------------------------------

def evaluate_labels(labelled: DataFrame, label: str = "Cluster", cols: Sequence[str] = Z_COLS,
                    id_col: str = "CustomerID", method: str = SILHOUETTE) -> tuple[float | None, float | None]:
    """(silhouette, Davies-Bouldin) of one labelling, as driver scalars. ``method`` is 'squared_euclidean'
    (linear) or 'euclidean' (exact distances, quadratic work: only when asked for)."""
    if method not in ("squared_euclidean", "euclidean"):
        raise ValueError("method must be 'squared_euclidean' or 'euclidean'")
    if method == "euclidean":
        sil = silhouette_exact(labelled, cols, label, id_col)
    else:
        sil = silhouette_linear(labelled, cols, label)
    s = sil.first()["silhouette"]
    d = davies_bouldin(labelled, cols, label).first()["davies_bouldin"]
    return (None if s is None else float(s)), (None if d is None else float(d))


def sweep(feats: DataFrame, ks: Sequence[int] = range(2, 11), n_init: int = 10, seed: int = 42,
          max_iter: int = 300, method: str = SILHOUETTE, id_col: str = "CustomerID",
          parallelism: int = 3) -> DataFrame:
    """C3 + C4 + C5: one fit per k (not three), with inertia, silhouette and Davies-Bouldin.

    All k and restarts are fitted together. Returns ``(k, inertia, silhouette, davies_bouldin, silhouette_method)``,
    len(ks) rows.
    """
    from concurrent.futures import ThreadPoolExecutor

    feats = feats.cache()

    def one(k):
        sil, db = evaluate_labels(fits[k].predict(feats), "Cluster", id_col=id_col, method=method)
        return int(k), fits[k].cost, sil, db, method

    try:
        fits = fit_each(feats, ks, n_init, seed, max_iter)
        # the scores of each k run as concurrent Spark jobs
        with ThreadPoolExecutor(max_workers=max(1, min(len(ks), parallelism))) as pool:
            rows = list(pool.map(one, ks))
    finally:
        feats.unpersist()
    spark = feats.sparkSession
    return spark.createDataFrame(
        rows, "k int, inertia double, silhouette double, davies_bouldin double, silhouette_method string")


def _best_aggs():
    """Aggregates for C6: first k of the highest silhouette / lowest Davies-Bouldin."""
    top_sil = F.when(F.col("silhouette").isNotNull(), F.struct(F.col("silhouette"), -F.col("k")))
    low_db = F.when(F.col("davies_bouldin").isNotNull(), F.struct(F.col("davies_bouldin"), F.col("k")))
    return [
        F.max_by("k", top_sil).alias("best_k_silhouette"),
        F.max("silhouette").alias("best_silhouette"),
        F.min_by("k", low_db).alias("best_k_db"),
        F.min("davies_bouldin").alias("best_db"),
    ]


def best_k(scores: DataFrame) -> DataFrame:
    """K of the highest silhouette and of the lowest Davies-Bouldin, first k on ties."""
    return scores.agg(*_best_aggs())


def k_decision(scores: DataFrame) -> DataFrame:
    """Elbow k (largest second difference of inertia), best silhouette k, best DB k, and
    whether all three agree — computed, not asserted. One window over the len(ks) score rows."""
    from pyspark.sql import Window

    w = Window.orderBy("k")
    bend = F.lag("inertia").over(w) - 2 * F.col("inertia") + F.lead("inertia").over(w)
    curv = scores.withColumn("bend", bend)
    ranked_bend = F.when(F.col("bend").isNotNull(), F.struct(F.col("bend"), -F.col("k")))
    out = curv.agg(F.max_by("k", ranked_bend).alias("elbow_k"), *_best_aggs())
    agree = (F.col("elbow_k") == F.col("best_k_silhouette")) & (F.col("elbow_k") == F.col("best_k_db"))
    return out.withColumn("all_agree", F.coalesce(agree, F.lit(False)))


# --- C10 cluster names, A18-A19, M4 ------------------------------------------------------------

def cluster_means(labelled: DataFrame, label: str = "Cluster", decimals: int = 1) -> DataFrame:
    """Mean raw R/F/M per cluster, rounded."""
    return labelled.groupBy(label).agg(*[F.bround(F.avg(c), decimals).alias(c) for c in RFM_COLS]).orderBy(label)


def name_clusters(labelled: DataFrame, label: str = "Cluster") -> dict[int, str]:
    """Names from the clusters' mean raw R/F/M (k rows collected).

    With k = 4: highest mean Monetary is VIP; of the rest, highest mean Recency is Lost; of the
    rest, highest mean Frequency is Loyal; the last is Regular. Ties go to the lower label.
    Other k: 'Cluster <id>'.
    """
    means = {r[label]: r for r in labelled.groupBy(label).agg(
        *[F.avg(c).alias(c) for c in RFM_COLS]).collect() if r[label] is not None}
    if len(means) != 4:
        return {int(c): f"Cluster {c}" for c in means}
    left = sorted(means)
    names = {}
    for name, col in ((NAME_VIP, "Monetary"), (NAME_LOST, "Recency"), (NAME_LOYAL, "Frequency")):
        pick = max(left, key=lambda c: (means[c][col], -c))
        names[int(pick)] = name
        left.remove(pick)
    names[int(left[0])] = NAME_REGULAR
    return names


def name_column(names: dict[int, str], label: str = "Cluster"):
    lit_map = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return F.try_element_at(lit_map, F.col(label))


def cluster_summary(labelled: DataFrame, names: dict[int, str] | None = None, label: str = "Cluster") -> DataFrame:
    """Name, size, share of customers (1 dp) and mean R/F/M (2 dp) per cluster.

    Without ``names`` the label itself is the name (e.g. rule segments used as clusters).
    """
    from pyspark.sql import Window

    g = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("Customers"),
                                    *[F.bround(F.avg(c), 2).alias(c) for c in RFM_COLS])
    share = F.bround(F.col("Customers") * 100.0 / F.sum("Customers").over(Window.partitionBy()), 1)
    fallback = F.concat(F.lit("Cluster "), F.col(label)) if names is not None else F.col(label).cast("string")
    name = F.coalesce(name_column(names, label), fallback) if names else fallback
    return g.select(label, name.alias("Name"), "Customers", share.alias("Share"), *RFM_COLS).orderBy(label)


def score_customers(df: DataFrame, stats: DataFrame, fit: KMeansFit | CentreModel, names: dict[int, str]) -> DataFrame:
    """M4: segment prediction for a batch of (Recency, Frequency, Monetary) rows.

    Scales with the training statistics, assigns the nearest centre, names it, and adds the
    health score, label and the prediction advice. One narrow projection: no shuffle.
    """
    z = standardize(df, RFM_COLS, stats)
    pred = fit.assign(z)
    score = health_score(F.col("Recency"), F.col("Frequency"), F.col("Monetary"))
    seg = F.coalesce(name_column(names), F.lit("Unknown"))
    return pred.select(
        *df.columns,
        "Cluster",
        seg.alias("KMSegment"),
        score.alias("HealthScore"),
        health_label(score).alias("HealthLabel"),
        advice(seg, "predict").alias("Advice"),
    )


# --- C11-C14 hold-out --------------------------------------------------------------------------

def split_key(id_col: str = "CustomerID", seed: int = 42):
    """The first 13 hex digits of md5("seed:id") as a number below 2^52, exact as a double: the same in any SQL engine."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double")


def split(df: DataFrame, test_pct: int = 20, id_col: str = "CustomerID", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """C11: (train, test) with exactly ``ceil(test_pct / 100 * n)`` test rows, those of the smallest hashes of the id.

    The hash at that rank is found by counting (:func:`basketry.functions.quantiles.value_at`), so the rows aren't
    sorted. Rows of one id stay together, so repeated ids may make the test part larger.
    """
    key = split_key(id_col, seed)
    top = value_at(df.select(key.alias("key")), "key", lambda n: -(-test_pct * n // 100) - 1)
    chosen = key <= F.lit(top) if top is not None else F.lit(False)
    return df.where(~chosen), df.where(chosen)


def holdout(z: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, max_iter: int = 300,
            test_pct: int = 20, id_col: str = "CustomerID", method: str = SILHOUETTE,
            fit: CentreModel | None = None) -> DataFrame:
    """Fit on train (or take ``fit``), predict train and test, score both, and give a verdict.

    ``z`` carries the standardised columns (by default scaled on all rows before the split, as
    in the analysed application; pass train-only statistics to :func:`standardize` to change it).
    """
    train, test = split(z, test_pct, id_col)
    if fit is None:
        fit = fit_kmeans(with_features(train, id_col=id_col), k, n_init, seed, max_iter)
    tr_sil, _ = evaluate_labels(fit.assign(train), id_col=id_col, method=method)
    te_sil, te_db = evaluate_labels(fit.assign(test), id_col=id_col, method=method)
    spark = z.sparkSession
    row = spark.createDataFrame([(tr_sil, te_sil, te_db)],
                                "train_silhouette double, test_silhouette double, test_davies_bouldin double")
    r3 = lambda c: F.bround(c, 3)
    out = row.select(r3("train_silhouette").alias("train_silhouette"), r3("test_silhouette").alias("test_silhouette"),
                     r3("test_davies_bouldin").alias("test_davies_bouldin"))
    gap = F.bround(F.abs(F.col("train_silhouette") - F.col("test_silhouette")), 3)
    return out.withColumn("gap", gap).withColumn(
        "verdict", F.when(F.col("gap") < GAP_THRESHOLD, "Good").otherwise("Check")).withColumn(
        "silhouette_method", F.lit(method))


def holdout_rfm(rfm_df: DataFrame, scale_on: str = "all", **kwargs) -> DataFrame:
    """C11-C14 from the raw RFM table. ``scale_on="all"`` fits the scaler on every customer before
    the split (the analysed application's order); ``"train"`` fits it on the training split only,
    so no statistic of the test customers leaks into the model."""
    if scale_on not in ("all", "train"):
        raise ValueError("scale_on must be 'all' or 'train'")
    id_col = kwargs.get("id_col", "CustomerID")
    base = split(rfm_df, kwargs.get("test_pct", 20), id_col)[0] if scale_on == "train" else rfm_df
    return holdout(standardize(rfm_df, stats=scaler_stats(base)), **kwargs)
