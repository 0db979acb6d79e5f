"""Customer segmentation model: RFM → standardise → k-means → names → rule segments.

The per-customer table is materialised once (a parquet table in the folder named by
``spark.checkpoint.dir``): it feeds the restarts, the naming, the summaries and every filter by
segment, and a lost executor then re-reads it instead of recomputing from the raw lines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from basketry.operators import cluster as CL
from basketry.operators import rfm as R
from basketry.session import ensure_checkpoint_dir, materialize


@dataclass
class SegmentModel:
    stats: DataFrame          # one row: population mean / std of R, F, M
    fit: CL.KMeansFit
    names: dict               # cluster id -> name
    customers: DataFrame      # CustomerID, R, F, M, z*, Cluster, KMSegment, Segment

    def score(self, df: DataFrame) -> DataFrame:
        """M4 for a batch of (Recency, Frequency, Monetary) rows."""
        return CL.score_customers(df, self.stats, self.fit, self.names)


def build_segment_model(sales: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42,
                        max_iter: int = 300) -> SegmentModel:
    spark = sales.sparkSession
    ensure_checkpoint_dir(spark)
    base = R.rfm(sales)  # written once inside rfm()
    stats = materialize(CL.scaler_stats(base))
    z = CL.standardize(base, stats=stats)
    feats = CL.with_features(z).cache()
    try:
        fit = CL.fit_kmeans(feats, k, n_init, seed, max_iter)
        labelled = materialize(fit.predict(feats).drop("features"))
    finally:
        feats.unpersist()
    names = CL.name_clusters(labelled)
    customers = R.rule_segments(labelled.withColumn("KMSegment", CL.name_column(names)))
    return SegmentModel(stats, fit, names, customers)
