"""The dashboard as a plan: filters, then every metric table of one filtered line table.

``get_metrics`` returns lazy DataFrames over one shared input. The dashboard computes all of
them, so the filtered lines are kept for the duration of one refresh:

- ``persist="cache"`` (default): ``persist(MEMORY_AND_DISK)``. The filtered lines have a short
  lineage (a pruned scan of the written, month-partitioned store plus semi joins), so a lost
  executor simply recomputes its partitions; nothing is copied to storage on each filter change,
  even when no filter is set. Call ``release(view)`` when the refresh is rendered.
- ``persist="write"``: a table written once under ``spark.checkpoint.dir`` (for inputs whose own
  lineage is long, e.g. straight from the raw joins).
- ``persist=None``: every table re-reads its input.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from basketry.operators import filters as FL
from basketry.operators import metrics as M
from basketry.operators import rfm as R
from basketry.session import materialize


def _keep(df: DataFrame, persist) -> DataFrame:
    if persist in (True, "write"):
        return materialize(df)
    if persist == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    if persist in (None, False):
        return df
    raise ValueError("persist must be 'cache', 'write' or None")


def get_metrics(df: DataFrame, cap: float = M.DEFAULT_CAP, top_n: int = 10, persist=None, weight: str | None = None,
                products: DataFrame | None = None) -> dict:
    """Every metric table of one line table, as a dict of lazy DataFrames (plus ``lines``).

    ``df`` may hold pre-aggregated lines: ``weight`` names the column with the number of lines a row stands for,
    and ``products`` has the units by product, which such a table lacks (see :mod:`basketry.plans.summary`).
    """
    src = _keep(df, persist)
    k = M.kpis(src, cap)
    baskets, frequency, months = M.basket_values(src, cap), M.purchase_frequency(src), M.monthly_revenue(src)
    heat = M.sales_heatmap(src, weight)
    if persist == "cache":
        heat = heat.persist(StorageLevel.MEMORY_AND_DISK)  # ≤168 rows, read by three tables
    return {
        "lines": src,
        "kpis": k,
        "kpi_text": M.kpi_text(k),
        "basket_data": baskets,
        "basket_histogram": M.histogram(baskets, "BasketValue"),
        "purchase_freq": frequency,
        "purchase_histogram": M.histogram(frequency, "PurchaseCount"),
        "monthly_revenue": months,
        "month_labels": M.month_labels(months),
        "peak_month": M.peak_month(src),
        "top_countries": M.top_countries(src, top_n, weight),
        "top_products": M.top_products(src if products is None else products, top_n),
        "top_customers": M.top_customers(src, top_n),
        "heatmap": heat,
        "heatmap_wide": M.heatmap_wide_from_long(heat),
        "heatmap_ceiling": M.ceiling_from_long(heat),
        "basket_shape": M.basket_shape(src, cap),
        "date_bounds": M.date_bounds(src),
        "countries": M.countries(src),
    }


def dashboard(lines: DataFrame, customers: DataFrame, spec: FL.FilterSpec, cap: float = M.DEFAULT_CAP,
              persist="cache") -> dict:
    """One filter change: apply the filters, recompute the metrics and the segment pies.

    ``customers`` is the per-customer table with Segment (and KMSegment when a k-means model was
    fitted). The pies count the customers that remain after filtering (J3 + X2).
    """
    out = get_metrics(FL.apply_filters(lines, customers, spec), cap, persist=persist)
    remaining = FL.customers_in(customers, out["lines"])
    out["rule_segments"] = R.segment_counts(remaining, "Segment")
    if "KMSegment" in customers.columns:
        out["km_segments"] = R.segment_counts(remaining, "KMSegment")
    return out


def release(view: dict) -> None:
    """Drop everything a refresh cached (no-op for written or unpersisted inputs)."""
    for df in view.values():
        if isinstance(df, DataFrame) and df.storageLevel != StorageLevel.NONE:
            df.unpersist()
