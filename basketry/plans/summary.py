"""A mergeable summary store for dashboard refreshes.

Two tables, both partitioned by month and far smaller than the lines:

- ``orders``: one row per order, customer, country and order time, with its revenue and number of lines. Every metric but the
  products is an aggregate of orders, so all filters, segment and basket included, work on these rows: distinct
  orders and customers are counted exactly, from the keys themselves;
- ``products``: units per product, country and hour, with a flag for lines exactly on the hour, so that a date bound
  at a full hour keeps the same lines as in the line table.

Sums of parts are sums of the whole, so new lines are appended as further rows (``mode="append"``) without reading the old
ones; nothing is rewritten. A change of dates or countries scans no lines. Only the product ranking needs them, and only
under a segment or basket filter, or a date bound that is not a full hour.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import filters as FL
from basketry.operators import metrics as M
from basketry.operators import rfm as R
from basketry.plans.dashboard import get_metrics
from basketry.sources.store import read_clean_sales, write_clean_sales

ORDER_KEYS = ("InvoiceNo", "CustomerID", "Country", "InvoiceDate", "Month", "Hour", "Day", "day_idx")


@dataclass(frozen=True)
class Summary:
    orders: DataFrame    # ORDER_KEYS, TotalPrice, Lines
    products: DataFrame  # Description, Country, Month, InvoiceDate (full hour), OnHour, Quantity


def order_cells(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*ORDER_KEYS).agg(F.sum("TotalPrice").alias("TotalPrice"), F.count(F.lit(1)).alias("Lines"))


def product_cells(lines: DataFrame) -> DataFrame:
    hour = F.to_timestamp_ntz(F.date_format("InvoiceDate", "yyyy-MM-dd HH"), F.lit("yyyy-MM-dd HH"))
    cells = lines.where(F.col("Description").isNotNull()).withColumn("_hour", hour)
    cells = cells.groupBy("Description", "Country", "Month", F.col("_hour").alias("InvoiceDate"), (F.col("InvoiceDate") == F.col("_hour")).alias("OnHour"))
    return cells.agg(F.sum("Quantity").alias("Quantity"))


def write_summary(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Summarise cleaned lines under ``path``; ``mode="append"`` adds the cells of new lines."""
    write_clean_sales(order_cells(lines), f"{path.rstrip('/')}/orders", mode)
    write_clean_sales(product_cells(lines), f"{path.rstrip('/')}/products", mode)


def read_summary(spark: SparkSession, path: str) -> Summary:
    return Summary(*[read_clean_sales(spark, f"{path.rstrip('/')}/{name}") for name in ("orders", "products")])


def _full_hour(bound: str | None) -> bool:
    """Whether a date bound falls on a full hour."""
    if not bound:
        return True
    at = datetime.fromisoformat(str(bound))
    return not (at.minute or at.second or at.microsecond)


def _products(summary: Summary, spec: FL.FilterSpec) -> DataFrame:
    """The product cells of the countries and dates of ``spec``, whose bounds are full hours."""
    out = FL.filter_country(summary.products, spec.countries)
    if spec.dates_need_both and not (spec.start and spec.end):
        return out
    out = FL.filter_dates(out, spec.start, spec.end, month_col="Month" if spec.month_pruning else None)
    if spec.end:  # the cell that starts at the end also holds later lines, unless they are exactly on the hour
        out = out.where((F.col("InvoiceDate") < F.lit(str(spec.end)).cast("timestamp_ntz")) | F.col("OnHour"))
    return out


def refresh(summary: Summary, customers: DataFrame | None, spec: FL.FilterSpec, cap: float = M.DEFAULT_CAP, top_n: int = 10,
            lines: DataFrame | None = None) -> dict:
    """The tables of :func:`basketry.plans.dashboard.dashboard` for one filter change, from the summary.

    ``lines`` is read for the product ranking alone, and only where the product cells can't tell (see above); without it that
    table is then absent.
    """
    cells = FL.apply_filters(summary.orders, customers, spec)
    from_cells = not spec.segment and not spec.basket and _full_hour(spec.start) and _full_hour(spec.end)
    products = _products(summary, spec) if from_cells else None if lines is None else FL.apply_filters(lines, customers, spec)
    out = get_metrics(cells, cap, top_n, weight="Lines", products=summary.products if products is None else products)
    if products is None:
        del out["top_products"]
    if customers is not None:
        remaining = FL.customers_in(customers, cells)
        out["rule_segments"] = R.segment_counts(remaining, "Segment")
        if "KMSegment" in customers.columns:
            out["km_segments"] = R.segment_counts(remaining, "KMSegment")
    return out
