"""Dashboard filters (F1-F6, F9) and the semi joins behind them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.metrics import order_totals

BANDS = ("Small", "Medium", "Large")


def filter_country(df: DataFrame, countries) -> DataFrame:
    """Country in the list; a single string is promoted to a list; empty means no filter."""
    if not countries:
        return df
    if isinstance(countries, str):
        countries = [countries]
    return df.where(F.col("Country").isin(list(countries)))


def _ts_literal(value):
    if isinstance(value, (datetime, date)):
        value = value.isoformat(sep=" ") if isinstance(value, datetime) else value.isoformat()
    return F.to_timestamp_ntz(F.lit(str(value)))


def filter_dates(df: DataFrame, start=None, end=None, ts: str = "InvoiceDate", month_col: str | None = None) -> DataFrame:
    """inclusive date range, each bound optional.

    A bare end date means midnight, so later times on that day are excluded (as in the source).
    The bounds are literals, so the predicate reaches the parquet scan when ``ts`` is a column
    of the table. With ``month_col`` (a ``yyyy-MM`` column derived from ``ts``, as ``clean_sales``
    derives Month) the implied month range is added too, so a table partitioned by month is
    pruned to the folders in range; the result is unchanged.
    """
    if start:
        df = df.where(F.col(ts) >= _ts_literal(start))
        if month_col:
            df = df.where(F.col(month_col) >= F.date_format(_ts_literal(start), "yyyy-MM"))
    if end:
        df = df.where(F.col(ts) <= _ts_literal(end))
        if month_col:
            df = df.where(F.col(month_col) <= F.date_format(_ts_literal(end), "yyyy-MM"))
    return df


def filter_segment(df: DataFrame, rfm: DataFrame, value, by: str = "KMSegment") -> DataFrame:
    """F3 + J1: lines whose customer is in segment ``value`` of column ``by`` (left semi join).

    The customer table grows with the data, so the join strategy is left to AQE's size check
    (broadcast when small, shuffled semi join otherwise).
    """
    if not value:
        return df
    members = rfm.where(F.col(by) == value).select("CustomerID")
    return df.join(members, "CustomerID", "left_semi")


def band_of(value, edges=(50.0, 200.0), medium_upper_inclusive: bool = False):
    """Band name for a basket-value column; anything not Small or Medium is Large."""
    lo, hi = edges
    medium_top = (value <= hi) if medium_upper_inclusive else (value < hi)
    return F.when(value < lo, "Small").when((value >= lo) & medium_top, "Medium").otherwise("Large")


def filter_basket(
    df: DataFrame,
    band,
    edges=(50.0, 200.0),
    medium_upper_inclusive: bool = False,
    totals_from: DataFrame | None = None,
) -> DataFrame:
    """F4/F5 + J2: lines of orders whose basket total falls in ``band``.

    Variant B (default): totals over ``df`` itself, Small < 50, Medium [50, 200), Large >= 200.
    Variant A: ``edges=(20, 100)``, ``medium_upper_inclusive=True`` and ``totals_from`` = the
    unfiltered table. Totals are a partially aggregated group-by; the lines keep their rows
    through a left semi join on InvoiceNo.
    """
    if not band:
        return df
    source = df if totals_from is None else totals_from
    totals = order_totals(source).where(F.col("InvoiceNo").isNotNull())
    lo, hi = edges
    v = F.col("BasketValue")
    if band == "Small":
        cond = v < lo
    elif band == "Medium":
        cond = (v >= lo) & ((v <= hi) if medium_upper_inclusive else (v < hi))
    else:
        cond = (v > hi) if medium_upper_inclusive else (v >= hi)
    return df.join(totals.where(cond).select("InvoiceNo"), "InvoiceNo", "left_semi")


# The basket edges 50 / 200, and 20 / 100 of the overview panel.
@dataclass(frozen=True)
class FilterSpec:
    """Filter state of the dashboard; the defaults reproduce the later ('master') callback."""

    countries: list | str | None = None
    start: str | None = None
    end: str | None = None
    segment: str | None = None
    segment_by: str = "KMSegment"
    basket: str | None = None
    basket_edges: tuple = (50.0, 200.0)
    medium_upper_inclusive: bool = False
    basket_totals_from_unfiltered: bool = False
    month_pruning: bool = False  # add the Month range implied by the dates (Month derived from InvoiceDate)
    dates_need_both: bool = False  # the overview panel filters dates only when both bounds are set

    @classmethod
    def overview(cls, countries=None, start=None, end=None, segment=None, basket=None) -> "FilterSpec":
        """The overview panel's variant: k-means segment, bands 20 / 100 (Medium inclusive) over the
        unfiltered table's basket totals, and a date range only when both ends are given."""
        return cls(countries=countries, start=start, end=end, segment=segment, segment_by="KMSegment",
                   basket=basket, basket_edges=(20.0, 100.0), medium_upper_inclusive=True,
                   basket_totals_from_unfiltered=True, dates_need_both=True)


def apply_filters(df: DataFrame, rfm: DataFrame | None, spec: FilterSpec) -> DataFrame:
    """country, dates, segment, basket — in that order (it matters for basket variant B)."""
    unfiltered = df
    out = filter_country(df, spec.countries)
    if not spec.dates_need_both or (spec.start and spec.end):
        out = filter_dates(out, spec.start, spec.end, month_col="Month" if spec.month_pruning else None)
    if spec.segment:
        if rfm is None:
            raise ValueError("a segment filter needs the customer table")
        out = filter_segment(out, rfm, spec.segment, spec.segment_by)
    out = filter_basket(
        out,
        spec.basket,
        spec.basket_edges,
        spec.medium_upper_inclusive,
        unfiltered if spec.basket_totals_from_unfiltered else None,
    )
    return out


def customers_in(rfm: DataFrame, lines: DataFrame) -> DataFrame:
    """J3 + X2: customer rows for the customers that remain in ``lines`` (left semi join).

    The probe side is the distinct customers of ``lines`` (partially aggregated map-side), so a
    customer owning a large share of the lines is one row on the join's buffered side.
    """
    remaining = lines.where(F.col("CustomerID").isNotNull()).select("CustomerID").distinct()
    return rfm.join(remaining, "CustomerID", "left_semi")


def customer_profile(rfm: DataFrame, customer_id) -> DataFrame:
    """point lookup by customer id, compared as a number; no match (also any fractional id) gives an empty result."""
    value = float(customer_id)
    return rfm.where(F.col("CustomerID") == F.lit(int(value)) if value.is_integer() else F.lit(False))
