"""Sales metrics over cleaned order lines.

Every function takes a cleaned line table and returns a lazy DataFrame. Group keys that may be
null are filtered first (pandas drops null keys, Spark keeps them). Top-k results break ties by
key ascending and are planned as TakeOrderedAndProject: each task keeps its own k best rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.columns import WEEKDAYS, money_k, money_units, thousands

# The basket cap and the share of the largest cell that the heatmap's colours end at.
DEFAULT_CAP = 1000.0
CEILING = 0.85


def _line_count(weight: str | None):
    """Lines of a group: its rows, or the sum of a column that says how many lines a row stands for."""
    return F.count(F.lit(1)) if weight is None else F.sum(weight).cast("long")


def _rank(df: DataFrame, *order) -> DataFrame:
    """1..k over an already limited top-k (a handful of rows, so one window task is fine)."""
    return df.withColumn("Rank", F.row_number().over(Window.orderBy(*order)))


def order_totals(df: DataFrame) -> DataFrame:
    """Sum of TotalPrice per InvoiceNo, null invoice kept as its own group.

    Partial aggregation runs before the shuffle, so a hot invoice costs one row per task.
    """
    return df.groupBy("InvoiceNo").agg(F.coalesce(F.sum("TotalPrice"), F.lit(0.0)).alias("BasketValue"))


def basket_values(df: DataFrame, cap: float | None = DEFAULT_CAP) -> DataFrame:
    """A4 + F7: basket value per order, keeping totals strictly below ``cap``."""
    b = order_totals(df).where(F.col("InvoiceNo").isNotNull())
    return b if cap is None else b.where(F.col("BasketValue") < cap)


def cap_baskets(baskets: DataFrame, cap: float = DEFAULT_CAP) -> DataFrame:
    """outlier cap on a basket table."""
    return baskets.where(F.col("BasketValue") < cap)


def kpis(df: DataFrame, cap: float | None = DEFAULT_CAP) -> DataFrame:
    """A1-A3, A5, F8: one row of headline numbers, zeros for an empty input.

    The lines are aggregated once to (invoice, customer). Both second-level aggregates consume
    that node whole — revenue and customers from the per-customer branch, orders and the capped
    average from the per-order branch — so its exchange is reused and the input is read, joined
    and de-duplicated once. A UNION ALL feeds one global aggregate: no join, no Expand.
    """
    pairs = df.groupBy("InvoiceNo", "CustomerID").agg(F.sum("TotalPrice").alias("v"))
    no_double = F.lit(None).cast("double")
    zero = F.lit(0).cast("long")
    per_order = pairs.groupBy("InvoiceNo").agg(F.sum("v").alias("ov")).select(
        F.col("ov"), F.col("InvoiceNo").isNotNull().cast("long").alias("is_order"),
        no_double.alias("cv"), zero.alias("is_customer"))
    per_customer = pairs.groupBy("CustomerID").agg(F.sum("v").alias("cv")).select(
        no_double.alias("ov"), zero.alias("is_order"),
        F.col("cv"), F.col("CustomerID").isNotNull().cast("long").alias("is_customer"))
    capped = (F.col("is_order") == 1) & ((F.col("ov") < cap) if cap is not None else F.lit(True))
    return per_order.unionByName(per_customer).agg(
        F.coalesce(F.sum("cv"), F.lit(0.0)).alias("total_revenue"),
        F.coalesce(F.sum("is_order"), F.lit(0)).cast("long").alias("total_orders"),
        F.coalesce(F.sum("is_customer"), F.lit(0)).cast("long").alias("customer_count"),
        F.coalesce(F.bround(F.avg(F.when(capped, F.col("ov"))), 0), F.lit(0.0)).alias("avg_order_value"),
    )


def kpi_text(k: DataFrame) -> DataFrame:
    """E5: the four KPI strings ('£x.xK', '1,234', '1,234', '£x')."""
    return k.select(
        money_k(F.col("total_revenue")).alias("revenue_text"),
        thousands(F.col("total_orders")).alias("orders_text"),
        thousands(F.col("customer_count")).alias("customers_text"),
        money_units(F.col("avg_order_value")).alias("avg_text"),
    )


def overview_kpi_text(df: DataFrame) -> DataFrame:
    """E5 + A6: the overview panel's KPI strings, whose average order is over all orders (no cap).

    The same single-pass aggregate as :func:`kpis` with the cap switched off.
    """
    return kpi_text(kpis(df, None))


def avg_order_uncapped(df: DataFrame) -> DataFrame:
    """Mean basket value over all orders, no cap; 0 when there is no order."""
    b = order_totals(df).where(F.col("InvoiceNo").isNotNull())
    return b.agg(F.coalesce(F.avg("BasketValue"), F.lit(0.0)).alias("avg_order_value"))


def purchase_frequency(df: DataFrame) -> DataFrame:
    """Distinct orders per customer.

    Two-level aggregation (customer, invoice) then customer: the first shuffle spreads a hot
    customer's invoices over many tasks and the second moves one row per task per customer.
    """
    pairs = df.where(F.col("CustomerID").isNotNull()).select("CustomerID", "InvoiceNo").distinct()
    return pairs.groupBy("CustomerID").agg(F.count("InvoiceNo").alias("PurchaseCount"))


def monthly_revenue(df: DataFrame) -> DataFrame:
    """A8 + T1: revenue per month, ascending."""
    return (
        df.where(F.col("Month").isNotNull())
        .groupBy("Month")
        .agg(F.coalesce(F.sum("TotalPrice"), F.lit(0.0)).alias("Revenue"))
        .orderBy("Month")
    )


def peak_month(df: DataFrame) -> DataFrame:
    """A9 + T5: the month with the highest revenue, the earliest on ties."""
    return monthly_revenue(df).orderBy(F.desc("Revenue"), F.asc("Month")).limit(1)


def month_labels(monthly: DataFrame) -> DataFrame:
    """E6: '£xK' point label per month."""
    return monthly.withColumn("Label", money_k(F.col("Revenue"), 0))


def top_countries(df: DataFrame, n: int = 10, weight: str | None = None) -> DataFrame:
    """A10 + E1: lines per country (named OrderCount, as in the source: it counts lines)."""
    top = (
        df.where(F.col("Country").isNotNull())
        .groupBy("Country")
        .agg(_line_count(weight).alias("OrderCount"))
        .orderBy(F.desc("OrderCount"), F.asc("Country"))
        .limit(n)
    )
    return top.withColumn("LogOrders", F.log1p("OrderCount"))


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """Units per product, top ``n`` with rank; lines without a name are ignored."""
    top = (
        df.where(F.col("Description").isNotNull())
        .groupBy(F.col("Description").alias("ProductName"))
        .agg(F.sum("Quantity").alias("UnitsSold"))
        .orderBy(F.desc("UnitsSold"), F.asc("ProductName"))
        .limit(n)
    )
    return _rank(top, F.desc("UnitsSold"), F.asc("ProductName"))


def top_customers(df: DataFrame, n: int = 10) -> DataFrame:
    """Revenue per customer, top ``n`` with rank; the id is shown as a string."""
    top = (
        df.where(F.col("CustomerID").isNotNull())
        .groupBy("CustomerID")
        .agg(F.sum("TotalPrice").alias("Revenue"))
        .orderBy(F.desc("Revenue"), F.asc("CustomerID"))
        .limit(n)
    )
    ranked = _rank(top, F.desc("Revenue"), F.asc("CustomerID"))
    return ranked.select(F.col("CustomerID").cast("string").alias("CustomerID"), "Revenue", "Rank")


def sales_heatmap(df: DataFrame, weight: str | None = None) -> DataFrame:
    """A13 + J6: lines per weekday × hour, every weekday × every observed hour, missing = 0.

    One pass over the lines: they are counted per (weekday, hour), the unknown weekday included,
    so hours seen only on such lines still get a row. Per hour, the at most seven weekday counts
    become a small map, and the seven-day grid is generated from it: no join, no second read.
    """
    cells = (
        df.where(F.col("Hour").isNotNull())
        .groupBy("Hour", "day_idx")
        .agg(_line_count(weight).alias("n"))
    )
    known = F.when(F.col("day_idx").isNotNull(), F.struct(F.col("day_idx"), F.col("n")))
    per_hour = cells.groupBy("Hour").agg(F.map_from_entries(F.collect_list(known)).alias("m"))
    names = F.array(*[F.lit(d) for d in WEEKDAYS])
    return (
        per_hour.select("Hour", "m", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_idx"))
        .select(
            F.element_at(names, F.col("day_idx") + 1).alias("Day"),
            "day_idx",
            "Hour",
            F.coalesce(F.try_element_at(F.col("m"), F.col("day_idx")), F.lit(0)).cast("long").alias("Orders"),
        )
        .orderBy("day_idx", "Hour")
    )


def sales_heatmap_wide(df: DataFrame) -> DataFrame:
    """Weekday rows Monday..Sunday × one column per hour (``h0`` .. ``h23``; 0 for an hour not observed)."""
    return heatmap_wide_from_long(sales_heatmap(df))


def heatmap_wide_from_long(long: DataFrame) -> DataFrame:
    """A14 from an already computed long heatmap (at most 168 rows)."""
    hours = list(range(24))  # given, so that no job is needed to find them
    wide = long.groupBy("day_idx", "Day").pivot("Hour", hours).agg(F.first("Orders"))
    return wide.select(
        "Day", "day_idx", *[F.coalesce(F.col(f"`{h}`"), F.lit(0)).cast("long").alias(f"h{h}") for h in hours]
    ).orderBy("day_idx")


def heatmap_ceiling(df: DataFrame, factor: float = CEILING) -> DataFrame:
    """Colour ceiling = factor × largest cell."""
    return ceiling_from_long(sales_heatmap(df), factor)


def ceiling_from_long(long: DataFrame, factor: float = CEILING) -> DataFrame:
    """A15 from an already computed long heatmap."""
    return long.agg((F.max("Orders") * factor).alias("zmax"))


def basket_shape(df: DataFrame, cap: float | None = DEFAULT_CAP) -> DataFrame:
    """Population skewness and excess kurtosis of capped basket values, 2 dp."""
    return basket_values(df, cap).agg(
        F.bround(F.skewness("BasketValue"), 2).alias("skewness"),
        F.bround(F.kurtosis("BasketValue"), 2).alias("kurtosis"),
    )


def histogram(df: DataFrame, col: str, nbins: int = 50) -> DataFrame:
    """Equal-width histogram with a readable bin width and at most ``nbins`` bins.

    Rule: raw width = (max - min) / nbins, rounded up to 1, 2 or 5 × 10^k; bins start on
    multiples of that width; if the aligned bins then number more than ``nbins``, the next
    readable width is used (one step is always enough for nbins >= 4). Only the global min/max
    travel, as one scalar subquery; the binning itself is a map-side-combined ``groupBy``.
    """
    if nbins < 4:
        raise ValueError("nbins must be at least 4")
    stats = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    raw = (F.col("hi") - F.col("lo")) / nbins
    raw = F.when(raw.isNull() | (raw <= 0), F.lit(1.0)).otherwise(raw)
    mag = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    ratio = raw / mag
    step = F.when(ratio <= 1, 1.0).when(ratio <= 2, 2.0).when(ratio <= 5, 5.0).otherwise(10.0)
    bigger = F.when(step == 1.0, 2.0).when(step == 2.0, 5.0).when(step == 5.0, 10.0).otherwise(20.0)
    w1, w2 = step * mag, bigger * mag
    count1 = F.floor(F.col("hi") / w1) - F.floor(F.col("lo") / w1) + 1
    width = stats.select(F.when(count1 > nbins, w2).otherwise(w1).alias("w")).scalar()
    v = F.col(col).cast("double")
    return (
        df.where(F.col(col).isNotNull())
        .withColumn("w", width)  # one subquery instance, referenced by column
        .select(F.floor(v / F.col("w")).alias("bin"), "w")
        .groupBy("bin", "w")
        .agg(F.count(F.lit(1)).alias("Count"))
        .select((F.col("bin") * F.col("w")).alias("bin_start"), ((F.col("bin") + 1) * F.col("w")).alias("bin_end"),
                "Count")
        .orderBy("bin_start")
    )


def date_bounds(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Earliest and latest order time, for the date filter."""
    return df.agg(F.min(ts).alias("min_date"), F.max(ts).alias("max_date"))


def countries(df: DataFrame) -> DataFrame:
    """Sorted distinct countries, for the country filter."""
    return df.where(F.col("Country").isNotNull()).select("Country").distinct().orderBy("Country")


def share_of_total(counts: DataFrame, count_col: str = "Count", decimals: int = 1) -> DataFrame:
    """Percentage share of a few grouped rows (one window over the grouped result only),
    rounded half to even like the percentage labels it replaces (1/16 = 6.25% shows 6.2)."""
    total = F.sum(count_col).over(Window.partitionBy())
    return counts.withColumn("Share", F.bround(F.col(count_col) * 100.0 / total, decimals))
