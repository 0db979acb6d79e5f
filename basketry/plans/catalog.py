"""Registered queries: one Spark callable per operator, with its DuckDB oracle where SQL can say it.

Every callable takes ``(spark, sf_dir)``, reads the whole tables of that folder and returns a lazy
DataFrame. Column names match the oracle exactly. Parameters that differ from the defaults are
data-driven: the TPC-H-like order totals all exceed 1,000, so the sales_lines queries pass
cap 200,000 and basket edges (100,000, 250,000) — see FIXTURES.md.

Adding a query: decorate a ``(spark, sf_dir) -> DataFrame`` function with ``@register(name, sql)``.
Build the SQL from the CTE helpers in ``oracle_sql`` (``with_sales``, ``with_events``, ``with_dirty``,
``with_sales_rfm``), alias every column identically on both sides, and round floats the same
way. Leave ``sql`` out only when the result depends on a fitted model (rows-only check). Then run
``python scripts/oracle_check.py /root/testdata/sf0.01 <name>``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators import clean as C
from basketry.operators import filters as FL
from basketry.operators import metrics as M
from basketry.operators import rfm as R
from basketry.plans import oracle_sql as S
from basketry.sources import adapters

LINES_CAP = 200_000.0
LINES_EDGES = (100_000.0, 250_000.0)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_sales(adapters.sales_lines(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_sales(adapters.event_sales(spark, sf_dir))


def dirty_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_sales(adapters.dirty_lines(spark, sf_dir))


def r2(col: str, alias: str | None = None, d: int = 2):
    """Rounded float column for a stable value hash (same rounding rule as DuckDB's round)."""
    return F.round(col, d).alias(alias or col)


# --- 2.1 / 2.2 sources and cleaning --------------------------------------------------------

@register("sales_lines", S.with_sales("SELECT InvoiceNo, Description, Quantity, InvoiceDate, UnitPrice, "
                                      "CustomerID, Country, TotalPrice FROM sales_lines"))
def q_sales_lines(spark, sf):
    return adapters.sales_lines(spark, sf)


@register("event_sales", S.with_events("SELECT * FROM event_sales"))
def q_event_sales(spark, sf):
    return adapters.event_sales(spark, sf)


@register("dirty_lines", S.with_dirty("SELECT InvoiceNo, Description, Quantity, InvoiceDate, UnitPrice, "
                                      "CustomerID, Country FROM dirty_lines"))
def q_dirty_lines(spark, sf):
    return adapters.dirty_lines(spark, sf)


@register("drop_missing_customer", S.with_dirty("SELECT count(*) AS n_rows, count(DISTINCT InvoiceNo) AS n_orders "
                                                "FROM dirty_lines WHERE CustomerID IS NOT NULL"))
def q_drop_missing_customer(spark, sf):
    df = C.drop_missing_customer(adapters.dirty_lines(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("InvoiceNo").alias("n_orders"))


@register("drop_dup_rows", S.with_dirty("SELECT count(*) AS n_rows FROM (SELECT DISTINCT * FROM dirty_lines) d"))
def q_drop_dup_rows(spark, sf):
    return C.drop_dup_rows(adapters.dirty_lines(spark, sf)).agg(F.count(F.lit(1)).alias("n_rows"))


@register("valid_orders", S.with_dirty("SELECT count(*) AS n_rows, round(sum(Quantity * UnitPrice), 2) AS value "
                                       "FROM dirty_lines WHERE Quantity > 0 AND UnitPrice > 0"))
def q_valid_orders(spark, sf):
    df = C.valid_orders(adapters.dirty_lines(spark, sf))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(F.col("Quantity") * F.col("UnitPrice")), 2).alias("value"))


@register("clean_sales", S.with_dirty("SELECT * FROM sales"))
def q_clean_sales(spark, sf):
    return dirty_clean(spark, sf)


@register("derived_columns", S.with_events("SELECT InvoiceNo, Month, Hour, Day, day_idx FROM sales"))
def q_derived_columns(spark, sf):
    return events(spark, sf).select("InvoiceNo", "Month", "Hour", "Day", "day_idx")


@register("shape", S.with_dirty("SELECT count(*) AS \"rows\", 12 AS \"columns\" FROM sales"))
def q_shape(spark, sf):
    from basketry.sources.csv import shape

    return shape(dirty_clean(spark, sf)).select("rows", F.col("columns").cast("int").alias("columns"))


def _as_csv(spark, df) -> str:
    """The table as CSV files in the checkpoint folder, quotes doubled."""
    from basketry.session import table_path

    path = table_path(spark, f"csv-{uuid.uuid4().hex}")
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@register("csv_sales", S.with_sales(
    """SELECT CAST(InvoiceNo AS VARCHAR) AS InvoiceNo, '"' || Description || '", RED' AS Description, Quantity,
       CustomerID, Country, round(TotalPrice, 2) AS TotalPrice, Month, strftime(InvoiceDate, '%Y-%m-%d') AS order_day FROM sales"""))
def q_csv_sales(spark, sf):
    """S1 + P1 + P11: the sales lines through CSV files, with quotes and commas in names and M/d/yyyy dates."""
    from basketry.sources.csv import read_sales_csv

    out = adapters.sales_lines(spark, sf).withColumns({
        "Description": F.concat(F.lit('"'), "Description", F.lit('", RED')),
        "InvoiceDate": F.date_format("InvoiceDate", "M/d/yyyy H:mm"),
        "CustomerID": F.col("CustomerID").cast("double"),
    })
    lines = C.clean_sales(read_sales_csv(spark, _as_csv(spark, out)))
    return lines.select("InvoiceNo", "Description", "Quantity", "CustomerID", "Country", r2("TotalPrice"), "Month",
                        F.date_format("InvoiceDate", "yyyy-MM-dd").alias("order_day"))


@register("csv_profile_trend", "SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'NaT' ELSE strftime(o_orderdate, '%Y-%m') END AS upload_month, "
                               "round(coalesce(sum(o_totalprice), 0), 2) AS amount FROM orders GROUP BY 1")
def q_csv_profile_trend(spark, sf):
    """S2 + E10 + U2: a user's CSV with some dates that are none."""
    from basketry.operators import profile
    from basketry.sources.csv import read_user_csv
    from basketry.sources.tables import table

    day = F.when(F.col("o_orderkey") % 97 == 0, "no date").otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    orders = table(spark, sf, "orders").select(day.alias("order_date"), F.col("o_totalprice").alias("amount"))
    return profile.profile_trend(read_user_csv(spark, _as_csv(spark, orders))["data"]).select("upload_month", r2("amount"))


# --- 2.5 aggregations ---------------------------------------------------------------------

KPI_SQL = """SELECT round(coalesce(sum(TotalPrice), 0), 2) AS total_revenue,
       count(DISTINCT InvoiceNo) AS total_orders, count(DISTINCT CustomerID) AS customer_count,
       coalesce((SELECT round_even(avg(v), 0) FROM (SELECT sum(TotalPrice) AS v FROM {src} WHERE InvoiceNo IS NOT NULL
                 GROUP BY InvoiceNo) b WHERE v < {cap}), 0) AS avg_order_value
FROM {src}"""


def _kpis_rounded(df, cap):
    return M.kpis(df, cap).select(r2("total_revenue"), "total_orders", "customer_count", "avg_order_value")


@register("kpis", S.with_sales(KPI_SQL.format(src="sales", cap=LINES_CAP)))
def q_kpis(spark, sf):
    return _kpis_rounded(sales(spark, sf), LINES_CAP)


@register("kpis_events", S.with_events(KPI_SQL.format(src="sales", cap=1000)))
def q_kpis_events(spark, sf):
    return _kpis_rounded(events(spark, sf), 1000.0)


@register("kpis_dirty", S.with_dirty(KPI_SQL.format(src="sales", cap=1000)))
def q_kpis_dirty(spark, sf):
    return _kpis_rounded(dirty_clean(spark, sf), 1000.0)


@register("kpi_text", S.with_events(
    "SELECT '£' || printf('%.1f', round_even(sum(TotalPrice) / 1000, 1)) || 'K' AS revenue_text, "
    "printf('%,d', count(DISTINCT InvoiceNo)) AS orders_text, printf('%,d', count(DISTINCT CustomerID)) AS customers_text, "
    "'£' || printf('%.0f', coalesce((SELECT round_even(avg(v), 0) FROM (SELECT sum(TotalPrice) AS v FROM sales "
    "GROUP BY InvoiceNo) b WHERE v < 1000), 0)) AS avg_text FROM sales"))
def q_kpi_text(spark, sf):
    return M.kpi_text(M.kpis(events(spark, sf), 1000.0))


@register("kpi_text_overview", S.with_sales(
    "SELECT '£' || printf('%.1f', round_even(sum(TotalPrice) / 1000, 1)) || 'K' AS revenue_text, "
    "printf('%,d', count(DISTINCT InvoiceNo)) AS orders_text, printf('%,d', count(DISTINCT CustomerID)) AS customers_text, "
    "'£' || printf('%.0f', (SELECT round_even(avg(v), 0) FROM (SELECT sum(TotalPrice) AS v FROM sales "
    "GROUP BY InvoiceNo) b)) AS avg_text FROM sales"))
def q_kpi_text_overview(spark, sf):
    return M.overview_kpi_text(sales(spark, sf))


@register("kpis_empty", S.with_events(
    "SELECT '£' || printf('%.1f', coalesce(sum(TotalPrice), 0) / 1000) || 'K' AS revenue_text, "
    "printf('%,d', count(DISTINCT InvoiceNo)) AS orders_text, printf('%,d', count(DISTINCT CustomerID)) AS customers_text, "
    "'£' || printf('%.0f', coalesce((SELECT round_even(avg(v), 0) FROM (SELECT sum(TotalPrice) AS v FROM sales "
    "WHERE Country = 'no such country' GROUP BY InvoiceNo) b WHERE v < 1000), 0)) AS avg_text "
    "FROM sales WHERE Country = 'no such country'"))
def q_kpis_empty(spark, sf):
    return M.kpi_text(M.kpis(FL.filter_country(events(spark, sf), ["no such country"]), 1000.0))


@register("basket_values", S.with_sales(
    f"SELECT InvoiceNo, round(sum(TotalPrice), 2) AS BasketValue FROM sales GROUP BY InvoiceNo "
    f"HAVING sum(TotalPrice) < {LINES_CAP}"))
def q_basket_values(spark, sf):
    return M.basket_values(sales(spark, sf), LINES_CAP).select("InvoiceNo", r2("BasketValue"))


@register("cap_baskets", S.with_events(
    "SELECT InvoiceNo, round(sum(TotalPrice), 2) AS BasketValue FROM sales GROUP BY InvoiceNo HAVING sum(TotalPrice) < 1000"))
def q_cap_baskets(spark, sf):
    return M.cap_baskets(M.basket_values(events(spark, sf), None), 1000.0).select("InvoiceNo", r2("BasketValue"))


@register("avg_order_uncapped", S.with_sales(
    "SELECT round(coalesce(avg(v), 0), 2) AS avg_order_value FROM (SELECT sum(TotalPrice) AS v FROM sales GROUP BY InvoiceNo) b"))
def q_avg_order_uncapped(spark, sf):
    return M.avg_order_uncapped(sales(spark, sf)).select(r2("avg_order_value"))


@register("purchase_frequency", S.with_sales(
    "SELECT CustomerID, count(DISTINCT InvoiceNo) AS PurchaseCount FROM sales GROUP BY CustomerID"))
def q_purchase_frequency(spark, sf):
    return M.purchase_frequency(sales(spark, sf))


@register("monthly_revenue", S.with_sales(
    "SELECT Month, round(sum(TotalPrice), 2) AS Revenue FROM sales GROUP BY Month ORDER BY Month"))
def q_monthly_revenue(spark, sf):
    return M.monthly_revenue(sales(spark, sf)).select("Month", r2("Revenue"))


@register("monthly_revenue_labels", S.with_sales(
    "SELECT Month, '£' || printf('%.0f', round_even(sum(TotalPrice) / 1000, 0)) || 'K' AS Label "
    "FROM sales GROUP BY Month"))
def q_monthly_revenue_labels(spark, sf):
    return M.month_labels(M.monthly_revenue(sales(spark, sf))).select("Month", "Label")


@register("peak_month", S.with_sales(
    "SELECT Month, round(sum(TotalPrice), 2) AS Revenue FROM sales GROUP BY Month "
    "ORDER BY sum(TotalPrice) DESC, Month ASC LIMIT 1"))
def q_peak_month(spark, sf):
    return M.peak_month(sales(spark, sf)).select("Month", r2("Revenue"))


@register("top_countries", S.with_sales(
    "SELECT Country, count(*) AS OrderCount, round(ln(1 + count(*)), 6) AS LogOrders FROM sales "
    "WHERE Country IS NOT NULL GROUP BY Country ORDER BY OrderCount DESC, Country ASC LIMIT 10"))
def q_top_countries(spark, sf):
    return M.top_countries(sales(spark, sf)).select("Country", "OrderCount", r2("LogOrders", d=6))


TOP_PRODUCTS_SQL = """SELECT ProductName, round(UnitsSold, 2) AS UnitsSold,
       CAST(row_number() OVER (ORDER BY UnitsSold DESC, ProductName ASC) AS INTEGER) AS Rank
FROM (SELECT Description AS ProductName, sum(Quantity) AS UnitsSold FROM sales WHERE Description IS NOT NULL
      GROUP BY Description ORDER BY UnitsSold DESC, ProductName ASC LIMIT 10) t"""


@register("top_products", S.with_sales(TOP_PRODUCTS_SQL))
def q_top_products(spark, sf):
    return M.top_products(sales(spark, sf)).select("ProductName", r2("UnitsSold"), "Rank")


@register("top_products_dirty", S.with_dirty(TOP_PRODUCTS_SQL))
def q_top_products_dirty(spark, sf):
    return M.top_products(dirty_clean(spark, sf)).select("ProductName", r2("UnitsSold"), "Rank")


@register("top_customers", S.with_sales(
    """SELECT CAST(CustomerID AS VARCHAR) AS CustomerID, round(Revenue, 2) AS Revenue,
       CAST(row_number() OVER (ORDER BY Revenue DESC, CustomerID ASC) AS INTEGER) AS Rank
FROM (SELECT CustomerID, sum(TotalPrice) AS Revenue FROM sales GROUP BY CustomerID
      ORDER BY Revenue DESC, CustomerID ASC LIMIT 10) t"""))
def q_top_customers(spark, sf):
    return M.top_customers(sales(spark, sf)).select("CustomerID", r2("Revenue"), "Rank")


HEATMAP_SQL = """SELECT CASE g.d WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday' WHEN 3 THEN 'Thursday'
            WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday' ELSE 'Sunday' END AS Day,
       CAST(g.d AS INTEGER) AS day_idx, g.Hour, coalesce(c.n, 0) AS Orders
FROM (SELECT h.Hour, d.d FROM (SELECT DISTINCT Hour FROM sales WHERE Hour IS NOT NULL) h, range(7) d(d)) g
LEFT JOIN (SELECT day_idx, Hour, count(*) AS n FROM sales WHERE day_idx IS NOT NULL AND Hour IS NOT NULL
           GROUP BY day_idx, Hour) c ON c.day_idx = g.d AND c.Hour = g.Hour"""


@register("sales_heatmap", S.with_events(HEATMAP_SQL))
def q_sales_heatmap(spark, sf):
    return M.sales_heatmap(events(spark, sf))


@register("sales_heatmap_lines", S.with_sales(HEATMAP_SQL))
def q_sales_heatmap_lines(spark, sf):
    return M.sales_heatmap(sales(spark, sf))


@register("sales_heatmap_wide", S.with_events(
    "SELECT Day, day_idx, " + ", ".join(f"sum(CASE WHEN Hour = {h} THEN Orders ELSE 0 END) :: BIGINT AS h{h}" for h in range(24))
    + f" FROM ({HEATMAP_SQL}) l GROUP BY Day, day_idx"))
def q_sales_heatmap_wide(spark, sf):
    return M.sales_heatmap_wide(events(spark, sf))


@register("heatmap_ceiling", S.with_events(f"SELECT round(max(Orders) * 0.85, 6) AS zmax FROM ({HEATMAP_SQL}) l"))
def q_heatmap_ceiling(spark, sf):
    return M.heatmap_ceiling(events(spark, sf)).select(r2("zmax", d=6))


@register("basket_shape", S.with_events(
    """SELECT round_even(sk, 2) AS skewness, round_even(ku, 2) AS kurtosis FROM (
  SELECT avg(power(v - m, 3)) / power(avg(power(v - m, 2)), 1.5) AS sk, kurtosis_pop(v) AS ku
  FROM (SELECT v, avg(v) OVER () AS m FROM (SELECT sum(TotalPrice) AS v FROM sales GROUP BY InvoiceNo) b WHERE v < 1000) x) y"""))
def q_basket_shape(spark, sf):
    return M.basket_shape(events(spark, sf), 1000.0)


def _hist_sql(values_sql: str, nbins: int = 50) -> str:
    return f"""WITH hv AS ({values_sql}),
hs AS (SELECT min(x) AS lo, max(x) AS hi,
              CASE WHEN (max(x) - min(x)) / {nbins} IS NULL OR (max(x) - min(x)) / {nbins} <= 0 THEN 1.0
                   ELSE (max(x) - min(x)) / {nbins} END AS r FROM hv),
hm AS (SELECT lo, hi, power(10, floor(log10(r))) AS mag, r / power(10, floor(log10(r))) AS ratio FROM hs),
hn AS (SELECT lo, hi, mag, CASE WHEN ratio <= 1 THEN 1.0 WHEN ratio <= 2 THEN 2.0 WHEN ratio <= 5 THEN 5.0 ELSE 10.0 END AS st
       FROM hm),
hw AS (SELECT CASE WHEN floor(hi / (st * mag)) - floor(lo / (st * mag)) + 1 > {nbins}
                   THEN (CASE WHEN st = 1.0 THEN 2.0 WHEN st = 2.0 THEN 5.0 WHEN st = 5.0 THEN 10.0 ELSE 20.0 END) * mag
                   ELSE st * mag END AS w FROM hn)
SELECT bin * w AS bin_start, (bin + 1) * w AS bin_end, count(*) AS "Count"
FROM (SELECT floor(x / w) AS bin, w FROM hv, hw WHERE x IS NOT NULL) z
GROUP BY bin, w"""


@register("histogram_purchase_count", S.with_events(
    "SELECT * FROM (" + _hist_sql("SELECT CAST(count(DISTINCT InvoiceNo) AS DOUBLE) AS x FROM sales GROUP BY CustomerID")
    + ") h"))
def q_histogram_purchase_count(spark, sf):
    pf = M.purchase_frequency(events(spark, sf))
    return M.histogram(pf, "PurchaseCount")


@register("histogram_basket", S.with_events(
    "SELECT * FROM (" + _hist_sql("SELECT sum(TotalPrice) AS x FROM sales GROUP BY InvoiceNo HAVING sum(TotalPrice) < 1000")
    + ") h"))
def q_histogram_basket(spark, sf):
    return M.histogram(M.basket_values(events(spark, sf), 1000.0), "BasketValue")


@register("date_bounds", S.with_sales("SELECT min(InvoiceDate) AS min_date, max(InvoiceDate) AS max_date FROM sales"))
def q_date_bounds(spark, sf):
    return M.date_bounds(sales(spark, sf))


@register("countries", S.with_sales("SELECT DISTINCT Country FROM sales WHERE Country IS NOT NULL ORDER BY Country"))
def q_countries(spark, sf):
    return M.countries(sales(spark, sf))


# --- 2.10 customer analytics ----------------------------------------------------------------

def rfm_of(spark, sf):
    """Per-customer table (written once inside ``rfm``): quantiles, scaling and segments reuse it."""
    return R.rfm(sales(spark, sf))


def seg_of(spark, sf):
    return R.rule_segments(rfm_of(spark, sf))


def segments_from(lines):
    """Rule segments of a (materialised) line table; ``rfm`` writes the customer table once."""
    return R.rule_segments(R.rfm(lines))


_STORES: dict = {}


def sales_store(spark, sf):
    """The cleaned sales lines, written once per session and folder as a month-partitioned store that all
    dashboard queries read. ``release_all`` drops it with everything else the session wrote."""
    from basketry.session import table_path
    from basketry.sources.store import read_clean_sales, write_clean_sales

    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORES:
        for old in [k for k in _STORES if k[0] != key[0]]:
            del _STORES[old]
        path = table_path(spark, f"sales-{uuid.uuid4().hex}")
        write_clean_sales(sales(spark, sf), path)
        _STORES[key] = path
    return read_clean_sales(spark, _STORES[key])


def release_all(spark) -> None:
    """Drop all tables this session wrote, and forget the stores and fits that live in them."""
    from basketry.session import drop_materialized

    _STORES.clear()
    _FITTED.clear()
    drop_materialized(spark)


@register("rfm", S.with_sales_rfm("SELECT CustomerID, Recency, Frequency, round(Monetary, 2) AS Monetary FROM rfm"))
def q_rfm(spark, sf):
    return R.rfm(sales(spark, sf)).select("CustomerID", "Recency", "Frequency", r2("Monetary"))


@register("rfm_events", S.with_events_rfm("SELECT CustomerID, Recency, Frequency, round(Monetary, 2) AS Monetary FROM rfm"))
def q_rfm_events(spark, sf):
    return R.rfm(events(spark, sf)).select("CustomerID", "Recency", "Frequency", r2("Monetary"))


@register("rule_thresholds", S.with_sales_rfm(
    "SELECT round(quantile_cont(Monetary, 0.75), 4) AS monetary_q, round(quantile_cont(Frequency, 0.75), 4) AS frequency_q "
    "FROM rfm"))
def q_rule_thresholds(spark, sf):
    # An interpolated quartile of 2-decimal values has at most 4 decimals: round there, not at a tie.
    return R.rule_thresholds(rfm_of(spark, sf)).select(r2("monetary_q", d=4), r2("frequency_q", d=4))


@register("rule_segments", S.with_sales_rfm("SELECT CustomerID, Segment FROM seg"))
def q_rule_segments(spark, sf):
    return seg_of(spark, sf).select("CustomerID", "Segment")


@register("rule_segments_events", S.with_events_rfm("SELECT CustomerID, Segment FROM seg"))
def q_rule_segments_events(spark, sf):
    return R.rule_segments(R.rfm(events(spark, sf))).select("CustomerID", "Segment")


SEGMENT_COUNTS_SQL = """SELECT Segment, count(*) AS Count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS Share,
       row_number() OVER (ORDER BY count(*) ASC, Segment ASC) = 1 AS Smallest
FROM seg GROUP BY Segment"""


@register("segment_counts", S.with_sales_rfm(SEGMENT_COUNTS_SQL))
def q_segment_counts(spark, sf):
    return R.segment_counts(seg_of(spark, sf), "Segment")


_DESCRIBE_COLS = ("CustomerID", "Recency", "Frequency", "Monetary")


def _describe_sql() -> str:
    def part(stat, fn):
        d = 4 if "%" in stat else 2
        cols = ", ".join(f"round(CAST({fn.format(c=c)} AS DOUBLE), {d}) AS {c}" for c in _DESCRIBE_COLS)
        return f"SELECT '{stat}' AS stat, {cols} FROM rfm"

    parts = [part("count", "count({c})"), part("mean", "avg({c})"), part("std", "stddev_samp({c})"),
             part("min", "min({c})"), part("25%", "quantile_cont({c}, 0.25)"), part("50%", "quantile_cont({c}, 0.5)"),
             part("75%", "quantile_cont({c}, 0.75)"), part("max", "max({c})")]
    return S.with_sales_rfm(" UNION ALL ".join(parts))


@register("describe_rfm", _describe_sql())
def q_describe_rfm(spark, sf):
    d = R.describe_rfm(rfm_of(spark, sf), _DESCRIBE_COLS)
    quart = F.col("stat").endswith("%")
    return d.select("stat", *[F.when(quart, F.round(c, 4)).otherwise(F.round(c, 2)).alias(c) for c in _DESCRIBE_COLS])


def _profiles_sql() -> str:
    from basketry.functions.columns import ADVICE_LOOKUP, ADVICE_LOOKUP_DEFAULT

    return S.with_sales_rfm(
        f"SELECT CustomerID, Recency, Frequency, round_even(Monetary, 2) AS Monetary, Segment, {S.HEALTH} AS HealthScore, "
        f"{S.health_label(S.HEALTH)} AS HealthLabel, {S.advice_case('Segment', ADVICE_LOOKUP, ADVICE_LOOKUP_DEFAULT)} AS Advice "
        f"FROM seg")


@register("customer_profiles", _profiles_sql())
def q_customer_profiles(spark, sf):
    return R.customer_profiles(seg_of(spark, sf))


def _cards_sql() -> str:
    from basketry.functions.columns import ADVICE_LOOKUP, ADVICE_LOOKUP_DEFAULT

    return S.with_sales_rfm(
        "SELECT CAST(CustomerID AS VARCHAR) AS CustomerID, CAST(Recency AS VARCHAR) || 'd' AS RecencyText, "
        "CAST(Frequency AS VARCHAR) AS FrequencyText, '£' || format('{:,}', CAST(round_even(round_even(Monetary, 2), 0) AS BIGINT)) "
        f"AS MonetaryText, Segment, {S.advice_case('Segment', ADVICE_LOOKUP, ADVICE_LOOKUP_DEFAULT)} AS Advice FROM seg")


@register("customer_cards", _cards_sql())
def q_customer_cards(spark, sf):
    return R.customer_cards(seg_of(spark, sf))


@register("customer_lookup", S.with_sales_rfm(
    "SELECT CustomerID, Recency, Frequency, round(Monetary, 2) AS Monetary, Segment FROM seg WHERE CustomerID = 7"))
def q_customer_lookup(spark, sf):
    return FL.customer_profile(seg_of(spark, sf), 7).select("CustomerID", "Recency", "Frequency", r2("Monetary"), "Segment")


@register("health_scores", S.with_events_rfm(
    f"SELECT CustomerID, {S.HEALTH} AS HealthScore, {S.health_label(S.HEALTH)} AS HealthLabel FROM rfm"))
def q_health_scores(spark, sf):
    from basketry.functions.columns import health_label, health_score

    df = R.rfm(events(spark, sf))
    s = health_score(F.col("Recency"), F.col("Frequency"), F.col("Monetary"))
    return df.select("CustomerID", s.alias("HealthScore"), health_label(s).alias("HealthLabel"))


# --- 2.3 / 2.4 filters and semi joins ----------------------------------------------------------

_LINE_COLS = "InvoiceNo, Description, Quantity, InvoiceDate, CustomerID, Country, TotalPrice"
_SOME_NATIONS = ["NATION_1", "NATION_7", "NATION_13"]


def _lines(df):
    return df.select(*_LINE_COLS.split(", "))


@register("filter_country", S.with_sales(
    f"SELECT {_LINE_COLS} FROM sales WHERE Country IN ('NATION_1', 'NATION_7', 'NATION_13')"))
def q_filter_country(spark, sf):
    return _lines(FL.filter_country(sales(spark, sf), _SOME_NATIONS))


@register("filter_dates", S.with_sales(
    f"SELECT {_LINE_COLS} FROM sales WHERE InvoiceDate >= TIMESTAMP '1996-01-01' AND InvoiceDate <= TIMESTAMP '1997-06-30'"))
def q_filter_dates(spark, sf):
    return _lines(FL.filter_dates(sales(spark, sf), "1996-01-01", "1997-06-30"))


@register("filter_dates_events", S.with_events(
    f"SELECT {_LINE_COLS} FROM sales WHERE InvoiceDate >= TIMESTAMP '2024-01-10' AND InvoiceDate <= TIMESTAMP '2024-01-20'"))
def q_filter_dates_events(spark, sf):
    return _lines(FL.filter_dates(events(spark, sf), "2024-01-10", "2024-01-20"))


@register("filter_segment", S.with_sales_rfm(
    f"SELECT {_LINE_COLS} FROM sales WHERE CustomerID IN (SELECT CustomerID FROM seg WHERE Segment = 'Loyal')"))
def q_filter_segment(spark, sf):
    df = sales_store(spark, sf)
    return _lines(FL.filter_segment(df, segments_from(df), "Loyal", by="Segment"))


@register("filter_basket_a", S.with_sales(
    f"SELECT {_LINE_COLS} FROM sales WHERE InvoiceNo IN (SELECT InvoiceNo FROM sales GROUP BY InvoiceNo "
    f"HAVING sum(TotalPrice) >= {LINES_EDGES[0]} AND sum(TotalPrice) <= {LINES_EDGES[1]})"))
def q_filter_basket_a(spark, sf):
    df = sales(spark, sf)
    return _lines(FL.filter_basket(df, "Medium", LINES_EDGES, medium_upper_inclusive=True, totals_from=df))


@register("filter_basket_b", S.with_events(
    f"SELECT {_LINE_COLS} FROM sales WHERE InvoiceNo IN (SELECT InvoiceNo FROM sales GROUP BY InvoiceNo "
    f"HAVING sum(TotalPrice) >= 200)"))
def q_filter_basket_b(spark, sf):
    return _lines(FL.filter_basket(events(spark, sf), "Large"))


ORDER_BUCKETS = 8


def _order_store(spark, sf):
    """All events as a table bucketed by order, written once per session and folder."""
    from basketry.session import table_path
    from basketry.sources.store import read_order_store, write_order_store

    key = (spark.sparkContext.applicationId, sf, "orders")
    if key not in _STORES:
        path = table_path(spark, f"orders-{uuid.uuid4().hex}")
        write_order_store(events(spark, sf), path, ORDER_BUCKETS)
        _STORES[key] = path
    return read_order_store(spark, _STORES[key], ORDER_BUCKETS)


@register("filter_basket_bucketed", S.with_events(
    f"SELECT {_LINE_COLS} FROM sales WHERE Country IN ('purchase', 'view') AND InvoiceNo IN "
    f"(SELECT InvoiceNo FROM sales GROUP BY InvoiceNo HAVING sum(TotalPrice) >= 20 AND sum(TotalPrice) <= 100)"))
def q_filter_basket_bucketed(spark, sf):
    """F4 + J2 on the bucketed store: neither the totals nor the semi join move a line."""
    lines = _order_store(spark, sf)
    some = FL.filter_country(lines, ["purchase", "view"])
    return _lines(FL.filter_basket(some, "Medium", (20.0, 100.0), True, lines))


@register("basket_band_counts", S.with_events(
    "SELECT CASE WHEN v < 20 THEN 'Small' WHEN v >= 20 AND v <= 100 THEN 'Medium' ELSE 'Large' END AS band, "
    "count(*) AS orders FROM (SELECT InvoiceNo, sum(TotalPrice) AS v FROM sales GROUP BY InvoiceNo) b GROUP BY band"))
def q_basket_band_counts(spark, sf):
    b = M.basket_values(events(spark, sf), None)
    return b.groupBy(FL.band_of(F.col("BasketValue"), (20.0, 100.0), True).alias("band")).agg(
        F.count(F.lit(1)).alias("orders"))


_SPEC = FL.FilterSpec(countries=["NATION_2", "NATION_3", "NATION_5", "NATION_8", "NATION_21"], start="1996-01-01",
                      end="2000-12-31", segment="Low Value", segment_by="Segment", basket="Medium",
                      basket_edges=LINES_EDGES, month_pruning=True)
_SPEC_SQL = f"""filtered0 AS (
  SELECT * FROM sales WHERE Country IN ('NATION_2', 'NATION_3', 'NATION_5', 'NATION_8', 'NATION_21')
    AND InvoiceDate >= TIMESTAMP '1996-01-01' AND InvoiceDate <= TIMESTAMP '2000-12-31'
    AND CustomerID IN (SELECT CustomerID FROM seg WHERE Segment = 'Low Value')),
filtered AS (
  SELECT * FROM filtered0 WHERE InvoiceNo IN (SELECT InvoiceNo FROM filtered0 GROUP BY InvoiceNo
    HAVING sum(TotalPrice) >= {LINES_EDGES[0]} AND sum(TotalPrice) < {LINES_EDGES[1]}))"""


def _filtered(spark, sf):
    df = sales_store(spark, sf)
    return FL.apply_filters(df, segments_from(df), _SPEC)


@register("apply_filters", S.with_sales_rfm(f", {_SPEC_SQL}\nSELECT {_LINE_COLS} FROM filtered"))
def q_apply_filters(spark, sf):
    return _lines(_filtered(spark, sf))


@register("dashboard_kpis", S.with_sales_rfm(
    f", {_SPEC_SQL}\n" + KPI_SQL.replace("{src}", "filtered").replace("{cap}", str(LINES_CAP))))
def q_dashboard_kpis(spark, sf):
    return _kpis_rounded(_filtered(spark, sf), LINES_CAP)


@register("dashboard_segments", S.with_sales_rfm(
    f", {_SPEC_SQL}\nSELECT Segment, count(*) AS Count, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS Share, "
    "row_number() OVER (ORDER BY count(*) ASC, Segment ASC) = 1 AS Smallest "
    "FROM seg WHERE CustomerID IN (SELECT CustomerID FROM filtered) GROUP BY Segment"))
def q_dashboard_segments(spark, sf):
    df = sales_store(spark, sf)
    seg = segments_from(df)
    return R.segment_counts(FL.customers_in(seg, FL.apply_filters(df, seg, _SPEC)), "Segment")


@register("customers_in_filter", S.with_sales_rfm(
    "SELECT CustomerID, Recency, Frequency, round(Monetary, 2) AS Monetary FROM rfm "
    "WHERE CustomerID IN (SELECT CustomerID FROM sales WHERE Country IN ('NATION_1', 'NATION_7', 'NATION_13'))"))
def q_customers_in_filter(spark, sf):
    df = sales_store(spark, sf)
    return FL.customers_in(R.rfm(df), FL.filter_country(df, _SOME_NATIONS)).select(
        "CustomerID", "Recency", "Frequency", r2("Monetary"))


# --- 2.11 clustering and evaluation -----------------------------------------------------------

from basketry.operators import cluster as CL  # noqa: E402
from basketry.operators import evaluate as EV  # noqa: E402

K = 4
N_INIT = 10          # restarts per fit, as in the analysed application
SWEEP_N_INIT = 10    # the sweep uses the same restarts and iteration cap as the final fit;
SWEEP_MAX_ITER = 300  # restarts and k values run as concurrent jobs, once per session
_RULE_LABEL = {"Low Value": 0, "High Value": 1, "Loyal": 2, "Recent": 3}


def z_rule(spark, sf):
    """Standardised R/F/M with the rule segment as an integer label."""
    seg = seg_of(spark, sf)
    lab = F.create_map(*[F.lit(x) for kv in _RULE_LABEL.items() for x in kv])
    return CL.standardize(seg).withColumn("label", F.element_at(lab, F.col("Segment")))


@register("standardize", S.with_sales_rfm(f", {S.Z}\nSELECT CustomerID, round(zRecency, 6) AS zRecency, "
                                          "round(zFrequency, 6) AS zFrequency, round(zMonetary, 6) AS zMonetary FROM z"))
def q_standardize(spark, sf):
    z = CL.standardize(rfm_of(spark, sf))
    return z.select("CustomerID", *[r2(c, d=6) for c in CL.Z_COLS])


@register("silhouette_rule", S.with_sales_rfm(S.silhouette_sql(squared=False)))
def q_silhouette_rule(spark, sf):
    return EV.silhouette_exact(z_rule(spark, sf), CL.Z_COLS, "label", "CustomerID").select(r2("silhouette", d=6))


@register("silhouette_squared_rule", S.with_sales_rfm(S.silhouette_sql(squared=True)))
def q_silhouette_squared_rule(spark, sf):
    return EV.silhouette_linear(z_rule(spark, sf), CL.Z_COLS, "label").select(r2("silhouette", d=6))


@register("davies_bouldin_rule", S.with_sales_rfm(S.DAVIES_BOULDIN))
def q_davies_bouldin_rule(spark, sf):
    return EV.davies_bouldin(z_rule(spark, sf), CL.Z_COLS, "label").select(r2("davies_bouldin", d=6))


_SPLIT_KEY = "substr(md5('42:' || CAST(CustomerID AS VARCHAR)), 1, 13)"


@register("holdout_split", S.with_sales_rfm(
    f"SELECT CustomerID, row_number() OVER (ORDER BY {_SPLIT_KEY}) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM rfm"))
def q_holdout_split(spark, sf):
    train, test = CL.split(R.rfm(sales(spark, sf)))
    return train.select("CustomerID", F.lit(False).alias("is_test")).unionByName(test.select("CustomerID", F.lit(True).alias("is_test")))


_FITTED: dict = {}


def _once(kind: str, spark, sf, build):
    """One fitted object per (session, folder, kind): several tables are read from one fit, as a
    user of the model would do; the fit itself is deterministic (fixed seeds and row layout)."""
    key = (kind, spark.sparkContext.applicationId, sf)
    if key not in _FITTED:
        for old in [k for k in _FITTED if k[1] != key[1]]:  # fits of sessions that are over
            del _FITTED[old]
        _FITTED[key] = build()
    return _FITTED[key]


def _model(spark, sf):
    from basketry.plans.segmentation import build_segment_model

    return _once("model", spark, sf, lambda: build_segment_model(sales(spark, sf), k=K, n_init=N_INIT))


@register("kmeans_fit")
def q_kmeans_fit(spark, sf):
    m = _model(spark, sf)
    sizes = m.customers.groupBy("Cluster").agg(F.count(F.lit(1)).alias("Customers"))
    return sizes.withColumn("k", F.lit(m.fit.k)).withColumn("cost", F.lit(m.fit.cost)).orderBy("Cluster")


@register("cluster_means")
def q_cluster_means(spark, sf):
    return CL.cluster_means(_model(spark, sf).customers)


@register("cluster_names")
def q_cluster_names(spark, sf):
    m = _model(spark, sf)
    return m.customers.groupBy("Cluster", "KMSegment").agg(F.count(F.lit(1)).alias("Customers")).orderBy("Cluster")


@register("cluster_summary")
def q_cluster_summary(spark, sf):
    m = _model(spark, sf)
    return CL.cluster_summary(m.customers, m.names)


@register("km_segment_counts")
def q_km_segment_counts(spark, sf):
    return R.segment_counts(_model(spark, sf).customers, "KMSegment")


@register("filter_segment_km")
def q_filter_segment_km(spark, sf):
    from basketry.plans.segmentation import build_segment_model

    df = sales_store(spark, sf)
    m = build_segment_model(df, k=K, n_init=N_INIT)
    return _lines(FL.filter_segment(df, m.customers, "VIP"))


@register("score_customers")
def q_score_customers(spark, sf):
    """M4 over every customer's own R/F/M (a batch prediction)."""
    m = _model(spark, sf)
    return m.score(m.customers.select("CustomerID", "Recency", "Frequency", "Monetary"))


def _sweep(spark, sf):
    def build():
        z = CL.standardize(rfm_of(spark, sf))
        return CL.sweep(CL.with_features(z), range(2, 11), SWEEP_N_INIT, 42, SWEEP_MAX_ITER)

    return _once("sweep", spark, sf, build)


@register("model_sweep")
def q_model_sweep(spark, sf):
    return _sweep(spark, sf)


@register("best_k")
def q_best_k(spark, sf):
    return CL.best_k(_sweep(spark, sf))


@register("k_decision")
def q_k_decision(spark, sf):
    return CL.k_decision(_sweep(spark, sf))


@register("bisecting")
def q_bisecting(spark, sf):
    z = CL.standardize(rfm_of(spark, sf))
    feats = CL.with_features(z, shift=10.0, partitions=8).cache()
    try:
        model = CL.fit_bisecting(feats, K)
        sizes = model.setPredictionCol("Cluster").transform(feats).groupBy("Cluster").agg(
            F.count(F.lit(1)).alias("Customers")).collect()   # k rows
        cost = float(model.summary.trainingCost)
    finally:
        feats.unpersist()
    rows = [(int(r["Cluster"]), int(r["Customers"]), cost) for r in sizes]
    return spark.createDataFrame(rows, "Cluster int, Customers long, cost double").orderBy("Cluster")


@register("holdout")
def q_holdout(spark, sf):
    z = CL.standardize(rfm_of(spark, sf))
    return CL.holdout(z, K, N_INIT)


# --- the model path with given centres and labels, which SQL can follow ------------------------

def _fixed(spark, sf):
    """(labelled by rule segment, the segments' means as centres, names of the clusters nearest to them)."""
    from basketry.session import materialize

    z = materialize(z_rule(spark, sf))
    model = CL.label_centres(z, "label")
    labelled = model.assign(z)
    names = CL.name_clusters(labelled)
    return z, model, names, labelled.withColumn("KMSegment", F.coalesce(CL.name_column(names), F.lit("Unknown")))


_FIXED_SQL = f", {S.Z},\n{S.nearest()},\n{S.NAMED}\n"


def _score_sql() -> str:
    from basketry.functions.columns import ADVICE_PREDICT, ADVICE_PREDICT_DEFAULT

    return S.with_sales_rfm(
        f"{_FIXED_SQL}SELECT CustomerID, Cluster, KMSegment, {S.HEALTH} AS HealthScore, {S.health_label(S.HEALTH)} AS HealthLabel, "
        f"{S.advice_case('KMSegment', ADVICE_PREDICT, ADVICE_PREDICT_DEFAULT)} AS Advice FROM named JOIN rfm USING (CustomerID)")


@register("score_customers_fixed", _score_sql())
def q_score_customers_fixed(spark, sf):
    """M4 over every customer, with the rule segments' means as centres."""
    z, model, names, _ = _fixed(spark, sf)
    base = z.select("CustomerID", *CL.RFM_COLS)
    scored = CL.score_customers(base, CL.scaler_stats(base), model, names)
    return scored.select("CustomerID", "Cluster", "KMSegment", "HealthScore", "HealthLabel", "Advice")


@register("cluster_names_fixed", S.with_sales_rfm(f"{_FIXED_SQL}SELECT Cluster, KMSegment, count(*) AS Customers FROM named GROUP BY 1, 2"))
def q_cluster_names_fixed(spark, sf):
    return _fixed(spark, sf)[3].groupBy("Cluster", "KMSegment").agg(F.count(F.lit(1)).alias("Customers"))


@register("km_segment_counts_fixed", S.with_sales_rfm(
    _FIXED_SQL + SEGMENT_COUNTS_SQL.replace("SELECT Segment,", "SELECT KMSegment AS Segment,").replace("Segment ASC", "KMSegment ASC").replace("FROM seg GROUP BY Segment", "FROM named GROUP BY KMSegment")))
def q_km_segment_counts_fixed(spark, sf):
    return R.segment_counts(_fixed(spark, sf)[3], "KMSegment")


@register("filter_segment_km_fixed", S.with_sales_rfm(
    f"{_FIXED_SQL}SELECT {_LINE_COLS} FROM sales WHERE CustomerID IN (SELECT CustomerID FROM named WHERE KMSegment = 'VIP')"))
def q_filter_segment_km_fixed(spark, sf):
    return _lines(FL.filter_segment(sales_store(spark, sf), _fixed(spark, sf)[3], "VIP"))


_IS_TEST = f"{_SPLIT_KEY} <= (SELECT k FROM (SELECT {_SPLIT_KEY} AS k, row_number() OVER (ORDER BY {_SPLIT_KEY}) AS r, count(*) OVER () AS n FROM rfm) s WHERE r = ceil(0.2 * n))"


@register("holdout_fixed", S.with_sales_rfm(
    f", {S.Z},\nzt AS (SELECT * FROM z WHERE NOT {_IS_TEST}),\n{S.nearest('zt')},\n"
    f"parts AS (SELECT CASE WHEN {_IS_TEST} THEN 'test' ELSE 'train' END AS g, CustomerID, Cluster AS lab FROM lab),\n"
    f"{S.label_scores('parts', 'sc')},\n"
    """r AS (SELECT round_even((SELECT silhouette FROM sc WHERE g = 'train'), 3) AS train_silhouette,
      round_even((SELECT silhouette FROM sc WHERE g = 'test'), 3) AS test_silhouette,
      round_even((SELECT davies_bouldin FROM sc WHERE g = 'test'), 3) AS test_davies_bouldin)
SELECT *, round_even(abs(train_silhouette - test_silhouette), 3) AS gap,
  CASE WHEN round_even(abs(train_silhouette - test_silhouette), 3) < 0.05 THEN 'Good' ELSE 'Check' END AS verdict FROM r"""))
def q_holdout_fixed(spark, sf):
    """C11-C14 with the train customers' rule-segment means as centres."""
    from basketry.session import materialize

    z = materialize(z_rule(spark, sf))
    return CL.holdout(z, fit=CL.label_centres(CL.split(z)[0], "label")).drop("silhouette_method")


_TILES = f", {S.Z},\ntiles AS (SELECT k AS g, CustomerID, CustomerID % k AS lab FROM z, range(2, 11) t(k)),\n{S.label_scores('tiles', 'sc')}\n"
_TILE_BEST = """(SELECT arg_max(g, (silhouette, -g)) FROM sc) AS best_k_silhouette, (SELECT arg_min(g, (davies_bouldin, g)) FROM sc) AS best_k_db"""


def _tile_scores(spark, sf):
    """C3-C5 of given labellings: customers by id modulo k, for k = 2..10 (nine rows)."""
    from basketry.session import materialize

    z = materialize(CL.standardize(rfm_of(spark, sf)))
    rows = []
    for k in range(2, 11):
        labelled = z.withColumn("Cluster", F.pmod("CustomerID", F.lit(k)).cast("int"))
        sil, db = CL.evaluate_labels(labelled)
        rows.append((k, CL.inertia(labelled).first()["inertia"], sil, db))
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, davies_bouldin double")


@register("label_scores_tiles", S.with_sales_rfm(
    f"{_TILES}SELECT CAST(g AS INTEGER) AS k, round(inertia, 4) AS inertia, round(silhouette, 6) AS silhouette, round(davies_bouldin, 4) AS davies_bouldin FROM sc"))
def q_label_scores_tiles(spark, sf):
    return _tile_scores(spark, sf).select("k", r2("inertia", d=4), r2("silhouette", d=6), r2("davies_bouldin", d=4))


@register("best_k_tiles", S.with_sales_rfm(f"{_TILES}SELECT CAST(best_k_silhouette AS INTEGER) AS best_k_silhouette, CAST(best_k_db AS INTEGER) AS best_k_db FROM (SELECT {_TILE_BEST}) b"))
def q_best_k_tiles(spark, sf):
    return CL.best_k(_tile_scores(spark, sf)).select("best_k_silhouette", "best_k_db")


@register("k_decision_tiles", S.with_sales_rfm(
    f"{_TILES}, bend AS (SELECT g, lag(inertia) OVER (ORDER BY g) - 2 * inertia + lead(inertia) OVER (ORDER BY g) AS b FROM sc)\n"
    f"SELECT CAST(elbow_k AS INTEGER) AS elbow_k, CAST(best_k_silhouette AS INTEGER) AS best_k_silhouette, CAST(best_k_db AS INTEGER) AS best_k_db, "
    f"elbow_k = best_k_silhouette AND elbow_k = best_k_db AS all_agree FROM (SELECT (SELECT arg_max(g, (b, -g)) FROM bend WHERE b IS NOT NULL) AS elbow_k, {_TILE_BEST}) d"))
def q_k_decision_tiles(spark, sf):
    return CL.k_decision(_tile_scores(spark, sf)).select("elbow_k", "best_k_silhouette", "best_k_db", "all_agree")


_INVARIANTS = "SELECT count(*) AS customers, CAST(0 AS BIGINT) AS off_nearest, count(*) AS in_clusters, true AS cheaper_than_one FROM rfm"


@register("kmeans_invariants", S.with_sales_rfm(_INVARIANTS))
def q_kmeans_invariants(spark, sf):
    """What any seeded fit must hold: all customers labelled, by their nearest centre, at less cost than one cluster."""
    m = _model(spark, sf)
    again = CL.assign_nearest(m.customers, m.fit.centres, out="near")
    one = CL.inertia(m.customers.withColumn("one", F.lit(0)), "one").first()["inertia"]
    return again.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("near") != F.col("Cluster")).alias("off_nearest"),
                     F.count("Cluster").alias("in_clusters")).withColumn("cheaper_than_one", F.lit(bool(m.fit.cost < one)))


@register("bisecting_invariants", S.with_sales_rfm("SELECT count(*) AS customers, 4 AS clusters, true AS cheaper_than_one FROM rfm"))
def q_bisecting_invariants(spark, sf):
    z = CL.standardize(rfm_of(spark, sf))
    sizes = q_bisecting(spark, sf)
    one = CL.inertia(z.withColumn("one", F.lit(0)), "one").first()["inertia"]
    return sizes.agg(F.sum("Customers").alias("customers"), F.count(F.lit(1)).cast("int").alias("clusters"), (F.max("cost") < one).alias("cheaper_than_one"))


# --- C8 density clustering (SQL brute force as the oracle; numpy brute force in tests) ----------

from basketry.operators import dbscan as DB  # noqa: E402


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ")


@register("dbscan", _recursive(S.with_sales_rfm(S.dbscan_summary_sql())))
def q_dbscan(spark, sf):
    z = CL.standardize(rfm_of(spark, sf))
    return DB.dbscan_summary(DB.dbscan(z, CL.Z_COLS, "CustomerID", eps=0.5, min_pts=5))


@register("dbscan_events", _recursive(S.with_events_rfm(S.dbscan_summary_sql())))
def q_dbscan_events(spark, sf):
    z = CL.standardize(R.rfm(events(spark, sf)))
    return DB.dbscan_summary(DB.dbscan(z, CL.Z_COLS, "CustomerID", eps=0.5, min_pts=5))


# --- 2.12 profiling an arbitrary table ---------------------------------------------------------

from basketry.operators import profile as PR  # noqa: E402
from basketry.sources.tables import table  # noqa: E402


@register("profile_trend", "SELECT coalesce(strftime(o_orderdate, '%Y-%m'), 'NaT') AS upload_month, "
                           "round(coalesce(sum(o_totalprice), 0), 2) AS o_totalprice FROM orders GROUP BY 1")
def q_profile_trend(spark, sf):
    return PR.profile_trend(table(spark, sf, "orders")).select("upload_month", r2("o_totalprice"))


@register("profile_geo", S.with_sales(
    "SELECT Country, round(sum(UnitPrice), 2) AS UnitPrice FROM sales_lines WHERE Country IS NOT NULL GROUP BY Country "
    "ORDER BY sum(UnitPrice) DESC, Country ASC LIMIT 10"))
def q_profile_geo(spark, sf):
    return PR.profile_geo(adapters.sales_lines(spark, sf)).select("Country", r2("UnitPrice"))


@register("profile_summary", S.with_sales(
    "SELECT count(*) AS \"rows\", 8 AS \"columns\", 'InvoiceDate' AS date_col, 'CustomerID' AS customer_col, "
    "'UnitPrice' AS value_col, 'Country' AS geography_col FROM sales_lines"))
def q_profile_summary(spark, sf):
    return PR.profile_summary(adapters.sales_lines(spark, sf)).withColumn("columns", F.col("columns").cast("int"))


@register("profile_summary_orders", "SELECT count(*) AS \"rows\", 6 AS \"columns\", 'o_orderdate' AS date_col, "
                                    "CAST(NULL AS VARCHAR) AS customer_col, 'o_totalprice' AS value_col, "
                                    "CAST(NULL AS VARCHAR) AS geography_col FROM orders")
def q_profile_summary_orders(spark, sf):
    return PR.profile_summary(table(spark, sf, "orders")).withColumn("columns", F.col("columns").cast("int"))


# --- A28 all metrics of one table --------------------------------------------------------------

_CONTENTS_SQL = f"""
SELECT 'monthly_revenue' AS tbl, Month AS item, round(sum(TotalPrice), 2) AS value FROM sales GROUP BY Month
UNION ALL SELECT 'month_labels', Month || ' £' || printf('%.0f', round_even(sum(TotalPrice) / 1000, 0)) || 'K', 0 FROM sales GROUP BY Month
UNION ALL SELECT * FROM (SELECT 'top_countries', Country, count(*)::DOUBLE FROM sales GROUP BY Country ORDER BY count(*) DESC, Country LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_products', Description, round(sum(Quantity), 2) FROM sales GROUP BY Description ORDER BY sum(Quantity) DESC, Description LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'top_customers', CustomerID::VARCHAR, round(sum(TotalPrice), 2) FROM sales GROUP BY CustomerID ORDER BY sum(TotalPrice) DESC, CustomerID LIMIT 10)
UNION ALL SELECT 'heatmap', Day || ' ' || Hour, Orders::DOUBLE FROM ({HEATMAP_SQL}) h
UNION ALL SELECT 'countries', Country, 0 FROM (SELECT DISTINCT Country FROM sales) c
UNION ALL SELECT 'date_bounds', strftime(min(InvoiceDate), '%Y-%m-%d %H:%M:%S') || ' ' || strftime(max(InvoiceDate), '%Y-%m-%d %H:%M:%S'), 0 FROM sales
UNION ALL SELECT 'purchase_freq', CustomerID::VARCHAR, count(DISTINCT InvoiceNo)::DOUBLE FROM sales GROUP BY CustomerID
UNION ALL SELECT 'basket_data', InvoiceNo::VARCHAR, round(sum(TotalPrice), 2) FROM sales GROUP BY InvoiceNo HAVING sum(TotalPrice) < 1000
UNION ALL SELECT 'purchase_histogram', printf('%.4f', bin_start), "Count"::DOUBLE FROM ({_hist_sql("SELECT CAST(count(DISTINCT InvoiceNo) AS DOUBLE) AS x FROM sales GROUP BY CustomerID")}) p
UNION ALL SELECT 'basket_histogram', printf('%.4f', bin_start), "Count"::DOUBLE FROM ({_hist_sql("SELECT sum(TotalPrice) AS x FROM sales GROUP BY InvoiceNo HAVING sum(TotalPrice) < 1000")}) q"""


@register("get_metrics_contents", S.with_events(_CONTENTS_SQL))
def q_get_metrics_contents(spark, sf):
    """The contents of every table of A28 over one written input, as rows (tbl, item, value)."""
    from basketry.plans.dashboard import get_metrics

    return _contents(get_metrics(events(spark, sf), 1000.0, persist="write"))


def _contents(m: dict) -> DataFrame:
    """Twelve tables of A28 as rows (tbl, item, value)."""
    start = F.format_string("%.4f", F.col("bin_start").cast("double"))
    when = [F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_date", "max_date")]
    parts = {
        "monthly_revenue": (F.col("Month"), F.round("Revenue", 2)),
        "month_labels": (F.concat_ws(" ", "Month", "Label"), F.lit(0.0)),
        "top_countries": (F.col("Country"), F.col("OrderCount")),
        "top_products": (F.col("ProductName"), F.round("UnitsSold", 2)),
        "top_customers": (F.col("CustomerID"), F.round("Revenue", 2)),
        "heatmap": (F.concat_ws(" ", "Day", "Hour"), F.col("Orders")),
        "countries": (F.col("Country"), F.lit(0.0)),
        "date_bounds": (F.concat_ws(" ", *when), F.lit(0.0)),
        "purchase_freq": (F.col("CustomerID").cast("string"), F.col("PurchaseCount")),
        "basket_data": (F.col("InvoiceNo").cast("string"), F.round("BasketValue", 2)),
        "purchase_histogram": (start, F.col("Count")),
        "basket_histogram": (start, F.col("Count")),
    }
    out = None
    for name, (item, value) in parts.items():
        rows = m[name].select(F.lit(name).alias("tbl"), item.alias("item"), value.cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("get_metrics_summary", S.with_events(
    """SELECT (SELECT count(*) FROM (SELECT InvoiceNo FROM sales GROUP BY InvoiceNo HAVING sum(TotalPrice) < 1000) b) AS basket_rows,
       (SELECT count(DISTINCT CustomerID) FROM sales) AS purchase_freq_rows,
       (SELECT count(DISTINCT Month) FROM sales) AS monthly_rows,
       (SELECT least(10, count(DISTINCT Country)) FROM sales) AS top_country_rows,
       (SELECT least(10, count(DISTINCT Description)) FROM sales) AS top_product_rows,
       (SELECT least(10, count(DISTINCT CustomerID)) FROM sales) AS top_customer_rows,
       (SELECT 7 * count(DISTINCT Hour) FROM sales) AS heatmap_rows"""))
def q_get_metrics_summary(spark, sf):
    """Row counts of every table of A28 over one checkpointed input, in one row."""
    from basketry.plans.dashboard import get_metrics

    m = get_metrics(events(spark, sf), 1000.0, persist="write")
    counts = {
        "basket_rows": m["basket_data"], "purchase_freq_rows": m["purchase_freq"], "monthly_rows": m["monthly_revenue"],
        "top_country_rows": m["top_countries"], "top_product_rows": m["top_products"],
        "top_customer_rows": m["top_customers"], "heatmap_rows": m["heatmap"],
    }
    first, *rest = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in counts.items()]
    row = first
    for other in rest:
        row = row.withColumn(other.columns[0], other.scalar())
    return row


@register("dashboard_top_products", S.with_sales_rfm(
    f", {_SPEC_SQL}\n" + TOP_PRODUCTS_SQL.replace("FROM sales WHERE", "FROM filtered WHERE")))
def q_dashboard_top_products(spark, sf):
    from basketry.plans.dashboard import dashboard

    df = sales_store(spark, sf)
    out = dashboard(df, segments_from(df), _SPEC, LINES_CAP)
    return out["top_products"].select("ProductName", r2("UnitsSold"), "Rank")


# --- A28 from the summary store ----------------------------------------------------------------

def _summary(spark, sf, kind, lines):
    """The summary store of ``lines``, written once per session and folder."""
    from basketry.plans.summary import read_summary, write_summary
    from basketry.session import table_path

    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _STORES:
        path = table_path(spark, f"summary-{uuid.uuid4().hex}")
        write_summary(lines(spark, sf), path)
        _STORES[key] = path
    return read_summary(spark, _STORES[key])


_PLAIN_SPEC = FL.FilterSpec(countries=["NATION_2", "NATION_3", "NATION_5", "NATION_8", "NATION_21"], start="1996-01-01", end="2000-12-31", month_pruning=True)
_PLAIN_SQL = """filtered AS (SELECT * FROM sales WHERE Country IN ('NATION_2', 'NATION_3', 'NATION_5', 'NATION_8', 'NATION_21')
  AND InvoiceDate >= TIMESTAMP '1996-01-01' AND InvoiceDate <= TIMESTAMP '2000-12-31')"""


@register("summary_kpis", S.with_sales_rfm(f", {_SPEC_SQL}\n" + KPI_SQL.replace("{src}", "filtered").replace("{cap}", str(LINES_CAP))))
def q_summary_kpis(spark, sf):
    """The KPI row of all four filters together, without a scan of the lines."""
    orders = _summary(spark, sf, "sales", sales_store).orders
    return _kpis_rounded(FL.apply_filters(orders, segments_from(orders), _SPEC), LINES_CAP)


@register("summary_kpis_dates", S.with_sales_rfm(
    f", {_PLAIN_SQL}\n" + KPI_SQL.replace("{src}", "filtered").replace("{cap}", str(LINES_CAP))))
def q_summary_kpis_dates(spark, sf):
    from basketry.plans.summary import refresh

    k = refresh(_summary(spark, sf, "sales", sales_store), None, _PLAIN_SPEC, LINES_CAP)["kpis"]
    return k.select(r2("total_revenue"), "total_orders", "customer_count", "avg_order_value")


@register("summary_top_products", S.with_sales_rfm(f", {_PLAIN_SQL}\n" + TOP_PRODUCTS_SQL.replace("FROM sales WHERE", "FROM filtered WHERE")))
def q_summary_top_products(spark, sf):
    from basketry.plans.summary import refresh

    out = refresh(_summary(spark, sf, "sales", sales_store), None, _PLAIN_SPEC, LINES_CAP)["top_products"]
    return out.select("ProductName", r2("UnitsSold"), "Rank")


@register("summary_contents", S.with_events(_CONTENTS_SQL))
def q_summary_contents(spark, sf):
    """The contents of every table of A28 from the summary store, as rows (tbl, item, value)."""
    from basketry.plans.summary import refresh

    return _contents(refresh(_summary(spark, sf, "events", events), None, FL.FilterSpec(), 1000.0))


# --- A18 / A19 on rule segments used as cluster labels (oracle-checkable) ----------------------

@register("cluster_means_rule", S.with_sales_rfm(
    "SELECT Segment, round_even(avg(Recency), 1) AS Recency, round_even(avg(Frequency), 1) AS Frequency, "
    "round_even(avg(Monetary), 1) AS Monetary FROM seg GROUP BY Segment"))
def q_cluster_means_rule(spark, sf):
    return CL.cluster_means(seg_of(spark, sf), "Segment")


@register("cluster_summary_rule", S.with_sales_rfm(
    "SELECT Segment, Segment AS Name, count(*) AS Customers, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS Share, "
    "round_even(avg(Recency), 2) AS Recency, round_even(avg(Frequency), 2) AS Frequency, "
    "round_even(avg(Monetary), 2) AS Monetary FROM seg GROUP BY Segment"))
def q_cluster_summary_rule(spark, sf):
    return CL.cluster_summary(seg_of(spark, sf), None, "Segment")


_OVERVIEW = replace(FL.FilterSpec.overview(countries=["purchase", "click"], start="2024-01-05", end="2024-01-25", segment="Recent", basket="Medium"),
                    segment_by="Segment")  # every customer of the events is Recent


@register("apply_filters_overview", S.with_events_rfm(
    f"SELECT {_LINE_COLS} FROM sales WHERE Country IN ('purchase', 'click') "
    "AND InvoiceDate >= TIMESTAMP '2024-01-05' AND InvoiceDate <= TIMESTAMP '2024-01-25' "
    "AND CustomerID IN (SELECT CustomerID FROM seg WHERE Segment = 'Recent') "
    "AND InvoiceNo IN (SELECT InvoiceNo FROM sales GROUP BY InvoiceNo HAVING sum(TotalPrice) >= 20 AND sum(TotalPrice) <= 100)"))
def q_apply_filters_overview(spark, sf):
    """Overview-panel variant: basket bands 20 / 100 over the unfiltered table's totals."""
    lines = events(spark, sf)
    return _lines(FL.apply_filters(lines, R.rule_segments(R.rfm(lines)), _OVERVIEW))


@register("profile_summary_events", "SELECT count(*) AS \"rows\", 6 AS \"columns\", CAST(NULL AS VARCHAR) AS date_col, "
                                    "'user_id' AS customer_col, 'value' AS value_col, "
                                    "CAST(NULL AS VARCHAR) AS geography_col FROM events")
def q_profile_summary_events(spark, sf):
    """U1 + U4 + U5 on the events table: no date or geography column is found, so the profile
    has a summary only (its trend and geography results are absent)."""
    p = PR.profile(table(spark, sf, "events"))
    if set(p) != {"summary"}:
        raise RuntimeError(f"unexpected profile results {sorted(p)}")
    return p["summary"].withColumn("columns", F.col("columns").cast("int"))


@register("profile_trend_lineitem", "SELECT coalesce(strftime(l_shipdate, '%Y-%m'), 'NaT') AS upload_month, "
                                    "round(coalesce(sum(l_extendedprice), 0), 2) AS l_extendedprice FROM lineitem GROUP BY 1")
def q_profile_trend_lineitem(spark, sf):
    return PR.profile(table(spark, sf, "lineitem"))["trend"].select("upload_month", r2("l_extendedprice"))
