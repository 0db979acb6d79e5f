"""Edge fixture for cleaning and metrics (FIXTURES.md §5): ~20 hand-made canonical rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basketry.operators import clean as C
from basketry.operators import filters as FL
from basketry.operators import metrics as M
from basketry.operators import rfm as R

COLS = "InvoiceNo long, Description string, Quantity double, InvoiceDate timestamp_ntz, UnitPrice double, " \
       "CustomerID long, Country string"


def ts(s):
    return datetime.fromisoformat(s)


ROWS = [
    (1, "apple", 2.0, ts("2024-01-01 10:00"), 5.0, 100, "UK"),       # basket 1: 10 + 10 = 20
    (1, "pear", 1.0, ts("2024-01-01 10:00"), 10.0, 100, "UK"),
    (2, "apple", 10.0, ts("2024-01-02 11:00"), 5.0, 101, "UK"),      # basket 2: 50
    (3, None, 4.0, ts("2024-01-03 12:30"), 25.0, 102, "FR"),         # null product, basket 100
    (3, None, 4.0, ts("2024-01-03 12:30"), 25.0, 102, "FR"),         # exact duplicate with a null field
    (4, "plum", 0.0, ts("2024-01-04 09:00"), 3.0, 103, "FR"),        # quantity 0: dropped
    (5, "plum", -1.0, ts("2024-01-04 09:00"), 3.0, 103, "FR"),       # negative: dropped
    (6, "plum", 1.0, ts("2024-01-04 09:00"), 0.0, 103, "FR"),        # price 0: dropped
    (7, "kiwi", 1.0, ts("2024-01-05 13:00"), 7.0, None, "DE"),       # no customer: dropped
    (8, "kiwi", 20.0, ts("2024-02-06 08:00"), 10.0, 104, "DE"),      # basket 200
    (9, "fig", 1.0, ts("2024-02-07 23:30"), 1000.0, 105, "DE"),      # basket 1000: above the cap
    (10, "date", 3.0, ts("2024-02-08 07:15"), 1.0, 101, "UK"),       # basket 3
    (11, "apple", 2.0, ts("2024-02-08 07:45"), 5.0, 106, "ES"),      # tie with pear at 10 units? see below
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, COLS)


@pytest.fixture(scope="module")
def clean(raw):
    return C.clean_sales(raw).cache()


def test_cleaning_rules(clean):
    assert clean.count() == 8  # 13 rows - 1 duplicate - 3 non-positive - 1 missing customer
    assert clean.where(F.col("CustomerID").isNull()).count() == 0
    assert clean.where(F.col("Description").isNull()).count() == 1  # kept by cleaning
    cols = set(clean.columns)
    assert {"TotalPrice", "Month", "Hour", "Day", "day_idx"} <= cols
    r = clean.where("InvoiceNo = 9").first()
    assert (r.Month, r.Hour, r.Day, r.day_idx) == ("2024-02", 23, "Wednesday", 2)


def test_supplied_columns_are_kept(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0, ts("2024-01-01 10:00"), 2.0, 7, "UK", 99.0, "Funday")],
        COLS + ", TotalPrice double, Day string")
    out = C.clean_sales(df).first()
    assert out.TotalPrice == 99.0  # supplied TotalPrice wins
    assert out.day_idx is None      # not a weekday name: no position, absent from heatmap
    assert M.sales_heatmap(C.clean_sales(df)).where("Orders > 0").count() == 0


def test_kpis_and_caps(clean):
    k = M.kpis(clean).first()
    assert k.total_orders == 7 and k.customer_count == 6
    assert k.total_revenue == pytest.approx(20 + 50 + 100 + 200 + 1000 + 3 + 10)
    # capped (< 1000) baskets: 20, 50, 100, 200, 3, 10 -> mean 63.83 -> 64
    assert k.avg_order_value == 64.0
    assert sorted(r.InvoiceNo for r in M.basket_values(clean).collect()) == [1, 2, 3, 8, 10, 11]


def test_empty_filter_gives_zero_kpis(clean):
    t = M.kpi_text(M.kpis(FL.filter_country(clean, ["nowhere"]))).first()
    assert (t.revenue_text, t.orders_text, t.customers_text, t.avg_text) == ("£0.0K", "0", "0", "£0")


def test_top_products_ties_and_nulls(clean):
    top = M.top_products(clean, 3).collect()
    # apple 2+10+2 = 14, kiwi 20, pear 1, date 3, fig 1; null product never ranked
    assert [(r.ProductName, r.UnitsSold, r.Rank) for r in top] == [("kiwi", 20.0, 1), ("apple", 14.0, 2),
                                                                    ("date", 3.0, 3)]
    names = [r.ProductName for r in M.top_products(clean, 10).collect()]
    assert None not in names and names[-2:] == ["fig", "pear"]  # tie at 1 unit: key order


def test_heatmap_zero_fill(clean):
    hm = M.sales_heatmap(clean)
    hours = {r.Hour for r in clean.select("Hour").distinct().collect()}
    assert hm.count() == 7 * len(hours)
    assert hm.agg(F.sum("Orders")).first()[0] == clean.count()
    wide = M.sales_heatmap_wide(clean)
    assert [r.Day for r in wide.collect()][0] == "Monday" and wide.count() == 7


def test_basket_bands(clean):
    # variant B: Small < 50, Medium [50, 200), Large >= 200 over the filtered rows
    small = FL.filter_basket(clean, "Small").select("InvoiceNo").distinct().collect()
    large = FL.filter_basket(clean, "Large").select("InvoiceNo").distinct().collect()
    assert sorted(r[0] for r in small) == [1, 10, 11]
    assert sorted(r[0] for r in large) == [8, 9]
    # variant A: Small < 20, Medium 20..100 inclusive, Large > 100, totals from the unfiltered table
    med = FL.filter_basket(clean, "Medium", (20, 100), True, totals_from=clean)
    assert sorted(r[0] for r in med.select("InvoiceNo").distinct().collect()) == [1, 2, 3]


def test_dates_inclusive(clean):
    got = FL.filter_dates(clean, "2024-01-02", "2024-02-08")
    # end date means midnight: the 07:15 and 07:45 lines of 2024-02-08 are excluded
    assert sorted(r[0] for r in got.select("InvoiceNo").distinct().collect()) == [2, 3, 8, 9]


def test_rfm_recency_floors(spark):
    df = spark.createDataFrame([
        (1, "a", 1.0, ts("2024-01-01 10:00"), 5.0, 1, "UK"),
        (2, "a", 1.0, ts("2024-01-03 09:00"), 5.0, 2, "UK"),
        (3, "a", 1.0, ts("2024-01-03 11:00"), 5.0, 3, "UK"),
    ], COLS)
    r = {x.CustomerID: x for x in R.rfm(C.clean_sales(df)).collect()}
    # snapshot = 2024-01-04 11:00; customer 2's last order is 1 day 2 h earlier -> 1, not 2 midnights
    assert r[1].Recency == 3 and r[2].Recency == 1 and r[3].Recency == 1


def test_rule_segments_later_rules_win(spark):
    rows = [(i, 100 + i, i + 1, float(100 * i)) for i in range(8)]
    rows.append((99, 5, 50, 99999.0))  # recent, loyal and high value at once -> Recent
    rfm = spark.createDataFrame(rows, "CustomerID long, Recency int, Frequency long, Monetary double")
    seg = {r.CustomerID: r.Segment for r in R.rule_segments(rfm).collect()}
    assert seg[99] == "Recent"
    assert seg[0] == "Low Value"
    assert seg[7] == "Loyal"
