"""The sf0.01 fixture facts recorded in FIXTURES.md, reproduced by the adapters and operators."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import clean as C
from basketry.operators import filters as FL
from basketry.operators import metrics as M
from basketry.operators import rfm as R
from basketry.sources import adapters

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def lines(spark):
    return C.clean_sales(adapters.sales_lines(spark, SF)).cache()


def test_sales_lines_facts(spark, lines):
    raw = adapters.sales_lines(spark, SF)
    assert raw.count() == 60_000
    assert raw.select("InvoiceNo").distinct().count() == 14_743
    assert raw.select("CustomerID").distinct().count() == 1_500
    assert raw.select("Country").distinct().count() == 25
    assert raw.select("Description").distinct().count() == 64
    assert M.basket_values(lines, 200_000).count() == 7_349
    totals = M.basket_values(lines, None)
    lo, hi = 100_000, 250_000
    bands = [totals.where(F.col("BasketValue") < lo).count(),
             totals.where((F.col("BasketValue") >= lo) & (F.col("BasketValue") <= hi)).count(),
             totals.where(F.col("BasketValue") > hi).count()]
    assert bands == [2_516, 7_080, 5_147]


def test_rule_segment_facts(lines):
    seg = {r.Segment: r.Count for r in R.segment_counts(R.rule_segments(R.rfm(lines))).collect()}
    assert seg == {"Low Value": 970, "Loyal": 248, "Recent": 168, "High Value": 114}


def test_dirty_lines_facts(spark):
    dirty = adapters.dirty_lines(spark, SF)
    assert dirty.count() == 65_393
    assert dirty.where(F.col("CustomerID").isNotNull()).count() == 61_524
    assert dirty.where(F.col("Quantity") <= 0).count() == 4_942
    assert dirty.where(F.col("UnitPrice") == 0).count() == 2_839
    assert dirty.where(F.col("Description").isNull()).count() == 3_551
    assert C.drop_dup_rows(C.drop_missing_customer(dirty)).count() == 56_441
    assert C.clean_sales(dirty).count() == 49_938


def test_event_sales_facts(spark):
    ev = C.clean_sales(adapters.event_sales(spark, SF))
    assert ev.count() == 10_000 and ev.select("CustomerID").distinct().count() == 150
    totals = M.basket_values(ev, None)
    for edges, inclusive, want in (((20, 100), True, [3_261, 5_423, 1_316]), ((50, 200), False, [6_335, 3_493, 172])):
        got = [FL.filter_basket(ev, band, edges, inclusive).select("InvoiceNo").distinct().count() for band in FL.BANDS]
        assert got == want, (edges, got)
    assert totals.count() == 10_000
