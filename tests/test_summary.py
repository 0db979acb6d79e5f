"""The summary store against the line table, its merging, and what a refresh reads."""

import pytest

from basketry.operators import clean as C
from basketry.operators import filters as FL
from basketry.operators import rfm as R
from basketry.plans.dashboard import dashboard
from basketry.plans.summary import order_cells, read_summary, refresh, write_summary

HOURS = ["2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-31 00:00:00", "2024-01-31 00:00:01", "2024-02-01 23:59:59", "2024-02-03 00:00:00", None]
SCHEMA = "InvoiceNo long, Description string, Quantity double, InvoiceDate string, UnitPrice double, CustomerID long, Country string"


@pytest.fixture(scope="module")
def lines(spark):
    rows = [(k % 23 if k % 11 else None, ["a", "b", None, "c"][k % 4], 1.0 + k % 5, HOURS[k % 23 % 7], 2.0 + k % 9, k % 23 % 6 + 1, ["X", "Y", None][k % 23 % 3]) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    return C.clean_sales(df.withColumn("InvoiceDate", df.InvoiceDate.cast("timestamp_ntz")))


def rows(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


SPECS = [FL.FilterSpec(), FL.FilterSpec(countries=["X"]), FL.FilterSpec(start="2024-01-01", end="2024-01-31", month_pruning=True), FL.FilterSpec(start="2024-01-01 10:30:00", end="2024-02-03"),
         FL.FilterSpec(countries=["X", "Y"], end="2024-01-31", segment="Recent", segment_by="Segment", basket="Large"), FL.FilterSpec.overview(countries=["Y"], start="2024-01-02", basket="Small"),
         FL.FilterSpec(countries=["nowhere"])]


@pytest.mark.parametrize("spec", SPECS)
def test_a_refresh_equals_that_of_the_lines(spark, lines, tmp_path, spec):
    path = str(tmp_path / "summary")
    write_summary(lines, path)
    customers = R.rule_segments(R.rfm(lines))
    want = dashboard(lines, customers, spec, persist=None)
    got = refresh(read_summary(spark, path), customers, spec, lines=lines)
    assert set(got) == set(want)
    for name in sorted(set(want) - {"lines"}):
        assert got[name].columns == want[name].columns and rows(got[name]) == rows(want[name]), name


def test_new_lines_are_appended(spark, lines, tmp_path):
    path = str(tmp_path / "summary")
    write_summary(lines.where("InvoiceNo % 2 = 0 OR InvoiceNo IS NULL"), path)
    before = set(read_summary(spark, path).orders.inputFiles())
    write_summary(lines.where("InvoiceNo % 2 = 1"), path, mode="append")
    store = read_summary(spark, path)
    assert before < set(store.orders.inputFiles())  # nothing is rewritten
    want = dashboard(lines, R.rule_segments(R.rfm(lines)), FL.FilterSpec(), persist=None)
    got = refresh(store, None, FL.FilterSpec())
    for name in ("kpis", "basket_data", "top_products", "heatmap", "top_countries", "purchase_freq"):
        assert rows(got[name]) == rows(want[name]), name


def test_dates_and_countries_scan_no_lines(spark, lines, tmp_path):
    source, path = str(tmp_path / "lines"), str(tmp_path / "summary")
    lines.write.parquet(source)
    stored = spark.read.parquet(source)
    write_summary(stored, path)
    for spec in SPECS[:3]:
        for name, df in refresh(read_summary(spark, path), None, spec, lines=stored).items():
            assert all(path in f for f in df.inputFiles()), name
    assert "top_products" not in refresh(read_summary(spark, path), None, SPECS[3])
    assert order_cells(stored).count() < stored.count()
