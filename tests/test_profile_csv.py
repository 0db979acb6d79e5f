"""CSV sources and table profiling (FIXTURES.md §6); files are written to a temporary folder."""

import pytest

from basketry.operators import clean as C
from basketry.operators import profile as PR
from basketry.sources.csv import read_sales_csv, read_user_csv, shape


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_roles_trend_and_nat(spark, tmp_path):
    path = _write(tmp_path, "a.csv", "order_date,client_id,amount,city\n"
                  "2024-01-05,1,10.5,Leeds\n2024-01-20,2,4.5,York\n2024-02-01,1,1.0,Leeds\nnot a date,3,2.0,York\n")
    df = read_user_csv(spark, path)["data"]
    roles = PR.detect_roles(df)
    assert roles == {"date": "order_date", "customer": "client_id", "value": "amount", "geography": "city"}
    trend = {r.upload_month: r.amount for r in PR.profile_trend(df).collect()}
    assert trend == {"2024-01": 15.0, "2024-02": 1.0, "NaT": 2.0}
    geo = PR.profile_geo(df).collect()
    assert [(r.city, r.amount) for r in geo] == [("Leeds", 11.5), ("York", 6.5)]
    s = PR.profile_summary(df).first()
    assert (s.rows, s.columns) == (4, 4)


def test_invoice_keyword_quirk(spark, tmp_path):
    path = _write(tmp_path, "b.csv", "InvoiceNo,InvoiceDate,UnitPrice,Country\n1,2024-01-05 10:00:00,2.5,UK\n")
    df = read_user_csv(spark, path)["data"]
    assert PR.detect_roles(df, prefer_typed_dates=False)["date"] == "InvoiceNo"  # plain first match
    assert PR.detect_roles(df)["date"] == "InvoiceDate"                           # typed dates first


def test_no_roles_no_result(spark, tmp_path):
    df = read_user_csv(spark, _write(tmp_path, "c.csv", "a,b\n1,2\n"))["data"]
    out = PR.profile(df)
    assert set(out) == {"summary"}
    assert PR.profile_trend(df) is None and PR.profile_geo(df) is None


def test_unreadable_file_is_an_error_result(spark, tmp_path):
    res = read_user_csv(spark, str(tmp_path / "missing.csv"))
    assert "error" in res and res["error"].startswith("Error reading file")


def test_sales_csv_to_clean(spark, tmp_path):
    path = _write(tmp_path, "sales.csv",
                  "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"
                  "536365,85123A,WHITE HEART,6,2010-12-01 08:26:00,2.55,17850.0,United Kingdom\n"
                  "536366,71053,LANTERN,-1,2010-12-01 08:28:00,3.39,17850.0,United Kingdom\n"
                  "536367,84406B,CUPID,8,2010-12-01 08:34:00,2.75,,France\n")
    raw = read_sales_csv(spark, path)
    assert shape(raw).first().asDict() == {"rows": 3, "columns": 8}
    clean = C.clean_sales(raw)
    row = clean.first()
    assert clean.count() == 1 and row.CustomerID == 17850 and row.TotalPrice == pytest.approx(15.3)
    assert (row.Month, row.Hour, row.Day, row.day_idx) == ("2010-12", 8, "Wednesday", 2)
    assert dict(clean.dtypes)["InvoiceDate"] == "timestamp_ntz"


def test_parse_ts_coerces(spark):
    df = spark.createDataFrame([("2024-03-01 12:00:00",), ("garbage",)], "InvoiceDate string")
    got = [r.InvoiceDate for r in C.parse_ts(df).collect()]
    assert got[0] is not None and got[1] is None


def test_numeric_date_column_counts_nanoseconds(spark):
    # 1.7e18 ns since the epoch = 2023-11-14 22:13:20 UTC
    df = spark.createDataFrame([(1_700_000_000_000_000_000, 5.0)], "event_time long, amount double")
    got = PR.profile_trend(df).collect()
    assert [(r.upload_month, r.amount) for r in got] == [("2023-11", 5.0)]


def test_us_style_invoice_dates(spark):
    df = spark.createDataFrame([("12/1/2010 8:26",), ("2010-12-01 08:26:00",), ("1/13/2011",), ("bad",)],
                               "InvoiceDate string")
    got = [r.InvoiceDate for r in C.parse_ts(df).collect()]
    assert [str(g) for g in got[:3]] == ["2010-12-01 08:26:00", "2010-12-01 08:26:00", "2011-01-13 00:00:00"]
    assert got[3] is None


def test_featured_sales_csv_keeps_supplied_columns(spark, tmp_path):
    path = _write(tmp_path, "featured.csv",
                  "InvoiceNo,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country,TotalPrice,Month,Hour,Day\n"
                  "1,A,2,12/1/2010 8:26,2.5,17850.0,United Kingdom,5.0,2010-12,8,Wednesday\n"
                  "2,B,1,2010-12-02 09:00:00,4.0,13047.0,France,4.0,2010-12,9,Thursday\n")
    raw = read_sales_csv(spark, path)
    assert dict(raw.dtypes)["TotalPrice"] == "double" and dict(raw.dtypes)["Hour"] == "int"
    rows = {r.InvoiceNo: r for r in C.clean_sales(raw).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].TotalPrice == 5.0 and rows["1"].Day == "Wednesday" and rows["1"].day_idx == 2
    assert str(rows["1"].InvoiceDate) == "2010-12-01 08:26:00" and rows["2"].CustomerID == 13047


def test_user_csv_reports_malformed_rows(spark, tmp_path):
    path = _write(tmp_path, "bad.csv", "a,b\n1,2,3\n4,5\n")
    res = read_user_csv(spark, path)                     # surplus fields would be lost
    assert "error" in res and res["error"].startswith("Error reading file")
    assert "data" in read_user_csv(spark, _write(tmp_path, "good.csv", "a,b\n1,2\n"), strict=True)
