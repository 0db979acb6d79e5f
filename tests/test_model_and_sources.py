"""Sources that keep what users' files hold, and fits that depend on their parameters only."""

import pytest
from pyspark.sql import functions as F

from basketry.operators import clean as C
from basketry.operators import cluster as CL
from basketry.operators import dbscan as DB
from basketry.operators import filters as FL
from basketry.operators import profile as PR
from basketry.sources.csv import read_sales_csv, read_user_csv

HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country\n"


def _write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_valid_records_survive(spark, tmp_path):
    path = _write(tmp_path, "s.csv", HEADER
                  + '1,A,"PACK ""RED, BIG"" MUG",6,2010-12-01 08:26:00,2.5,7,UK\n'
                  + "2,B,LANTERN,6.0,12/1/2010 8:26,2.5,7,UK\n"
                  + '3,C,"TWO\nLINES",1,2010-12-01,2.5,7,UK\n'
                  + "4,D,NA,1,2010-12-01 08:26:00,2.5,7,UK\n"
                  + "5,E,SHORT,1,2010-12-01 08:26:00,2.5,7\n")
    rows = {r.InvoiceNo: r for r in C.clean_sales(read_sales_csv(spark, path, multi_line=True)).collect()}
    assert set(rows) == {"1", "2", "3", "4", "5"}
    assert rows["1"].Description == 'PACK "RED, BIG" MUG' and rows["3"].Description == "TWO\nLINES"
    assert rows["2"].Quantity == 6 and rows["4"].Description is None and rows["5"].Country is None


@pytest.mark.parametrize("record", ["1,A,B,1,2010-12-01,2.5,7,UK,surplus\n", "1,A,B,one,2010-12-01,2.5,7,UK\n", "1,A,B,1,some day,2.5,7,UK\n"])
def test_bad_sales_records_are_errors(spark, tmp_path, record):
    path = _write(tmp_path, "bad.csv", HEADER + "2,A,B,1,2010-12-01,2.5,7,UK\n" + record)
    with pytest.raises(Exception, match="more fields|cannot be cast|malformed|not a date|CAST_INVALID"):
        C.clean_sales(read_sales_csv(spark, path)).collect()


def test_user_csv_fields(spark, tmp_path):
    more = read_user_csv(spark, _write(tmp_path, "more.csv", "a,amount\n1,2,3\n"))
    assert "more fields" in more["error"]
    short = _write(tmp_path, "less.csv", "a,amount\n1\n2,5\n")
    assert [tuple(r) for r in read_user_csv(spark, short)["data"].collect()] == [(1, None), (2, 5)]
    assert "fewer fields" in read_user_csv(spark, short, strict=True)["error"]
    na = read_user_csv(spark, _write(tmp_path, "na.csv", 'city,amount\nNA,1.5\nYork,n/a\n"a ""b"", c",2\n'))["data"]
    assert [tuple(r) for r in na.collect()] == [(None, 1.5), ("York", None), ('a "b", c', 2.0)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps_keep_their_wall_clock(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-03-10 02:30:00", "3/10/2024 2:30", "3/10/2024 2:30:00", "2024/3/10 02:30:00", "2024-03-10T02:30:00", "3/10/2024", "2024/3/10", "garbage", None]
        df = spark.createDataFrame([(t,) for t in texts], "InvoiceDate string")
        got = [None if r.t is None else r.t for r in C.parse_ts(df).select(F.col("InvoiceDate").cast("string").alias("t")).collect()]
        assert got == ["2024-03-10 02:30:00"] * 5 + ["2024-03-10 00:00:00"] * 2 + [None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_profile_of_a_dotted_column(spark):
    df = spark.createDataFrame([("Leeds", 2.0), ("York", 3.0)], "city string, `total.amount` double")
    assert [tuple(r) for r in PR.profile_geo(df).collect()] == [("York", 3.0), ("Leeds", 2.0)]
    assert set(PR.profile(df)) == {"summary", "geo"}


def test_lookup_compares_numbers(spark):
    df = spark.createDataFrame([(123, 1)], "CustomerID long, Frequency long")
    assert FL.customer_profile(df, "123").count() == 1 == FL.customer_profile(df, 123.0).count()
    assert FL.customer_profile(df, "123.7").count() == 0


def _points(spark, n=400):
    return spark.range(n).select(F.col("id").alias("CustomerID"), *[((F.xxhash64("id", F.lit(i)) % 1000) / 500.0 + F.pmod("id", F.lit(3)) * 4).alias(c) for i, c in enumerate(CL.Z_COLS)])


def test_fits_and_measures_do_not_depend_on_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            z = _points(spark)
            scores = CL.sweep(CL.with_features(z), [2, 3], n_init=2, max_iter=20).collect()
            assert {r.silhouette_method for r in scores} == {"squared_euclidean"}
            fit = CL.fit_kmeans(CL.with_features(z), 3, n_init=2, max_iter=20)
            seen.append((sorted(fit.centres.values()), [round(r.inertia, 8) for r in scores]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]
    asked = CL.sweep(CL.with_features(_points(spark)), [3], n_init=1, max_iter=5, method="euclidean").first()
    assert asked.silhouette_method == "euclidean"
    with pytest.raises(ValueError, match="method"):
        CL.evaluate_labels(_points(spark).withColumn("Cluster", F.lit(0)), method="auto")


def test_nearest_centre_is_the_models_prediction(spark):
    feats = CL.with_features(_points(spark))
    fit = CL.fit_kmeans(feats, 3, n_init=1, max_iter=20)
    both = fit.assign(fit.predict(feats, "p"), "q")
    assert both.where("p <> q").count() == 0
    assert fit.cost == pytest.approx(CL.inertia(both, "q").first()["inertia"], rel=1e-6)


def test_density_clustering_needs_a_column(spark):
    """Any number of columns works (tests/test_cluster.py); none at all is an error."""
    with pytest.raises(ValueError):
        DB.dbscan(_points(spark), [], "CustomerID")


def test_date_filter_prunes_the_written_store(spark):
    from basketry.plans import catalog

    df = catalog.QUERIES["apply_filters"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(Month" in plan or "(Month#" in plan.split("PartitionFilters:")[1][:200]


def test_empty_kpis_read_the_table(spark):
    from basketry.plans import catalog

    df = catalog.QUERIES["kpis_empty"](spark, "/root/testdata/sf0.001")
    assert df.inputFiles() and df.first().avg_text == "£0"


def test_wide_heatmap_needs_no_job_to_find_hours(spark):
    from basketry.operators import metrics as M

    lines = spark.createDataFrame([(3, 0, "a")], "Hour int, day_idx int, InvoiceNo string")
    wide = M.sales_heatmap_wide(lines)
    assert [c for c in wide.columns if c[1:].isdigit()] == [f"h{i}" for i in range(24)]
    assert wide.count() == 7 and wide.first().h3 == 1
