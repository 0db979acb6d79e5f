"""Small unit checks for rules defined here (histogram bins, KPI text, weekday/elapsed helpers)."""

from datetime import datetime

from pyspark.sql import functions as F

from basketry.functions.columns import elapsed_days, money_k, money_units, thousands, weekday_index
from basketry.operators import metrics as M


def test_histogram_nice_width_and_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0.0, 3.0, 7.5, 99.0, 123.0]], "x double")
    rows = M.histogram(df, "x", nbins=50).collect()
    # raw width (123 - 0) / 50 = 2.46 -> rounded up to 5; bins start on multiples of 5
    assert {r.bin_end - r.bin_start for r in rows} == {5.0}
    assert [(r.bin_start, r.Count) for r in rows] == [(0.0, 2), (5.0, 1), (95.0, 1), (120.0, 1)]
    assert sum(r.Count for r in rows) == 5


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(4.0,), (4.0,)], "x double")
    assert [(r.bin_start, r.Count) for r in M.histogram(df, "x").collect()] == [(4.0, 2)]


def test_kpi_text_formats(spark):
    df = spark.createDataFrame([(1234567.0, 1234567, 2.5, 0.25)], "rev double, n long, avg double, small double")
    r = df.select(money_k(F.col("rev")).alias("a"), thousands(F.col("n")).alias("b"),
                  money_units(F.col("avg")).alias("c"), money_k(F.col("small") * 1000, 1).alias("d")).first()
    assert (r.a, r.b, r.c) == ("£1234.6K", "1,234,567", "£2")  # 2.5 rounds half to even, as in Python
    assert r.d == "£0.2K"


def test_weekday_and_elapsed(spark):
    df = spark.createDataFrame(
        [("Monday", datetime(2024, 1, 1, 10), datetime(2024, 1, 3, 9)),
         ("Sunday", datetime(2024, 1, 1, 10), datetime(2024, 1, 3, 10)),
         ("Funday", datetime(2024, 1, 1, 23, 59, 59), datetime(2024, 1, 2, 0, 0, 0))],
        "d string, a timestamp_ntz, b timestamp_ntz")
    got = df.select(weekday_index(F.col("d")).alias("i"), elapsed_days(F.col("a"), F.col("b")).alias("e")).collect()
    assert [(r.i, r.e) for r in got] == [(0, 1), (6, 2), (None, 0)]


def test_share_of_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 5)], "Segment string, Count long")
    shares = {r.Segment: r.Share for r in M.share_of_total(df).collect()}
    assert shares == {"a": 12.5, "b": 25.0, "c": 62.5}


def test_histogram_never_exceeds_nbins(spark):
    # raw width 1.0 would align to 51 bins (0..50); the next readable width (2) gives 26
    df = spark.createDataFrame([(0.5,), (50.5,), (25.0,)], "x double")
    rows = M.histogram(df, "x", nbins=50).collect()
    assert {r.bin_end - r.bin_start for r in rows} == {2.0}
    assert max(r.bin_start for r in rows) / 2.0 + 1 <= 50


def test_share_rounds_half_to_even(spark):
    df = spark.createDataFrame([("a", 1), ("b", 15)], "Segment string, Count long")
    shares = {r.Segment: r.Share for r in M.share_of_total(df).collect()}
    assert shares == {"a": 6.2, "b": 93.8}   # 6.25 -> 6.2, 93.75 -> 93.8


def test_health_score_boundaries(spark):
    from basketry.functions.columns import advice, health_label, health_score

    rows = [(29, 10, 1000.0), (30, 9, 999.99), (89, 5, 300.0), (90, 4, 299.99)]
    df = spark.createDataFrame(rows, "r int, f long, m double")
    s = health_score(F.col("r"), F.col("f"), F.col("m"))
    got = [(x.s, x.l) for x in df.select(s.alias("s"), health_label(s).alias("l")).collect()]
    # 40+30+30, 20+20+20, 20+20+20, 5+5+5
    assert got == [(100, "Healthy"), (60, "Average"), (60, "Average"), (15, "At Risk")]
    adv = spark.createDataFrame([("VIP",), ("Nope",), (None,)], "s string").select(
        advice(F.col("s"), "predict").alias("a")).collect()
    assert adv[0].a.startswith("Top customer") and adv[1].a == adv[2].a == "Analyse further for targeted marketing."
