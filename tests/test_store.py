"""Month-partitioned cleaned sales and partition pruning by the date filter."""

from basketry.operators import clean as C
from basketry.operators import filters as FL
from basketry.sources import event_sales, read_clean_sales, write_clean_sales

from tests.test_plan_shapes import plan


def test_month_partitions_prune_and_keep_results(spark, tmp_path):
    lines = C.clean_sales(event_sales(spark, "/root/testdata/sf0.01"))
    path = str(tmp_path / "sales")
    write_clean_sales(lines, path)
    stored = read_clean_sales(spark, path)
    plain = FL.filter_dates(stored, "2024-01-10", "2024-01-20")
    pruned = FL.filter_dates(stored, "2024-01-10", "2024-01-20", month_col="Month")
    assert sorted(map(tuple, plain.select("InvoiceNo").collect())) == sorted(map(tuple, pruned.select("InvoiceNo").collect()))
    p = [line for line in plan(pruned).splitlines() if line.startswith("PartitionFilters")]
    assert p and "Month" in p[0] and "2024-01" in p[0]
    spec = FL.FilterSpec(start="2024-01-10", end="2024-01-20", month_pruning=True)
    assert FL.apply_filters(stored, None, spec).count() == plain.count()


def test_materialize_and_release(spark):
    import os

    from basketry.session import materialize, release

    df = materialize(spark.range(10).withColumnRenamed("id", "x"))
    assert df.count() == 10
    table_dir = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.isdir(table_dir)
    assert release(df)
    assert not os.path.exists(table_dir)
    with __import__("pytest").raises(ValueError):
        release(spark.read.parquet("/root/testdata/sf0.001/nation.parquet"))


def test_a_basket_filter_moves_no_line_of_the_order_store(spark, tmp_path):
    from basketry.sources import read_order_store, write_order_store

    lines = C.clean_sales(event_sales(spark, "/root/testdata/sf0.01"))
    path = str(tmp_path / "orders")
    write_order_store(lines, path, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Exchange" not in plan(FL.filter_basket(read_order_store(spark, path, 4), "Large"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for known in (True, False):
        if not known:  # as in a later session
            for t in spark.catalog.listTables():
                if t.name.startswith("orders_"):
                    spark.sql(f"DROP TABLE {t.name}")
        stored = read_order_store(spark, path, 4)
        assert stored.schema.simpleString() == lines.schema.simpleString()
        some = FL.filter_dates(stored, "2024-01-05", "2024-01-20")
        for own, plain in ((FL.filter_basket(some, "Large"), FL.filter_basket(FL.filter_dates(lines, "2024-01-05", "2024-01-20"), "Large")),
                           (FL.filter_basket(some, "Medium", (20.0, 100.0), True, stored), FL.filter_basket(FL.filter_dates(lines, "2024-01-05", "2024-01-20"), "Medium", (20.0, 100.0), True, lines))):
            assert "hashpartitioning" not in plan(own)  # at most the few orders of the band are broadcast
            assert sorted(r.InvoiceNo for r in own.collect()) == sorted(r.InvoiceNo for r in plain.collect()) != []
