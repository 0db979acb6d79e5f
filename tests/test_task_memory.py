"""Memory of one task: the number of tasks follows the size of the tables where whole lines are sorted and hashed."""

import datetime as dt

from pyspark.sql import functions as F

from basketry import session
from basketry.operators import clean as C
from basketry.sources import adapters, tables
from basketry.sources.store import read_clean_sales, write_clean_sales

N = 4000


def _tables(spark, folder):
    key = F.col("id")
    day = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    made = {
        "lineitem": spark.range(N).select((key % 900).alias("l_orderkey"), (key % 37).alias("l_partkey"), (key % 50 + 1).cast("double").alias("l_quantity"), (key * 1.5 + 1).alias("l_extendedprice")),
        "orders": spark.range(900).select(key.alias("o_orderkey"), (key % 80).alias("o_custkey"), day.alias("o_orderdate")),
        "customer": spark.range(80).select(key.alias("c_custkey"), (key % 5).alias("c_nationkey")),
        "nation": spark.range(5).select(key.alias("n_nationkey"), F.concat(F.lit("N"), key).alias("n_name")),
        "part": spark.range(37).select(key.alias("p_partkey"), F.concat(F.lit("part "), key).alias("p_name")),
    }
    for name, df in made.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_lines_are_dealt_by_the_size_of_the_table(spark, tmp_path, monkeypatch):
    sf = _tables(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")  # tables this small would be broadcast whole
    few = C.clean_sales(adapters.sales_lines(spark, sf))
    rows = sorted(map(tuple, few.collect()))
    monkeypatch.setattr(tables, "TASK_BYTES", 500, raising=False)
    many = C.clean_sales(adapters.sales_lines(spark, sf))
    dealt = many.rdd.getNumPartitions()
    again = sorted(map(tuple, many.collect()))
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert again == rows and len(rows) == N
    assert dealt > spark.sparkContext.defaultParallelism


def test_store_is_written_in_small_tasks(spark, tmp_path, monkeypatch):
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    monkeypatch.setattr(session, "_SMALL", {name: 4096}, raising=False)
    lines = spark.range(20000).select("id", F.xxhash64("id").alias("v"), F.lit("2024-01").alias("Month"))
    write_clean_sales(lines, str(tmp_path / "store"))
    kept = read_clean_sales(spark, str(tmp_path / "store"))
    assert len(kept.inputFiles()) > 4 and kept.count() == 20000
    assert spark.conf.get(name) == before
