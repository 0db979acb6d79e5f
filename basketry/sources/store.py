"""Cleaned order lines on storage, partitioned by month or bucketed by order.

At scale the cleaned table is written once and every dashboard refresh reads it. Partitioning by
``Month`` (``yyyy-MM``, derived from InvoiceDate by ``clean_sales``) lets a date filter skip
whole month folders: ``filter_dates(..., month_col="Month")`` adds the implied month range,
which Spark turns into ``PartitionFilters`` on the scan.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from basketry.session import small_tasks


def write_clean_sales(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write cleaned lines as parquet partitioned by Month (one folder per month).

    The rebalance hint brings the lines of a month together, so a month has few files, and lets the
    planner split a month that is too large for one task.
    """
    with small_tasks(df.sparkSession):
        df.hint("rebalance", "Month").write.mode(mode).partitionBy("Month").parquet(path)


def read_clean_sales(spark: SparkSession, path: str) -> DataFrame:
    """Read a table written by :func:`write_clean_sales`; Month comes back as a string column."""
    return spark.read.option("basePath", path).parquet(path)


def write_order_store(df: DataFrame, path: str, buckets: int, mode: str = "overwrite") -> None:
    """Write cleaned lines under ``path`` as a table bucketed and sorted by InvoiceNo.

    The lines of an order lie in one bucket, so a basket filter (:func:`basketry.operators.filters.filter_basket`) finds order
    totals and joins them back without moving a line. Choose ``buckets`` so that one holds a few hundred megabytes;
    it is part of the table and must be given again to read it. A null InvoiceNo has its own place in a bucket.
    """
    name = _order_table(path, buckets)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.repartition(buckets, "InvoiceNo").write.mode(mode).format("parquet").bucketBy(buckets, "InvoiceNo").sortBy("InvoiceNo").option("path", path).saveAsTable(name)


def read_order_store(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """Read a table written by :func:`write_order_store`, in any session: a session that does not know it yet registers it."""
    name = _order_table(path, buckets)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (InvoiceNo) SORTED BY (InvoiceNo) INTO {int(buckets)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def _order_table(path: str, buckets: int) -> str:
    return f"orders_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}_{int(buckets)}"
