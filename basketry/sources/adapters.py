"""Adapters that map the driver's tables onto the canonical sales-line schema.

Canonical columns: InvoiceNo, Description, Quantity, InvoiceDate, UnitPrice, CustomerID,
Country and optionally TotalPrice. Every adapter is a lazy plan over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.sources.tables import table, tasks_for

CANONICAL = ["InvoiceNo", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]


def _order_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders joined to customer and nation: one row per order with its country."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem ⋈ part ⋈ order header, with the columns the adapters need.

    The two large equi-joins shuffle lineitem on l_partkey and l_orderkey; nation is tiny and the
    planner broadcasts it on its measured size. No explicit broadcast hint: customer and part grow
    with the data, so their join strategy is left to the size check in AQE. The join by order comes last, as
    cleaning and the sums per order then need no further shuffle; where that is more than a few tasks, their number
    follows the size of lineitem, so a task's memory doesn't grow with the table.
    """
    lineitem = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    lines = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey"))
    tasks = tasks_for(spark, sf_dir, "lineitem")
    if tasks > spark.sparkContext.defaultParallelism:
        lines = lines.repartition(tasks, "l_orderkey")
    return lines.join(_order_header(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))


def _unit_price() -> Column:
    return F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))


def sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the canonical schema, TotalPrice included (= l_extendedprice)."""
    return _lines(spark, sf_dir).select(
        F.col("o_orderkey").alias("InvoiceNo"),
        F.col("p_name").alias("Description"),
        F.col("l_quantity").alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        _unit_price().alias("UnitPrice"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("n_name").alias("Country"),
        F.col("l_extendedprice").alias("TotalPrice"),
    )


def event_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one-line orders, by event type as Country and Description; unlike ``sales_lines`` they
    carry a time of day."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("InvoiceNo"),
        F.col("event_type").alias("Description"),
        F.lit(1.0).alias("Quantity"),
        F.col("ts").alias("InvoiceDate"),
        F.col("value").alias("UnitPrice"),
        F.col("user_id").alias("CustomerID"),
        F.col("event_type").alias("Country"),
        F.col("value").alias("TotalPrice"),
    )


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sales_lines`` with repeatable damage so every cleaning rule has work to do.

    Fixed damage rules (they define the fixture, they do not thin the data):
    Description null when l_partkey % 19 = 0; Quantity negated when InvoiceNo % 13 = 0;
    UnitPrice 0.0 when InvoiceNo % 23 = 0; CustomerID null when InvoiceNo % 17 = 0;
    the damaged rows with InvoiceNo % 11 = 0 appear twice. No TotalPrice column.
    """
    inv = F.col("o_orderkey")
    # one pass: the duplicated rows come from a generator, not from a second copy of the joins
    copies = F.explode(F.sequence(F.lit(1), F.when(inv % 11 == 0, 2).otherwise(1)))
    return _lines(spark, sf_dir).select(
        inv.alias("InvoiceNo"),
        F.when(F.col("l_partkey") % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("p_name")).alias("Description"),
        F.when(inv % 13 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("Quantity"),
        F.col("o_orderdate").alias("InvoiceDate"),
        F.when(inv % 23 == 0, F.lit(0.0)).otherwise(_unit_price()).alias("UnitPrice"),
        F.when(inv % 17 == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
        copies.alias("_copy"),
    ).drop("_copy")
