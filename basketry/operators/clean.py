"""Projections and cleaning of order lines.

The order of :func:`clean_sales` matters and follows the analysed application: parse the
timestamp, drop lines without a customer, drop exact duplicates, keep real orders, then add
the derived columns that are missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.columns import parse_timestamp, weekday_index


def parse_ts(df: DataFrame, col: str = "InvoiceDate", strict: bool = False) -> DataFrame:
    """String timestamps become ``timestamp_ntz``; a value that can't be parsed becomes null, or with
    ``strict`` an error when the data are read.

    Timestamp columns are left alone (parquet already stores ``timestamp_ntz``).
    """
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return df
    if isinstance(dtype, (T.TimestampType, T.DateType)):
        return df.withColumn(col, F.col(col).cast("timestamp_ntz"))
    text = F.col(col).cast("string")
    parsed = parse_timestamp(text)
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"not a date in {col}: "), text)).cast("timestamp_ntz")
        parsed = F.when(text.isNotNull() & parsed.isNull(), bad).otherwise(parsed)
    return df.withColumn(col, parsed)


def drop_missing_customer(df: DataFrame) -> DataFrame:
    """Lines without a customer are not analysed."""
    return df.na.drop(subset=["CustomerID"])


def drop_dup_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates over all columns, nulls comparing equal.

    Planned as a hash aggregate on every column: copies collapse map-side before the shuffle,
    so a group of copies holding a large share of the rows never lands whole on one task.
    """
    return df.dropDuplicates()


def valid_orders(df: DataFrame) -> DataFrame:
    """Real orders only, ``Quantity > 0 AND UnitPrice > 0`` (nulls fail both)."""
    return df.where((F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))


def customer_as_int(df: DataFrame) -> DataFrame:
    """P5: CustomerID as a 64-bit integer."""
    return df.withColumn("CustomerID", F.col("CustomerID").cast("bigint"))


def with_total_price(df: DataFrame) -> DataFrame:
    """TotalPrice = Quantity × UnitPrice, only when the column is absent."""
    if "TotalPrice" in df.columns:
        return df
    return df.withColumn("TotalPrice", (F.col("Quantity") * F.col("UnitPrice")).cast("double"))


def with_month(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Month as ``yyyy-MM`` when absent."""
    return df if "Month" in df.columns else df.withColumn("Month", F.date_format(ts, "yyyy-MM"))


def with_hour(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """Hour 0-23 when absent."""
    return df if "Hour" in df.columns else df.withColumn("Hour", F.hour(ts))


def with_day(df: DataFrame, ts: str = "InvoiceDate") -> DataFrame:
    """English weekday name when absent."""
    return df if "Day" in df.columns else df.withColumn("Day", F.date_format(ts, "EEEE"))


def with_day_idx(df: DataFrame) -> DataFrame:
    """P10: ordered weekday, 0 = Monday; a supplied Day that is not a weekday name gives null."""
    return df.withColumn("day_idx", weekday_index(F.col("Day")))


def clean_sales(raw: DataFrame) -> DataFrame:
    """The full cleaning sequence P1..P10."""
    df = parse_ts(raw, strict=True)
    df = drop_missing_customer(df)
    df = drop_dup_rows(df)
    df = valid_orders(df)
    df = customer_as_int(df)
    for step in (with_total_price, with_month, with_hour, with_day, with_day_idx):
        df = step(df)
    return df


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Select and rename result columns in one projection."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])
