"""Sources: the driver's parquet tables, adapters onto the sales schema, CSV readers."""

from basketry.sources.adapters import dirty_lines, event_sales, sales_lines
from basketry.sources.csv import SALES_SCHEMA, read_sales_csv, read_user_csv, shape
from basketry.sources.store import read_clean_sales, read_order_store, write_clean_sales, write_order_store
from basketry.sources.tables import table

__all__ = [
    "SALES_SCHEMA",
    "dirty_lines",
    "event_sales",
    "read_clean_sales",
    "read_order_store",
    "read_sales_csv",
    "read_user_csv",
    "sales_lines",
    "shape",
    "table",
    "write_clean_sales",
    "write_order_store",
]
