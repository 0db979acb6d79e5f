"""basketry: sales and customer analytics as lazy Spark DataFrames.

Sub-packages
------------
sources    readers for sales CSV, user CSV and the driver's parquet tables; month-partitioned store
functions  column expressions (dates, formatting, health score, advice, exact quantiles)
operators  cleaning, filters, metrics, RFM, clustering, evaluation, density clustering, profiling
plans      compositions: dashboard metrics, segmentation model, query catalog
llm        training-data operators; nothing else imports it

The most used entry points are re-exported here.
"""

from basketry.operators.clean import clean_sales
from basketry.operators.filters import FilterSpec, apply_filters
from basketry.operators.profile import profile
from basketry.operators.rfm import rfm, rule_segments
from basketry.plans.dashboard import dashboard, get_metrics, release
from basketry.plans.segmentation import SegmentModel, build_segment_model

__version__ = "0.1.0"

__all__ = [
    "FilterSpec",
    "SegmentModel",
    "apply_filters",
    "build_segment_model",
    "clean_sales",
    "dashboard",
    "get_metrics",
    "profile",
    "release",
    "rfm",
    "rule_segments",
]
