"""Column expressions shared by the operators (all built-in Spark SQL, no Python UDF)."""

from basketry.functions.columns import (
    ADVICE_LOOKUP,
    ADVICE_PREDICT,
    WEEKDAYS,
    advice,
    elapsed_days,
    health_label,
    health_score,
    money_k,
    money_units,
    thousands,
    weekday_index,
)
from basketry.functions.quantiles import exact_quantiles

__all__ = [
    "ADVICE_LOOKUP",
    "ADVICE_PREDICT",
    "WEEKDAYS",
    "advice",
    "elapsed_days",
    "exact_quantiles",
    "health_label",
    "health_score",
    "money_k",
    "money_units",
    "thousands",
    "weekday_index",
]
