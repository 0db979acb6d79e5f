"""Profile of an arbitrary table (U1-U5): detect column roles by name, then a monthly trend and a
top-10 by geography when the roles allow it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.columns import parse_timestamp

# Role keywords, matched as substrings of the lower-case column name, in this order.
ROLE_KEYWORDS = {
    "date": ["date", "invoice", "time"],
    "customer": ["customer", "user", "client"],
    "value": ["price", "revenue", "amount", "total", "value"],
    "geography": ["country", "region", "city"],
}
MISSING_MONTH = "NaT"


def detect_roles(df: DataFrame, prefer_typed_dates: bool = True) -> dict[str, str | None]:
    """For each role, the first column whose lower-case name contains one of its keywords.

    Metadata only (no job). With ``prefer_typed_dates`` the date role looks at date/timestamp
    columns first, so an invoice-number column placed before the real date column no longer
    wins because "invoice" is a date keyword; pass ``False`` for plain first-match order.
    """
    fields = df.schema.fields
    roles: dict[str, str | None] = {}
    for role, words in ROLE_KEYWORDS.items():
        order = fields
        if role == "date" and prefer_typed_dates:
            typed = (T.DateType, T.TimestampType, T.TimestampNTZType)
            order = [f for f in fields if isinstance(f.dataType, typed)] + [
                f for f in fields if not isinstance(f.dataType, typed)]
        roles[role] = next((f.name for f in order if any(w in f.name.lower() for w in words)), None)
    return roles


def _as_timestamp(df: DataFrame, col: str):
    """Coercing parse (E10): bad values become null. Numbers count nanoseconds since the epoch,
    as a pandas datetime conversion of an integer column does."""
    dtype = df.schema[col].dataType
    c = F.col(f"`{col}`")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp_ntz")
    if isinstance(dtype, T.NumericType):
        # wall-clock arithmetic on timestamp_ntz: independent of the session time zone
        micros = F.floor(c.cast("double") / 1000).cast("long")
        return F.timestamp_add("MICROSECOND", micros, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))
    return parse_timestamp(c.cast("string"))


def _value(df: DataFrame, col: str):
    return F.col(f"`{col}`").try_cast("double")


def profile_trend(df: DataFrame, roles: dict | None = None) -> DataFrame | None:
    """Sum of the value column per month ``yyyy-MM``; unparseable dates form the group 'NaT'."""
    roles = roles or detect_roles(df)
    date_col, value_col = roles.get("date"), roles.get("value")
    if not (date_col and value_col):
        return None
    month = F.coalesce(F.date_format(_as_timestamp(df, date_col), "yyyy-MM"), F.lit(MISSING_MONTH))
    return (
        df.groupBy(month.alias("upload_month"))
        .agg(F.coalesce(F.sum(_value(df, value_col)), F.lit(0.0)).alias(value_col))
        .orderBy("upload_month")
    )


def profile_geo(df: DataFrame, roles: dict | None = None, n: int = 10) -> DataFrame | None:
    """U3 + T4: the ``n`` largest value sums by geography; ties keep the key order."""
    roles = roles or detect_roles(df)
    geo, value_col = roles.get("geography"), roles.get("value")
    if not (geo and value_col):
        return None
    return (
        df.where(F.col(f"`{geo}`").isNotNull())
        .groupBy(F.col(f"`{geo}`").alias(geo))
        .agg(F.coalesce(F.sum(_value(df, value_col)), F.lit(0.0)).alias(value_col))
        .orderBy(F.desc(f"`{value_col}`"), F.asc(f"`{geo}`"))
        .limit(n)
    )


def profile_summary(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """U4: rows (a distributed count), columns and the detected roles, one row."""
    roles = roles or detect_roles(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        *[F.lit(roles[r]).cast("string").alias(f"{r}_col") for r in ROLE_KEYWORDS],
    )


def profile(df: DataFrame, prefer_typed_dates: bool = True) -> dict[str, DataFrame]:
    """Summary always; 'trend' and 'geo' only when their roles were found."""
    roles = detect_roles(df, prefer_typed_dates)
    out = {"summary": profile_summary(df, roles)}
    trend, geo = profile_trend(df, roles), profile_geo(df, roles)
    if trend is not None:
        out["trend"] = trend
    if geo is not None:
        out["geo"] = geo
    return out
