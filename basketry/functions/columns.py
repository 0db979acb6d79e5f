"""Scalar column functions (E1-E11 of the survey)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the analysed application's constants.
# ---------------------------------------------------------------------------
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Advice shown with a customer lookup, by rule segment, and its default.
ADVICE_LOOKUP = {
    "High Value": "This customer is a high spender. Offer exclusive deals and early access to new products.",
    "Loyal": "This customer orders frequently. Enrol them in a loyalty rewards program.",
    "Recent": "This customer purchased recently. Send a follow-up offer to convert them into a regular buyer.",
    "Low Value": "This customer has low engagement. Target with a special discount to increase activity.",
}
ADVICE_LOOKUP_DEFAULT = "Analyse this customer further for targeted marketing."

# Advice shown with a segment prediction, by segment name, and its default.
ADVICE_PREDICT = {
    "High Value": "High spender. Offer exclusive early access deals.",
    "Loyal": "Frequent buyer. Enrol in loyalty rewards program.",
    "Recent": "Just purchased. Send follow-up offer to convert to regular.",
    "Low Value": "Low engagement. Send special discount to re-activate.",
    "Regular": "Average buyer. Upsell with bundle offers.",
    "Lost": "Not buying anymore. Send win-back campaign urgently.",
    "VIP": "Top customer. Assign personal account manager.",
}
ADVICE_PREDICT_DEFAULT = "Analyse further for targeted marketing."

# Health score: recency below 30 / 90 days scores 40 / 20, else 5; frequency at least 10 / 5
# scores 30 / 20, else 5; monetary at least 1000 / 300 scores 30 / 20, else 5.
# Labels: at least 70 Healthy, at least 40 Average, else At Risk.
HEALTH_LABELS = ("Healthy", "Average", "At Risk")
# ---------------------------------------------------------------------------


# Text timestamp layouts with slashes, month before day (as pandas assumes without dayfirst),
# each with an optional time of day behind it, and how they read in ISO order.
SLASHED_DATES = [(r"^(\d{1,2})/(\d{1,2})/(\d{4})( .*)?$", "$3-$1-$2$4"), (r"^(\d{4})/(\d{1,2})/(\d{1,2})( .*)?$", "$1-$2-$3$4")]


def parse_timestamp(text: Column) -> Column:
    """Coercing timestamp parse (P1, E10): ISO texts, and the slashed layouts put in ISO order; otherwise null.

    The wall-clock time is taken as it is written: no session time zone is involved.
    """
    iso = F.trim(text)
    for layout, order in SLASHED_DATES:
        iso = F.regexp_replace(iso, layout, order)
    return iso.try_cast("timestamp_ntz")


def weekday_index(day_name: Column) -> Column:
    """0 = Monday .. 6 = Sunday for an English weekday name; anything else is null (P10)."""
    expr = F.when(F.lit(False), F.lit(None).cast("int"))
    for i, name in enumerate(WEEKDAYS):
        expr = expr.when(day_name == name, F.lit(i))
    return expr


def _second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.date_part(F.lit("SECOND"), ts).cast("double")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days elapsed from ``start`` to ``end``, floored.

    Not ``datediff``, which counts midnights: 10:00 on day 1 to 09:00 on day 3 is 1 day, not 2.
    Computed from calendar date and time of day, so it does not depend on the session time zone.
    """
    days = F.datediff(F.to_date(end), F.to_date(start))
    return (days - F.when(_second_of_day(end) < _second_of_day(start), 1).otherwise(0)).cast("int")


def money_k(value: Column, decimals: int = 1) -> Column:
    """'£12.3K' (E5/E6): rounded half-even first, as Python's formatting does."""
    return F.concat(F.lit("£"), F.format_string(f"%.{decimals}f", F.bround(value / 1000.0, decimals)), F.lit("K"))


def money_units(value: Column) -> Column:
    """'£123' with no decimals (E5)."""
    return F.concat(F.lit("£"), F.format_string("%.0f", F.bround(value, 0)))


def thousands(value: Column) -> Column:
    """'1,234,567' for an integer count (E5)."""
    return F.format_number(value.cast("bigint"), 0)


def health_score(recency: Column, frequency: Column, monetary: Column) -> Column:
    """0-100 score from raw recency (days), frequency (orders) and monetary value."""
    r = F.when(recency < 30, 40).when(recency < 90, 20).otherwise(5)
    f = F.when(frequency >= 10, 30).when(frequency >= 5, 20).otherwise(5)
    m = F.when(monetary >= 1000, 30).when(monetary >= 300, 20).otherwise(5)
    return (r + f + m).cast("int")


def health_label(score: Column) -> Column:
    """Healthy / Average / At Risk."""
    healthy, average, at_risk = HEALTH_LABELS
    return F.when(score >= 70, healthy).when(score >= 40, average).otherwise(at_risk)


def advice(segment: Column, table: str = "lookup") -> Column:
    """Advice text for a segment name with a default (E9, J4); a literal map, no join."""
    mapping, default = (
        (ADVICE_LOOKUP, ADVICE_LOOKUP_DEFAULT) if table == "lookup" else (ADVICE_PREDICT, ADVICE_PREDICT_DEFAULT)
    )
    lit_map = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(lit_map, segment), F.lit(default))
