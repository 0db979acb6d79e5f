"""Recency / frequency / monetary tables and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.columns import advice, elapsed_days, health_label, health_score
from basketry.functions.quantiles import exact_quantiles
from basketry.operators.metrics import share_of_total
from basketry.session import materialize

# Rule-segment names and thresholds of the analysed application.
SEGMENT_LOW, SEGMENT_HIGH, SEGMENT_LOYAL, SEGMENT_RECENT = "Low Value", "High Value", "Loyal", "Recent"
RULE_QUANTILE = 0.75
RECENT_DAYS = 30


def rfm(df: DataFrame, materialized: bool = True) -> DataFrame:
    """M1: one row per customer.

    Recency = whole days from the customer's last order to the snapshot (latest order time + 1
    day), Frequency = distinct invoices, Monetary = sum of TotalPrice. Aggregated in two levels,
    (customer, invoice) then customer, so neither a hot customer nor a hot invoice puts its raw
    lines on a single task.

    With ``materialized`` (default) the per-customer aggregate is written once as a table in the
    checkpoint folder: the snapshot scalar subquery then scans that small table instead of making
    a second pass over the lines, and every later consumer (quantiles, scaling, fits) reads it.
    The group of lines without a customer is kept until after the snapshot, so the snapshot is
    the latest time over all lines.
    """
    per_order = df.groupBy("CustomerID", "InvoiceNo").agg(
        F.max("InvoiceDate").alias("last"), F.sum("TotalPrice").alias("value"))
    per_customer = per_order.groupBy("CustomerID").agg(
        F.max("last").alias("last"),
        F.count("InvoiceNo").alias("Frequency"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias("Monetary"),
    )
    if materialized:
        per_customer = materialize(per_customer)
    snapshot = per_customer.agg((F.max("last") + F.expr("INTERVAL 1 DAY")).alias("snapshot")).scalar()
    # bind the scalar subquery to one column: every reference to the Column object itself would
    # add another copy of the subquery to the plan
    return per_customer.where(F.col("CustomerID").isNotNull()).withColumn("_snapshot", snapshot).select(
        F.col("CustomerID").cast("bigint").alias("CustomerID"),
        elapsed_days(F.col("last"), F.col("_snapshot")).alias("Recency"),
        F.col("Frequency").cast("bigint").alias("Frequency"),
        F.col("Monetary").cast("double").alias("Monetary"),
    )


def rule_thresholds(rfm_df: DataFrame, p: float = RULE_QUANTILE) -> DataFrame:
    """Exact 75th percentiles (linear interpolation) of Monetary and Frequency, one row."""
    return exact_quantiles(rfm_df, [("monetary_q", "Monetary", p), ("frequency_q", "Frequency", p)])


def rule_segments(rfm_df: DataFrame, p: float = RULE_QUANTILE) -> DataFrame:
    """M2: rule segment per customer; later rules win.

    In order: everyone Low Value; Monetary > q75 High Value; Frequency > q75 Loyal; Recency < 30
    Recent. Tested in reverse as one CASE. The thresholds are one scalar subquery.
    """
    q = rule_thresholds(rfm_df, p).select(F.struct("monetary_q", "frequency_q").alias("q")).scalar()
    seg = (
        F.when(F.col("Recency") < RECENT_DAYS, SEGMENT_RECENT)
        .when(F.col("Frequency") > F.col("_q.frequency_q"), SEGMENT_LOYAL)
        .when(F.col("Monetary") > F.col("_q.monetary_q"), SEGMENT_HIGH)
        .otherwise(SEGMENT_LOW)
    )
    return rfm_df.withColumn("_q", q).withColumn("Segment", seg).drop("_q")


def describe_rfm(rfm_df: DataFrame, cols=("CustomerID", "Recency", "Frequency", "Monetary")) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per column (long form).

    One row per statistic (``stat``), one double column per input column.
    """
    cols = list(cols)
    moments = rfm_df.agg(
        *[F.count(c).cast("double").alias(f"count__{c}") for c in cols],
        *[F.avg(c).alias(f"mean__{c}") for c in cols],
        *[F.stddev_samp(c).alias(f"std__{c}") for c in cols],
        *[F.min(c).cast("double").alias(f"min__{c}") for c in cols],
        *[F.max(c).cast("double").alias(f"max__{c}") for c in cols],
    )
    quarts = exact_quantiles(
        rfm_df, [(f"{tag}__{c}", c, p) for c in cols for tag, p in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75))]
    )
    stats = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]
    one = moments.select(F.struct(*moments.columns).alias("m")).scalar()
    qs = quarts.select(F.struct(*[f"`{c}`" for c in quarts.columns]).alias("q")).scalar()
    # each scalar subquery is bound to one column, then read field by field
    base = rfm_df.sparkSession.range(1).select(one.alias("_m"), qs.alias("_q"))
    rows = []
    for s in stats:
        src = F.col("_q") if "%" in s else F.col("_m")
        rows.append(F.struct(F.lit(s).alias("stat"), *[src.getField(f"{s}__{c}").alias(c) for c in cols]))
    return base.select(F.inline(F.array(*rows)))


def segment_counts(seg_df: DataFrame, by: str = "Segment") -> DataFrame:
    """A20/A21 + W2 + T3: customers per segment, share in percent (1 dp), count descending.

    ``Smallest`` flags the first minimum in that order (the slice the chart pulls out).
    """
    from pyspark.sql import Window

    counts = (
        seg_df.where(F.col(by).isNotNull())
        .groupBy(F.col(by).alias("Segment"))
        .agg(F.count(F.lit(1)).alias("Count"))
    )
    counts = share_of_total(counts)
    smallest = F.row_number().over(Window.orderBy(F.asc("Count"), F.asc("Segment"))) == 1
    return counts.withColumn("Smallest", smallest).orderBy(F.desc("Count"), F.asc("Segment"))


def customer_profiles(seg_df: DataFrame) -> DataFrame:
    """M3: per customer R/F/M, segments, health score and label, and advice for the rule segment."""
    cols = [
        "CustomerID",
        "Recency",
        "Frequency",
        F.bround("Monetary", 2).alias("Monetary"),
        "Segment",
    ]
    if "KMSegment" in seg_df.columns:
        cols.append("KMSegment")
    score = health_score(F.col("Recency"), F.col("Frequency"), F.col("Monetary"))
    return seg_df.select(
        *cols,
        score.alias("HealthScore"),
        health_label(score).alias("HealthLabel"),
        advice(F.col("Segment"), "lookup").alias("Advice"),
    )


def customer_cards(seg_df: DataFrame) -> DataFrame:
    """M3 display: the lookup card's text fields per customer ('12d', '£1,234', segment, advice).

    Monetary is rounded to 2 dp first and then shown without decimals, both half to even, as the
    card does; the first step also absorbs summation-order noise at a .5 tie.
    """
    monetary = F.concat(F.lit("£"), F.format_number(F.bround(F.bround(F.col("Monetary"), 2), 0), 0))
    return seg_df.select(
        F.col("CustomerID").cast("string").alias("CustomerID"),
        F.concat(F.col("Recency").cast("string"), F.lit("d")).alias("RecencyText"),
        F.col("Frequency").cast("string").alias("FrequencyText"),
        monetary.alias("MonetaryText"),
        "Segment",
        advice(F.col("Segment"), "lookup").alias("Advice"),
    )
