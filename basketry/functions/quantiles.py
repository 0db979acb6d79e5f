"""Exact quantiles with linear interpolation, computed without one task seeing every value.

Spark's exact ``percentile`` keeps a map of every distinct value of a group in one aggregation buffer; for
a global quantile that is the whole column in one task. Here the wanted ranks are narrowed down by counting:

1. one pass counts the values of each sign and power of two (at most about 4,200 groups a column, whatever the values),
   with the least and greatest value of each. A quantile ``p`` needs the values at ranks ``floor(h)`` and
   ``ceil(h)`` with ``h = p·(n - 1)``, as in pandas ``quantile``, Spark ``percentile`` and DuckDB ``quantile_cont``;
   the group that holds a rank is its interval;
2. while an interval holds more than FEW values, a further pass counts it in ``buckets`` of equal width between its
   least and greatest value. Ranks in one interval share it and are counted once. Values of an interval differ by less than
   a factor of two, so five passes tell any two doubles apart, also with the heaviest tails;
3. a last pass counts the distinct values of the intervals that are left, at most FEW each.

All passes aggregate in the tasks first; the driver gets counts of buckets, bounded by the parameters. Calling
this runs the passes. No result depends on a sketch or a setting.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, FEW = 4096, 20_000


def _power(v: Column) -> Column:
    """A number that grows with v: the sign and power of two (Java's logarithm never falls where its argument grows)."""
    size = F.when(F.abs(v) == float("inf"), F.lit(1030)).otherwise(F.floor(F.log2(F.abs(v)))) + 1100
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0)).cast("int")


def _narrowed(rows: list, ranks: Sequence[int], below: int) -> dict:
    """(least, greatest) of the bucket that holds each rank -> (values below it, its count, its ranks)."""
    rows = sorted(rows, key=lambda r: r["lo"])
    ends = list(itertools.accumulate((r["c"] for r in rows), initial=below))
    out: dict = {}
    for rank in ranks:
        at = bisect.bisect_right(ends, rank) - 1
        out.setdefault((rows[at]["lo"], rows[at]["hi"]), (ends[at], rows[at]["c"], []))[2].append(rank)
    return out


def values_at(df: DataFrame, cols: Sequence[str], ranks_of: Callable[[str, int], Sequence[int]], buckets: int = BUCKETS, few: int = FEW) -> tuple[dict, dict]:
    """The number n of values per column, and the value at each rank (from 0) that ``ranks_of(column, n)`` asks for."""
    spark = df.sparkSession
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "k", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    tally = [F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    powers = long.groupBy("k", _power(F.col("v")).alias("power")).agg(*tally).collect()  # at most 4,200 a column
    sizes, found, open_ = {}, {}, []
    for c in cols:
        rows = [r for r in powers if r["k"] == c]
        sizes[c] = sum(r["c"] for r in rows)
        ranks = sorted(r for r in set(ranks_of(c, sizes[c])) if 0 <= r < sizes[c])
        open_ += [(c, *ends, *rest) for ends, rest in _narrowed(rows, ranks, 0).items()]
    last = []
    while open_:
        for c, lo, hi, below, count, ranks in open_:
            if lo == hi:
                found.update({(c, r): lo for r in ranks})
            elif count <= few:
                last.append((c, lo, hi, below, count, ranks))
        open_ = [x for x in open_ if x[1] < x[2] and x[4] > few]
        if not open_:
            break
        bounds = F.broadcast(spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(open_)], "i int, k string, lo double, hi double"))  # one row per rank at most
        inside = long.join(bounds, "k").where(F.col("v").between(F.col("lo"), F.col("hi")))
        # the bucket grows with the value, so the values between a bucket's ends are its members; halves keep the width finite
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        bucket = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counted = inside.groupBy("i", bucket.alias("bucket")).agg(*tally).collect()  # `buckets` rows per interval
        open_ = [(open_[i][0], *ends, *rest) for i in range(len(open_))
                 for ends, rest in _narrowed([r for r in counted if r["i"] == i], open_[i][5], open_[i][3]).items()]
    if last:
        bounds = F.broadcast(spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(last)], "i int, k string, lo double, hi double"))
        inside = long.join(bounds, "k").where(F.col("v").between(F.col("lo"), F.col("hi")))
        values = inside.groupBy("i", F.col("v").alias("lo")).agg(F.count(F.lit(1)).alias("c")).withColumn("hi", F.col("lo")).collect()  # `few` rows per interval
        for i, (c, _, _, below, _, ranks) in enumerate(last):
            for (v, _), (_, _, own) in _narrowed([r for r in values if r["i"] == i], ranks, below).items():
                found.update({(c, r): v for r in own})
    return sizes, found


def value_at(df: DataFrame, col: str, rank_of: Callable[[int], int]) -> float | None:
    """The value at rank ``rank_of(n)`` (from 0) of the n values of a column; None if there is none."""
    _, found = values_at(df, [col], lambda _, n: [rank_of(n)])
    return next(iter(found.values()), None)


def exact_quantiles(df: DataFrame, specs: Sequence[tuple[str, str, float]], buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """One-row DataFrame with a double column per ``(name, column, p)`` spec; nulls and NaN are ignored, no values give null."""
    if not specs:
        raise ValueError("no quantiles requested")
    for _, _, p in specs:
        if not 0.0 <= p <= 1.0:
            raise ValueError(f"probability {p} outside [0, 1]")
    cols = sorted({c for _, c, _ in specs})
    sizes, found = values_at(df, cols, lambda c, n: [f(p * (n - 1)) for _, col, p in specs if col == c for f in (math.floor, math.ceil)], buckets, few)
    row = []
    for _, c, p in specs:
        h = p * (sizes[c] - 1)
        if not sizes[c]:
            row.append(None)
            continue
        v0, v1, part = found[c, math.floor(h)], found[c, math.ceil(h)], h - math.floor(h)
        row.append(float(v0 + (v1 - v0) * part) if part else float(v0))
    return df.sparkSession.createDataFrame([tuple(row)], ", ".join(f"`{name}` double" for name, _, _ in specs))
