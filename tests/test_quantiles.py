"""Exact quantiles: intervals by powers of two, refined by buckets, down to a few values."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from basketry.functions.quantiles import exact_quantiles


def _np_q(x, p):
    return float(np.quantile(np.asarray(x, dtype=float), p))  # linear interpolation


@pytest.mark.parametrize("buckets", [4096, 3])
def test_matches_numpy_with_hot_value(spark, buckets):
    rng = np.random.default_rng(7)
    # a third of all rows share one value, the rest are spread over several scales
    x = np.concatenate([np.full(20_000, 42.0), rng.lognormal(3, 2, 30_000), rng.integers(0, 50, 10_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    specs = [(f"p{int(p * 1000)}", "v", p) for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)]
    row = exact_quantiles(df, specs, buckets=buckets).first()
    for name, _, p in specs:
        assert row[name] == pytest.approx(_np_q(x, p), rel=1e-12, abs=1e-9), (name, buckets)


def test_several_columns_and_nulls(spark):
    rows = [(float(i), None if i % 3 == 0 else float(i * i)) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "a double, b double")
    got = exact_quantiles(df, [("qa", "a", 0.75), ("qb", "b", 0.25)]).first()
    assert got.qa == pytest.approx(_np_q([r[0] for r in rows], 0.75))
    assert got.qb == pytest.approx(_np_q([r[1] for r in rows if r[1] is not None], 0.25))


def test_no_sketch_in_the_plan(spark):
    df = spark.range(100).withColumn("a", F.col("id") * 1.5)
    plan = exact_quantiles(df, [("q", "a", 0.5)])._jdf.queryExecution().toString()
    assert "percentile" not in plan


PS = (0.0, 0.001, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


@pytest.mark.parametrize("buckets, few", [(4096, 20_000), (16, 50), (2, 1)])
def test_heavy_tails_of_both_signs(spark, buckets, few):
    """Values over six hundred orders of magnitude, zeros, repeats, close neighbours and infinities."""
    rng = np.random.default_rng(11)
    x = np.concatenate([10.0 ** rng.uniform(-300, 300, 400), -(10.0 ** rng.uniform(-300, 300, 400)), np.zeros(50), np.full(200, 7.5), 1.0 + np.arange(300) * 2.0**-52,
                        [5e-324, -5e-324, 1.7e308, -1.7e308, np.inf]])
    df = spark.createDataFrame([(float(v), None if k % 2 else float(k)) for k, v in enumerate(x)] + [(float("nan"), None)], "v double, w double")
    specs = [(f"p{k}", "v", p) for k, p in enumerate(PS)] + [(f"w{k}", "w", p) for k, p in enumerate(PS)]
    row = exact_quantiles(df, specs, buckets=buckets, few=few).first()
    ordered, halves = np.sort(x), np.arange(0, len(x), 2).astype(float)
    for k, p in enumerate(PS):
        h = p * (len(x) - 1)
        low, high = ordered[int(np.floor(h))], ordered[int(np.ceil(h))]
        want = low + (high - low) * (h - np.floor(h)) if h != np.floor(h) else low
        assert row[f"p{k}"] == want and row[f"w{k}"] == pytest.approx(_np_q(halves, p), rel=1e-12)


def test_no_values_give_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert tuple(exact_quantiles(df, [("qa", "a", 0.5), ("qb", "b", 0.5)]).first()) == (None, 1.0)
