"""Property tests (hypothesis) for invariants that must hold on any input."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from basketry.functions.quantiles import exact_quantiles
from basketry.operators import filters as FL

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(values=st.lists(st.floats(-1e6, 1e6, allow_nan=False, allow_infinity=False), min_size=1, max_size=300),
       ps=st.lists(st.floats(0, 1), min_size=1, max_size=4), buckets=st.sampled_from([2, 16, 4096]))
def test_exact_quantiles_match_numpy(spark, values, ps, buckets):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    specs = [(f"q{i}", "v", p) for i, p in enumerate(ps)]
    row = exact_quantiles(df, specs, buckets=buckets).first()
    for name, _, p in specs:
        assert row[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-6)


@SETTINGS
@given(totals=st.lists(st.sampled_from([0.5, 19.99, 20.0, 49.99, 50.0, 100.0, 150.0, 199.99, 200.0, 1000.0]),
                       min_size=1, max_size=40),
       variant_a=st.booleans())
def test_basket_bands_partition_orders(spark, totals, variant_a):
    rows = [(i, float(t)) for i, t in enumerate(totals)]
    df = spark.createDataFrame(rows, "InvoiceNo long, TotalPrice double")
    edges, inclusive = ((20.0, 100.0), True) if variant_a else ((50.0, 200.0), False)
    got = {}
    for band in FL.BANDS:
        got[band] = {r[0] for r in FL.filter_basket(df, band, edges, inclusive).select("InvoiceNo").collect()}
    assert set().union(*got.values()) == set(range(len(totals)))
    assert sum(len(v) for v in got.values()) == len(totals)
    lo, hi = edges
    for i, t in enumerate(totals):
        want = "Small" if t < lo else ("Medium" if (t <= hi if inclusive else t < hi) else "Large")
        assert i in got[want]
