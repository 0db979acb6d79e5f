"""Plans: dashboard composition, segmentation model, batch scoring, A28 over one input."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from basketry.operators import clean as C
from basketry.operators import filters as FL
from basketry.plans.dashboard import dashboard, get_metrics
from basketry.plans.segmentation import build_segment_model

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    from basketry.sources.adapters import event_sales

    return C.clean_sales(event_sales(spark, "/root/testdata/sf0.01"))


@pytest.fixture(scope="module")
def model(lines):
    return build_segment_model(lines, k=4, n_init=2, max_iter=50)


def test_get_metrics_tables(lines):
    m = get_metrics(lines, persist="cache")
    assert {"kpis", "monthly_revenue", "top_products", "heatmap", "basket_shape"} <= set(m)
    assert m["kpis"].first().total_orders == lines.select("InvoiceNo").distinct().count()
    assert m["heatmap"].count() == 7 * 24


def test_model_names_and_segments(model):
    cust = model.customers
    assert set(model.names.values()) == {"VIP", "Lost", "Loyal", "Regular"}
    assert cust.where(F.col("KMSegment").isNull()).count() == 0
    assert {r.Segment for r in cust.select("Segment").distinct().collect()} <= {
        "Low Value", "High Value", "Loyal", "Recent"}
    # VIP has the highest mean Monetary
    means = {r.KMSegment: r.m for r in cust.groupBy("KMSegment").agg(F.avg("Monetary").alias("m")).collect()}
    assert max(means, key=means.get) == "VIP"


def test_score_customers_batch(spark, model):
    batch = spark.createDataFrame([(5, 12, 2000.0), (400, 1, 10.0)], "Recency int, Frequency long, Monetary double")
    out = model.score(batch).orderBy("Recency").collect()
    assert out[0].HealthScore == 100 and out[0].HealthLabel == "Healthy"
    assert out[1].HealthScore == 15 and out[1].HealthLabel == "At Risk"
    assert all(r.KMSegment in model.names.values() and r.Advice for r in out)
    # scoring the training customers reproduces their clusters
    again = model.score(model.customers.select("CustomerID", "Recency", "Frequency", "Monetary"))
    diff = again.join(model.customers.select("CustomerID", F.col("Cluster").alias("c0")), "CustomerID").where(
        F.col("Cluster") != F.col("c0"))
    assert diff.count() == 0


def test_dashboard_filters_and_pies(lines, model):
    spec = FL.FilterSpec(start="2024-01-05", end="2024-01-25", segment="VIP", basket="Small")
    view = dashboard(lines, model.customers, spec)
    assert view["lines"].storageLevel.useDisk
    k = view["kpis"].first()
    vip = {r.CustomerID for r in model.customers.where("KMSegment = 'VIP'").select("CustomerID").collect()}
    filtered = FL.apply_filters(lines, model.customers, spec)
    assert {r.CustomerID for r in filtered.select("CustomerID").distinct().collect()} <= vip
    assert k.total_orders == filtered.select("InvoiceNo").distinct().count()
    km = view["km_segments"].collect()
    assert [r.Segment for r in km] == ["VIP"] or k.total_orders == 0
    lo, hi = datetime(2024, 1, 5), datetime(2024, 1, 25)
    bounds = filtered.agg(F.min("InvoiceDate"), F.max("InvoiceDate")).first()
    assert bounds[0] is None or (bounds[0] >= lo and bounds[1] <= hi)
    from basketry.plans.dashboard import release

    assert view["heatmap"].is_cached
    release(view)
    assert not view["lines"].is_cached and not view["heatmap"].is_cached


def test_overview_filter_variant(lines, model):
    spec = FL.FilterSpec.overview(start="2024-01-10", basket="Medium")   # one date bound: no date filter
    got = FL.apply_filters(lines, model.customers, spec)
    totals = lines.groupBy("InvoiceNo").agg(F.sum("TotalPrice").alias("v"))
    medium = {r.InvoiceNo for r in totals.where("v >= 20 AND v <= 100").collect()}
    assert {r.InvoiceNo for r in got.select("InvoiceNo").distinct().collect()} == medium


def test_holdout_scaler_choice(model):
    from basketry.operators import cluster as CL

    rfm = model.customers.select("CustomerID", "Recency", "Frequency", "Monetary")
    for scale_on in ("all", "train"):
        r = CL.holdout_rfm(rfm, scale_on=scale_on, n_init=2, max_iter=30).first()
        assert 0 <= r.gap <= 2 and r.verdict in ("Good", "Check") and r.silhouette_method == "squared_euclidean"
