"""Degenerate inputs: nothing crashes and the answers are the defined ones."""

from basketry.operators import clean as C
from basketry.operators import dbscan as DB
from basketry.operators import evaluate as EV
from basketry.operators import metrics as M
from basketry.operators import rfm as R

LINE_SCHEMA = ("InvoiceNo long, Description string, Quantity double, InvoiceDate timestamp_ntz, UnitPrice double, "
               "CustomerID long, Country string")


def test_dbscan_without_core_points_is_all_noise(spark):
    sparse = spark.createDataFrame([(i, float(i * 10), 0.0, 0.0) for i in range(6)], "id long, a double, b double, c double")
    s = DB.dbscan_summary(DB.dbscan(sparse, ["a", "b", "c"], "id")).first()
    assert (s.clusters, s.noise_pct, s.core_points, s.points) == (0, 100.0, 0, 6)


def test_scores_need_two_clusters(spark):
    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0, 0) for i in range(5)], "id long, a double, b double, c double, label int")
    assert EV.silhouette_exact(pts, ["a", "b", "c"], "label").first()[0] is None
    assert EV.silhouette_linear(pts, ["a", "b", "c"], "label").first()[0] is None
    assert EV.davies_bouldin(pts, ["a", "b", "c"], "label").first()[0] is None


def test_empty_lines(spark):
    lines = C.clean_sales(spark.createDataFrame([], LINE_SCHEMA))
    assert M.kpis(lines).first().asDict() == {"total_revenue": 0.0, "total_orders": 0, "customer_count": 0,
                                              "avg_order_value": 0.0}
    assert R.rfm(lines).count() == 0 and R.rule_segments(R.rfm(lines)).count() == 0
    assert M.sales_heatmap(lines).count() == 0 and M.sales_heatmap_wide(lines).count() == 0
    assert M.histogram(M.basket_values(lines), "BasketValue").count() == 0
    assert M.top_products(lines).count() == 0 and M.monthly_revenue(lines).count() == 0
