"""Scale properties that must survive refactoring, checked on the physical plans."""

import pytest

from basketry.operators import clean as C
from basketry.operators import filters as FL
from basketry.operators import metrics as M
from basketry.operators import rfm as R
from basketry.sources.adapters import sales_lines

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    """The formatted plan (node details untruncated), as ``df.explain("formatted")`` prints it."""
    jvm = df.sparkSession._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pushed(p: str) -> str:
    return "\n".join(line for line in p.splitlines() if line.startswith("PushedFilters"))


@pytest.fixture(scope="module")
def lines(spark):
    return C.clean_sales(sales_lines(spark, SF))


def test_distinct_counts_are_two_level(lines):
    p = plan(M.purchase_frequency(lines))
    # first shuffle on (customer, invoice) spreads a hot customer; no Expand
    assert "hashpartitioning(CustomerID" in p and "InvoiceNo" in p and "Expand" not in p
    p = plan(R.rfm(lines))
    assert "Expand" not in p


def test_kpis_read_their_input_once(lines):
    df = M.kpis(lines)
    df.collect()
    final = plan(df)
    assert "ReusedExchange" in final
    assert "Expand" not in final


def test_filters_reach_the_scan(spark, lines):
    df = FL.filter_dates(FL.filter_country(lines, ["NATION_1"]), "1996-01-01", "1996-12-31")
    p = pushed(plan(df))
    assert "n_name,NATION_1" in p.replace(" ", "")
    assert "GreaterThanOrEqual(o_orderdate" in p and "LessThanOrEqual(o_orderdate" in p


def test_scans_read_only_needed_columns(spark):
    p = plan(M.monthly_revenue(C.clean_sales(sales_lines(spark, SF))))
    schemas = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert schemas and not any(c in line for line in schemas for c in ("l_tax", "l_shipdate", "c_acctbal", "p_brand"))


def test_no_cartesian_products(lines):
    for df in (M.kpis(lines), M.sales_heatmap(lines), R.rule_segments(R.rfm(lines)), M.histogram(
            M.basket_values(lines, None), "BasketValue")):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
