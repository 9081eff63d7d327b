"""The metric layer over every metric, operation and grouping."""

import itertools

import pytest

from tests.oracle import duck
from zocalo.plans.marketplace import Marketplace
from zocalo.plans.metrics import GROUPINGS, METRICS, OPERATIONS, MetricSpec, metric_query
from zocalo.queries.views import with_views

PATH = "/root/testdata/sf0.001"
ITEMS = """SELECT i.*, o.customer_id, customer_state, date_trunc('month', order_purchase_timestamp) AS month,
  coalesce(product_category_name_english, p.product_category_name) AS category FROM m_items i JOIN m_orders o USING (order_id)
  JOIN m_customers USING (customer_id) JOIN m_products p USING (product_id) LEFT JOIN m_translation t ON p.product_category_name = t.product_category_name"""
CASES = {
    ("review_score", "carrier"): f"SELECT carrier_id, avg(review_score) FROM m_reviews JOIN (SELECT DISTINCT order_id, carrier_id FROM ({ITEMS})) USING (order_id) GROUP BY 1",
    ("on_time_rate", "state"): f"SELECT customer_state, avg(on_time_rate) FROM m_carriers JOIN (SELECT DISTINCT carrier_id, customer_state FROM ({ITEMS})) USING (carrier_id) GROUP BY 1",
    ("stock_qty", "carrier"): f"SELECT carrier_id, sum(stock_qty) FROM m_inventory JOIN (SELECT DISTINCT product_id, seller_id, carrier_id FROM ({ITEMS})) USING (product_id, seller_id) GROUP BY 1",
    ("stock_qty", "state"): f"SELECT customer_state, sum(stock_qty) FROM m_inventory JOIN (SELECT DISTINCT product_id, seller_id, customer_state FROM ({ITEMS})) USING (product_id, seller_id) GROUP BY 1",
    ("returns_count", "carrier"): f"SELECT carrier_id, count(*) FROM m_returns JOIN (SELECT DISTINCT order_id, product_id, seller_id, carrier_id FROM ({ITEMS})) USING (order_id, product_id, seller_id) GROUP BY 1",
    ("incidents_count", "category"): f"SELECT category, count(*) FROM m_incidents JOIN (SELECT DISTINCT order_id, category FROM ({ITEMS})) USING (order_id) GROUP BY 1",
    ("on_time_rate", "month"): f"SELECT month, avg(on_time_rate) FROM m_carriers JOIN (SELECT DISTINCT carrier_id, month FROM ({ITEMS})) USING (carrier_id) GROUP BY 1",
    ("order_count", "state"): "SELECT customer_state, count(DISTINCT order_id) FROM m_orders JOIN m_customers USING (customer_id) GROUP BY 1",
}


@pytest.fixture(scope="module")
def market(spark):
    return Marketplace(spark, PATH)


@pytest.mark.parametrize("metric,group", list(CASES))
def test_groupings_over_items_equal_sql(market, metric, group):
    got = {r[0]: float(r[1]) for r in metric_query(market, MetricSpec(metric, group_by=(group,))).collect()}
    expected = {r[0]: float(r[1]) for r in duck(PATH).execute(with_views(CASES[metric, group])).fetchall()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_every_combination_has_a_plan(market):
    few = itertools.product(("ticket_count", "revenue"), OPERATIONS, (None, "category"))
    for metric, operation, group in [*itertools.product(METRICS, (None,), (None, *GROUPINGS)), *few]:
        spec = MetricSpec(metric, operation, (group,) if group else (), compare=("1", "2") if operation == "compare" else ())
        if operation == "compare" and not group or operation in ("average", "median") and not group and METRICS[metric].aggregate.startswith("count"):
            with pytest.raises(ValueError):
                metric_query(market, spec)
        else:
            assert metric_query(market, spec).columns


def test_counts_are_not_taken_over_ids(market):
    one = lambda m, op, g=(): metric_query(market, MetricSpec(m, op, g)).collect()[0][0]
    con = duck(PATH)
    sql = lambda text: con.execute(with_views(text)).fetchone()[0]
    assert one("ticket_count", "sum") == sql("SELECT count(*) FROM m_tickets")
    months = "(SELECT count(*) AS n FROM m_returns GROUP BY date_trunc('month', return_date))"
    assert one("returns_count", "average", ("month",)) == pytest.approx(sql(f"SELECT avg(n) FROM {months}"))
    assert one("returns_count", "median", ("month",)) == sql(f"SELECT median(n) FROM {months}")


def test_several_metrics_keep_every_group(market):
    rows = metric_query(market, MetricSpec(("ticket_count", "satisfaction_score", "revenue"), group_by=("state",))).collect()
    assert len(rows) == 25 and all(len(r) == 4 for r in rows)
    plan = metric_query(market, MetricSpec(("revenue", "freight_value"), group_by=("month",)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2


def test_ranking_without_grouping_and_typed_comparison(market):
    assert metric_query(market, MetricSpec("revenue", "rank_desc")).count() == 1
    row = metric_query(market, MetricSpec("revenue", "compare", ("month",), compare=("1998-01-01", "1998-02-01"))).collect()[0]
    assert row["1998-01-01"] > 0 and row["1998-02-01"] > 0
    assert metric_query(market, MetricSpec("refund_amount", "detail")).count() > 200


def test_questions_become_metric_queries(spark):
    from zocalo.operators.structuring import structure
    from zocalo.plans.answering import spec_of
    asked = {"¿Cuál fue el total vendido por mes en 2018?": ("revenue", "sum", ("month",), (), ("2018-01-01", "2018-12-31")),
             "¿Cuántas órdenes canceladas hubo?": ("order_count", "count", (), (("order_status", "canceled"),), None),
             "Mediana del precio por categoria": ("price", "median", ("category",), (), None),
             "promedio de ordenes": ("order_count", None, (), (), None),
             "total de flete y ventas por vendedor": (("revenue", "freight_value"), "sum", ("seller",), (), None)}
    rows = structure(spark.createDataFrame([(q,) for q in asked], "question string"), "question").collect()
    for r in rows:
        s = spec_of(r)
        assert (s.metric, s.operation, s.group_by, s.filters, s.date_range) == asked[r["question"]]
    with pytest.raises(ValueError):
        spec_of(structure(spark.createDataFrame([("hola",)], "question string"), "question").first())
