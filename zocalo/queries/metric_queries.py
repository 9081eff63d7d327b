"""Metrics, operations, groupings, filters and simple projections (F, A, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo.operators import aggregates, filters, ranking
from zocalo.plans.answering import answer
from zocalo.plans.metrics import MetricSpec, metric_query, month_of
from zocalo.queries.registry import query


def as_double(df, *columns):
    return df.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in columns})


def iso_day(name):
    return F.date_format(name, "yyyy-MM-dd")


# --- filters and projections ------------------------------------------------------------------

@query("F01_flt_catalogue_equality", """
SELECT count(*) AS orders, CAST(round(CAST(sum(order_total) AS DOUBLE), 2) AS DOUBLE) AS total
FROM m_orders JOIN m_customers USING (customer_id)
WHERE customer_state = 'NATION_7' AND order_status = 'delivered' AND payment_type = 'boleto'""")
def _(m):
    states = m.customers()
    df = m.orders().join(states, "customer_id")
    wanted = [("state", "NATION_7"), ("order_status", "delivered"), ("payment_type", "boleto")]
    return (df.filter(filters.equals_all(wanted, {"state": "customer_state"}))
            .agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("order_total").cast("double"), 2).alias("total")))


@query("F02_flt_date_range", """
SELECT count(*) AS orders, strftime(min(order_purchase_timestamp), '%Y-%m-%d') AS first_day,
       strftime(max(order_purchase_timestamp), '%Y-%m-%d') AS last_day
FROM m_orders WHERE CAST(order_purchase_timestamp AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'""")
def _(m):
    return (m.orders().filter(filters.in_days("order_purchase_timestamp", "1997-01-01", "1998-12-31"))
            .agg(F.count(F.lit(1)).alias("orders"), iso_day(F.min("order_purchase_timestamp")).alias("first_day"),
                 iso_day(F.max("order_purchase_timestamp")).alias("last_day")))


@query("F03_flt_delivered_only", """
SELECT order_id, customer_id FROM m_dated_orders WHERE order_delivered_customer_date IS NOT NULL""")
def _(m):
    return m.dated_orders().filter(F.col("order_delivered_customer_date").isNotNull()).select("order_id", "customer_id")


@query("F04_flt_late_flag", """
SELECT order_id, CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 ELSE 0 END AS late
FROM m_dated_orders""")
def _(m):
    late = filters.late_flag("order_delivered_customer_date", "order_estimated_delivery_date")
    return m.dated_orders().select("order_id", late.alias("late"))


@query("F05_flt_low_stock", """
SELECT warehouse_id, product_id, seller_id, stock_qty, reorder_point FROM m_inventory WHERE stock_qty < reorder_point""")
def _(m):
    return m.inventory().filter(filters.low_stock()).drop("last_restocked_date")


@query("F06_flt_open_cases", """
SELECT 'ticket' AS kind, count(*) FILTER (WHERE NOT resolved) AS open_cases, count(*) AS all_cases FROM m_tickets
UNION ALL
SELECT 'incident', count(*) FILTER (WHERE resolved_date IS NULL), count(*) FROM m_incidents""")
def _(m):
    def summary(df, kind, is_open):
        return df.agg(F.count_if(is_open).alias("open_cases"), F.count(F.lit(1)).alias("all_cases")).withColumn("kind", F.lit(kind))
    return summary(m.tickets(), "ticket", filters.open_ticket()).unionByName(
        summary(m.incidents(), "incident", filters.open_incident()))


@query("F07_flt_row_cap_flag", """
SELECT order_id, CAST(order_total AS DOUBLE) AS order_total, (SELECT count(*) FROM m_orders WHERE order_status = 'shipped') > 200 AS truncated
FROM m_orders WHERE order_status = 'shipped' ORDER BY order_total DESC, order_id LIMIT 200""")
def _(m):
    df = m.orders().filter(F.col("order_status") == "shipped").select("order_id", F.col("order_total").cast("double"))
    return filters.cap_rows(df, [F.col("order_total").desc(), F.col("order_id").asc()])


@query("F08_prj_null_defaults", """
SELECT o.order_id, coalesce(review_score, 5) AS score, coalesce(customer_state, 'SP') AS state,
       coalesce(order_delivered_customer_date, order_purchase_timestamp) AS ticket_base
FROM m_dated_orders o LEFT JOIN (SELECT order_id, min_by(review_score, review_id) AS review_score FROM m_reviews GROUP BY order_id) r
     ON o.order_id = r.order_id
LEFT JOIN (SELECT * FROM m_customers WHERE customer_state <> 'NATION_3') c ON o.customer_id = c.customer_id""")
def _(m):
    known = m.customers().filter(F.col("customer_state") != "NATION_3")
    review = m.reviews().groupBy("order_id").agg(F.min_by("review_score", "review_id").alias("review_score"))
    return (m.dated_orders().join(review, "order_id", "left").join(known, "customer_id", "left")
            .select("order_id", F.coalesce("review_score", F.lit(5)).alias("score"),
                    F.coalesce("customer_state", F.lit("SP")).alias("state"),
                    F.coalesce("order_delivered_customer_date", "order_purchase_timestamp").alias("ticket_base")))


@query("F09_prj_category_fallback", """
SELECT coalesce(product_category_name_english, p.product_category_name) AS category, count(*) AS products
FROM m_products p LEFT JOIN m_translation t ON p.product_category_name = t.product_category_name GROUP BY 1""")
def _(m):
    return (m.products().join(m.category_translation(), "product_category_name", "left")
            .groupBy(F.coalesce("product_category_name_english", "product_category_name").alias("category"))
            .agg(F.count(F.lit(1)).alias("products")))


@query("F10_prj_clip_round", """
SELECT seller_id, product_id, order_id, order_item_id,
       CAST(sum(CAST(round_even(CAST(least(greatest(CAST(price AS DOUBLE) / 20000 - 0.5, 1), 5) AS DOUBLE), 0) AS BIGINT)) AS BIGINT) AS clipped,
       CAST(sum(CAST(greatest(price * CAST(0.5 AS DECIMAL(2,1)), CAST(0.5 AS DECIMAL(2,1))) AS DOUBLE)) AS DOUBLE) AS floored
FROM (SELECT * FROM m_items) GROUP BY ALL""")
def _(m):
    number = F.col("price").cast("double") / 20000 - 0.5
    clipped = F.bround(F.greatest(F.least(number, F.lit(5.0)), F.lit(1.0)), 0).cast("bigint")
    half = F.greatest(F.col("price") * F.lit(0.5).cast("decimal(2,1)"), F.lit(0.5).cast("decimal(2,1)")).cast("double")
    return (m.items().groupBy("seller_id", "product_id", "order_id", "order_item_id")
            .agg(F.sum(clipped).alias("clipped"), F.sum(half).alias("floored")))


@query("F11_prj_period_span", """
SELECT incident_id, strftime(reported_date + to_days(CAST(incident_id % 30 AS INTEGER)), '%Y-%m-%d') AS period_end,
       date_diff('day', CAST(reported_date AS DATE), CAST(resolved_date AS DATE)) AS resolution_days FROM m_incidents""")
def _(m):
    return m.incidents().select(
        "incident_id", F.date_format(F.date_add("reported_date", (F.col("incident_id") % 30).cast("int")), "yyyy-MM-dd").alias("period_end"),
        F.date_diff("resolved_date", "reported_date").cast("bigint").alias("resolution_days"))


# --- metrics ----------------------------------------------------------------------------------

@query("A01_met_revenue", """
SELECT customer_state AS state, CAST(sum(price) AS DOUBLE) AS revenue
FROM m_items JOIN m_orders USING (order_id) JOIN m_customers USING (customer_id)
WHERE order_status = 'delivered' GROUP BY customer_state""")
def _(m):
    return as_double(metric_query(m, MetricSpec("revenue", group_by=("state",), filters=(("order_status", "delivered"),))), "revenue")


@query("A02_met_order_count", """
SELECT coalesce(product_category_name_english, p.product_category_name) AS category, count(DISTINCT i.order_id) AS order_count
FROM m_items i JOIN m_products p USING (product_id) LEFT JOIN m_translation t ON p.product_category_name = t.product_category_name
GROUP BY 1""")
def _(m):
    return metric_query(m, MetricSpec("order_count", group_by=("category",)))


@query("A03_met_on_time_rate", """
SELECT c.carrier_id, round(max(on_time_rate), 4) AS stored_rate,
       round(avg(CASE WHEN order_delivered_customer_date <= order_estimated_delivery_date THEN 1.0 ELSE 0.0 END), 4) AS observed_rate
FROM m_carriers c JOIN m_items i ON c.carrier_id = i.carrier_id JOIN m_dated_orders o USING (order_id)
WHERE order_delivered_customer_date IS NOT NULL GROUP BY c.carrier_id""")
def _(m):
    stored = metric_query(m, MetricSpec("on_time_rate", group_by=("carrier",)))
    on_time = (F.col("order_delivered_customer_date") <= F.col("order_estimated_delivery_date")).cast("double")
    observed = (m.items().join(m.dated_orders().filter(F.col("order_delivered_customer_date").isNotNull()), "order_id")
                .groupBy("carrier_id").agg(F.round(F.avg(on_time), 4).alias("observed_rate")))
    return (observed.join(stored, F.col("carrier_id") == F.col("carrier"))
            .select("carrier_id", F.round("on_time_rate", 4).alias("stored_rate"), "observed_rate"))


@query("A04_met_freight_value", """
SELECT carrier_id AS carrier, round(CAST(sum(freight_value) AS DOUBLE), 4) AS freight_value,
       round(CAST(sum(freight_value) AS DOUBLE) / count(*), 4) AS avg_freight FROM m_items GROUP BY carrier_id""")
def _(m):
    return (m.items().groupBy(F.col("carrier_id").alias("carrier"))
            .agg(F.round(F.sum("freight_value").cast("double"), 4).alias("freight_value"),
                 F.round(F.sum("freight_value").cast("double") / F.count(F.lit(1)), 4).alias("avg_freight")))


@query("A05_met_review_score", """
SELECT date_trunc('month', order_purchase_timestamp) AS month, round(avg(review_score), 4) AS review_score
FROM m_reviews JOIN m_orders USING (order_id) GROUP BY 1""")
def _(m):
    return as_double(metric_query(m, MetricSpec("review_score", group_by=("month",))), "review_score")


@query("A06_met_stock_reorder", """
SELECT seller_id AS seller, CAST(sum(stock_qty) AS BIGINT) AS stock_qty, CAST(sum(reorder_point) AS BIGINT) AS reorder_point,
       count(*) FILTER (WHERE stock_qty < reorder_point) AS low_stock FROM m_inventory GROUP BY seller_id""")
def _(m):
    return m.inventory().groupBy(F.col("seller_id").alias("seller")).agg(
        F.sum("stock_qty").alias("stock_qty"), F.sum("reorder_point").alias("reorder_point"),
        F.count_if(filters.low_stock()).alias("low_stock"))


@query("A07_met_returns", """
SELECT date_trunc('month', return_date) AS month, count(*) AS returns_count, round(CAST(sum(refund_amount) AS DOUBLE), 4) AS refund_amount
FROM m_returns GROUP BY 1""")
def _(m):
    return as_double(metric_query(m, MetricSpec(("returns_count", "refund_amount"), group_by=("month",))), "refund_amount")


@query("A08_met_incidents", """
SELECT incident_type, count(*) AS incidents_count, round(CAST(sum(compensation_value) AS DOUBLE), 4) AS compensation_value
FROM m_incidents GROUP BY incident_type""")
def _(m):
    return as_double(m.incidents().groupBy("incident_type").agg(
        F.count(F.lit(1)).alias("incidents_count"), F.sum("compensation_value").alias("compensation_value")), "compensation_value")


@query("A09_met_tickets", """
SELECT category, priority, count(*) AS ticket_count,
       round(CAST(sum(resolution_time_hr) AS DOUBLE) / count(resolution_time_hr), 4) AS resolution_time_hr,
       round(avg(satisfaction_score), 4) AS satisfaction_score FROM m_tickets GROUP BY category, priority""")
def _(m):
    mean = F.sum("resolution_time_hr").cast("double") / F.count("resolution_time_hr")
    return m.tickets().groupBy("category", "priority").agg(
        F.count(F.lit(1)).alias("ticket_count"), F.round(mean, 4).alias("resolution_time_hr"),
        F.round(F.avg("satisfaction_score"), 4).alias("satisfaction_score"))


@query("A10_met_price", """
SELECT change_reason, round(CAST(sum(new_price - old_price) AS DOUBLE) / count(*), 4) AS avg_price_change,
       round(CAST(sum(new_price) AS DOUBLE) / count(*), 4) AS price FROM m_price_history GROUP BY change_reason""")
def _(m):
    n = F.count(F.lit(1))
    change = F.sum(F.col("new_price") - F.col("old_price")).cast("double") / n
    return m.price_history().groupBy("change_reason").agg(
        F.round(change, 4).alias("avg_price_change"), F.round(F.sum("new_price").cast("double") / n, 4).alias("price"))


@query("A05b_met_review_score_by_category", """
SELECT category, round(avg(review_score), 4) AS review_score FROM m_reviews JOIN (
  SELECT DISTINCT order_id, coalesce(product_category_name_english, p.product_category_name) AS category
  FROM m_items JOIN m_products p USING (product_id) LEFT JOIN m_translation t ON p.product_category_name = t.product_category_name) USING (order_id)
GROUP BY category""")
def _(m):
    return as_double(metric_query(m, MetricSpec("review_score", group_by=("category",))), "review_score")


@query("A08b_met_incidents_by_state", """
SELECT customer_state AS state, count(*) AS incidents_count, round(CAST(sum(compensation_value) AS DOUBLE), 4) AS compensation_value
FROM m_incidents JOIN m_orders USING (order_id) JOIN m_customers USING (customer_id) GROUP BY customer_state""")
def _(m):
    return as_double(metric_query(m, MetricSpec(("incidents_count", "compensation_value"), group_by=("state",))), "compensation_value")


@query("A09b_met_ticket_count_sum", """
SELECT seller_id AS seller, count(*) AS ticket_count FROM m_tickets JOIN (SELECT DISTINCT order_id, seller_id FROM m_items) USING (order_id)
GROUP BY seller_id""")
def _(m):
    return metric_query(m, MetricSpec("ticket_count", "sum", group_by=("seller",)))


@query("A01b_met_revenue_two_states", """
SELECT customer_state AS state, round(CAST(sum(price) AS DOUBLE), 4) AS revenue
FROM m_items JOIN m_orders USING (order_id) JOIN m_customers USING (customer_id) WHERE customer_state IN ('NATION_1', 'NATION_2') GROUP BY 1""")
def _(m):
    return as_double(metric_query(m, MetricSpec("revenue", group_by=("state",), filters=(("state", "NATION_1"), ("state", "NATION_2")))), "revenue")


@query("A13b_op_average_of_counts", """
SELECT avg(n) AS order_count FROM (SELECT date_trunc('month', order_purchase_timestamp) AS month, count(DISTINCT order_id) AS n FROM m_orders GROUP BY 1)""")
def _(m):
    return metric_query(m, MetricSpec("order_count", "average", group_by=("month",)))


@query("A11_op_count", """
SELECT count(*) AS ticket_count FROM m_tickets WHERE priority = 'critica' AND NOT resolved""")
def _(m):
    return metric_query(m, MetricSpec("ticket_count", "count", filters=(("priority", "critica"), ("resolved", "false"))))


@query("A12_op_sum", """
SELECT round(CAST(sum(price) AS DOUBLE), 4) AS revenue FROM m_items JOIN m_orders USING (order_id)
WHERE order_purchase_timestamp >= TIMESTAMP '1998-01-01' AND order_purchase_timestamp < TIMESTAMP '1999-01-01'""")
def _(m):
    return as_double(metric_query(m, MetricSpec("revenue", "sum", date_range=("1998-01-01", "1998-12-31"))), "revenue")


@query("A13_op_average", """
SELECT date_trunc('month', order_purchase_timestamp) AS month, round(avg(CAST(freight_value AS DOUBLE)), 2) AS freight_value
FROM m_items JOIN m_orders USING (order_id) GROUP BY 1""")
def _(m):
    df = metric_query(m, MetricSpec("freight_value", "average", group_by=("month",)))
    return df.withColumn("freight_value", F.round("freight_value", 2))


@query("A14_op_median", """
SELECT seller_id AS seller, CAST(median(price) AS DOUBLE) AS price FROM (SELECT seller_id, CAST(price AS DOUBLE) AS price FROM m_items)
GROUP BY seller_id""")
def _(m):
    return metric_query(m, MetricSpec("price", "median", group_by=("seller",)))


@query("A14b_op_median_per_pair", """
SELECT product_id, seller_id, median(CAST(price AS DOUBLE)) AS price_ref FROM m_items GROUP BY product_id, seller_id""")
def _(m):
    return aggregates.exact_median(m.items(), ["product_id", "seller_id"], "price", "price_ref")


@query("A15_op_compare", """
SELECT date_trunc('month', order_purchase_timestamp) AS month,
       round(CAST(sum(price) FILTER (WHERE customer_state = 'NATION_1') AS DOUBLE), 4) AS NATION_1,
       round(CAST(sum(price) FILTER (WHERE customer_state = 'NATION_2') AS DOUBLE), 4) AS NATION_2
FROM m_items JOIN m_orders USING (order_id) JOIN m_customers USING (customer_id) GROUP BY 1""")
def _(m):
    spec = MetricSpec("revenue", "compare", group_by=("state", "month"), compare=("NATION_1", "NATION_2"))
    return as_double(metric_query(m, spec), "NATION_1", "NATION_2")


@query("A16_op_detail", """
SELECT order_id, product_id, seller_id, return_reason, return_date, CAST(refund_amount AS DOUBLE) AS refund_amount, refund_method,
       (SELECT count(*) FROM m_returns WHERE return_date >= TIMESTAMP '1999-01-01' AND return_date < TIMESTAMP '1999-02-01') > 200 AS truncated
FROM m_returns WHERE return_date >= TIMESTAMP '1999-01-01' AND return_date < TIMESTAMP '1999-02-01'
ORDER BY order_id, product_id, seller_id, return_reason, return_date, refund_amount, refund_method LIMIT 200""")
def _(m):
    return as_double(metric_query(m, MetricSpec("refund_amount", "detail", date_range=("1999-01-01", "1999-01-31"), top=200)), "refund_amount")


@query("A17_grp_month", """
SELECT date_trunc('month', order_purchase_timestamp) AS month, round(CAST(sum(price) AS DOUBLE), 4) AS revenue
FROM m_items JOIN m_orders USING (order_id)
WHERE order_purchase_timestamp >= TIMESTAMP '1998-01-01' AND order_purchase_timestamp < TIMESTAMP '1999-01-01'
GROUP BY 1 ORDER BY 1""")
def monthly_revenue(m):
    return as_double(metric_query(m, MetricSpec("revenue", "sum", group_by=("month",), date_range=("1998-01-01", "1998-12-31"))), "revenue")


@query("A18_grp_dimensions", """
SELECT seller_state AS state, i.seller_id AS seller, coalesce(product_category_name_english, p.product_category_name) AS category,
       i.carrier_id AS carrier, round(CAST(sum(price) AS DOUBLE), 4) AS revenue
FROM m_items i JOIN m_sellers s ON i.seller_id = s.seller_id JOIN m_products p ON i.product_id = p.product_id
LEFT JOIN m_translation t ON p.product_category_name = t.product_category_name GROUP BY ALL""")
def _(m):
    spec = MetricSpec("revenue", group_by=("state", "seller", "category", "carrier"), state_of="seller")
    return as_double(metric_query(m, spec), "revenue")


@query("A20_agg_distinct_pairs", "SELECT DISTINCT product_id, seller_id FROM m_items")
def _(m):
    return m.items().select("product_id", "seller_id").distinct()


@query("A21_agg_repeat_buyers", """
SELECT customer_unique_id, count(*) AS delivered_orders FROM m_orders JOIN m_customers USING (customer_id)
WHERE order_status = 'delivered' GROUP BY customer_unique_id HAVING count(*) > 1""")
def _(m):
    return (m.orders().filter(F.col("order_status") == "delivered").join(m.customers(), "customer_id")
            .groupBy("customer_unique_id").agg(F.count(F.lit(1)).alias("delivered_orders"))
            .filter(F.col("delivered_orders") > 1))


@query("A22_agg_promo_units", """
SELECT promo_type, CAST(sum(units_sold_during) AS BIGINT) AS units FROM m_promotions GROUP BY promo_type""")
def _(m):
    return m.promotions().groupBy("promo_type").agg(F.sum("units_sold_during").alias("units"))


@query("A23_agg_payments", """
SELECT payment_type, count(*) AS payment_records, count(DISTINCT order_id) AS orders, round(CAST(sum(payment_value) AS DOUBLE), 4) AS paid
FROM m_payments GROUP BY payment_type""")
def _(m):
    return m.payments().groupBy("payment_type").agg(
        F.count(F.lit(1)).alias("payment_records"), F.count_distinct("order_id").alias("orders"),
        F.round(F.sum("payment_value").cast("double"), 4).alias("paid"))


# --- sorts and top-k --------------------------------------------------------------------------

@query("T01_op_rank_desc", """
SELECT seller_id AS seller, round(CAST(sum(price) AS DOUBLE), 4) AS revenue FROM m_items GROUP BY seller_id
ORDER BY revenue DESC, seller LIMIT 10""")
def _(m):
    return as_double(metric_query(m, MetricSpec("revenue", "rank_desc", group_by=("seller",), top=10)), "revenue")


@query("T02_op_rank_asc", """
SELECT carrier_id AS carrier, round(on_time_rate, 4) AS on_time_rate FROM m_carriers ORDER BY on_time_rate, carrier""")
def _(m):
    return as_double(metric_query(m, MetricSpec("on_time_rate", "rank_asc", group_by=("carrier",))), "on_time_rate")


@query("T03_op_rank_nearest_average", """
WITH r AS (SELECT customer_state AS state, CAST(sum(price) AS DOUBLE) AS revenue
           FROM m_items JOIN m_orders USING (order_id) JOIN m_customers USING (customer_id) GROUP BY 1)
SELECT state, round(revenue, 4) AS revenue, round(abs(revenue - (SELECT avg(revenue) FROM r)), 2) AS distance_to_average FROM r""")
def _(m):
    df = as_double(metric_query(m, MetricSpec("revenue", "rank_nearest_average", group_by=("state",))), "revenue")
    return df.withColumn("distance_to_average", F.round("distance_to_average", 2))


# --- questions in words -----------------------------------------------------------------------

@query("Q11_qs_answer_trend", """
SELECT date_trunc('month', order_purchase_timestamp) AS month, round(CAST(sum(price) AS DOUBLE), 4) AS revenue
FROM m_items JOIN m_orders USING (order_id) GROUP BY 1""")
def _(m):
    return as_double(answer(m, "¿Cuál fue el total vendido por mes?"), "revenue")


@query("Q11b_qs_answer_ranking", """
SELECT customer_state AS state, round(CAST(sum(freight_value) AS DOUBLE), 4) AS freight_value FROM m_items JOIN m_orders USING (order_id) JOIN m_customers USING (customer_id)
WHERE order_status = 'delivered' AND order_id IN (SELECT order_id FROM m_payments WHERE payment_type = 'credit_card') GROUP BY 1""")
def _(m):
    return as_double(answer(m, "¿Dónde se pagó el mayor flete por estado, entregado y con tarjeta?"), "freight_value")
