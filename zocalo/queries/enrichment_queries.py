"""Enrichment joins, ordered scans, sampling and integrity checks (J, W, P, D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo.operators import filters, joins, ordered, ranking, sampling
from zocalo.plans.metrics import MetricSpec, metric_query
from zocalo.queries.metric_queries import as_double
from zocalo.queries.registry import query
from zocalo.queries.views import sql_list, view

REGIONS = [f"NATION_{i}" for i in range(25)]

view("m_first_review", """
SELECT order_id, min_by(review_score, review_id) AS review_score FROM m_reviews GROUP BY order_id""")
view("m_signals", """
SELECT o.order_id, o.customer_id, CASE WHEN order_delivered_customer_date > order_estimated_delivery_date THEN 1 ELSE 0 END AS late,
       coalesce(review_score, 5) AS score
FROM m_dated_orders o LEFT JOIN m_first_review r ON o.order_id = r.order_id WHERE order_delivered_customer_date IS NOT NULL""")
view("m_coverage", f"""
SELECT DISTINCT carrier_id, region FROM (
  SELECT carrier_id, unnest(CASE WHEN contains(coverage_regions, 'NACIONAL') THEN {sql_list(REGIONS)}
                                 ELSE string_split(coverage_regions, ',') END) AS region FROM m_carriers)""")


def hash_sql(seed: str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def first_review(m):
    return ranking.best_per_key(m.reviews(), ["order_id"], ["review_id"], ["review_score"])


def signals(m):
    """Delivered orders with their first review and the late flag."""
    late = filters.late_flag("order_delivered_customer_date", "order_estimated_delivery_date")
    delivered = m.dated_orders().filter(F.col("order_delivered_customer_date").isNotNull()).withColumn("late", late)
    return (joins.left_once(delivered, m.reviews(), "order_id", ["review_id"], ["review_score"])
            .select("order_id", "customer_id", "late", F.coalesce("review_score", F.lit(5)).alias("score")))


@query("J01_join_enrich_left", """
SELECT o.order_id, coalesce(customer_state, 'SP') AS customer_state
FROM m_orders o LEFT JOIN (SELECT * FROM m_customers WHERE customer_id % 9 <> 0) c ON o.customer_id = c.customer_id""")
def _(m):
    known = m.customers().filter(F.col("customer_id") % 9 != 0)
    return (m.orders().join(known, "customer_id", "left")
            .select("order_id", F.coalesce("customer_state", F.lit("SP")).alias("customer_state")))


@query("J02_join_inner_equi", """
SELECT order_id, count(*) AS items, CAST(sum(price) AS DOUBLE) AS price
FROM m_items JOIN m_orders USING (order_id) WHERE order_status = 'delivered' GROUP BY order_id""")
def _(m):
    delivered = m.orders().filter(F.col("order_status") == "delivered").select("order_id")
    return (m.items().join(delivered, "order_id").groupBy("order_id")
            .agg(F.count(F.lit(1)).alias("items"), F.sum("price").cast("double").alias("price")))


@query("J03_join_left_dedup_right", """
SELECT o.order_id, review_score FROM m_orders o LEFT JOIN m_first_review r ON o.order_id = r.order_id""")
def _(m):
    return (joins.left_once(m.orders(), m.reviews(), "order_id", ["review_id"], ["review_score"])
            .select("order_id", "review_score"))


view("m_dated_items", """
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.price,
       CASE WHEN i.order_id % 23 <> 0 THEN o.order_purchase_timestamp END AS order_purchase_timestamp
FROM m_items i JOIN m_orders o ON i.order_id = o.order_id""")


def dated_items(m):
    """Items with the purchase time of their order; some have none."""
    orders = m.orders().select("order_id", "order_purchase_timestamp")
    known = F.when(F.col("order_id") % 23 != 0, F.col("order_purchase_timestamp"))
    return (m.items().join(orders, "order_id").withColumn("order_purchase_timestamp", known)
            .select("order_id", "order_item_id", "product_id", "seller_id", "price", "order_purchase_timestamp"))


@query("J04_join_asof_backward", """
SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, CAST(i.price AS DOUBLE) AS price, h.price_event_id
FROM m_dated_items i ASOF LEFT JOIN m_price_history h
  ON i.product_id = h.product_id AND i.seller_id = h.seller_id AND i.order_purchase_timestamp >= h.change_at""")
def _(m):
    joined = ordered.asof_backward(dated_items(m), m.price_history(), ["product_id", "seller_id"],
                                   "order_purchase_timestamp", "change_at", "price_event_id")
    return joined.drop("order_purchase_timestamp").withColumn("price", F.col("price").cast("double"))


@query("J05_join_validity_interval", """
WITH valid AS (
  SELECT i.order_id, min(struct_pack(start_date, promotion_id)) AS first
  FROM m_dated_items i JOIN m_promotions p ON i.product_id = p.product_id AND i.seller_id = p.seller_id
   AND i.order_purchase_timestamp >= p.start_date AND i.order_purchase_timestamp <= p.end_date GROUP BY i.order_id)
SELECT p.order_id, p.payment_sequential, CAST(p.payment_value AS DOUBLE) AS payment_value, v.first.promotion_id AS promotion_id
FROM m_payments p LEFT JOIN valid v ON p.order_id = v.order_id""")
def _(m):
    promoted = joins.first_valid_interval(dated_items(m), m.promotions(), ["product_id", "seller_id"], "order_id",
                                          "order_purchase_timestamp", "start_date", "end_date", "promotion_id")
    return (m.payments().join(promoted, "order_id", "left")
            .select("order_id", "payment_sequential", F.col("payment_value").cast("double"), "promotion_id"))


@query("J06_join_star_metrics", """
SELECT customer_state AS state, date_trunc('month', order_purchase_timestamp) AS month,
       round(CAST(sum(price) AS DOUBLE), 4) AS revenue, round(CAST(sum(freight_value) AS DOUBLE), 4) AS freight_value
FROM m_items JOIN m_orders USING (order_id) JOIN m_customers USING (customer_id) GROUP BY 1, 2""")
def _(m):
    keys = ("state", "month")
    return as_double(metric_query(m, MetricSpec(("revenue", "freight_value"), group_by=keys)), "revenue", "freight_value")


@query("J07_join_fk_anti", """
WITH bad AS (
  SELECT DISTINCT 'items.order_id' AS fk, CAST(order_id AS VARCHAR) AS value FROM m_items WHERE order_id NOT IN (SELECT order_id FROM m_orders WHERE order_id % 50 <> 0)
  UNION ALL SELECT DISTINCT 'returns.order_id', CAST(order_id AS VARCHAR) FROM m_returns WHERE order_id NOT IN (SELECT order_id FROM m_orders WHERE order_id % 50 <> 0)
  UNION ALL SELECT DISTINCT 'orders.customer_id', CAST(customer_id AS VARCHAR) FROM m_orders WHERE customer_id NOT IN (SELECT customer_id FROM m_customers)
  UNION ALL SELECT DISTINCT 'items.product_id', CAST(product_id AS VARCHAR) FROM m_items WHERE product_id NOT IN (SELECT product_id FROM m_products WHERE product_id % 400 <> 1)
  UNION ALL SELECT DISTINCT 'items.carrier_id', CAST(carrier_id AS VARCHAR) FROM m_items WHERE carrier_id NOT IN (SELECT carrier_id FROM m_carriers)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fk ORDER BY value) AS n FROM bad)
SELECT f.fk, count(r.value) AS bad_count, coalesce(string_agg(r.value, ',' ORDER BY r.value) FILTER (WHERE r.n <= 3), '') AS examples
FROM (SELECT unnest(['items.order_id', 'returns.order_id', 'orders.customer_id', 'items.product_id', 'items.carrier_id']) AS fk) f
LEFT JOIN ranked r ON f.fk = r.fk GROUP BY f.fk""")
def referential_report(m):
    kept = m.orders().filter(F.col("order_id") % 50 != 0)
    products = m.products().filter(F.col("product_id") % 400 != 1)
    return joins.orphan_report([
        ("items.order_id", m.items(), "order_id", kept, "order_id"),
        ("returns.order_id", m.returns(), "order_id", kept, "order_id"),
        ("orders.customer_id", m.orders(), "customer_id", m.customers(), "customer_id"),
        ("items.product_id", m.items(), "product_id", products, "product_id"),
        ("items.carrier_id", m.items(), "carrier_id", m.carriers(), "carrier_id"),
    ])


@query("J17_join_coverage_map", "SELECT region, carrier_id FROM m_coverage")
def _(m):
    return joins.coverage_map(m.carriers(), REGIONS)


@query("W03_win_price_chain", """
SELECT product_id, price_event_id, CAST(old_price AS DOUBLE) AS old_price, CAST(previous AS DOUBLE) AS previous FROM (
  SELECT *, lag(new_price) OVER (PARTITION BY product_id ORDER BY change_at, price_event_id) AS previous FROM m_price_history)
WHERE previous IS NOT NULL AND previous <> old_price""")
def _(m):
    broken = ordered.chain_breaks(m.price_history(), ["product_id"], "change_at", "price_event_id", "old_price", "new_price")
    return broken.select("product_id", "price_event_id", F.col("old_price").cast("double"), F.col("previous").cast("double"))


@query("W04_win_last_known", """
SELECT order_id, last_value(CASE WHEN order_status = 'delivered' THEN order_id END IGNORE NULLS) OVER (
  PARTITION BY customer_id ORDER BY order_purchase_timestamp, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_delivered
FROM m_orders""")
def _(m):
    orders = m.orders().select("order_id", "customer_id", "order_status", "order_purchase_timestamp")
    delivered = F.when(F.col("order_status") == "delivered", F.col("order_id"))
    return (ordered.running_last(orders, ["customer_id"], "order_purchase_timestamp", ["order_id"], delivered, "last_delivered")
            .select("order_id", "last_delivered"))


@query("W06_win_first_match", """
SELECT order_id, min(struct_pack(start_date, promotion_id)).promotion_id AS promotion_id
FROM m_dated_items i JOIN m_promotions p ON i.product_id = p.product_id AND i.seller_id = p.seller_id
 AND i.order_purchase_timestamp >= p.start_date AND i.order_purchase_timestamp <= p.end_date GROUP BY order_id""")
def _(m):
    return joins.first_valid_interval(dated_items(m), m.promotions(), ["product_id", "seller_id"], "order_id",
                                      "order_purchase_timestamp", "start_date", "end_date", "promotion_id")


@query("W07_win_duplicate_flag", """
SELECT order_id, order_item_id, product_id, seller_id, count(*) OVER (PARTITION BY order_id, order_item_id) > 1 AS duplicated FROM m_items""")
def _(m):
    keyed = m.items().select("order_id", "order_item_id", "product_id", "seller_id")
    return ranking.flag_duplicates(keyed, ["order_id", "order_item_id"])


# --- sampling ---------------------------------------------------------------------------------

@query("P01_smp_weighted", f"""
SELECT order_id, late, score FROM m_signals
ORDER BY -ln(({hash_sql('incidents', 'order_id')} + 0.5::DOUBLE) / 4294967296)
         / (1.0::DOUBLE + late * 3.0::DOUBLE + CASE WHEN score <= 2 THEN 4.0::DOUBLE ELSE 0 END), order_id LIMIT 1000""")
def _(m):
    weight = sampling.incident_weight(F.col("late"), F.col("score"))
    return sampling.weighted_sample(signals(m), "order_id", weight, 1000, "incidents").select("order_id", "late", "score")


@query("T06_srt_top_k_by_weight", """
SELECT order_id, CAST(order_total AS DOUBLE) AS weight FROM m_orders ORDER BY order_total DESC, order_id LIMIT 500""")
def _(m):
    top = ranking.ranked(m.orders().select("order_id", "order_total"), "order_total", ["order_id"], top=500)
    return top.select("order_id", F.col("order_total").cast("double").alias("weight"))


@query("P02_smp_with_replacement", f"""
WITH pairs AS (SELECT DISTINCT product_id, seller_id FROM m_items),
numbered AS (SELECT *, row_number() OVER (ORDER BY {hash_sql('bucket', 'product_id', 'seller_id')}, product_id, seller_id) - 1 AS idx FROM pairs),
draws AS (SELECT range AS draw, {hash_sql('promos', 'range')} % (SELECT count(*) FROM pairs) AS idx FROM range(5000))
SELECT draw, product_id, seller_id FROM draws JOIN numbered USING (idx)""")
def _(m):
    pairs = m.items().select("product_id", "seller_id").distinct()
    return sampling.sample_with_replacement(pairs, ["product_id", "seller_id"], 5000, "promos")


@query("P03_smp_risk_weights", """
SELECT order_id, 1.0::DOUBLE + late * 3 + CASE WHEN score <= 2 THEN 4 ELSE 0 END AS incident_weight,
       1.0::DOUBLE + CASE WHEN score <= 2 THEN 4.0::DOUBLE WHEN score = 3 THEN 1.5::DOUBLE ELSE 0 END AS ticket_weight,
       1.0::DOUBLE + CASE WHEN score <= 2 THEN 4 ELSE 0 END AS return_weight FROM m_signals""")
def _(m):
    late, score = F.col("late"), F.col("score")
    return signals(m).select("order_id", sampling.incident_weight(late, score).alias("incident_weight"),
                             sampling.ticket_weight(score).alias("ticket_weight"),
                             sampling.return_weight(score).alias("return_weight"))


@query("P04_smp_assign_by_region", f"""
WITH choices AS (
  SELECT region, carrier_id, row_number() OVER (PARTITION BY region ORDER BY {hash_sql('bucket', 'carrier_id')}, carrier_id) - 1 AS idx,
         count(*) OVER (PARTITION BY region) AS n
  FROM (SELECT region, carrier_id FROM m_coverage UNION ALL SELECT '*', carrier_id FROM m_carriers)),
placed AS (
  SELECT order_id, coalesce(r.region, '*') AS region, {hash_sql('carrier', 'order_id')} AS h
  FROM m_orders JOIN (SELECT customer_id, CASE WHEN customer_id % 10 = 0 THEN 'unknown' ELSE customer_state END AS customer_state FROM m_customers) USING (customer_id)
  LEFT JOIN (SELECT DISTINCT region FROM m_coverage) r ON r.region = customer_state)
SELECT order_id, carrier_id FROM placed p JOIN choices c ON p.region = c.region AND p.h % (SELECT max(n) FROM choices x WHERE x.region = p.region) = c.idx""")
def _(m):
    state = F.when(F.col("customer_id") % 10 == 0, "unknown").otherwise(F.col("customer_state"))
    orders = m.orders().join(m.customers(), "customer_id").select("order_id", state.alias("state"))
    coverage = joins.coverage_map(m.carriers(), REGIONS)
    return sampling.assign_by_region(orders, coverage, m.carriers(), "order_id", "state", "carrier").select("order_id", "carrier_id")


@query("P05_smp_surrogate_ids", """
SELECT order_id, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12)) AS uid
FROM (SELECT order_id, md5('orders:' || order_id) AS h FROM m_orders)""")
def _(m):
    return m.orders().select("order_id", sampling.surrogate_id("orders", F.col("order_id")).alias("uid"))


# --- integrity --------------------------------------------------------------------------------

@query("D04_dq_ranges", """
SELECT 'carriers.on_time_rate' AS rule, count(*) AS checked, count(*) FILTER (WHERE NOT on_time_rate BETWEEN 0.65 AND 1) AS bad FROM m_carriers
UNION ALL SELECT 'promotions.discount_pct', count(*), count(*) FILTER (WHERE NOT discount_pct BETWEEN 0 AND 0.45) FROM m_promotions
UNION ALL SELECT 'tickets.satisfaction_score', count(satisfaction_score), count(*) FILTER (WHERE NOT satisfaction_score BETWEEN 1 AND 4) FROM m_tickets""")
def _(m):
    from zocalo.operators.quality import range_report
    return range_report([("carriers.on_time_rate", m.carriers(), "on_time_rate", 0.65, 1),
                         ("promotions.discount_pct", m.promotions(), "discount_pct", 0, 0.45),
                         ("tickets.satisfaction_score", m.tickets(), "satisfaction_score", 1, 4)])


@query("D05_dq_composite_key", """
SELECT order_id, order_item_id, count(*) AS copies, CAST(min(price) AS DOUBLE) AS kept_price FROM m_items
GROUP BY order_id, order_item_id HAVING count(*) > 1""")
def _(m):
    from zocalo.operators.quality import repeated_keys
    kept = F.min("price").cast("double").alias("kept_price")
    return repeated_keys(m.items(), ["order_id", "order_item_id"], kept)


@query("D06_dq_coverage_min", f"""
SELECT r.region, count(c.carrier_id) AS carriers FROM (SELECT unnest({sql_list(REGIONS + ['NATION_99'])}) AS region) r
LEFT JOIN (SELECT * FROM m_coverage WHERE carrier_id % 2 = 1) c ON r.region = c.region GROUP BY r.region HAVING count(c.carrier_id) < 9""")
def _(m):
    odd = m.carriers().filter(F.col("carrier_id") % 2 == 1)
    return joins.coverage_counts(odd, REGIONS + ["NATION_99"]).filter(F.col("carriers") < 9)


@query("D03_dq_referential", """
SELECT fk, bad_count, bad_count = 0 AS ok FROM (
  SELECT 'returns.product_id' AS fk, count(DISTINCT product_id) FILTER (WHERE product_id NOT IN (SELECT product_id FROM m_products)) AS bad_count FROM m_returns
  UNION ALL SELECT 'items.seller_id', count(DISTINCT seller_id) FILTER (WHERE seller_id NOT IN (SELECT seller_id FROM m_sellers)) FROM m_items
  UNION ALL SELECT 'promotions.seller_id', count(DISTINCT seller_id) FILTER (WHERE seller_id NOT IN (SELECT seller_id FROM m_sellers WHERE seller_id % 3 <> 0)) FROM m_promotions
  UNION ALL SELECT 'tickets.customer_id', count(DISTINCT customer_id) FILTER (WHERE customer_id NOT IN (SELECT customer_id FROM m_customers)) FROM m_tickets)""")
def _(m):
    sellers = m.sellers()
    report = joins.orphan_report([
        ("returns.product_id", m.returns(), "product_id", m.products(), "product_id"),
        ("items.seller_id", m.items(), "seller_id", sellers, "seller_id"),
        ("promotions.seller_id", m.promotions(), "seller_id", sellers.filter(F.col("seller_id") % 3 != 0), "seller_id"),
        ("tickets.customer_id", m.tickets(), "customer_id", m.customers(), "customer_id"),
    ])
    return report.select("fk", "bad_count", (F.col("bad_count") == 0).alias("ok"))
