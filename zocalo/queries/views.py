"""SQL text of the business tables, for the side-by-side check of every query."""

from __future__ import annotations

import re

from zocalo.plans import marketplace as mk

VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """Add a named subquery; it may use the ones added before it."""
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the named subqueries it uses, in declaration order."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(body)
    if not needed:
        return sql.strip()
    prefix = ",\n".join(f"{n} AS (\n{b}\n)" for n, b in VIEWS.items() if n in needed)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {prefix},\n{body[5:]}"
    return f"WITH {prefix}\n{body}"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_pick(values: list[str], index: str) -> str:
    return f"({sql_list(values)})[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


def sql_case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


view("m_states", "SELECT n_nationkey, n_name AS state FROM nation")
view("m_orders", f"""
SELECT o_orderkey AS order_id, o_custkey AS customer_id, {sql_case('o_orderstatus', mk.ORDER_STATUSES)} AS order_status,
       o_orderdate AS order_purchase_timestamp, o_orderdate + INTERVAL 60 DAY AS order_estimated_delivery_date,
       {sql_case('o_orderpriority', mk.PAYMENT_TYPES)} AS payment_type, CAST(o_totalprice AS DECIMAL(12,2)) AS order_total
FROM orders""")
view("m_deliveries", """
SELECT l_orderkey AS order_id, max(l_shipdate) AS order_delivered_customer_date FROM lineitem GROUP BY l_orderkey""")
view("m_dated_orders", """
SELECT o.*, CASE WHEN o.order_status = 'delivered' THEN d.order_delivered_customer_date END AS order_delivered_customer_date
FROM m_orders o LEFT JOIN m_deliveries d USING (order_id)""")
view("m_items", """
SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id, l_suppkey AS seller_id,
       l_suppkey AS carrier_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
       CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS freight_value,
       l_shipdate AS shipping_limit_date
FROM lineitem""")
view("m_customers", """
SELECT c_custkey AS customer_id, 'buyer-' || CAST(c_custkey // 2 AS VARCHAR) AS customer_unique_id, state AS customer_state
FROM customer JOIN m_states ON c_nationkey = n_nationkey""")
view("m_sellers", """
SELECT s_suppkey AS seller_id, state AS seller_state FROM supplier JOIN m_states ON s_nationkey = n_nationkey""")
view("m_carriers", f"""
SELECT s_suppkey AS carrier_id, s_name AS carrier_name, {sql_pick(mk.CARRIER_TYPES, 's_suppkey')} AS carrier_type,
       CASE WHEN s_suppkey % 20 = 0 THEN 'NACIONAL'
            ELSE 'NATION_' || (s_suppkey % 25) || ',NATION_' || ((s_suppkey * 7 + 3) % 25) || ',NATION_' || ((s_suppkey * 11 + 5) % 25)
       END AS coverage_regions,
       CAST(600 + (s_suppkey * 37) % 400 AS DOUBLE) / 1000 AS on_time_rate
FROM supplier""")
view("m_products", """
SELECT p_partkey AS product_id, lower(p_type) AS product_category_name, p_size AS product_size FROM part""")
view("m_translation", f"""
SELECT DISTINCT lower(p_type) AS product_category_name, lower(p_type) || '_en' AS product_category_name_english
FROM part WHERE p_type IN ({', '.join(repr(t) for t in mk.TRANSLATED_TYPES)})""")
view("m_payments", """
SELECT order_id, 1 AS payment_sequential, payment_type,
       CASE WHEN order_id % 5 = 0 THEN CAST(order_total * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(12,2)) ELSE order_total END AS payment_value
FROM m_orders
UNION ALL
SELECT order_id, 2, payment_type,
       CAST(order_total - CAST(order_total * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(12,2)) AS DECIMAL(12,2))
FROM m_orders WHERE order_id % 5 = 0""")
view("m_reviews", """
SELECT order_id, 'r' || order_id || '-1' AS review_id, CAST(1 + order_id % 5 AS INTEGER) AS review_score,
       order_purchase_timestamp + INTERVAL 20 DAY AS review_creation_date
FROM m_orders WHERE order_id % 17 <> 0
UNION ALL
SELECT order_id, 'r' || order_id || '-2', CAST(1 + (order_id // 10) % 5 AS INTEGER), order_purchase_timestamp + INTERVAL 25 DAY
FROM m_orders WHERE order_id % 17 <> 0 AND order_id % 10 = 0""")
view("m_inventory", """
SELECT l_partkey % 12 AS warehouse_id, l_partkey AS product_id, l_suppkey AS seller_id,
       CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS INTEGER) AS stock_qty, p_size AS reorder_point,
       max(l_shipdate) AS last_restocked_date
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, l_suppkey, p_size""")
view("m_price_history", f"""
SELECT l_partkey AS product_id, l_suppkey AS seller_id, l_shipdate AS change_at,
       CAST(10 + max(l_linenumber) AS DECIMAL(12,2)) AS old_price, CAST(10 + min(l_linenumber) AS DECIMAL(12,2)) AS new_price,
       'pe-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS price_event_id,
       {sql_pick(mk.CHANGE_REASONS, 'l_partkey')} AS change_reason
FROM lineitem GROUP BY l_partkey, l_suppkey, l_shipdate""")
view("m_promotions", f"""
SELECT 'pr-' || l_partkey || '-' || l_suppkey || '-' || k AS promotion_id, l_partkey AS product_id, l_suppkey AS seller_id,
       CAST(5 + (l_partkey + k) % 46 AS DOUBLE) / 100 AS discount_pct,
       DATE '1995-01-01' + CAST((l_partkey * 31 + l_suppkey * 17 + k * 400) % 2200 AS INTEGER) AS start_date,
       DATE '1995-01-01' + CAST((l_partkey * 31 + l_suppkey * 17 + k * 400) % 2200 + 7 + (l_partkey + l_suppkey + k * 5) % 24 AS INTEGER) AS end_date,
       {sql_pick(mk.PROMO_TYPES, 'l_partkey + l_suppkey')} AS promo_type,
       20 + (l_partkey * 7 + l_suppkey) % 100 AS units_sold_during
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) CROSS JOIN (SELECT unnest([0, 1]) AS k)""")
view("m_tickets", f"""
SELECT event_id AS ticket_id, event_id AS order_id, user_id AS customer_id, ts AS created_at, {sql_pick(mk.TICKET_CATEGORIES, 'event_id')} AS category,
       {sql_pick(mk.TICKET_PRIORITIES, 'user_id')} AS priority, CAST(value AS DECIMAL(12,2)) AS resolution_time_hr,
       CASE WHEN event_id % 13 <> 0 THEN CAST(1 + event_id % 5 AS INTEGER) END AS satisfaction_score, value > 20 AS resolved
FROM events WHERE event_type = 'error'""")
view("m_incidents", f"""
SELECT event_id AS incident_id, event_id AS order_id, {sql_pick(mk.INCIDENT_TYPES, 'user_id')} AS incident_type, ts AS reported_date,
       CASE WHEN event_id % 5 <> 0 THEN ts + to_days(CAST(1 + event_id % 30 AS INTEGER)) END AS resolved_date,
       {sql_pick(mk.RESOLUTION_TYPES, 'event_id')} AS resolution_type, CAST(value AS DECIMAL(12,2)) AS compensation_value
FROM events WHERE event_type = 'click'""")
view("m_returns", f"""
SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
       {sql_pick(mk.RETURN_REASONS, 'l_partkey')} AS return_reason, l_shipdate + to_days(1 + l_linenumber) AS return_date,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(CASE WHEN l_orderkey % 10 < 3 THEN 0.5 ELSE 1.0 END AS DECIMAL(2,1)) AS DECIMAL(12,2)) AS refund_amount,
       {sql_pick(mk.REFUND_METHODS, 'l_suppkey')} AS refund_method
FROM lineitem WHERE l_returnflag = 'R'""")
