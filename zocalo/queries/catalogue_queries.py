"""Catalogue audits and presentation (X17-X21, X23, A19, A25, J16, D07-D08, U03, W05, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from zocalo.functions.json_edges import json_number, truth
from zocalo.functions.labels import COLUMN_LABELS, column_label
from zocalo.operators import catalogue, presentation
from zocalo.operators.rules import RULES, rule_texts
from zocalo.plans.marketplace import pick
from zocalo.queries import sqltext as s
from zocalo.queries.questions import question_rows
from zocalo.queries.registry import query
from zocalo.queries.views import sql_pick, view

# --- catalogue text derived from the parts: one table entry per part ---------------------------


def entries(m):
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    extra = F.when(k % 2 == 0, "extra timestamp,\n").otherwise("")
    ddl = F.concat(F.lit("CREATE TABLE t"), text(k), F.lit(" (\nid uuid PRIMARY KEY,               -- Identificador único\nsize  INT4 NOT NULL,\nkind text, -- Valores: b | a"),
                   text(k % 5), F.lit(" extra | c\nprice numeric( 12 , 2 ) DEFAULT 0,\n"), extra, F.lit("PRIMARY KEY (id)\n);"))
    return m.raw("part").select(F.concat(F.lit("t"), text(k)).alias("table"), ddl.alias("ddl"), k.alias("k"))


def actual(m):
    k = F.col("p_partkey")
    col = lambda when, name, kind: F.when(when, F.struct(F.lit(name).alias("column"), kind.alias("type")))
    always = F.lit(True)
    columns = F.array(col(always, "id", F.lit("UUID")), col(always, "size", F.lit("integer")), col(always, "kind", F.when(k % 7 == 0, "varchar").otherwise("TEXT")),
                      col(always, "price", F.lit("NUMERIC(12,2)")), col((k % 2 == 0) & (k % 3 != 0), "extra", F.lit("timestamp  without time zone")), col(k % 11 == 0, "added", F.lit("bool")))
    name = F.when(k % 60 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.concat(F.lit("t"), k.cast("string")))
    return m.raw("part").select(name.alias("table"), F.explode(F.filter(columns, lambda c: c.isNotNull())).alias("c")).select("table", "c.column", "c.type")


view("m_documented", """
SELECT 't' || p_partkey AS "table", "column", type, comment FROM (
  SELECT p_partkey, unnest(['id', 'size', 'kind', 'price', 'extra']) AS "column", unnest(['uuid', 'INT4', 'text', 'numeric( 12 , 2 )', 'timestamp']) AS type,
         unnest(['Identificador único', NULL, 'Valores: b | a' || (p_partkey % 5) || ' extra | c', NULL, NULL]) AS comment FROM part)
WHERE "column" <> 'extra' OR p_partkey % 2 = 0""")
view("m_actual", """
SELECT CASE WHEN k % 60 = 0 THEN 'x' ELSE 't' END || k AS "table", "column", type FROM (
  SELECT p_partkey AS k, unnest(['id', 'size', 'kind', 'price', 'extra', 'added']) AS "column",
         unnest(['uuid', 'integer', CASE WHEN p_partkey % 7 = 0 THEN 'varchar' ELSE 'text' END, 'numeric(12,2)', 'timestamp without time zone', 'boolean']) AS type FROM part)
WHERE ("column" <> 'extra' OR (k % 2 = 0 AND k % 3 <> 0)) AND ("column" <> 'added' OR k % 11 = 0)""")
view("m_drift", """
SELECT coalesce(d."table", a."table") AS "table", coalesce(d."column", a."column") AS "column",
       CASE WHEN a."column" IS NULL THEN 'missing' WHEN d."column" IS NULL THEN 'undocumented' WHEN d.canon <> a.type THEN 'type_difference' END AS issue
FROM (SELECT *, CASE type WHEN 'INT4' THEN 'integer' WHEN 'numeric( 12 , 2 )' THEN 'numeric(12,2)' WHEN 'timestamp' THEN 'timestamp without time zone' ELSE type END AS canon
      FROM m_documented WHERE "table" IN (SELECT "table" FROM m_actual)) d
FULL JOIN (SELECT * FROM m_actual WHERE "table" IN (SELECT "table" FROM m_documented)) a ON d."table" = a."table" AND d."column" = a."column" """)

TYPES = ["  Timestamp ", "DECIMAL", "int4", "INT8", "float8", "Bool", "numeric", "character  varying", " Int"]


@query("X17_type_canonical", f"""
SELECT type, CASE t {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in catalogue.TYPE_ALIASES.items())} ELSE t END AS canonical FROM (
  SELECT type, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(type)), '\\s+', ' ', 'g'), '\\s*,\\s*', ',', 'g'), '\\(\\s*', '(', 'g'), '\\s*\\)', ')', 'g') AS t FROM (
    SELECT DISTINCT unnest([{sql_pick(TYPES, 'p_partkey')}, p_type, p_type || '( ' || p_size || ' ,' || chr(9) || '2 )', upper(p_brand) || '  (' || p_size || ')']) AS type FROM part))""")
def _(m):
    size = F.col("p_size").cast("string")
    made = F.array(pick(TYPES, F.col("p_partkey")), F.col("p_type"), F.concat("p_type", F.lit("( "), size, F.lit(" ,\t2 )")), F.concat(F.upper("p_brand"), F.lit("  ("), size, F.lit(")")))
    return m.raw("part").select(F.explode(made).alias("type")).distinct().select("type", catalogue.canonical_type(F.col("type")).alias("canonical"))


@query("X18_ddl_flatten", 'SELECT "table", "column", type, comment FROM m_documented')
def _(m):
    return catalogue.flatten_ddl(entries(m))


@query("X19_ddl_comment_values", """
SELECT "table", CASE WHEN "column" = 'kind' THEN 'a' || (CAST(substr("table", 2) AS BIGINT) % 5) || ',b,c' ELSE '' END AS documented FROM m_documented WHERE comment IS NOT NULL""")
def _(m):
    flat = catalogue.flatten_ddl(entries(m)).filter(F.col("comment").isNotNull())
    return flat.select("table", F.array_join(catalogue.documented_values(F.col("comment")), ",").alias("documented"))


def drift(m):
    return catalogue.schema_drift(catalogue.flatten_ddl(entries(m)), actual(m))


@query("J16_join_schema_drift", 'SELECT "table", "column", issue FROM m_drift WHERE issue IS NOT NULL')
def _(m):
    return drift(m).select("table", "column", "issue")


@query("A25_agg_structural_issues", """
SELECT CAST(sum(n) AS BIGINT) AS structural_issues FROM (
  SELECT max(CASE WHEN issue = 'missing' THEN 1 ELSE 0 END) + max(CASE WHEN issue = 'undocumented' THEN 1 ELSE 0 END) + count(*) FILTER (WHERE issue = 'type_difference') AS n
  FROM m_drift WHERE issue IS NOT NULL GROUP BY "table")""")
def _(m):
    return catalogue.structural_issues(drift(m))


@query("D07_dq_schema_drift", """
SELECT issue, count(*) AS found FROM (
  SELECT issue FROM m_drift WHERE issue IS NOT NULL
  UNION ALL SELECT 'missing_table' FROM (SELECT "table" FROM m_documented EXCEPT SELECT "table" FROM m_actual)
  UNION ALL SELECT 'undocumented_table' FROM (SELECT "table" FROM m_actual EXCEPT SELECT "table" FROM m_documented)) GROUP BY issue""")
def _(m):
    tables = catalogue.table_drift(catalogue.flatten_ddl(entries(m)), actual(m)).select("issue")
    return drift(m).select("issue").unionByName(tables).groupBy("issue").agg(F.count(F.lit(1)).alias("found"))


@query("U03_set_difference_both", """
SELECT "table", 'missing_table' AS issue FROM (SELECT "table" FROM m_documented EXCEPT SELECT "table" FROM m_actual)
UNION ALL SELECT "table", 'undocumented_table' FROM (SELECT "table" FROM m_actual EXCEPT SELECT "table" FROM m_documented)""")
def _(m):
    return catalogue.table_drift(catalogue.flatten_ddl(entries(m)), actual(m))


OBSERVED_SQL = " UNION ".join(
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM m_{t} WHERE {c} IS NOT NULL"
    for t, columns in (("incidents", ["incident_type", "resolution_type"]), ("tickets", ["category", "priority"]), ("carriers", ["carrier_type"]),
                       ("price_history", ["change_reason"]), ("promotions", ["promo_type"]), ("returns", ["return_reason", "refund_method"]),
                       ("orders", ["order_status"]), ("payments", ["payment_type"])) for c in columns)


def observed(m):
    return catalogue.observed_values({
        "incidents": (m.incidents(), ["incident_type", "resolution_type"]), "tickets": (m.tickets(), ["category", "priority"]),
        "carriers": (m.carriers(), ["carrier_type"]), "price_history": (m.price_history(), ["change_reason"]), "promotions": (m.promotions(), ["promo_type"]),
        "returns": (m.returns(), ["return_reason", "refund_method"]), "orders": (m.orders(), ["order_status"]), "payments": (m.payments(), ["payment_type"])})


@query("A19_agg_distinct_catalogue", OBSERVED_SQL)
def _(m):
    return observed(m)


# The catalogue names the values that half of the rows hold, and one that is new.
DOCUMENTED_FROM = {("carriers", "carrier_type"): "carrier_id", ("orders", "order_status"): "order_id", ("payments", "payment_type"): "order_id", ("promotions", "promo_type"): "product_id"}


@query("D08_dq_category_drift", f"""
WITH o AS ({OBSERVED_SQL}), d AS ({' UNION ALL '.join(f"""SELECT '{t}' AS "table", '{c}' AS "column", unnest(list_append(list(DISTINCT {c}), 'nuevo')) AS value FROM m_{t} WHERE {k} % 1000 < 3"""
                                                       for (t, c), k in DOCUMENTED_FROM.items())})
SELECT "table", "column", value, 'not_observed' AS issue FROM (SELECT * FROM d EXCEPT SELECT * FROM o)
UNION ALL SELECT "table", "column", value, 'not_documented' FROM (SELECT * FROM o WHERE ("table", "column") IN (SELECT ("table", "column") FROM d) EXCEPT SELECT * FROM d)""")
def _(m):
    documented = None
    for (table, column), key in DOCUMENTED_FROM.items():
        named = m.table(table).filter(F.col(key) % 1000 < 3).agg(F.array_sort(F.collect_set(column)).alias("listed"))  # a closed list of categories
        row = named.select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.concat(F.lit("Valores: "), F.array_join(F.concat("listed", F.array(F.lit("nuevo"))), " | ")).alias("comment"))
        documented = row if documented is None else documented.unionByName(row)
    return catalogue.category_drift(documented, observed(m))


@query("W05_win_contiguous_ids", """
SELECT "table", 'tabla_' || row_number() OVER (ORDER BY position IS NULL, position, "table") AS id FROM (
  SELECT 't' || p_partkey AS "table", CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS position FROM part)""")
def _(m):
    k = F.col("p_partkey")
    return catalogue.contiguous_ids(m.raw("part").select(F.concat(F.lit("t"), k.cast("string")).alias("table"), F.when(k % 3 != 0, k).alias("position")))


@query("X23_txt_policy_section", f"""
SELECT "table", "table" || ':' || chr(10) || '  - Tabla ' || "table" || CASE WHEN k % 2 = 0 THEN chr(10) || '  - Segunda' ELSE '' END AS section
FROM (SELECT p_partkey AS k, 't' || p_partkey AS "table" FROM part) WHERE k % 3 <> 0
UNION ALL SELECT question_id, array_to_string(list_filter([{', '.join(f"CASE WHEN {s.rule_fired('t', r)} THEN {s.q('- ' + r.text)} END" for r in RULES)}], lambda x: x IS NOT NULL), chr(10)) AS section
FROM m_folded WHERE {' OR '.join(s.rule_fired('t', r) for r in RULES)}""")
def _(m):
    from zocalo.functions.text import clean_spaces, fold
    from zocalo.operators.filters import keep_where
    k = F.col("p_partkey")
    table = F.concat(F.lit("t"), k.cast("string"))
    policies = F.when(k % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit(" Tabla "), table), F.lit(""), F.when(k % 2 == 0, "Segunda").otherwise("  ")))
    sections = m.raw("part").select(table.alias("table"), presentation.policy_section(table, policies).alias("section")).filter(F.col("section").isNotNull())
    asked = question_rows(m).select(F.col("question_id").alias("table"), fold(clean_spaces(F.col("question"))).alias("t"))
    fired = asked.select("table", rule_texts(F.col("t")).alias("section"))
    return sections.unionByName(keep_where(fired, F.col("section") != ""))


# --- JSON edges -------------------------------------------------------------------------------

@query("X20_json_edge_decode", """
SELECT event_id, CAST(CASE WHEN event_id % 5 < 3 THEN json_extract(props, '$.k') ELSE '-1' END AS BIGINT) AS k, event_id % 2 = 0 AS flag FROM events""")
def _(m):
    e = F.col("event_id")
    raw = F.when(e % 5 < 3, F.col("props")).when(e % 5 == 3, "").otherwise("{broken")
    flag = F.when(e % 2 == 0, " True ").when(e % 3 == 0, F.lit(None)).otherwise("no")
    return m.raw("events").select("event_id", json_number(raw, "k", -1).alias("k"), truth(flag).alias("flag"))


@query("X21_json_value_form", """
SELECT order_id, CASE order_id % 4 WHEN 0 THEN CAST(order_id AS VARCHAR) WHEN 1 THEN order_id || '.5' WHEN 2 THEN md5(CAST(order_id AS VARCHAR))
  ELSE strftime(order_purchase_timestamp, '%Y-%m-%dT%H:%M:%S') END AS form FROM m_orders""")
def _(m):
    o = F.col("order_id")
    from zocalo.queries.evaluation_queries import dashed
    h = F.md5(o.cast("string"))
    kind = F.when(o % 4 < 2, "decimal").when(o % 4 == 2, "uuid").otherwise("datetime")
    value = (F.when(o % 4 == 0, F.concat(o.cast("string"), F.lit(".00"))).when(o % 4 == 1, F.concat(o.cast("string"), F.lit(".50")))
             .when(o % 4 == 2, F.upper(dashed(h))).otherwise(F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")))
    return m.orders().select("order_id", presentation.value_form(kind, value).alias("form"))


# --- presentation -----------------------------------------------------------------------------

COLUMNS = ["order_id", "revenue", "on_time_rate", "order_date", "created_at", "resolved", "year", "comment", "total_orders", "custom_metric_xyz"]


def cells(m):
    """The orders of a customer as one result set, in cells; every third row has one more column."""
    o = F.col("order_id")
    text = lambda c: c.cast("string")
    cell = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("kind"), value.alias("value"))
    day = F.date_format("order_purchase_timestamp", "yyyy-MM-dd")
    row = [cell("order_id", "int", text(o)), cell("revenue", "float", text(F.col("order_total"))), cell("on_time_rate", "float", text((o % 100 / 100).cast("decimal(4,2)"))),
           cell("order_date", "date", day), cell("created_at", "text", F.concat(day, F.lit("T10:20:30Z"))), cell("resolved", "bool", text(o % 2 == 0)),
           cell("year", "int", F.date_format("order_purchase_timestamp", "yyyy")), cell("comment", "null", F.lit(None).cast("string")), cell("total_orders", "int", text(o * 1000)),
           F.when(o % 3 == 0, cell("custom_metric_xyz", "text", F.concat(F.lit("n "), text(o))))]
    return (m.orders().select(F.col("customer_id").alias("result_id"), o.alias("row_no"), F.posexplode(F.filter(F.array(*row), lambda c: c.isNotNull())).alias("pos", "c"))
            .select("result_id", "row_no", "pos", "c.key", "c.kind", "c.value"))


TYPE_SQL = """CASE key WHEN 'order_id' THEN 'text' WHEN 'revenue' THEN CASE WHEN whole THEN 'integer' ELSE 'decimal' END WHEN 'on_time_rate' THEN 'percentage' WHEN 'order_date' THEN 'date'
  WHEN 'created_at' THEN 'datetime' WHEN 'resolved' THEN 'boolean' WHEN 'year' THEN 'integer' WHEN 'comment' THEN 'null' WHEN 'total_orders' THEN 'integer' ELSE 'text' END"""
view("m_shown", f"""
SELECT customer_id AS result_id, order_id AS row_no, key, order_total, order_purchase_timestamp AS ts, whole, third, {TYPE_SQL} AS type FROM (
  SELECT *, unnest({COLUMNS}) AS key FROM (
    SELECT *, bool_and(order_total = floor(order_total)) OVER (PARTITION BY customer_id) AS whole, bool_or(order_id % 3 = 0) OVER (PARTITION BY customer_id) AS third FROM m_orders))
WHERE key <> 'custom_metric_xyz' OR third""")
view("m_displayed", """
SELECT *, CASE key WHEN 'order_id' THEN CAST(row_no AS VARCHAR) WHEN 'revenue' THEN CASE WHEN whole THEN format('{:,.0f}', CAST(order_total AS DOUBLE)) ELSE format('{:,.2f}', CAST(order_total AS DOUBLE)) END
  WHEN 'on_time_rate' THEN (row_no % 100) || '.00 %' WHEN 'order_date' THEN strftime(ts, '%d/%m/%Y') WHEN 'created_at' THEN strftime(ts, '%d/%m/%Y') || ' 10:20:30'
  WHEN 'resolved' THEN CASE WHEN row_no % 2 = 0 THEN 'Sí' ELSE 'No' END WHEN 'year' THEN strftime(ts, '%Y') WHEN 'comment' THEN '—' WHEN 'total_orders' THEN format('{:,}', row_no * 1000)
  ELSE CASE WHEN row_no % 3 = 0 THEN 'n ' || row_no ELSE '—' END END AS display FROM m_shown""")


@query("R01_pr_infer_types", "SELECT DISTINCT result_id, key, type FROM m_shown")
def _(m):
    return presentation.column_types(cells(m))


def shown(m, *types):
    return presentation.result_table(cells(m)).filter(F.col("type").isin(*types)).select("result_id", "row_no", "key", "display")


@query("R02_pr_format_numbers", "SELECT result_id, row_no, key, display FROM m_displayed WHERE type IN ('integer', 'decimal')")
def _(m):
    return shown(m, "integer", "decimal")


@query("R03_pr_format_percent", "SELECT result_id, row_no, key, display FROM m_displayed WHERE type = 'percentage'")
def _(m):
    return shown(m, "percentage")


@query("R04_pr_format_temporal", "SELECT result_id, row_no, key, display FROM m_displayed WHERE type IN ('date', 'datetime', 'boolean', 'null')")
def _(m):
    return shown(m, "date", "datetime", "boolean", "null")


NAMES = list(COLUMN_LABELS) + ["total_orders", "average_price", "custom_metric_xyz", "my-id_value", " Order-Status ", "unknown_id"]
NAME_LABELS = list(COLUMN_LABELS.values()) + ["Total pedidos", "Promedio precio", "Custom metric xyz", "My ID value", "Pedido estado", "Unknown ID"]


@query("R05_pr_column_labels", f"SELECT p_partkey, {sql_pick(NAMES, 'p_partkey')} AS key, {sql_pick(NAME_LABELS, 'p_partkey')} AS label FROM part")
def _(m):
    named = m.raw("part").select("p_partkey", pick(NAMES, F.col("p_partkey")).alias("key"))
    return named.withColumn("label", column_label(F.col("key")))


LABEL_SQL = """CASE key WHEN 'order_id' THEN 'ID del pedido' WHEN 'revenue' THEN 'Ingresos' WHEN 'on_time_rate' THEN 'Tasa de puntualidad' WHEN 'order_date' THEN 'Pedido fecha'
  WHEN 'created_at' THEN 'Fecha de creación' WHEN 'resolved' THEN 'Resuelto' WHEN 'year' THEN 'Year' WHEN 'comment' THEN 'Comment' WHEN 'total_orders' THEN 'Total pedidos' ELSE 'Custom metric xyz' END"""


@query("R06_pr_result_table", f"SELECT result_id, row_no, key, {LABEL_SQL} AS label, type, display FROM m_displayed")
def _(m):
    return presentation.result_table(cells(m)).drop("first")
