"""Free-text questions derived from the given tables, in Spark and in SQL.

One question per order, cut from templates, plus every user turn of the
conversations as it stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.functions import vocabulary as v
from zocalo.plans.marketplace import Marketplace, pick
from zocalo.queries import sqltext as s
from zocalo.queries.views import sql_list, sql_pick, view

TEMPLATES = [
    "¿Qué transportista tiene la mejor puntualidad en {uf}?",
    "¿Cuánto fue el total vendido por mes en {y}?",
    "Productos con stock crítico bajo el punto de reorden",
    "¿Cuántas órdenes canceladas hubo en {uf} con tarjeta?",
    "¿Cuántos tickets de soporte están  sin resolver?",
    "Muéstrame la evolución mensual de los ingresos entre {y} y {z}",
    "Compara: ventas de {uf} versus ventas de SP en {y}",
    "Promedio de flete por vendedor en el estado de {uf}",
    "¿Cuál es la mediana del precio por categoría?",
    "Quiero ver los vendedores de menor a mayor facturación",
    "Estados cuya calificación está más cerca del promedio",
    "¿Cuántos tickets hay por categoría y cuáles ya están resueltos?",
    "Total de reembolsos y devoluciones entregadas por estado en {y}",
    "Incidencias y compensación acumulada por transportista",
    "¿Cuáles son los 5 estados de vendedores con más inventario?",
    "Dame compradores recurrentes con boleto en {uf}",
    "Estado del pedido {y} con voucher",
    "Tiempo de resolución y satisfacción de reclamos cerrados",
    "Necesito saber qué empresas de transporte cumplen mejor, de mayor a menor",
    "Listado de clientes únicos en uf {uf}",
    "Número de pedidos pendientes de atención al cliente",
    "Precio promedio por carrier {z}",
    "Hay se es al de AL",
    "   ",
]


def question_rows(m: Marketplace) -> DataFrame:
    """(question_id, asked_at, question)"""
    year = F.date_format("o_orderdate", "yyyy")
    after = (F.year("o_orderdate") + 1).cast("string")
    text = pick(TEMPLATES, F.col("o_orderkey"))
    for mark, value in (("{y}", year), ("{z}", after), ("{uf}", pick(v.STATE_CODES, F.col("o_custkey")))):
        text = F.replace(text, F.lit(mark), value)
    orders = m.spread("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("question_id"),
                                    F.col("o_orderdate").alias("asked_at"), text.alias("question"))
    turns = m.spread("conversations").filter(F.col("role") == "user").select(
        F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"),
        F.lit(None).cast("timestamp_ntz").alias("asked_at"), F.col("text").alias("question"))
    return orders.unionByName(turns)


view("m_questions", f"""
SELECT 'o' || o_orderkey AS question_id, o_orderdate AS asked_at,
       replace(replace(replace({sql_pick(TEMPLATES, 'o_orderkey')}, '{{y}}', strftime(o_orderdate, '%Y')),
               '{{z}}', CAST(year(o_orderdate) + 1 AS VARCHAR)), '{{uf}}', {sql_pick(v.STATE_CODES, 'o_custkey')}) AS question
FROM orders
UNION ALL
SELECT 'c-' || conv_id || '-' || turn, NULL, text FROM conversations WHERE role = 'user'""")
view("m_folded", f"""
SELECT question_id, asked_at, original_question, {s.fold('original_question')} AS t
FROM (SELECT question_id, asked_at, {s.clean('question')} AS original_question FROM m_questions) WHERE original_question <> ''""")
view("m_parts", f"""
SELECT *, {s.intent('t')} AS intent, {s.metrics('t')} AS metrics, {s.groups('t')} AS group_by,
       {s.filters('original_question', 't')} AS filters,
       regexp_extract_all(t, '\\b(20[0-9]{{2}})\\b', 1) AS years
FROM m_folded""")
view("m_lists", f"""
SELECT *, {s.operation('t', 'intent')} AS operation, {s.context('t', 'metrics')} AS context_all,
       {s.chain([s.tables('t', 'metrics', 'group_by'), s.filter_tables('filters'), s.rule_tables('t')])} AS tables_all
FROM m_parts""")
view("m_structured", f"""
SELECT *, {s.normalized('t', 'intent', 'metrics', 'group_by', 'context_all')} AS normalized_question,
       {s.ordered_distinct('context_all')} AS context, {s.ordered_distinct('tables_all')} AS suggested_tables,
       CASE WHEN len(years) > 0 THEN list_min(years) || '-01-01' END AS start_date,
       CASE WHEN len(years) > 0 THEN list_max(years) || '-12-31' END AS end_date
FROM m_lists""")
