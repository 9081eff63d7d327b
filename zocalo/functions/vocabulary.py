"""Fixed values the text rules depend on: word lists, codes, table names, patterns.

They must stay as they are for results to agree with the business definition, so
they are kept here together, in the order in which the rules apply.
"""

# Intents, first match wins; "detail" if none.
TEMPORAL_PHRASES = ["por mes", "mensual", "mes a mes", "tendencia"]
TEMPORAL_WORDS = ["evolucion", "evoluciones"]
RANKING_WORDS = ["mayor", "menor", "mejor", "peor", "top", "ranking", "mas ", "menos "]
COMPARISON_WORDS = ["comparar", "comparacion", "versus", " vs "]
COUNT_INTENT_WORDS = ["cuantos", "cuantas", "cantidad", "numero de", "numero total de"]
AGGREGATION_WORDS = ["total", "promedio", "suma", "monto"]
INTENTS = ["ranking", "count", "aggregation", "temporal_trend", "comparison", "detail"]

# Operations, first match wins; "detail" if none.
AVERAGE_REFERENCE = "promedio"
NEAR_WORDS = ["cerca", "cercan", "proxim"]
DESCENDING_PHRASES = ["de mayor a menor", "descendente"]
ASCENDING_PHRASES = ["de menor a mayor", "ascendente"]
HIGHEST_WORDS = ["mayor", "mejor", "mas alto", "mas alta", "mas cumplido", "mas cumplida", "mas puntual", "top"]
LOWEST_WORDS = ["menor", "peor", "mas bajo", "mas baja", "menos cumplido", "menos cumplida", "menos puntual"]
MEDIAN_WORDS = ["mediana"]
AVERAGE_WORDS = ["promedio", "media aritmetica", "valor medio", "average"]
COUNT_WORDS = ["cuantos", "cuantas", "cantidad", "numero de", "contar", "conteo"]
SUM_WORDS = ["total", "suma", "sumar", "acumulado"]

# Words that bring a metric, in output order.
SUPPORT_WORDS = ["ticket", "soporte", "atencion al cliente", "reclamo"]
METRIC_WORDS = [
    (["venta", "vendido", "ingreso", "facturacion"], ["revenue"]),
    (["orden", "pedido", "compra"], ["order_count"]),
    (["cumplimiento", "puntualidad", "a tiempo", "entrega puntual"], ["on_time_rate"]),
    (["flete", "freight", "envio"], ["freight_value"]),
    (["resena", "calificacion", "puntaje"], ["review_score"]),
    (["stock", "inventario", "reorden"], ["stock_qty", "reorder_point"]),
    (["devolucion", "devoluciones", "reembolso"], ["returns_count", "refund_amount"]),
    (["incidencia", "incidente", "compensacion"], ["incidents_count", "compensation_value"]),
    (SUPPORT_WORDS, ["ticket_count"]),
    (["tiempo de resolucion", "tiempo de respuesta", "demora en resolver"], ["resolution_time_hr"]),
    (["satisfaccion"], ["satisfaction_score"]),
    (["precio", "price"], ["price"]),
]
SUPPORT_METRICS = ["ticket_count", "resolution_time_hr", "satisfaction_score"]

# Groupings, in output order.
GROUP_WORDS = [
    (["por mes", "mensual", "mes a mes"], "month"),
    (["por estado"], "state"),
    (["por categoria"], "category"),
    (["por vendedor"], "seller"),
    (["por transportista", "por carrier"], "carrier"),
]

# State codes, those that are also common words, and what may stand before a code.
STATE_CODES = ["AC", "AL", "AP", "AM", "BA", "CE", "DF", "ES", "GO", "MA", "MT", "MS", "MG", "PA", "PB", "PR", "PE", "PI",
               "RJ", "RN", "RS", "RO", "RR", "SC", "SP", "SE", "TO"]
AMBIGUOUS_STATE_CODES = ["AL", "ES", "SE"]
STATE_PREFIX = r"en\s+(?:el\s+)?estado(?:\s+de)?|estado(?:\s+de)?|uf|en|de|para"

# Words that bring an equality filter, in output order.
FILTER_WORDS = [
    (["cancelad"], ("order_status", "canceled")),
    (["entregad"], ("order_status", "delivered")),
    (["tarjeta", "credit_card"], ("payment_type", "credit_card")),
    (["boleto"], ("payment_type", "boleto")),
    (["voucher"], ("payment_type", "voucher")),
    (["critica", "critico"], ("priority", "critica")),
]
UNRESOLVED_WORDS = ["sin resolver", "no resuelt", "abiert", "pendient"]
RESOLVED_WORDS = ["resuelt", "cerrad"]
FILTER_TABLES = {
    "state": "olist_customers_dataset",
    "order_status": "olist_orders_dataset",
    "payment_type": "olist_order_payments_dataset",
    "resolved": "customer_support_tickets",
    "priority": "customer_support_tickets",
}

# Metrics (or words) that bring context labels and tables, in output order.
CARRIER_WORDS = ["transportista", "carrier"]
CONTEXT_RULES = [
    (["on_time_rate"], CARRIER_WORDS, ["logistica", "transportistas"], ["carriers", "olist_order_items_dataset"]),
    (["revenue", "order_count"], [], ["ventas"], ["olist_orders_dataset", "olist_order_items_dataset"]),
    (["freight_value"], [], ["logistica"], ["olist_order_items_dataset", "carriers"]),
    (["review_score"], [], ["resenas"], ["olist_order_reviews_dataset"]),
    (["stock_qty", "reorder_point"], [], ["inventario"], ["warehouse_inventory", "olist_products_dataset"]),
    (["returns_count", "refund_amount"], [], ["devoluciones"], ["product_returns"]),
    (["incidents_count", "compensation_value"], [], ["incidencias"], ["delivery_incidents"]),
    (SUPPORT_METRICS, [], ["soporte"], ["customer_support_tickets"]),
    (["price"], [], ["precios"], ["product_price_history"]),
]
CATEGORY_TABLES = ["olist_products_dataset", "product_category_name_translation"]
STATE_TABLES = ["olist_customers_dataset"]

# Phrase replacements of the normalised question and its three set forms.
PHRASES = {
    "empresa de transporte": "transportista",
    "empresas de transporte": "transportistas",
    "mejor cumplimiento": "mayor tasa de cumplimiento",
    "cumplen mejor": "mayor tasa de cumplimiento",
    "total vendido": "ventas totales",
    "quiero ver": "",
    "muestrame": "",
    "dame": "",
    "necesito saber": "",
}
CARRIER_RANKING_FORM = "Listar transportistas ordenados por mayor tasa de cumplimiento de entrega."
MONTHLY_REVENUE_FORM = "Calcular ventas totales agrupadas por mes."
LOW_STOCK_FORM = "Listar productos con stock por debajo del punto de reorden."

# Words in a column name that mark a rate.
PERCENT_WORDS = ["pct", "percent", "percentage", "porcentaje", "rate", "ratio", "tasa"]
