"""Spanish labels of result columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of known columns.
COLUMN_LABELS = {
    "carrier_id": "ID del transportista",
    "carrier_name": "Transportista",
    "carrier_type": "Tipo de transportista",
    "avg_delivery_days": "Tiempo promedio de entrega (días)",
    "coverage_regions": "Regiones de cobertura",
    "cost_per_kg": "Costo por kg",
    "on_time_rate": "Tasa de puntualidad",
    "incident_id": "ID del incidente",
    "incident_type": "Tipo de incidente",
    "reported_date": "Fecha de reporte",
    "resolved_date": "Fecha de resolución",
    "resolution_type": "Tipo de resolución",
    "compensation_value": "Valor de compensación",
    "ticket_id": "ID del ticket",
    "created_at": "Fecha de creación",
    "category": "Categoría",
    "priority": "Prioridad",
    "resolution_time_hr": "Tiempo de resolución (h)",
    "satisfaction_score": "Puntaje de satisfacción",
    "resolved": "Resuelto",
    "customer_id": "ID del cliente",
    "customer_unique_id": "ID único del cliente",
    "customer_zip_code_prefix": "Código postal del cliente",
    "customer_city": "Ciudad del cliente",
    "customer_state": "Estado del cliente",
    "geolocation_zip_code_prefix": "Código postal",
    "geolocation_lat": "Latitud",
    "geolocation_lng": "Longitud",
    "geolocation_city": "Ciudad",
    "geolocation_state": "Estado",
    "order_id": "ID del pedido",
    "order_status": "Estado del pedido",
    "order_purchase_timestamp": "Fecha de compra",
    "order_approved_at": "Fecha de aprobación",
    "order_delivered_carrier_date": "Fecha de entrega al transportista",
    "order_delivered_customer_date": "Fecha de entrega al cliente",
    "order_estimated_delivery_date": "Fecha estimada de entrega",
    "order_item_id": "ID del ítem del pedido",
    "shipping_limit_date": "Fecha límite de envío",
    "price": "Precio",
    "freight_value": "Valor del flete",
    "payment_sequential": "Secuencia de pago",
    "payment_type": "Tipo de pago",
    "payment_installments": "Número de cuotas",
    "payment_value": "Valor del pago",
    "product_id": "ID del producto",
    "product_category_name": "Categoría del producto",
    "product_category_name_english": "Categoría del producto en inglés",
    "product_name_lenght": "Longitud del nombre del producto",
    "product_description_lenght": "Longitud de la descripción",
    "product_photos_qty": "Cantidad de fotos",
    "product_weight_g": "Peso del producto (g)",
    "product_length_cm": "Largo del producto (cm)",
    "product_height_cm": "Alto del producto (cm)",
    "product_width_cm": "Ancho del producto (cm)",
    "price_event_id": "ID del cambio de precio",
    "old_price": "Precio anterior",
    "new_price": "Precio nuevo",
    "change_at": "Fecha de cambio",
    "change_reason": "Motivo del cambio",
    "promotion_id": "ID de la promoción",
    "discount_pct": "Porcentaje de descuento",
    "start_date": "Fecha de inicio",
    "end_date": "Fecha de fin",
    "promo_type": "Tipo de promoción",
    "units_sold_during": "Unidades vendidas durante la promoción",
    "warehouse_id": "ID del almacén",
    "stock_qty": "Cantidad en stock",
    "reorder_point": "Punto de reorden",
    "last_restocked_date": "Fecha del último reabastecimiento",
    "return_id": "ID de la devolución",
    "return_reason": "Motivo de devolución",
    "return_date": "Fecha de devolución",
    "refund_amount": "Monto reembolsado",
    "refund_method": "Método de reembolso",
    "reestocked": "Reincorporado al inventario",
    "review_id": "ID de la reseña",
    "review_score": "Puntaje de la reseña",
    "review_comment_title": "Título del comentario",
    "review_comment_message": "Comentario de la reseña",
    "review_creation_date": "Fecha de creación de la reseña",
    "review_answer_timestamp": "Fecha de respuesta a la reseña",
    "seller_id": "ID del vendedor",
    "seller_zip_code_prefix": "Código postal del vendedor",
    "seller_city": "Ciudad del vendedor",
    "seller_state": "Estado del vendedor",
    "id": "ID",
}

# Words that make up a label when every word of a name is known.
WORD_LABELS = {
    "total": "Total",
    "count": "cantidad",
    "number": "número",
    "average": "promedio",
    "avg": "promedio",
    "sum": "total",
    "orders": "pedidos",
    "order": "pedido",
    "customers": "clientes",
    "customer": "cliente",
    "products": "productos",
    "product": "producto",
    "sellers": "vendedores",
    "seller": "vendedor",
    "returns": "devoluciones",
    "return": "devolución",
    "payments": "pagos",
    "payment": "pago",
    "price": "precio",
    "revenue": "ingresos",
    "value": "valor",
    "amount": "monto",
    "quantity": "cantidad",
    "qty": "cantidad",
    "units": "unidades",
    "days": "días",
    "delivery": "entrega",
    "rate": "tasa",
    "score": "puntaje",
    "status": "estado",
    "date": "fecha",
}


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))


def column_label(key: Column) -> Column:
    """Registered label, else the translated words if all are known, else the name made readable."""
    plain = F.lower(F.trim(key))
    words = F.filter(F.split(plain, r"[_\-\s]+"), lambda w: w != "")
    translated = F.transform(words, lambda w: _lookup(WORD_LABELS, w))
    by_words = F.when((F.size(words) > 0) & ~F.exists(translated, lambda w: w.isNull()), _capital(F.array_join(translated, " ")))
    readable = F.regexp_replace(F.regexp_replace(F.trim(key), r"[_\-\s]+", " "), r"(?i)\bid\b", "ID")
    return F.coalesce(_lookup(COLUMN_LABELS, plain), by_words, _capital(readable))
