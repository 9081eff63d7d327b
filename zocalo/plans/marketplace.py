"""Business tables of the marketplace, built over the given parquet tables.

Column names follow the business model (orders, items, sellers, carriers, ...).
Every table is a lazy DataFrame, so Catalyst prunes the columns a query does not
touch and pushes its filters into the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Category values of the business model.
ORDER_STATUSES = {"F": "delivered", "O": "shipped", "P": "canceled"}
PAYMENT_TYPES = {
    "1-URGENT": "credit_card",
    "2-HIGH": "boleto",
    "3-MEDIUM": "voucher",
    "4-NOT SPECIFIED": "debit_card",
    "5-LOW": "not_defined",
}
CARRIER_TYPES = ["express", "standard", "economy", "freight"]
TICKET_CATEGORIES = ["envio", "producto", "pago", "reembolso", "garantia", "otro"]
TICKET_PRIORITIES = ["baja", "media", "alta", "critica"]
INCIDENT_TYPES = ["retraso", "producto_danado", "perdida", "direccion_incorrecta", "entrega_fallida"]
RESOLUTION_TYPES = ["reembolso", "reenvio", "compensacion", "sin_resolucion", "disculpa"]
CHANGE_REASONS = ["ajuste_inflacion", "promocion", "cambio_proveedor", "correccion_precio", "demanda_estacional"]
PROMO_TYPES = ["flash_sale", "seasonal", "clearance", "bundle", "loyalty"]
RETURN_REASONS = ["defectuoso", "no_coincide_descripcion", "talla_incorrecta", "llego_tarde", "cambio_opinion",
                  "danado_envio"]
REFUND_METHODS = ["tarjeta", "credito_tienda", "transferencia", "reembolso_original"]
TRANSLATED_TYPES = ["ECONOMY", "LARGE", "PROMO"]


SPREAD_BELOW = 256 * 1024 * 1024


def money(column: str) -> Column:
    return F.col(column).cast("decimal(12,2)")


def pick(values: list[str], index: Column) -> Column:
    """The value at ``index mod size``."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def mapped(column: str, values: dict[str, str]) -> Column:
    chain = None
    for key, value in values.items():
        hit = F.col(column) == key
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


class Marketplace:
    """Lazy access to the business tables under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are costly to process, over all cores even if it is one small file.

        Only inputs below ``SPREAD_BELOW`` are shuffled for this; larger ones come in
        enough splits by themselves.
        """
        df = self.raw(name)
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return df.repartition(self.spark.sparkContext.defaultParallelism) if size < SPREAD_BELOW else df

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def states(self) -> DataFrame:
        return self.raw("nation").select("n_nationkey", F.col("n_name").alias("state"))

    def orders(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            mapped("o_orderstatus", ORDER_STATUSES).alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("order_estimated_delivery_date"),
            mapped("o_orderpriority", PAYMENT_TYPES).alias("payment_type"),
            money("o_totalprice").alias("order_total"),
        )

    def deliveries(self) -> DataFrame:
        return self.raw("lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(
            F.max("l_shipdate").alias("order_delivered_customer_date"))

    def dated_orders(self) -> DataFrame:
        """Orders with their delivery date, which only delivered orders have."""
        orders = self.orders()
        delivered = self.deliveries()
        return orders.join(delivered, "order_id", "left").withColumn(
            "order_delivered_customer_date",
            F.when(F.col("order_status") == "delivered", F.col("order_delivered_customer_date")))

    def items(self) -> DataFrame:
        price = money("l_extendedprice")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_suppkey").alias("carrier_id"),
            price.alias("price"),
            (price * F.col("l_tax").cast("decimal(4,2)")).alias("freight_value"),
            F.col("l_shipdate").alias("shipping_limit_date"),
        )

    def customers(self) -> DataFrame:
        return (self.raw("customer")
                .join(self.states(), F.col("c_nationkey") == F.col("n_nationkey"))
                .select(F.col("c_custkey").alias("customer_id"),
                        F.concat(F.lit("buyer-"), F.expr("c_custkey div 2").cast("string")).alias("customer_unique_id"),
                        F.col("state").alias("customer_state")))

    def sellers(self) -> DataFrame:
        return (self.raw("supplier")
                .join(self.states(), F.col("s_nationkey") == F.col("n_nationkey"))
                .select(F.col("s_suppkey").alias("seller_id"), F.col("state").alias("seller_state")))

    def carriers(self) -> DataFrame:
        key = F.col("s_suppkey")
        covered = [F.concat(F.lit("NATION_"), ((key * m + a) % 25).cast("string")) for m, a in ((1, 0), (7, 3), (11, 5))]
        return self.raw("supplier").select(
            key.alias("carrier_id"),
            F.col("s_name").alias("carrier_name"),
            pick(CARRIER_TYPES, key).alias("carrier_type"),
            F.when(key % 20 == 0, "NACIONAL").otherwise(F.concat_ws(",", *covered)).alias("coverage_regions"),
            ((600 + (key * 37) % 400) / 1000).alias("on_time_rate"),
        )

    def products(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("product_id"),
                                       F.lower("p_type").alias("product_category_name"),
                                       F.col("p_size").alias("product_size"))

    def category_translation(self) -> DataFrame:
        return (self.raw("part").filter(F.col("p_type").isin(TRANSLATED_TYPES))
                .select(F.lower("p_type").alias("product_category_name")).distinct()
                .withColumn("product_category_name_english", F.concat("product_category_name", F.lit("_en"))))

    def payments(self) -> DataFrame:
        """One payment per order, two for every fifth order."""
        first = F.when(F.col("order_id") % 5 == 0, (F.col("order_total") * F.lit(0.6).cast("decimal(2,1)")).cast("decimal(12,2)")).otherwise(
            F.col("order_total"))
        rows = F.array(
            F.struct(F.lit(1).alias("payment_sequential"), F.col("first").alias("payment_value")),
            F.struct(F.lit(2).alias("payment_sequential"),
                     (F.col("order_total") - F.col("first")).cast("decimal(12,2)").alias("payment_value")))
        return (self.orders().withColumn("first", first)
                .withColumn("p", F.explode(F.when(F.col("order_id") % 5 == 0, rows).otherwise(F.slice(rows, 1, 1))))
                .select("order_id", "p.payment_sequential", "payment_type", "p.payment_value"))

    def reviews(self) -> DataFrame:
        """Most orders have one review, every tenth has two, some have none."""
        order = F.col("order_id")
        rows = F.array(
            F.struct(F.lit(1).alias("n"), (1 + order % 5).cast("int").alias("review_score"), F.lit(20).alias("days")),
            F.struct(F.lit(2).alias("n"), (1 + F.expr("order_id div 10") % 5).cast("int").alias("review_score"),
                     F.lit(25).alias("days")))
        return (self.orders().filter(order % 17 != 0)
                .withColumn("r", F.explode(F.when(order % 10 == 0, rows).otherwise(F.slice(rows, 1, 1))))
                .select("order_id",
                        F.concat(F.lit("r"), order.cast("string"), F.lit("-"), F.col("r.n").cast("string")).alias("review_id"),
                        F.col("r.review_score").alias("review_score"),
                        F.expr("order_purchase_timestamp + make_dt_interval(r.days)").alias("review_creation_date")))

    def inventory(self) -> DataFrame:
        stock = self.raw("lineitem").groupBy(F.col("l_partkey").alias("product_id"),
                                             F.col("l_suppkey").alias("seller_id")).agg(
            F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("int").alias("stock_qty"),
            F.max("l_shipdate").alias("last_restocked_date"))
        return (stock.join(self.products(), "product_id")
                .select((F.col("product_id") % 12).alias("warehouse_id"), "product_id", "seller_id", "stock_qty",
                        F.col("product_size").alias("reorder_point"), "last_restocked_date"))

    def price_history(self) -> DataFrame:
        """One price event per (product, seller, day)."""
        return (self.raw("lineitem")
                .groupBy(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("seller_id"),
                         F.col("l_shipdate").alias("change_at"))
                .agg((10 + F.max("l_linenumber")).cast("decimal(12,2)").alias("old_price"),
                     (10 + F.min("l_linenumber")).cast("decimal(12,2)").alias("new_price"))
                .withColumn("price_event_id", F.concat_ws("-", F.lit("pe"), F.col("product_id").cast("string"),
                                                          F.col("seller_id").cast("string"),
                                                          F.date_format("change_at", "yyyyMMdd")))
                .withColumn("change_reason", pick(CHANGE_REASONS, F.col("product_id"))))

    def promotions(self) -> DataFrame:
        """Two promotions per (product, seller) pair that was ever sold."""
        product, seller, k = F.col("l_partkey"), F.col("l_suppkey"), F.col("k")
        pairs = self.raw("lineitem").select("l_partkey", "l_suppkey").distinct()
        start = F.date_add(F.lit("1995-01-01").cast("date"), ((product * 31 + seller * 17 + k * 400) % 2200).cast("int"))
        return (pairs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
                .select(F.concat_ws("-", F.lit("pr"), product.cast("string"), seller.cast("string"),
                                    k.cast("string")).alias("promotion_id"),
                        product.alias("product_id"), seller.alias("seller_id"),
                        ((5 + (product + k) % 46) / 100).alias("discount_pct"),
                        start.alias("start_date"),
                        F.date_add(start, (7 + (product + seller + k * 5) % 24).cast("int")).alias("end_date"),
                        pick(PROMO_TYPES, product + seller).alias("promo_type"),
                        (20 + (product * 7 + seller) % 100).alias("units_sold_during")))

    def tickets(self) -> DataFrame:
        event = F.col("event_id")
        return self.raw("events").filter(F.col("event_type") == "error").select(
            event.alias("ticket_id"), event.alias("order_id"), F.col("user_id").alias("customer_id"), F.col("ts").alias("created_at"),
            pick(TICKET_CATEGORIES, event).alias("category"),
            pick(TICKET_PRIORITIES, F.col("user_id")).alias("priority"),
            money("value").alias("resolution_time_hr"),
            F.when(event % 13 != 0, (1 + event % 5).cast("int")).alias("satisfaction_score"),
            (F.col("value") > 20).alias("resolved"))

    def incidents(self) -> DataFrame:
        event = F.col("event_id")
        return self.raw("events").filter(F.col("event_type") == "click").select(
            event.alias("incident_id"), event.alias("order_id"),
            pick(INCIDENT_TYPES, F.col("user_id")).alias("incident_type"),
            F.col("ts").alias("reported_date"),
            F.when(event % 5 != 0, F.expr("ts + make_dt_interval(CAST(1 + event_id % 30 AS INT))")).alias("resolved_date"),
            pick(RESOLUTION_TYPES, event).alias("resolution_type"),
            money("value").alias("compensation_value"))

    def returns(self) -> DataFrame:
        half = F.when(F.col("l_orderkey") % 10 < 3, F.lit(0.5)).otherwise(F.lit(1.0)).cast("decimal(2,1)")
        return self.raw("lineitem").filter(F.col("l_returnflag") == "R").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            pick(RETURN_REASONS, F.col("l_partkey")).alias("return_reason"),
            F.expr("l_shipdate + make_dt_interval(1 + l_linenumber)").alias("return_date"),
            (money("l_extendedprice") * half).cast("decimal(12,2)").alias("refund_amount"),
            pick(REFUND_METHODS, F.col("l_suppkey")).alias("refund_method"))
