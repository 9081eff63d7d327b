"""Metric layer: metric x operation x grouping x filter x period -> DataFrame.

A ``MetricSpec`` is turned into one declarative plan.  Only the tables the spec
needs are joined; Catalyst pushes filters and prunes columns from there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.operators.aggregates import exact_median
from zocalo.operators.filters import cap_rows, equals_all, in_days
from zocalo.operators.ranking import nearest_average, ranked
from zocalo.plans.marketplace import Marketplace


@dataclass(frozen=True)
class Metric:
    table: str
    column: str
    aggregate: str
    date: str | None


PURCHASE = "order_purchase_timestamp"

# The closed list of metrics, with the table and date each reads.
METRICS = {
    "revenue": Metric("items", "price", "sum", PURCHASE),
    "order_count": Metric("orders", "order_id", "count_distinct", PURCHASE),
    "on_time_rate": Metric("carriers", "on_time_rate", "average", None),
    "freight_value": Metric("items", "freight_value", "sum", PURCHASE),
    "review_score": Metric("reviews", "review_score", "average", PURCHASE),
    "stock_qty": Metric("inventory", "stock_qty", "sum", "last_restocked_date"),
    "reorder_point": Metric("inventory", "reorder_point", "sum", "last_restocked_date"),
    "returns_count": Metric("returns", "order_id", "count", "return_date"),
    "refund_amount": Metric("returns", "refund_amount", "sum", "return_date"),
    "incidents_count": Metric("incidents", "incident_id", "count", "reported_date"),
    "compensation_value": Metric("incidents", "compensation_value", "sum", "reported_date"),
    "ticket_count": Metric("tickets", "ticket_id", "count", "created_at"),
    "resolution_time_hr": Metric("tickets", "resolution_time_hr", "average", "created_at"),
    "satisfaction_score": Metric("tickets", "satisfaction_score", "average", "created_at"),
    "price": Metric("items", "price", "average", PURCHASE),
}

OPERATIONS = ("rank_desc", "rank_asc", "rank_nearest_average", "compare", "median", "average", "count", "sum", "detail")
GROUPINGS = ("month", "state", "category", "seller", "carrier")
ITEM_GROUPINGS = {"category", "seller", "carrier"}
#: What identifies a row's dealings: the columns by which a table meets the order items.
ITEM_KEYS = {"orders": ["order_id"], "reviews": ["order_id"], "incidents": ["order_id"], "tickets": ["order_id"], "carriers": ["carrier_id"],
             "inventory": ["product_id", "seller_id"], "returns": ["order_id", "product_id", "seller_id"], "items": ["order_id"]}


@dataclass(frozen=True)
class MetricSpec:
    """``metric`` is one name or several; ``compare`` holds values of the first grouping as text."""

    metric: str | tuple[str, ...]
    operation: str | None = None
    group_by: tuple[str, ...] = ()
    filters: tuple[tuple[str, str], ...] = ()
    date_range: tuple[str, str] | None = None
    state_of: str = "customer"
    top: int | None = None
    compare: tuple[str, ...] = ()

    @property
    def metrics(self) -> tuple[str, ...]:
        return (self.metric,) if isinstance(self.metric, str) else tuple(self.metric)


def month_of(ts: str) -> Column:
    return F.date_trunc("month", F.col(ts)).cast("timestamp_ntz")


def _sources(spec: MetricSpec) -> dict[str, str]:
    """The column each dimension of ``spec`` is derived from."""
    state = "customer_id" if spec.state_of == "customer" else "seller_id"
    return {"state": state, "category": "product_id", "seller": "seller_id", "carrier": "carrier_id", "order_status": "order_id",
            "payment_type": "order_id", "month": PURCHASE, "period": PURCHASE}


def _with_orders(market: Marketplace, df: DataFrame, wanted: set[str]) -> DataFrame:
    """Adds those of the wanted order columns that ``df`` lacks."""
    missing = [c for c in ("customer_id", "order_status", PURCHASE) if c in wanted and c not in df.columns]
    return df.join(market.orders().select("order_id", *missing), "order_id") if missing else df


def _with_dimensions(market: Marketplace, df: DataFrame, spec: MetricSpec, dims: set[str], date: str | None) -> DataFrame:
    """Derives ``dims`` from the columns of ``df`` and applies the filters among them."""
    if "state" in dims:
        if spec.state_of == "customer":
            df = df.join(market.customers().select("customer_id", F.col("customer_state").alias("state")), "customer_id")
        else:
            df = df.join(market.sellers().select("seller_id", F.col("seller_state").alias("state")), "seller_id")
    if "category" in dims and "category" not in df.columns:
        df = df.join(market.products().select("product_id", "product_category_name"), "product_id")
        df = df.join(market.category_translation(), "product_category_name", "left")
        df = df.withColumn("category", F.coalesce("product_category_name_english", "product_category_name"))
    for dim in ("seller", "carrier"):
        if dim in dims:
            df = df.withColumn(dim, F.col(f"{dim}_id"))
    if "month" in dims:
        df = df.withColumn("month", month_of(date))
    wanted = [(f, v) for f, v in spec.filters if f in dims]
    paid_by = [v for f, v in wanted if f == "payment_type"]
    if paid_by and "payment_type" not in df.columns:
        paid = market.payments().filter(F.col("payment_type").isin(paid_by)).select("order_id")
        df = df.join(paid, "order_id", "left_semi")  # semi: several payments must not multiply rows
        wanted = [(f, v) for f, v in wanted if f != "payment_type"]
    if wanted:
        df = df.filter(equals_all(wanted))
    if spec.date_range and "period" in dims:
        df = df.filter(in_days(date, *spec.date_range))
    return df


def _fact(market: Marketplace, spec: MetricSpec, metric: Metric) -> DataFrame:
    """The metric's table joined with just the dimensions the spec mentions.

    A dimension that the table's own columns cannot give is reached over the order items: each row counts once for every
    different value among the items it meets (a review once in each category of its order, say).
    """
    groups, fields = set(spec.group_by), {field for field, _ in spec.filters}
    table = metric.table
    if table == "orders" and groups & ITEM_GROUPINGS:
        table = "items"  # item grain: orders must then be counted distinct
    df = market.table(table)
    dims = groups | fields | ({"period"} if spec.date_range else set())
    sources = _sources(spec)
    own, met, order_columns = set(), set(), set()
    for dim in dims:
        source = metric.date if dim in ("month", "period") and metric.date else sources.get(dim, dim)
        if dim in df.columns or source in df.columns and source != "order_id":
            own.add(dim)
        elif "order_id" in df.columns and (source in ("customer_id", PURCHASE) or dim in ("order_status", "payment_type")):
            own.add(dim)
            order_columns.add(dim if dim == "order_status" else source)
        elif dim in sources:
            met.add(dim)
        else:
            raise ValueError(f"{table} cannot be filtered by {dim}")
    df = _with_dimensions(market, _with_orders(market, df, order_columns), spec, own, metric.date or PURCHASE)
    if met:
        needed = {sources[d] for d in met} | ({"order_status"} & met)
        keys = ITEM_KEYS[table]
        through = _with_orders(market, market.items().select("order_id", "product_id", "seller_id", "carrier_id"), needed)
        through = _with_dimensions(market, through, spec, met, PURCHASE)
        df = df.join(through.select(*keys, *sorted(met & groups)).distinct(), keys)
    return df


COUNTS = ("count", "count_distinct")


def _aggregate(metric: Metric, operation: str | None) -> Column:
    """The value of one group. A count is never taken over the ids themselves: its sum is the count."""
    if metric.aggregate in COUNTS:
        return F.count_distinct(F.col(metric.column)) if metric.aggregate == "count_distinct" else F.count(F.lit(1))
    kind = operation if operation in ("sum", "average", "count") else metric.aggregate
    column = F.col(metric.column)
    return {"sum": F.sum(column), "average": F.avg(column.cast("double")), "count": F.count(F.lit(1))}[kind]


def _checked(spec: MetricSpec) -> None:
    for name in spec.metrics:
        if name not in METRICS:
            raise ValueError(f"unknown metric: {name}")
    if spec.operation is not None and spec.operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {spec.operation}")
    if not set(spec.group_by) <= set(GROUPINGS):
        raise ValueError(f"unknown grouping in {spec.group_by}")
    if spec.operation == "compare" and not (spec.group_by and spec.compare):
        raise ValueError("compare needs a grouping and the values to compare")
    if spec.operation in ("average", "median") and not spec.group_by and any(METRICS[n].aggregate in COUNTS for n in spec.metrics):
        raise ValueError(f"the {spec.operation} of a count needs a grouping to count by")


def metric_query(market: Marketplace, spec: MetricSpec) -> DataFrame:
    """The DataFrame that answers ``spec``; each value column has its metric's name.

    Several metrics of one table come from one pass over it; those of different tables are joined on the groups, of
    which none is lost. The average or median of a count is that of the groups' counts, one row.
    """
    _checked(spec)
    names = spec.metrics
    if len(names) > 1:
        return _several(market, spec)
    name = names[0]
    metric = METRICS[name]
    groups = list(spec.group_by)
    fact = _fact(market, spec, metric)
    if spec.operation == "detail":
        order = [F.col(c).asc_nulls_first() for c in fact.columns]
        return fact.withColumn("truncated", F.lit(False)) if spec.top is None else cap_rows(fact, order, spec.top)
    if spec.operation in ("average", "median") and metric.aggregate in COUNTS:
        counts = fact.groupBy(*groups).agg(_aggregate(metric, None).alias(name))
        return exact_median(counts, [], name, name) if spec.operation == "median" else counts.agg(F.avg(name).alias(name))
    if spec.operation == "median":
        return exact_median(fact, groups, metric.column, name)
    value = _aggregate(metric, spec.operation)
    if spec.operation == "compare":
        side, rest = groups[0], groups[1:]
        as_text = F.date_format(side, "yyyy-MM-dd") if side == "month" else F.col(side).cast("string")
        return fact.withColumn(side, as_text).groupBy(*rest).pivot(side, list(spec.compare)).agg(value)
    result = fact.groupBy(*groups).agg(value.alias(name))
    if spec.operation in ("rank_desc", "rank_asc"):
        return ranked(result, name, groups, spec.operation == "rank_desc", spec.top)
    if spec.operation == "rank_nearest_average":
        return nearest_average(result, name, groups, spec.top)
    return result.orderBy("month") if groups == ["month"] else result


def _several(market: Marketplace, spec: MetricSpec) -> DataFrame:
    if spec.operation not in (None, "sum", "average", "count"):
        raise ValueError(f"{spec.operation} takes one metric")
    if spec.operation == "average" and any(METRICS[n].aggregate in COUNTS for n in spec.metrics):
        raise ValueError("the average of a count takes one metric")
    groups = list(spec.group_by)
    shared: dict[tuple[str, str | None], list[str]] = {}
    for name in spec.metrics:
        shared.setdefault((METRICS[name].table, METRICS[name].date), []).append(name)
    parts = [_fact(market, replace(spec, metric=names[0]), METRICS[names[0]]).groupBy(*groups).agg(
        *[_aggregate(METRICS[n], spec.operation).alias(n) for n in names]) for names in shared.values()]
    if len(parts) == 1:
        return parts[0]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.groupBy(*groups).agg(*[F.max(n).alias(n) for n in spec.metrics])
