"""Row filters over the closed set of business fields."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields a question may filter on.
FILTER_FIELDS = ("state", "order_status", "payment_type", "priority", "resolved")
ROW_CAP = 200


def equals_all(filters: Iterable[tuple[str, object]], columns: dict[str, str] | None = None) -> Column:
    """Every field must hold one of the values given for it; ``columns`` maps a field to the column holding it."""
    names = columns or {}
    wanted: dict[str, list[object]] = {}
    for field, value in filters:
        if field not in FILTER_FIELDS:
            raise ValueError(f"unknown filter field: {field}")
        wanted.setdefault(field, []).append(str(value).lower() == "true" if field == "resolved" else value)
    terms = [F.col(names.get(field, field)).isin(values) for field, values in wanted.items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def in_days(ts: str, start: str, end: str) -> Column:
    """``start <= day(ts) <= end`` without wrapping ``ts``, so it still reaches the scan."""
    first = F.lit(start).cast("date").cast("timestamp_ntz")
    after = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return (F.col(ts) >= first) & (F.col(ts) < after)


def late_flag(delivered: str, promised: str) -> Column:
    """1 when delivered after the promised date; an unknown date is not late."""
    return F.coalesce((F.col(delivered) > F.col(promised)).cast("int"), F.lit(0))


def low_stock() -> Column:
    return F.col("stock_qty") < F.col("reorder_point")


def open_ticket() -> Column:
    return ~F.col("resolved")


def open_incident() -> Column:
    return F.col("resolved_date").isNull()


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on derived columns without repeating their derivation.

    A plain filter is pushed below the projections and takes a copy of every
    expression it reads with it; long text rules would then run once per mention.
    Exploding a one-element list keeps the test above them.
    """
    return df.withColumn("_kept", F.explode(F.when(condition, F.array(F.lit(1))))).drop("_kept")


def cap_rows(df: DataFrame, order: list[Column], cap: int = ROW_CAP, exact_flag: bool = True) -> DataFrame:
    """The first ``cap`` rows plus ``truncated``.

    ``exact_flag=False`` reproduces the older reading, which also flags a result
    of exactly ``cap`` rows.  Only ``cap + 1`` rows ever reach the last stage.
    """
    head = df.orderBy(*order).limit(cap + 1)
    one = Window.partitionBy(F.lit(1))
    seen = F.count(F.lit(1)).over(one)
    return (head.withColumn("_n", F.row_number().over(one.orderBy(*order)))
            .withColumn("truncated", seen > cap if exact_flag else seen >= cap)
            .filter(F.col("_n") <= cap).drop("_n"))
