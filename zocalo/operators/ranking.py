"""Orderings, top-n and best-per-key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, value: str, keys: list[str], descending: bool = True, top: int | None = None) -> DataFrame:
    """Order by ``value`` with ``keys`` as tie-break; ``top`` turns it into a top-k."""
    first = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    ordered = df.orderBy(first, *[F.col(k).asc() for k in keys])
    return ordered.limit(top) if top is not None else ordered


def nearest_average(df: DataFrame, value: str, keys: list[str], top: int | None = None) -> DataFrame:
    """Order by the distance of ``value`` to its average over all rows.

    The average is a one-row aggregate joined back, so no window pulls every row
    into a single partition.
    """
    average = df.agg(F.avg(F.col(value).cast("double")).alias("_avg"))
    spread = (df.join(F.broadcast(average))  # one row by construction
              .withColumn("distance_to_average", F.round(F.abs(F.col(value).cast("double") - F.col("_avg")), 6))
              .drop("_avg"))
    return ranked(spread, "distance_to_average", keys, descending=False, top=top)


def best_per_key(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """One row per key, the smallest by ``order``; partial aggregation runs before the shuffle."""
    best = F.min_by(F.struct(*payload), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*")


def top_n_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """First ``n`` rows per key.  Spark keeps only n rows per key and task before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def flag_duplicates(df: DataFrame, keys: list[str], name: str = "duplicated") -> DataFrame:
    """Mark rows whose key occurs more than once.

    The counts are aggregated first and joined back: a hot key then is a skewed
    join that AQE can split, not one window partition.
    """
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) > 1).alias(name))
    return df.join(counts, keys)
