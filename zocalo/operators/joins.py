"""Enrichment joins and key audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.operators.ordered import asof_backward, running_max
from zocalo.operators.ranking import best_per_key, top_n_per_key

NATIONWIDE = "NACIONAL"


def left_once(left: DataFrame, right: DataFrame, key: str, order: list[str], take: list[str]) -> DataFrame:
    """Left join with at most one right row per key, the first by ``order``."""
    return left.join(best_per_key(right, [key], order, take), key, "left")


def winner_segments(intervals: DataFrame, by: list[str], start: str, end: str, interval_id: str, parts: int | None = None) -> DataFrame:
    """Overlapping intervals of a key as disjoint stretches of time, each won by the interval with the least (start, id).

    (by, _from, _segment): the stretch begins at ``_from`` and lasts to ``_segment._until``, both inclusive. In order of (start, id) an interval
    wins exactly what lies beyond the latest end so far, as everything up to there is covered by an earlier one. So each interval gives
    at most one stretch, however long it is.
    """
    at = lambda c: F.col(c).cast("timestamp_ntz")
    keyed = F.col(start) <= F.col(end)
    for column in by:
        keyed = keyed & F.col(column).isNotNull()
    usable = intervals.filter(keyed).select(*by, F.col(start).alias("_start"), F.col(interval_id).alias("_id"), at(start).alias("_begin"), at(end).alias("_until"))
    covered = running_max(usable, by, "_begin", ["_id"], F.col("_until"), "_covered", before=True, parts=parts)
    beyond = F.col("_covered") + F.expr("interval 1 microsecond")  # the next instant that a timestamp can hold
    return (covered.filter(F.col("_covered").isNull() | (F.col("_until") > F.col("_covered")))
            .select(*by, F.greatest("_begin", beyond).alias("_from"), F.struct("_until", "_start", "_id").alias("_segment")))


def first_valid_interval(sales: DataFrame, intervals: DataFrame, by: list[str], group: str, ts: str, start: str,
                         end: str, interval_id: str, parts: int | None = None) -> DataFrame:
    """Per ``group`` the first interval (by start, id) that covers one of its sales.

    An interval is valid from the start of its first day to midnight of its last
    day, both inclusive.  Intervals become disjoint stretches first; each sale then looks
    up the last stretch that begins at or before it, in one ordered scan over both.
    """
    dated = sales.select(group, *by, ts).filter(F.col(ts).isNotNull())
    segments = winner_segments(intervals, by, start, end, interval_id, parts)
    found = asof_backward(dated, segments, by, ts, "_from", "_segment", parts)
    valid = found.filter(F.col(ts) <= F.col("_segment._until")).select(group, F.struct("_segment._start", "_segment._id").alias("_valid"))
    return valid.groupBy(group).agg(F.min("_valid")["_id"].alias(interval_id))


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str) -> DataFrame:
    """Distinct non-null child keys without a parent row."""
    keys = child.select(F.col(column).alias("_k")).filter(F.col("_k").isNotNull()).distinct()
    parents = parent.select(F.col(parent_column).alias("_k"))
    return keys.join(parents, "_k", "left_anti").select(F.lit(name).alias("fk"), F.col("_k").cast("string").alias("value"))


def orphan_report(pairs: list[tuple[str, DataFrame, str, DataFrame, str]], sample: int = 3) -> DataFrame:
    """One row per key pair: number of bad keys and the first few of them."""
    bad = None
    for name, child, column, parent, parent_column in pairs:
        found = orphan_keys(child, column, parent, parent_column, name)
        bad = found if bad is None else bad.unionByName(found)
    counts = bad.groupBy("fk").agg(F.count(F.lit(1)).alias("bad_count"))
    examples = (top_n_per_key(bad, ["fk"], [F.col("value")], sample).groupBy("fk")
                .agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("examples")))
    names = F.explode(F.array(*[F.lit(p[0]) for p in pairs])).alias("fk")
    listed = bad.sparkSession.range(1).select(names)
    return (listed.join(counts, "fk", "left").join(examples, "fk", "left")
            .select("fk", F.coalesce("bad_count", F.lit(0)).alias("bad_count"), F.coalesce("examples", F.lit("")).alias("examples")))


def coverage_map(carriers: DataFrame, regions: list[str]) -> DataFrame:
    """(region, carrier) pairs; a nationwide carrier covers every region."""
    listed = F.array_distinct(F.transform(F.split("coverage_regions", ","), lambda r: F.trim(r)))
    everywhere = F.array(*[F.lit(r) for r in regions])
    covered = F.when(F.array_contains(listed, NATIONWIDE), everywhere).otherwise(listed)
    return carriers.select("carrier_id", F.explode(covered).alias("region"))


def coverage_counts(carriers: DataFrame, regions: list[str]) -> DataFrame:
    """Carriers per region of a closed list, zero included."""
    listed = carriers.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in regions])).alias("region"))
    counts = coverage_map(carriers, regions).groupBy("region").agg(F.count(F.lit(1)).alias("carriers"))
    return listed.join(counts, "region", "left").select("region", F.coalesce("carriers", F.lit(0)).alias("carriers"))


def text_key(*columns: str) -> dict[str, Column]:
    """Cast join keys to one type, for ``withColumns``."""
    return {c: F.col(c).cast("string") for c in columns}
