"""Running values per key in time order; of large inputs over ranges of (key, time) instead of one task per key.

Rows are dealt by sampled ranges of (key, time, tie-break), so a key with very many rows is simply spread over many ranges. Each
range is scanned on its own; what a key brings along from the ranges before comes from one aggregate with one row per range.
An input so small that a single task could sort all of it is dealt by key instead, which needs no sample and no Python; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of input up to which rows are dealt by key: one key that holds them all is then still a sort that a task can spill.
BY_KEY_BELOW = 4 << 30


def _read_bytes(df: DataFrame) -> int:
    """Estimated size of the tables that ``df`` reads."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def _key_starts(batch: pa.RecordBatch, by: list[str]) -> np.ndarray:
    """Whether each row's key differs from that of the row before; the first row counts as different."""
    fresh = np.ones(batch.num_rows, bool)
    if batch.num_rows > 1:
        same = np.ones(batch.num_rows - 1, bool)
        for name in by:
            column = batch.column(name)
            a, b = column.slice(1), column.slice(0, batch.num_rows - 1)
            equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            same &= equal.to_numpy(zero_copy_only=False)
        fresh[1:] = ~same
    return fresh


def _last_places(values: pa.Array, start: np.ndarray) -> np.ndarray:
    """Place of the last value at or before each row within its key, -1 where there is none."""
    place = np.arange(len(values))
    last = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), place, -1))
    return np.where(last >= start, last, -1)


def _largest_places(values: pa.Array, start: np.ndarray) -> np.ndarray:
    """Place of the largest value at or before each row within its key, -1 where there is none."""
    n = len(values)
    order = pc.sort_indices(values, sort_keys=[("", "ascending")], null_placement="at_start").to_numpy().astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    rank[~values.is_valid().to_numpy(zero_copy_only=False)] = -1
    number = np.cumsum(np.concatenate([[0], start[1:] != start[:-1]]))  # of the key, so that each key's ranks lie above the last one's
    running = np.maximum.accumulate(rank + number * (n + 1)) - number * (n + 1)
    return np.where(running >= 0, order[np.maximum(running, 0)], -1)


def _scan(by: list[str], name: str, largest: bool, before: bool):
    """Worker: rows sorted by key and time get the running value of their key within the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, carried = None, None  # key of the last row, and its running value as an array of one
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = _key_starts(batch, by)
            start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            goes_on = tail is not None and all(batch.column(c)[0].as_py() == v for c, v in zip(by, tail))
            values = batch.column("_value")
            if goes_on and carried is not None:
                values = pa.concat_arrays([carried, values])  # takes part as a row before the first one
                fronted = np.concatenate([[0], np.where(start == 0, 0, start + 1)])
            else:
                fronted = start
            places = (_largest_places if largest else _last_places)(values, fronted)
            front = len(values) - n
            if before:
                shifted = np.concatenate([[-1], places[:-1]])
                own = np.where(shifted >= fronted, shifted, -1)[front:]
            else:
                own = places[front:]
            running = values.take(pa.array(np.maximum(own, 0), mask=own < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, running], names=[*batch.schema.names, name])
            end = places[-1]
            carried = values.slice(end, 1) if end >= 0 else None
            tail = [batch.column(c)[n - 1].as_py() for c in by]

    return run


def _running(df: DataFrame, by: list[str], ts: str, tie: list[str], value: Column, name: str, largest: bool, before: bool,
             parts: int | None) -> DataFrame:
    if by and parts is None and _read_bytes(df) < BY_KEY_BELOW:
        given = F.when(F.col(ts).isNotNull(), value)
        upto = Window.partitionBy(*by).orderBy(ts, *tie).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
        running = (F.max(given) if largest else F.last(given, ignorenulls=True)).over(upto)
        return df.withColumn(name, running).withColumn(name, F.when(F.col(ts).isNotNull(), F.col(name)))
    columns, order = df.columns, list(dict.fromkeys([*by, ts, *tie]))
    rest = [c for c in columns if c not in order]
    given = F.when(F.col(ts).isNotNull(), value)
    rows = df.select(*order, given.alias("_value"), F.struct(F.lit(0).alias("_"), *rest).alias("_rest"))
    # A fixed number of ranges, so that both readings below number them alike.
    count = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(count, *order).withColumn("_part", F.spark_partition_id())
    mark = F.struct(*by, "_value") if largest else F.struct(*order, "_value")
    # The hash asks for whole rows, so that both readings share one shuffle.
    ends = ranged.groupBy("_part").agg(F.min(F.struct(F.lit(0).alias("_"), *by)).alias("_first"), F.max(F.when(F.col("_value").isNotNull(), mark)).alias("_last"),
                                       F.max(F.xxhash64("_rest")).alias("_seen"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    entering = ends.filter(F.col("_seen").isNotNull()).withColumn("_entering", F.max("_last").over(earlier))
    for c in by:
        entering = entering.filter(F.col(f"_entering.{c}").eqNullSafe(F.col(f"_first.{c}")))
    entering = entering.filter(F.col("_entering").isNotNull()).select(F.col("_part").alias("_of"), "_first", F.col("_entering._value").alias("_brought"))
    schema = f"{ranged._jdf.schema().toDDL()}, `{name}` {rows.schema['_value'].dataType.simpleString()}"
    scanned = ranged.sortWithinPartitions(*order).mapInArrow(_scan(by, name, largest, before), schema)
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_first.{c}"))
    joined = scanned.join(F.broadcast(entering), same, "left")  # at most one row per range
    both = F.greatest(name, "_brought") if largest else F.coalesce(name, "_brought")
    return joined.select(*[F.col(f"_rest.{c}").alias(c) if c in rest else F.col(c) for c in columns], F.when(F.col(ts).isNotNull(), both).alias(name))


def running_last(df: DataFrame, by: list[str], ts: str, tie: list[str], value: Column, name: str, before: bool = False,
                 parts: int | None = None) -> DataFrame:
    """Add the last non-null ``value`` of the key in (``ts``, ``tie``) order.

    ``before=True`` leaves the row's own value out.  Rows without ``ts`` get null.  One shuffle, into ``parts`` ranges if given; by default a
    large input goes to as many ranges as the session has shuffle partitions, a small one by key. How rows are cut never changes the result.
    """
    return _running(df, by, ts, tie, value, name, False, before, parts)


def running_max(df: DataFrame, by: list[str], ts: str, tie: list[str], value: Column, name: str, before: bool = False,
                parts: int | None = None) -> DataFrame:
    """As ``running_last``, with the largest value so far."""
    return _running(df, by, ts, tie, value, name, True, before, parts)


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, right_id: str,
                  parts: int | None = None) -> DataFrame:
    """Left rows with the last right event of the same key at or before their time.

    One shuffle over the union of both sides instead of a range join.  On equal
    times the event with the largest id wins; rows without time or without a key
    match nothing.
    """
    keyed = F.lit(True)
    for column in by:
        keyed = keyed & F.col(column).isNotNull()
    events = right.filter(keyed & F.col(right_ts).isNotNull()).select(
        *by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(right_id).alias("_event"))
    sales = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"),
                        F.struct(*left.columns).alias("_row"))
    both = sales.unionByName(events, allowMissingColumns=True)
    scanned = running_last(both, by, "_ts", ["_side", "_event"], F.col("_event"), right_id, parts=parts)
    return scanned.filter(F.col("_side") == 1).select("_row.*", right_id)


def chain_breaks(events: DataFrame, by: list[str], ts: str, event_id: str, old: str, new: str, parts: int | None = None) -> DataFrame:
    """Events whose old value differs from the new value of the event before."""
    linked = running_last(events, by, ts, [event_id], F.col(new), "previous", before=True, parts=parts)
    return linked.filter(F.col("previous").isNotNull() & (F.col(old) != F.col("previous")))
