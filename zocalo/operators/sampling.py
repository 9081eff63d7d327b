"""Reproducible sampling and assignment.

Randomness is a hash of (seed, row key), so results do not depend on how the
data is partitioned or on task retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zocalo.operators.ordered import asof_backward
from zocalo.session import shared_dir

HASH_RANGE = 2 ** 32
#: Rows that a hash bucket is meant to hold.
BUCKET_ROWS = 4096


def hash32(seed: str, *keys: Column) -> Column:
    """First 32 bits of md5("seed:key[:key...]") as a non-negative bigint."""
    text = F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def uniform(seed: str, *keys: Column) -> Column:
    """Number in (0, 1)."""
    return (hash32(seed, *keys) + 0.5) / HASH_RANGE


def weighted_sample(df: DataFrame, key: str, weight: Column, k: int, seed: str) -> DataFrame:
    """``k`` rows without replacement, probability proportional to ``weight``.

    The k smallest of ``-ln(u) / w``; each task keeps its own k best.
    """
    return (df.withColumn("_w", weight.cast("double")).filter(F.col("_w") > 0)
            .withColumn("_race", -F.log(uniform(seed, F.col(key))) / F.col("_w"))
            .orderBy("_race", key).limit(k).drop("_w", "_race"))


def bucketed(df: DataFrame, id_columns: list[str], rows: int = BUCKET_ROWS, seed: str = "bucket") -> tuple[DataFrame, int]:
    """``df`` with the hash ``_h`` of its ids and the bucket ``_b``, its leading bits, and how many bits that are.

    There are as many buckets as the row count asks for. They are stretches of the order by hash, so that how many there are never changes the order.
    """
    bits = min(31, max(0, (df.count() // rows).bit_length()))
    hashed = df.withColumn("_h", hash32(seed, *[F.col(c) for c in id_columns]))
    return hashed.withColumn("_b", F.shiftright("_h", 32 - bits) if bits else F.lit(0).cast("bigint")), bits


def bucket_offsets(spread: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """(keys, _b, _c, _o, n): rows of each bucket, of the buckets before it, and of the group.

    Counts are added up in a tree of two levels, so that no task sees more than about the square root of the buckets of a group.
    """
    branch = F.shiftright("_b", bits // 2)
    sizes = spread.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c")).withColumn("_t", branch)
    earlier = lambda window, order: window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    trunk = sizes.groupBy(*keys, "_t").agg(F.sum("_c").alias("_s"))
    trunk = trunk.select(*keys, "_t", F.coalesce(F.sum("_s").over(earlier(group, "_t")), F.lit(0)).alias("_before"), F.sum("_s").over(group).alias("n"))
    within = F.coalesce(F.sum("_c").over(earlier(Window.partitionBy(*keys, "_t"), "_b")), F.lit(0))
    return sizes.withColumn("_in", within).join(trunk, [*keys, "_t"]).select(*keys, "_b", "_c", (F.col("_before") + F.col("_in")).alias("_o"), "n")


def numbered(df: DataFrame, keys: list[str], id_columns: list[str], name: str = "idx", rows: int = BUCKET_ROWS,
             seed: str = "bucket") -> DataFrame:
    """Dense 0-based number per ``keys`` group in the order of a hash of the ids, plus the group size ``n``.

    Rows are spread over hash buckets of about ``rows``; a bucket is numbered locally and shifted by
    the sizes of the buckets before it, so no task holds a whole group.
    """
    spread, bits = bucketed(df, id_columns, rows, seed)
    local = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *id_columns)) - 1
    return (spread.withColumn("_local", local).join(bucket_offsets(spread, keys, bits), [*keys, "_b"])
            .withColumn(name, F.col("_local") + F.col("_o")).drop("_local", "_o", "_c", "_b", "_h"))


def in_order(df: DataFrame, order: list[Column], name: str = "idx") -> DataFrame:
    """Dense 0-based number of each row in ``order``.

    The sorted rows are kept in the shared folder; each sorted part is numbered by itself and shifted by the sizes of
    the parts before it, so no task holds more than its own part.
    """
    shared_dir(df.sparkSession)
    parts = df.orderBy(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))  # one row per part
    before = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_local", local).join(offsets, "_part").withColumn(name, F.col("_local") + F.col("_o")).drop("_part", "_local", "_o")


def sample_with_replacement(df: DataFrame, id_columns: list[str], draws: int, seed: str, rows: int = BUCKET_ROWS) -> DataFrame:
    """``draws`` uniform picks with replacement, one output row per draw.

    A draw is a place in the order by hash. It goes down the bucket counts first; only rows of buckets that were drawn are then numbered.
    """
    spread, bits = bucketed(df.select(*id_columns), id_columns, rows)
    offsets = bucket_offsets(spread, [], bits)
    size = F.broadcast(df.agg(F.count(F.lit(1)).alias("_n")))  # one row
    total = df.sparkSession.range(draws).withColumnRenamed("id", "draw")
    picks = total.join(size).filter("_n > 0").select("draw", (hash32(seed, F.col("draw")) % F.col("_n")).alias("_idx"))
    leaf = offsets.select(F.col("_o").alias("_from"), F.struct("_b", "_o").alias("_leaf"))
    placed = asof_backward(picks, leaf, [], "_idx", "_from", "_leaf").select("draw", "_leaf._b", (F.col("_idx") - F.col("_leaf._o") + 1).alias("_local"))
    drawn = spread.join(placed.select("_b").distinct(), "_b", "left_semi")
    local = drawn.withColumn("_local", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *id_columns)))
    return placed.join(local, ["_b", "_local"]).select("draw", *id_columns)


def assign_by_region(orders: DataFrame, coverage: DataFrame, carriers: DataFrame, order_id: str, region: str,
                     seed: str) -> DataFrame:
    """One carrier per order among those covering its region, or among all if the region is unknown; null if there is none.

    Carriers are numbered per region; the order's hash picks a number.  The lookup
    joins on (region, number), so a region with many orders or carriers is spread.
    """
    everyone = carriers.select(F.lit("*").alias("region"), "carrier_id")
    choices = numbered(coverage.select("region", "carrier_id").unionByName(everyone), ["region"], ["carrier_id"])
    sizes = choices.groupBy("region").agg(F.max("n").alias("_n"))
    known = sizes.withColumnRenamed("region", "_known")
    placed = (orders.join(known, F.col(region) == F.col("_known"), "left")
              .withColumn("_region", F.coalesce("_known", F.lit("*"))))
    fallback = F.broadcast(sizes.filter(F.col("region") == "*").select(F.col("_n").alias("_all")))  # one row
    picks = placed.join(fallback, F.lit(True), "left").withColumn(
        "_idx", hash32(seed, F.col(order_id)) % F.coalesce("_n", "_all"))
    chosen = choices.select(F.col("region").alias("_region"), F.col("idx").alias("_idx"), "carrier_id")
    return picks.join(chosen, ["_region", "_idx"], "left").select(*orders.columns, "carrier_id")


def incident_weight(late: Column, score: Column) -> Column:
    return 1.0 + late * 3.0 + (F.coalesce(score, F.lit(5)) <= 2).cast("int") * 4.0


def ticket_weight(score: Column) -> Column:
    known = F.coalesce(score, F.lit(5))
    return 1.0 + (known <= 2).cast("int") * 4.0 + (known == 3).cast("int") * 1.5


def return_weight(score: Column) -> Column:
    return 1.0 + (F.coalesce(score, F.lit(5)) <= 2).cast("int") * 4.0


def surrogate_id(seed: str, *keys: Column) -> Column:
    """Deterministic 8-4-4-4-12 hex id."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))
    parts = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *parts)
