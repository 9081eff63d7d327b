"""Mixing of sources to target weights by floor(rate) copies and one hash-seeded Bernoulli copy. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zocalo.llm.frames import WORD, exact, numbered_columns
from zocalo.session import shared_dir

#: A table of sources up to this many bytes (counted, not guessed) is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources in code point order, null last, take ``weights`` in turn and share the sum of all sizes by weight. A target
    stops at ``cap`` times its source's size; the excess is shared by weight among the others until none is above.
    Sizes are added up per task before the shuffle. Numbering is by sorted partitions with offsets, and the sharing
    needs one two-number aggregate a round, so no task or driver holds the list of sources.
    """
    shared_dir(sized.sparkSession)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("part", F.spark_partition_id()).checkpoint()
    offsets = (sums.groupBy("part").count()
               .select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before")))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    ranked = sums.join(offsets, "part").select(
        "source", "source_size",
        F.element_at(F.array(*map(F.lit, weights)), ((place % len(weights)) + 1).cast("int")).cast("long").alias("weight")).checkpoint()
    first = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(1)).alias("weight")).first()
    share, capped = first["total"] / first["weight"], 0
    while True:
        above = F.col("weight") * F.lit(float(share)) > F.col("source_size") * cap
        now = ranked.agg(F.count(F.when(above, 1)).alias("n"), F.coalesce(F.sum(F.when(above, F.col("source_size") * cap)), F.lit(0)).alias("held"),
                         F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if now["n"] == capped or not now["weight"]:
            break
        capped, share = now["n"], (first["total"] - now["held"]) / now["weight"]
    target = F.least(F.col("weight") * F.lit(float(share)), (F.col("source_size") * cap).cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def with_targets(docs: DataFrame, source: str, targets: DataFrame) -> DataFrame:
    """``docs`` with source_size and target; a small table of sources is broadcast, any other joined by a shuffle."""
    known = targets.select(F.col("source").alias("mix_source"), "source_size", "target")
    size = known.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("mix_source"), F.lit(0)) + 64), F.lit(0))).first()[0]
    side = F.broadcast(known) if size <= BROADCAST_BYTES else known
    return docs.join(side, docs[source].eqNullSafe(side["mix_source"]), "left").drop("mix_source")


def copies(doc_id: Column, size: Column, target: Column, cap: int = 3, seed: int = 42) -> Column:
    """floor(rate) copies and one more where the id's hash falls below the fraction; never more than ``cap``."""
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    digits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), doc_id.cast("string")).cast("binary")), 1, 13), 16, 10)
    extra = digits.cast("double") / F.lit(float(1 << 52)) < rate - F.floor(rate)
    return F.least(F.floor(rate) + extra.cast("long"), F.lit(cap)).cast("long")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, size (words), source_size, target of its source, taken (words, repeats counted).

    Null text has size 0 and takes nothing; null sources form one source; rows with the same id get the same number of
    copies; if all sizes are 0 the targets are 0; an empty table gives an empty result. Other columns are ignored.
    """
    rows = exact(docs, doc_id="doc_id", text="text", source="source")
    sized = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    joined = with_targets(sized, "source", source_targets(sized, weights, cap))
    return joined.select("doc_id", "size", "source_size", "target",
                         (F.col("size") * copies(F.col("doc_id"), F.col("source_size"), F.col("target"), cap, seed)).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 42) -> DataFrame:
    """The documents of the mix themselves, each row as many times as ``copies`` says, with all columns of ``docs``."""
    flat, at = numbered_columns(docs)
    sized = flat.select(F.col(at["source"]).alias("source"), word_count(F.col(at["text"])).alias("size"))
    joined = with_targets(flat, at["source"], source_targets(sized, weights, cap))
    times = F.array_repeat(F.lit(0), copies(F.col(at["doc_id"]), F.col("source_size"), F.col("target"), cap, seed).cast("int"))
    return joined.select(*flat.columns, F.explode(times).alias("mix_copy")).drop("mix_copy").toDF(*docs.columns)
