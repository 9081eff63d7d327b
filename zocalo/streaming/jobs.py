"""Streams of texts, questions, memory events and usage.

Sources and checkpoints live in shared folders; every job can be stopped or lose
executors and goes on from its checkpoint.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zocalo.functions.redaction import redact
from zocalo.operators import memory, structuring
from zocalo.sources.sinks import BatchLog


def file_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet of a folder whose names fit ``pattern``, files or folders of files, as a stream; the schema is that of what is there now."""
    if not re.search(r"[*?\[{]", pattern):
        pattern = f"{pattern[:-1]}[{pattern[-1]}]"  # a stream takes a plain path for a folder, and a pattern for what fits it
    found = f"{folder}/{pattern}"
    return spark.readStream.schema(spark.read.parquet(found).schema).option("maxFilesPerTrigger", files_per_batch).parquet(found)


def redacted(stream: DataFrame, text: str) -> DataFrame:
    """Stateless: secrets and personal data removed from a text column."""
    return stream.withColumn(text, redact(F.col(text)))


def structured(stream: DataFrame, question: str) -> DataFrame:
    """Stateless: questions with their structured fields."""
    return structuring.structure(stream, question)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there now into a parquet folder and return it."""
    running = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
               .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
    running.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def _logged(stream: DataFrame, log: BatchLog, folder: str, reduce, fold) -> None:
    """``reduce`` of each micro-batch into the log, under the id that Spark keeps in the stream's checkpoint; ``fold`` as parts pile up."""
    checkpoint = f"{folder}/checkpoint"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        named = log.spark.read.json(f"{checkpoint}/metadata").first()
        log.write(reduce(batch), named["id"], batch_id)
        log.compact(fold)

    (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def merge_into_log(records: DataFrame, log: BatchLog, folder: str, seq: list[str]) -> None:
    """Merge each micro-batch of memory records by itself and add it to the log.

    Merging is associative, so ``merged_log`` gives the same store whatever the triggers, retries and checkpoints were.
    """
    _logged(records, log, folder, lambda batch: memory.merge(batch, seq), memory.folded)


def merged_log(log: BatchLog) -> DataFrame:
    """The store: all parts of the log as one row per fingerprint."""
    return memory.folded(log.read())


def log_usage(hits: DataFrame, log: BatchLog, folder: str) -> None:
    """Add the (call, memory) pairs of each micro-batch to the log."""
    _logged(hits, log, folder, lambda batch: batch.select("call_id", "memory_id").distinct(), lambda rows: rows.distinct())


def usage_counts(log: BatchLog) -> DataFrame:
    """Retrievals per memory; a memory counts once per call, however often and late the call was reported."""
    return log.read().distinct().groupBy("memory_id").agg(F.count(F.lit(1)).alias("retrieval_count"))
