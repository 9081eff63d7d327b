"""Streams give what the batch job gives, whatever the triggers, repeats and checkpoints are."""

import pytest

from pyspark.sql import functions as F

from zocalo import streaming
from zocalo.session import run_dir
from zocalo.sources import sinks

CALLS = [[("c1", "m1"), ("c1", "m2")], [("c2", "m1"), ("c2", "m1")], [("c1", "m1")], [("c3", "m2"), ("c2", "m3")]]
EXPECTED = {"m1": 2, "m2": 2, "m3": 1}


def written(spark):
    folder = run_dir(spark, "calls")
    for rows in CALLS:
        spark.createDataFrame(rows, "call_id string, memory_id string").coalesce(1).write.mode("append").parquet(folder)
    return folder


def counts(log):
    return {r["memory_id"]: r["retrieval_count"] for r in streaming.usage_counts(log).collect()}


@pytest.mark.parametrize("files", [1, 3, 100])
def test_usage_counts_do_not_depend_on_triggers(spark, files):
    folder, work = written(spark), run_dir(spark, "usage")
    log = sinks.BatchLog(spark, f"{work}/log")
    streaming.log_usage(streaming.file_stream(spark, folder, "*.parquet", files), log, work)
    assert counts(log) == EXPECTED
    streaming.log_usage(streaming.file_stream(spark, folder, "*.parquet", files), log, work)  # nothing new
    assert counts(log) == EXPECTED


def test_another_checkpoint_and_late_repeats_change_nothing(spark):
    folder, first, second = written(spark), run_dir(spark, "usage"), run_dir(spark, "usage")
    log = sinks.BatchLog(spark, f"{first}/log")
    streaming.log_usage(streaming.file_stream(spark, folder, "*.parquet", 1), log, first)
    streaming.log_usage(streaming.file_stream(spark, folder, "*.parquet", 2), log, second)
    assert counts(log) == EXPECTED
    spark.createDataFrame([("c1", "m1"), ("c9", "m3")], "call_id string, memory_id string").write.mode("append").parquet(folder)
    streaming.log_usage(streaming.file_stream(spark, folder, "*.parquet", 1), log, first)
    assert counts(log) == EXPECTED | {"m3": 2}


def test_a_batch_that_runs_again_replaces_its_part(spark):
    log = sinks.BatchLog(spark, run_dir(spark, "log"))
    log.write(spark.range(3).select(F.col("id").cast("string").alias("call_id"), F.lit("m").alias("memory_id")), "s", 0)
    log.write(spark.range(2).select(F.col("id").cast("string").alias("call_id"), F.lit("m").alias("memory_id")), "s", 0)
    assert counts(log) == {"m": 2}


def test_parts_of_a_log_pile_up_in_levels(spark):
    log = sinks.BatchLog(spark, run_dir(spark, "log"), fan=3)
    fold = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    frame = lambda k: spark.createDataFrame([(k, 1), ("all", 1)], "k string, n long")
    most = 0
    for batch in range(20):
        for stream in ("s", "t"):
            log.write(frame(stream), stream, batch)
            log.compact(fold)
            log.write(frame(stream), stream, batch)  # the last batch runs again
        log.write(frame("late"), "s", max(batch - 9, 0) if batch > 9 else batch)  # an old one must not count again
        if batch <= 9:
            log.write(frame("s"), "s", batch)
        most = max(most, len(log.parts()))
    assert {r["k"]: r["n"] for r in fold(log.read()).collect()} == {"s": 20, "t": 20, "all": 40}
    assert most <= 12
