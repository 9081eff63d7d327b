"""Data-quality jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.functions.numbers import answer_number, percent_key
from zocalo.functions.redaction import MAX_DEPTH, REDACTED, TOO_DEEP, redact, sensitive_key


def range_report(rules: list[tuple[str, DataFrame, str, float, float]]) -> DataFrame:
    """Values checked and values outside [low, high], one aggregate per rule."""
    report = None
    for name, df, column, low, high in rules:
        row = df.agg(F.count(column).alias("checked"), F.count_if(~F.col(column).between(low, high)).alias("bad"))
        row = row.withColumn("rule", F.lit(name))
        report = row if report is None else report.unionByName(row)
    return report


def repeated_keys(df: DataFrame, keys: list[str], *extra: Column) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *extra).filter(F.col("copies") > 1)


# --- result sets ------------------------------------------------------------------------------

def result_health(cells: DataFrame, metrics: DataFrame, results: DataFrame, cap: int) -> DataFrame:
    """Warnings per result set: empty, possibly cut at the cap, a metric null in every row.

    ``cells`` is long (result_id, row_no, pos, col, num), ``metrics`` (result_id,
    metric), ``results`` lists every result_id.  A metric belongs to the first column
    whose name contains it or is contained in it, ignoring case.
    """
    sizes = cells.groupBy("result_id").agg(F.count_distinct("row_no").alias("row_count"))
    columns = cells.groupBy("result_id", "col").agg(F.min("pos").alias("pos"), F.count("num").alias("filled"))
    name, metric = F.lower("col"), F.lower("metric")
    chosen = (columns.join(metrics, "result_id").filter(F.contains(name, metric) | F.contains(metric, name))
              .groupBy("result_id", "metric").agg(F.min_by("filled", "pos").alias("filled")))
    empty_metrics = chosen.filter(F.col("filled") == 0).groupBy("result_id").agg(F.count(F.lit(1)).alias("null_metrics"))
    rows = F.coalesce("row_count", F.lit(0))
    return (results.select("result_id").join(sizes, "result_id", "left").join(empty_metrics, "result_id", "left")
            .select("result_id", rows.alias("row_count"), (rows == 0).alias("empty"), (rows == cap).alias("maybe_cut"),
                    F.coalesce("null_metrics", F.lit(0)).alias("null_metrics")))


def _bucket(x: Column, tolerance: float) -> Column:
    """Bucket half a tolerance wide: linear up to 1, logarithmic beyond."""
    width = tolerance / 2
    edge = int(1 / width) + 1
    size = F.abs(x)
    steps = F.when(size <= 1, F.floor(size / width)).otherwise(edge + F.floor(F.log(size) / F.log(F.lit(1 + width))))
    return F.when(x < 0, -steps - 1).otherwise(steps).cast("bigint")


def unsupported_numbers(answers: DataFrame, cells: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Numbers of a text that no cell of its result supports.

    ``answers`` has (result_id, answer), ``cells`` (result_id, col, num).  A number
    is supported by a value v within ``tolerance * max(|v|, 1)``; one followed by
    ``%`` only by rate columns with |v| <= 1, times 100.  Values are reduced to the
    smallest and largest per narrow bucket before the join, so a text meets a few
    buckets around each of its numbers, however many cells the result has.
    """
    token = F.explode(F.regexp_extract_all("answer", F.lit(r"([0-9]+(?:[.,][0-9]+)?(?:\s*%)?)"), F.lit(1)))
    raw = F.regexp_extract("_token", r"^[0-9]+(?:[.,][0-9]+)?", 0)
    said = (answers.select("result_id", token.alias("_token"))
            .select("result_id", raw.alias("_raw"), F.endswith("_token", F.lit("%")).alias("percent"))
            .withColumn("said", answer_number(F.col("_raw"))).distinct())
    shown = cells.filter(F.col("num").isNotNull()).select("result_id", F.col("num").cast("double").alias("v"),
                                                          percent_key(F.col("col")).alias("rate"))
    values = (shown.select("result_id", F.lit(False).alias("percent"), "v")
              .unionByName(shown.filter(F.col("rate") & (F.abs("v") <= 1)).select("result_id", F.lit(True).alias("percent"), (F.col("v") * 100).alias("v"))))
    ranges = (values.withColumn("_b", _bucket(F.col("v"), tolerance)).groupBy("result_id", "percent", "_b")
              .agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")))
    around = F.explode(F.sequence(_bucket(F.col("said"), tolerance) - 5, _bucket(F.col("said"), tolerance) + 5))
    fits = lambda v: F.abs(F.col("said") - F.col(v)) <= tolerance * F.greatest(F.abs(v), F.lit(1.0))
    supported = (said.withColumn("_b", around).join(ranges, ["result_id", "percent", "_b"]).filter(fits("_lo") | fits("_hi"))
                 .select("result_id", "_raw", "percent").distinct())
    return (said.join(supported, ["result_id", "_raw", "percent"], "left_anti")
            .select("result_id", F.concat("_raw", F.when(F.col("percent"), " %").otherwise("")).alias("number")))


def row_summary(cells: DataFrame) -> DataFrame:
    """Row count and column list (in order of first appearance) per result, without any value."""
    columns = cells.groupBy("result_id", "col").agg(F.min(F.struct("row_no", "pos")).alias("first"))
    listed = columns.groupBy("result_id").agg(F.array_sort(F.collect_list(F.struct("first", "col")))["col"].alias("columns"))
    return cells.groupBy("result_id").agg(F.count_distinct("row_no").alias("row_count")).join(listed, "result_id")


def case_errors() -> Column:
    """Contract errors of a reference case, as codes."""
    c = F.col
    blank = lambda x: F.coalesce(F.trim(x), F.lit("")) == ""
    checks = [(blank("case_id"), "case_id"), (blank("question"), "question"), (~c("has_reference"), "reference_outputs"),
              (c("row_count").isNull() | (c("row_count") != c("rows_given")), "row_count"),
              (~c("version").eqNullSafe(c("expected_version")), "dataset_version")]
    return F.filter(F.array(*[F.when(bad, F.lit(code)) for bad, code in checks]), lambda e: e.isNotNull())


def redact_leaves(leaves: DataFrame) -> DataFrame:
    """Payload leaves (payload_id, path, value) with secrets removed.

    A sensitive key hides everything below it, anything ten levels down becomes a
    marker, and the rows under a top-level ``data`` or ``rows`` give way to their
    count and column names.
    """
    tables = leaves.filter(F.lower(F.col("path")[0]).isin("data", "rows") & (F.size("path") > 2))
    cells = tables.select(F.struct("payload_id", F.col("path")[0].alias("key")).alias("result_id"),
                          F.regexp_extract(F.col("path")[1], "[0-9]+", 0).cast("bigint").alias("row_no"),
                          F.col("pos"), F.col("path")[2].alias("col"))
    summary = row_summary(cells).select(
        "result_id.payload_id", F.concat("result_id.key", F.lit("_summary")).alias("key"),
        F.to_json(F.struct("row_count", "columns")).alias("value")).select("payload_id", F.array("key").alias("path"), "value")
    kept = leaves.filter(~F.lower(F.col("path")[0]).isin("data", "rows"))
    hidden = F.array_position(F.transform("path", lambda k: sensitive_key(k)), F.lit(True))
    deep = F.size("path") >= MAX_DEPTH
    at = F.when((hidden > 0) & (hidden <= MAX_DEPTH), hidden.cast("int")).when(deep, F.lit(MAX_DEPTH)).otherwise(F.size("path"))
    value = F.when((hidden > 0) & (hidden <= MAX_DEPTH), REDACTED).when(deep, TOO_DEEP).otherwise(redact(F.col("value")))
    return kept.select("payload_id", F.slice("path", F.lit(1), at).alias("path"), value.alias("value")).distinct().unionByName(summary)
