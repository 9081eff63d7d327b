"""Readers for CSV tables, case files, catalogues and memory banks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SCHEMA = """
case_id string, enabled boolean, split string, inputs struct<question: string>,
reference_outputs struct<expected_status: string, expected_sources: array<string>, reference_sql: string,
  expected_result: struct<row_count: int, rows: array<map<string, string>>, numeric_tolerance: double>>,
metadata struct<dataset_version: string, domain: string, result_type: string, quality_status: string>"""
CATALOGUE_SCHEMA = "id string, nombre string, descripcion string, ddl string, politicas array<string>"
RECORD_FIELDS = """normalized_question: string, intent: string, operation: string, metrics: array<string>,
filters: array<struct<field: string, operator: string, value: string>>, date_range: struct<start_date: string, end_date: string>,
group_by: array<string>, context: array<string>"""
BANK_SCHEMA = f"""
version string, memories array<struct<key: string, original_question: string, {RECORD_FIELDS}, sql: string, sources: string, status: string,
  validated: boolean, execution_status: string>>,
cases array<struct<id: string, category: string, question: string, {RECORD_FIELDS}, expected_memory: string>>"""


def csv_table(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A CSV folder with header; quotes are doubled within quotes and a quoted field may hold line breaks (RFC 4180)."""
    # Spark takes a field that reads like nullValue for null; one that no text has leaves quoted empty fields as they are.
    df = spark.read.schema(schema).options(header=True, escape='"', multiLine=True, nullValue="\0", emptyValue="").csv(path)
    return df.select(*columns) if columns else df


def lenient_timestamp(x: Column) -> Column:
    """Timestamp of a text, null where it is none."""
    return x.try_cast("timestamp_ntz")


def aligned_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Join keys as text on every side."""
    return df.withColumns({k: F.col(k).cast("string") for k in keys})


def parsed_cases(spark: SparkSession, path: str) -> DataFrame:
    """Every non-blank line of a case file with its problem, if any: malformed, no_case_id or duplicate."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", CASE_SCHEMA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("c"), "value")
    cases = parsed.select("c.*", F.col("value").alias("line"))
    named = F.coalesce(F.col("case_id"), F.lit("")) != ""
    copies = cases.filter(named).groupBy("case_id").agg(F.count(F.lit(1)).alias("_n"))
    problem = (F.when(F.col("_bad").isNotNull(), "malformed").when(~named, "no_case_id").when(F.col("_n") > 1, "duplicate"))
    return cases.join(copies, "case_id", "left").withColumn("problem", problem).drop("_n", "_bad")


def enabled_cases(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Enabled cases (the default) of a case file.

    With ``strict`` a broken line or an empty result is an error, as the whole file
    is then not to be trusted; otherwise broken lines are left out.
    """
    cases = parsed_cases(spark, path)
    good = cases.filter(F.col("problem").isNull() & F.coalesce("enabled", F.lit(True))).drop("problem")
    if strict:
        totals = cases.agg(F.count("problem").alias("bad"), F.count_if(F.col("problem").isNull() & F.coalesce("enabled", F.lit(True))).alias("good")).first()
        if totals["bad"]:
            raise ValueError(f"{totals['bad']} broken lines in {path}")
        if not totals["good"]:
            raise ValueError(f"no enabled case in {path}")
    return good


def table_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue entries of JSON files (one array or object per file); missing policies become an empty list."""
    entries = spark.read.schema(CATALOGUE_SCHEMA).option("multiLine", True).json(path)
    return entries.withColumn("politicas", F.coalesce("politicas", F.expr("cast(array() as array<string>)")))


def memory_bank(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(memories, cases) of bank files; absent groupings and status get their defaults."""
    return split_bank(spark.read.schema(BANK_SCHEMA).option("multiLine", True).json(path))


def split_bank(bank: DataFrame) -> tuple[DataFrame, DataFrame]:
    groups = F.coalesce("group_by", F.expr("cast(array() as array<string>)"))
    memories = bank.select(F.inline("memories")).withColumns({"group_by": groups, "status": F.coalesce("status", F.lit("success"))})
    return memories, bank.select(F.inline("cases")).withColumn("group_by", groups)
