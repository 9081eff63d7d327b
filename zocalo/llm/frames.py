"""Column picking by exact name, held-out parts and shared folders for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zocalo.session import run_dir

#: White space that separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(df: DataFrame, **wanted: str) -> DataFrame:
    """``alias=name`` columns, found by exact spelling (the first of equal names), whatever other columns there are.

    Names that differ in case only, or repeat, would be ambiguous in a plain select.
    """
    flat, at = numbered_columns(df)
    return flat.select(*[F.col(at[name]).alias(alias) for alias, name in wanted.items()])


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and which of them each original name (its first use) has become."""
    at: dict[str, str] = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, f"c{i}")
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), at


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def unit_hash(*columns: Column, seed: int) -> Column:
    """A fixed pseudo-random double in [0, 1) for the given columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = run_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
