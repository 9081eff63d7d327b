"""Aggregations that need more than one built-in call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: The sketch that brackets the middle is off by at most one part in this many of a group's rows.
SKETCH = 10_000


def exact_median(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group by rank selection.

    A mergeable sketch per group gives two values that have the middle ranks between them. A second pass counts what lies
    below and keeps only the distinct values in between (about one row in a thousand of a large group); the middle
    ranks are found among those. So no task sorts a group, and the rows themselves are never shuffled.
    """
    wide = 4 / SKETCH
    rows = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull())
    bounds = rows.groupBy(*keys).agg(F.percentile_approx("_v", [0.5 - wide, 0.5 + wide], SKETCH).alias("_bounds"), F.count(F.lit(1)).alias("_n"))
    bounds = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bounds")[0].alias("_from"), F.col("_bounds")[1].alias("_to"), "_n")
    if keys:
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        placed = rows.join(bounds, same)
    else:
        placed = rows.join(F.broadcast(bounds))  # one row
    between = F.when(F.col("_v") >= F.col("_from"), F.col("_v")).alias("_w")  # null: all that lies below
    counts = placed.filter(F.col("_v") <= F.col("_to")).groupBy(*keys, "_n", between).agg(F.count(F.lit(1)).alias("_c"))
    upto = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy(F.col("_w").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_hi", F.sum("_c").over(upto))
    lo = F.floor((F.col("_n") + 1) / 2)
    hi = F.floor((F.col("_n") + 2) / 2)
    covers = lambda rank: (F.col("_hi") - F.col("_c") < rank) & (rank <= F.col("_hi")) & F.col("_w").isNotNull()
    number = F.col("_w").cast("double")
    low, high = F.max(F.when(covers(lo), number)), F.max(F.when(covers(hi), number))
    found = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(F.count(F.lit(1)) == 0, None).otherwise(F.raise_error(F.lit("the bracket of a median missed the middle")))
    return ranked.groupBy(*keys).agg(found.alias(name))


def pass_rates(runs: DataFrame, evaluator: str, split: str, passed: Column) -> DataFrame:
    """Passed, total and rate per evaluator, for every split and overall (``all``)."""
    rolled = (runs.groupBy(evaluator, split).agg(F.sum(passed.cast("int")).alias("passed"), F.count(F.lit(1)).alias("total")))
    overall = (rolled.groupBy(evaluator).agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
               .select(evaluator, F.lit("all").alias(split), "passed", "total"))
    return rolled.unionByName(overall).withColumn("rate", F.round(F.col("passed") / F.col("total"), 6))


def class_counts(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Rows per class of a closed list, zero where a class never occurs."""
    counts = [F.count_if(F.col(column) == c).alias(f"_{i}") for i, c in enumerate(classes)]
    pairs = F.array(*[F.struct(F.lit(c).alias(column), F.col(f"_{i}").alias("cases")) for i, c in enumerate(classes)])
    return df.agg(*counts).select(F.inline(pairs))
