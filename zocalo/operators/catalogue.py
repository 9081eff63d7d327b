"""Audits of the table catalogue against the actual schema and values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.operators.sampling import in_order

# Constraint lines, type spellings and how a declaration is read.
CONSTRAINTS = r"^(?:PRIMARY KEY|FOREIGN KEY|UNIQUE|CONSTRAINT|CHECK)"
COLUMN_LINE = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s+(.+?)(?:,\s*)?(?:\s+--\s*(.*))?$"
TYPE_PART = r"(?i)^(.+?)(?=\s+(?:DEFAULT|GENERATED|NOT NULL|NULL|PRIMARY KEY|REFERENCES|UNIQUE|CHECK)\b|$)"
TYPE_ALIASES = {"timestamp": "timestamp without time zone", "decimal": "numeric", "int": "integer", "int4": "integer",
                "int8": "bigint", "float8": "double precision", "bool": "boolean"}


def canonical_type(x: Column) -> Column:
    """Lower case, single spaces, no spaces around brackets and commas, aliases resolved."""
    t = F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")
    for pattern, becomes in ((r"\s*,\s*", ","), (r"\(\s*", "("), (r"\s*\)", ")")):
        t = F.regexp_replace(t, pattern, becomes)
    aliases = F.create_map(*[F.lit(v) for pair in TYPE_ALIASES.items() for v in pair])
    return F.coalesce(F.element_at(aliases, t), t)


def flatten_ddl(entries: DataFrame) -> DataFrame:
    """Catalogue entries (table, ddl) -> (table, column, type, comment)."""
    body = F.regexp_extract("ddl", r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    line = F.rtrim(F.trim("_line"), F.lit(","))
    declared = F.trim(F.regexp_extract("_l", COLUMN_LINE, 2))
    comment = F.nullif(F.regexp_extract("_l", COLUMN_LINE, 3), F.lit(""))
    return (entries.select("table", F.explode(F.split(body, "\n")).alias("_line")).select("table", line.alias("_l"))
            .filter((F.col("_l") != "") & ~F.upper("_l").rlike(CONSTRAINTS) & F.col("_l").rlike(COLUMN_LINE))
            .select("table", F.regexp_extract("_l", COLUMN_LINE, 1).alias("column"),
                    F.trim(F.regexp_extract(declared, TYPE_PART, 1)).alias("type"), comment.alias("comment")))


def documented_values(comment: Column) -> Column:
    """Values a comment lists after its first colon, separated by bars; sorted, empty if it lists none."""
    listed = F.split(F.regexp_extract(comment, r"(?s)^[^:]*:(.*)$", 1), r"\|")
    names = F.transform(listed, lambda v: F.regexp_extract(v, r"^\s*([A-Za-z0-9_]+)", 1))
    values = F.array_sort(F.array_distinct(F.filter(names, lambda v: v != "")))
    return F.when(F.contains(comment, F.lit(":")) & F.contains(comment, F.lit("|")), values).otherwise(F.expr("cast(array() as array<string>)"))


def schema_drift(documented: DataFrame, actual: DataFrame) -> DataFrame:
    """(table, column, issue) for tables on both sides: missing, undocumented, type_difference."""
    both = documented.select("table").distinct().join(actual.select("table").distinct(), "table")
    d = documented.join(both, "table", "left_semi").select("table", "column", F.col("type").alias("_d"))
    a = actual.join(both, "table", "left_semi").select("table", "column", F.col("type").alias("_a"))
    issue = (F.when(F.col("_a").isNull(), "missing").when(F.col("_d").isNull(), "undocumented")
             .when(canonical_type(F.col("_d")) != canonical_type(F.col("_a")), "type_difference"))
    return (d.join(a, ["table", "column"], "full").withColumn("issue", issue).filter(F.col("issue").isNotNull())
            .select("table", "column", "issue", F.col("_d").alias("documented"), F.col("_a").alias("actual")))


def table_drift(documented: DataFrame, actual: DataFrame) -> DataFrame:
    """Tables found on one side only."""
    d = documented.select("table").distinct().withColumn("_d", F.lit(True))
    a = actual.select("table").distinct().withColumn("_a", F.lit(True))
    side = F.when(F.col("_a").isNull(), "missing_table").when(F.col("_d").isNull(), "undocumented_table")
    return d.join(a, "table", "full").select("table", side.alias("issue")).filter(F.col("issue").isNotNull())


def structural_issues(drift: DataFrame) -> DataFrame:
    """Sum over tables of (any missing) + (any undocumented) + number of type differences."""
    is_ = lambda name: F.col("issue") == name
    per_table = drift.groupBy("table").agg((F.max(is_("missing").cast("int")) + F.max(is_("undocumented").cast("int"))).alias("_any"),
                                           F.count_if(is_("type_difference")).alias("_types"))
    return per_table.agg(F.coalesce(F.sum(F.col("_any") + F.col("_types")), F.lit(0)).alias("structural_issues"))


def observed_values(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Distinct non-null values of the category columns: (table, column, value), one pass per table."""
    found = None
    for name, (df, columns) in tables.items():
        pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
        rows = df.select(pairs).filter(F.col("value").isNotNull()).distinct().select(F.lit(name).alias("table"), "column", "value")
        found = rows if found is None else found.unionByName(rows)
    return found


def category_drift(documented: DataFrame, observed: DataFrame) -> DataFrame:
    """Values documented but not observed, or observed but not documented, where values are documented at all."""
    listed = documented.withColumn("value", F.explode(documented_values(F.col("comment")))).select("table", "column", "value", F.lit(True).alias("_d"))
    columns = listed.select("table", "column").distinct()
    seen = observed.join(columns, ["table", "column"], "left_semi").withColumn("_o", F.lit(True))
    issue = F.when(F.col("_o").isNull(), "not_observed").when(F.col("_d").isNull(), "not_documented")
    return (listed.join(seen, ["table", "column", "value"], "full").withColumn("issue", issue)
            .filter(F.col("issue").isNotNull()).select("table", "column", "value", "issue"))


def contiguous_ids(entries: DataFrame) -> DataFrame:
    """Entry ids tabla_1..n: known entries in their order, new ones by name."""
    placed = in_order(entries, [F.col("position").isNull(), F.col("position"), F.col("table")], "place")
    return placed.select("table", F.concat(F.lit("tabla_"), (F.col("place") + 1).cast("string")).alias("id"))
