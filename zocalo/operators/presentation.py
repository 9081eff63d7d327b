"""Types, labels and display text of result columns.

Result sets come as long cells (result_id, row_no, key, kind, value): one row per
cell, ``kind`` being null, bool, int, float, date, datetime or text and ``value``
its text form.  Profiling is one aggregate over all columns of all results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zocalo.functions.labels import column_label
from zocalo.functions.vocabulary import PERCENT_WORDS

# Words in a column name, display forms.
DATE_WORDS = ["date", "fecha"]
DATETIME_WORDS = ["datetime", "timestamp"]
PLAIN_INTEGER_WORDS = ["year", "anio", "año", "month", "mes", "day", "dia", "día"]
PLAIN_INTEGER_KEYS = ["month_number", "mes_nro", "mes_num"]
NULL_TEXT = "—"
DATE_FORM, DATETIME_FORM = "dd/MM/yyyy", "dd/MM/yyyy HH:mm:ss"
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
ISO_DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}(:[0-9]{2}(:[0-9]{2}([.][0-9]{3,6})?)?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"


def _has_word(key: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(F.lower(key), "[^a-z0-9áéíóúñ]+"), F.array(*[F.lit(w) for w in words]))


def identifier_key(key: Column) -> Column:
    return F.lower(F.trim(key)).rlike("(^|_| )id$")


def plain_integer_key(key: Column) -> Column:
    return F.lower(F.trim(key)).isin(PLAIN_INTEGER_KEYS) | _has_word(key, PLAIN_INTEGER_WORDS)


def datetime_key(key: Column) -> Column:
    return F.endswith(F.lower(F.trim(key)), F.lit("_at")) | _has_word(key, DATETIME_WORDS)


def date_key(key: Column) -> Column:
    return datetime_key(key) | _has_word(key, DATE_WORDS)


def _temporal(key: Column, kind: Column, value: Column) -> tuple[Column, Column]:
    """(is a date or time, has a time part) of a cell."""
    text = F.trim(value)
    written = (kind == "text") & date_key(key)
    day = written & text.rlike(ISO_DATE) & text.try_cast("date").isNotNull()
    time = written & text.rlike(ISO_DATETIME) & F.substring(text, 1, 10).try_cast("date").isNotNull()
    return kind.isin("date", "datetime") | day | time, (kind == "datetime") | time


def _profile(cells: DataFrame) -> DataFrame:
    """(result_id, key, first, type) of every column; ``first`` is the place where it appears first.

    What depends on the name alone is asked once for a column, not for each of its cells.
    """
    c = F.col
    named, written = date_key(c("key")), c("kind") == "text"
    text = F.trim("value")
    day = written & text.rlike(ISO_DATE) & text.try_cast("date").isNotNull()
    time = written & text.rlike(ISO_DATETIME) & F.substring(text, 1, 10).try_cast("date").isNotNull()
    number = c("kind").isin("int", "float")
    whole = (c("kind") == "int") | ((c("kind") == "float") & c("value").try_cast("decimal(38,10)").eqNullSafe(
        F.floor(c("value").try_cast("decimal(38,10)")).cast("decimal(38,10)")))
    some = c("kind") != "null"
    profile = cells.groupBy("result_id", "key").agg(
        F.min(F.struct("row_no", "pos")).alias("first"), F.count_if(some).alias("n"), F.count_if(c("kind") == "bool").alias("bools"),
        F.count_if(c("kind").isin("date", "datetime")).alias("times"), F.count_if(c("kind") == "datetime").alias("timed"),
        F.count_if(day | time).alias("told_times"), F.count_if(time).alias("told_timed"),
        F.count_if(number).alias("numbers"), F.count_if(number & whole).alias("wholes"))
    times = c("times") + F.when(named, c("told_times")).otherwise(0)
    timed = c("timed") + F.when(named, c("told_timed")).otherwise(0)
    kind = (F.when(c("n") == 0, "null").when(identifier_key(c("key")), "text").when(c("bools") == c("n"), "boolean")
            .when(times == c("n"), F.when(timed > 0, "datetime").otherwise("date"))
            .when(c("numbers") == c("n"), F.when(_has_word(c("key"), PERCENT_WORDS), "percentage")
                  .when(c("wholes") == c("n"), "integer").otherwise("decimal"))
            .otherwise("text"))
    return profile.select("result_id", "key", "first", kind.alias("type"))


def column_types(cells: DataFrame) -> DataFrame:
    """(result_id, key, type) with type null, text, boolean, datetime, date, percentage, integer or decimal."""
    return _profile(cells).select("result_id", "key", "type")


def display(key: Column, kind: Column, value: Column, type_: Column) -> Column:
    """Text shown for a cell, given the type of its column."""
    text = F.trim(value)
    number = value.try_cast("decimal(38,10)")
    infinite = F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity")
    numeric = kind.isin("int", "float")
    _, timed = _temporal(key, kind, value)
    day = F.date_format(F.substring(text, 1, 10).try_cast("date"), DATE_FORM)
    clock = F.regexp_extract(text, "[T ](.*?)([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$", 1)
    full_clock = F.concat(clock, F.substring(F.lit("00:00:00"), F.length(clock) + 1, F.lit(8)))
    moment = F.concat(day, F.lit(" "), full_clock)
    percent = F.concat(F.format_number(F.when(F.abs(number) <= 1, number * 100).otherwise(number), 2), F.lit(" %"))
    integer = F.when(plain_integer_key(key), F.floor(number).cast("string")).otherwise(F.format_number(number, 0))
    return (F.when((kind == "null") | (type_ == "null"), NULL_TEXT)
            .when(type_ == "boolean", F.when(F.lower(text) == "true", "Sí").otherwise("No"))
            .when(type_ == "datetime", F.coalesce(F.when(timed, moment).otherwise(day), value))
            .when(type_ == "date", F.coalesce(day, value))
            .when((type_ == "text") | ~numeric, value)
            .when(infinite, NULL_TEXT)
            .when(type_ == "percentage", percent).when(type_ == "integer", integer)
            .otherwise(F.format_number(number, 2)))


def result_table(cells: DataFrame) -> DataFrame:
    """Every cell with its column's place, label and type, over ragged rows.

    Columns are ordered by first appearance; a row that lacks one shows the null
    text.  Both joins are by sort and merge: all sides grow with the results, and alike
    columns pack so well in a shuffle that a size check would send them whole through the driver.
    """
    columns = _profile(cells).withColumn("label", column_label(F.col("key")))
    grid = cells.select("result_id", "row_no").distinct().join(columns.hint("merge"), "result_id")
    own = cells.select("result_id", "row_no", "key", "kind", "value").hint("merge")
    full = grid.join(own, ["result_id", "row_no", "key"], "left")
    kind = F.coalesce("kind", F.lit("null"))
    return full.select("result_id", "row_no", "first", "key", "label", "type",
                       display(F.col("key"), kind, F.col("value"), F.col("type")).alias("display"))


def value_form(kind: Column, value: Column) -> Column:
    """JSON-ready text of a database value: whole decimals as integers, ids and bytes as plain hex."""
    number = value.try_cast("decimal(38,10)")
    whole = F.floor(number).cast("decimal(38,0)").cast("string")
    return (F.when(kind == "decimal", F.when(number == F.floor(number), whole).otherwise(number.cast("double").cast("string")))
            .when(kind == "uuid", F.lower(F.replace(value, F.lit("-"), F.lit(""))))
            .when(kind == "bytes", F.lower(F.hex(F.encode(value, "UTF-8"))))
            .when(kind == "datetime", F.replace(value, F.lit(" "), F.lit("T"))).otherwise(value))


def policy_section(table: Column, policies: Column) -> Column:
    """Table name and one bullet per non-empty policy; null when none is left."""
    lines = F.filter(F.transform(policies, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(lines) > 0, F.concat(table, F.lit(":\n"), F.array_join(F.transform(lines, lambda p: F.concat(F.lit("  - "), p)), "\n")))
