"""Numbers, ids and values written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from zocalo.functions.text import compare_form
from zocalo.functions.vocabulary import PERCENT_WORDS

# Patterns of ids, numbers and months in text.
UUID = r"[0-9a-fA-F]{32}|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
NUMBER_TEXT = r"^[+-]?[0-9]+(\.[0-9]+)?$"
ANSWER_NUMBER = r"(?U)(?<!\w)[-+]?[0-9][0-9.,]*(?!\w)"
MONTH = r"^[0-9]{4}-[0-9]{2}$"
NUMBER = "decimal(38,10)"


def uuid_form(x: Column) -> Column:
    """32 lower-case hex digits of a plain or dashed UUID, else null."""
    t = F.trim(x)
    return F.when(t.rlike(f"^(?:{UUID})$"), F.lower(F.replace(t, F.lit("-"), F.lit(""))))


def number_from_text(x: Column) -> Column:
    t = F.trim(x)
    return F.when(t.rlike(NUMBER_TEXT), t.try_cast(NUMBER))


def readings(token: Column) -> Column:
    """All numbers a printed token may stand for, whatever its separators mean."""
    t = F.btrim(F.trim(token), F.lit(".,"))
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    last = F.regexp_extract(t, r"([.,])[^.,]*$", 1)
    plain = F.when(last == ".", F.replace(t, F.lit(","), F.lit(""))).otherwise(
        F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    sign = F.regexp_extract(t, r"^[+-]?", 0)
    parts = F.split(F.regexp_replace(t, r"^[+-]", ""), "[.,]")
    later = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    decimal = F.when(F.size(parts) == 2, F.concat(sign, F.array_join(parts, ".")))
    grouped = F.when(F.forall(later, lambda g: F.length(g) == 3), F.concat(sign, F.array_join(parts, "")))
    texts = F.when(comma & dot, F.array(plain)).when(comma | dot, F.array(decimal, grouped)).otherwise(F.array(t))
    return F.array_distinct(F.filter(F.transform(texts, lambda v: v.try_cast(NUMBER)), lambda v: v.isNotNull()))


def answer_number(x: Column) -> Column:
    """One reading of a printed number, Spanish or English separators."""
    t = F.trim(x)
    comma, dot = F.contains(t, F.lit(",")), F.contains(t, F.lit("."))
    no = lambda mark: F.replace(t, F.lit(mark), F.lit(""))
    last = F.regexp_extract(t, r"([.,])[^.,]*$", 1)
    tail = F.length(F.regexp_extract(t, r",([^,]*)$", 1))
    text = (F.when(comma & dot, F.when(last == ",", F.replace(no("."), F.lit(","), F.lit("."))).otherwise(no(",")))
            .when(comma, F.when(F.startswith(t, F.lit("0,")) | (tail <= 2), F.replace(t, F.lit(","), F.lit("."))).otherwise(no(",")))
            .otherwise(t))
    return text.try_cast("double")


def percent_key(key: Column) -> Column:
    """Whether a column name speaks of a rate."""
    return F.arrays_overlap(F.split(F.lower(key), "[^a-záéíóúñ]+"), F.array(*[F.lit(w) for w in PERCENT_WORDS]))


def equivalent(actual: Column, expected: Column, tolerance: Column) -> Column:
    """Whether two printed values state the same fact."""
    a, e = number_from_text(actual), number_from_text(expected)
    ua, ue = uuid_form(actual), uuid_form(expected)
    return (F.when(a.isNotNull() & e.isNotNull(), F.abs(a - e) <= tolerance.cast(NUMBER))
            .when(actual.isNull() | expected.isNull(), actual.eqNullSafe(expected))
            .when(ua.isNotNull() & ue.isNotNull(), ua == ue)
            .when(F.trim(expected).rlike(MONTH), F.startswith(F.trim(actual), F.trim(expected)))
            .otherwise(compare_form(actual) == compare_form(expected)))
