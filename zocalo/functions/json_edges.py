"""Lenient decoding of values at the edge of the system: broken JSON, blank text, flags in words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_number(raw: Column, field: str, default: int) -> Column:
    """A whole-number field of a JSON object; ``default`` where the text is null, blank or broken or the field is missing."""
    parsed = F.from_json(F.nullif(F.trim(raw), F.lit("")), f"{field} bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.coalesce(parsed[field], F.lit(default)).cast("bigint")


def truth(raw: Column) -> Column:
    """True for the word true in any case, with blanks around it or not; false for all else, null included."""
    return F.coalesce(F.lower(F.trim(raw)) == "true", F.lit(False))
