"""Checks on logged query text (no parsing)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Comment forms, allowed starts and forbidden keywords.
COMMENT = r"(?s)--[^\r\n]*|/\*.*?\*/"
READ_START = r"(?i)^\s*(?:SELECT|WITH)\b"
MUTATING = (r"(?i)\b(?:ALTER|CALL|COPY|CREATE|DELETE|DO|DROP|EXECUTE|GRANT|INSERT|MERGE|REVOKE|TRUNCATE|UPDATE|VACUUM)\b")


def read_only(sql: Column) -> Column:
    """Starts with SELECT or WITH and has no mutating keyword anywhere outside comments."""
    text = F.trim(F.regexp_replace(F.coalesce(sql, F.lit("")), COMMENT, " "))
    return text.rlike(READ_START) & ~text.rlike(MUTATING)


def stage(sql: Column, unknown: Column) -> Column:
    """First check a logged query fails, or ok."""
    text = F.rtrim(F.trim(sql), F.lit(";"))
    return (F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "syntax")
            .when(F.contains(text, F.lit(";")) | ~read_only(text), "statement")
            .when(F.size(unknown) > 0, "tables").otherwise("ok"))
