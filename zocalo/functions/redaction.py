"""Removal of secrets and personal data from text and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is redacted, in the order applied, and what it becomes.
REDACTED = "[REDACTED]"
TOO_DEEP = "[MAX_DEPTH_REACHED]"
MAX_DEPTH = 10
PATTERNS = [
    ("database_url", r"(?i)\b(?:postgres(?:ql)?|mysql|mariadb|sqlite)(?:\+[A-Za-z0-9_.-]+)?://[^\s]+", "[REDACTED]"),
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]"),
    ("trace_key", r"\blsv2_[A-Za-z0-9_-]+\b", "[REDACTED]"),
    ("cloud_key", r"\bAIza[0-9A-Za-z_-]{20,}\b", "[REDACTED]"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "[REDACTED_UUID]"),
    ("hex_id", r"\b[0-9a-fA-F]{32}\b", "[REDACTED_ID]"),
    ("named_secret", r"(?i)\b(api[_-]?key|password|secret|token)\s*[:=]\s*([^\s,;]+)", "$1=[REDACTED]"),
]
SENSITIVE_KEYS = ["api_key", "apikey", "authorization", "cf_api_key", "cloudflare_api_key", "cookie", "database_url", "db_url",
                  "google_api_key", "langsmith_api_key", "password", "secret", "token"]
SENSITIVE_SUFFIXES = ["_api_key", "_password", "_secret", "_token"]


def redact(x: Column) -> Column:
    for _, pattern, becomes in PATTERNS:
        x = F.regexp_replace(x, f"(?U){pattern}", becomes)
    return x


def hits(x: Column) -> dict[str, Column]:
    """Matches per pattern, each counted on the text the earlier patterns left."""
    counts = {}
    for name, pattern, becomes in PATTERNS:
        counts[name] = F.regexp_count(x, F.lit(f"(?U){pattern}"))
        x = F.regexp_replace(x, f"(?U){pattern}", becomes)
    return counts


def sensitive_key(key: Column) -> Column:
    plain = F.btrim(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), F.lit("_"))
    ends = plain.rlike("(?:" + "|".join(SENSITIVE_SUFFIXES) + ")$")
    return plain.isin(SENSITIVE_KEYS) | ends
