"""Stable hashes and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Memory id format and the namespace of case ids.
MEMORY_ID_PREFIX = "query-memory-v2-"
CASE_NAMESPACE = "dc75eef4-3d98-43f2-b494-13b25a87ba11"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with sorted keys; null members are written out."""
    return F.to_json(F.struct(*[fields[name].alias(name) for name in sorted(fields)]), {"ignoreNullFields": "false"})


def sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def memory_id(fingerprint: Column) -> Column:
    return F.concat(F.lit(MEMORY_ID_PREFIX), F.substring(fingerprint, 1, 32))


def name_uuid(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1)
    part = lambda start, size: F.substring(digest, start, size)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3),
                    F.lit("-"), part(21, 12))


def case_id(dataset: Column, case: Column) -> Column:
    return name_uuid(CASE_NAMESPACE, F.concat_ws(":", dataset, case))
