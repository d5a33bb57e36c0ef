"""Times, identifiers and canonical JSON values."""

from __future__ import annotations

import hashlib
import json
import math
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of ids, SHA-256 digests and UTC times (fixed values).
ID_PATTERN = r"^[a-z0-9][a-z0-9_-]{0,127}$"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
UTC_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|\+00:00)$"


def is_id(x: Column) -> Column:
    return F.coalesce(x.rlike(ID_PATTERN), F.lit(False))


def is_sha256(x: Column) -> Column:
    return F.coalesce(x.rlike(SHA256_PATTERN), F.lit(False))


def utc_micros(x: Column) -> Column:
    """Epoch microseconds of an ISO time in UTC; NULL for any other text."""
    return F.when(x.rlike(UTC_PATTERN), F.unix_micros(F.try_to_timestamp(F.regexp_replace(x, r"Z$", "+00:00"))))


def utc_text(micros: Column) -> Column:
    """ISO time with Z; a fraction of six digits only where it is not zero."""
    stamp = F.timestamp_micros(micros)
    return F.when(F.pmod(micros, F.lit(1_000_000)) == 0, F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def plain(value: Any) -> Any:
    """JSON scalars only: numbers of array libraries unwrapped, no infinities."""
    if hasattr(value, "item") and not isinstance(value, (list, dict, str)):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("JSON numbers are finite")
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def canonical_bytes(value: Any) -> bytes:
    """Sorted keys, no blanks, UTF-8, finite numbers."""
    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


def digest(value: Any) -> str:
    return hashlib.sha256(canonical_bytes(value)).hexdigest()
