"""What a column's type allows: one answer for Spark types and for raw type strings."""

from __future__ import annotations

from pyspark.sql import types as T

_TIME = ("BOOL", "DATE", "TIME", "INTERVAL")
_NUMERIC = ("INT", "DECIMAL", "NUMERIC", "DOUBLE", "FLOAT", "REAL", "HUGEINT", "FIXED")
_NESTED = ("ARRAY", "MAP", "STRUCT", "VARIANT", "OBJECT", "LIST", "UNION", "[]")
_BYTES = ("BYTES", "BLOB", "BYTEA", "BINARY")


def raw(kind: T.DataType | str) -> str:
    return (kind if isinstance(kind, str) else kind.simpleString()).upper()


def _has(kind: T.DataType | str, words: tuple[str, ...]) -> bool:
    text = raw(kind)
    return any(w in text for w in words)


def is_nested(kind: T.DataType | str) -> bool:
    return _has(kind, _NESTED)


def is_blob(kind: T.DataType | str) -> bool:
    """Bytes, alone or repeated: left out of scans unless asked for."""
    return _has(kind, _BYTES)


def is_boolean(kind: T.DataType | str) -> bool:
    return "BOOL" in raw(kind)


def is_numeric(kind: T.DataType | str) -> bool:
    return not is_nested(kind) and not _has(kind, _TIME) and _has(kind, _NUMERIC)


def is_integer(kind: T.DataType | str) -> bool:
    return not is_nested(kind) and not _has(kind, _TIME) and "INT" in raw(kind)


def is_string(kind: T.DataType | str) -> bool:
    return not is_nested(kind) and _has(kind, ("CHAR", "TEXT", "STRING"))


def is_temporal(kind: T.DataType | str) -> bool:
    """Has a calendar date, so that a span of it can have gaps."""
    return not is_nested(kind) and "INTERVAL" not in raw(kind) and _has(kind, ("DATE", "TIMESTAMP"))


def is_date_only(kind: T.DataType | str) -> bool:
    return is_temporal(kind) and "TIMESTAMP" not in raw(kind)


def units_of(kind: T.DataType | str) -> tuple[str, ...]:
    return ("day", "month") if is_date_only(kind) else ("day", "month", "hour")


def join_family(kind: T.DataType | str) -> str:
    """Types that can meet in a join: whole and decimal numbers, texts, floats, or the type itself."""
    text = raw(kind)
    if is_numeric(kind):
        return "float" if any(w in text for w in ("DOUBLE", "FLOAT", "REAL")) else "integer"
    if is_string(kind) or "UUID" in text:
        return "text"
    return text
