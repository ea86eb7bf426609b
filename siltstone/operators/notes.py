"""Data-quality notes from aggregates: where content contradicts the declared type, name or role."""

from __future__ import annotations

import datetime as dt

from .. import types
from ..model import ColumnStats, ValueDomain
from . import pii

MATCH = 0.95
_HASHES = {32: "md5", 40: "sha1", 64: "sha256"}


def _dated(name: str, kind: str, share: float, fmt: str) -> str:
    return f"{name} is declared {kind} but {share:.0%} of values match the {fmt} dates; a cast with this format would make them dates"


def slash_note(name: str, kind: str, s: ColumnStats) -> str | None:
    """One component over 12 proves which is the day; both over 12 prove that no order fits."""
    date, stamp = s.slash_date_fraction or 0.0, s.slash_datetime_fraction or 0.0
    if date + stamp < MATCH:
        return None
    clock = " %H:%M:%S" if stamp > date else ""
    day, month = f"%d/%m/%Y{clock}", f"%m/%d/%Y{clock}"
    first, second = (s.slash_first_over_12 or 0) > 0, (s.slash_second_over_12 or 0) > 0
    if first and second:
        return None
    if first or second:
        return _dated(name, kind, date + stamp, day if first else month)
    return f"{name} is declared {kind}; {date + stamp:.0%} of values are slash dates whose order is ambiguous: {day} and {month} fit all of them, and the wrong one swaps silently"


def epoch_note(name: str, kind: str, s: ColumnStats) -> str | None:
    sec, ms = s.epoch_s_fraction or 0.0, s.epoch_ms_fraction or 0.0
    if max(sec, ms) < MATCH:
        return None
    unit, share, low, high, per = ("seconds", sec, s.epoch_s_min, s.epoch_s_max, 1) if sec >= ms else ("milliseconds", ms, s.epoch_ms_min, s.epoch_ms_max, 1000)
    if low is None or high is None:
        return None
    day = lambda x: dt.datetime.fromtimestamp(x / per, tz=dt.UTC).date().isoformat()
    return f"{name} is declared {kind} but {share:.0%} of values lie in the unix epoch {unit} range; implied dates {day(low)} to {day(high)}"


def contradiction_notes(name: str, kind: str, s: ColumnStats | None) -> list[str]:
    if s is None:
        return []
    out = []
    if types.is_string(kind):
        if (s.iso_date_fraction or 0) >= MATCH:
            out.append(_dated(name, kind, s.iso_date_fraction, "%Y-%m-%d"))
        if (s.iso_datetime_fraction or 0) >= MATCH:
            out.append(_dated(name, kind, s.iso_datetime_fraction, "%Y-%m-%d %H:%M:%S"))
        out.append(slash_note(name, kind, s))
        if (s.numeric_fraction or 0) >= MATCH and not epoch_note(name, kind, s):
            whole = s.integer_fraction or 0
            fits = "all of them are whole numbers" if whole >= MATCH else f"only {whole:.0%} fit an integer, the others have decimals"
            out.append(f"{name} is declared {kind} but {s.numeric_fraction:.0%} of values are numeric text; {fits}")
    out.append(epoch_note(name, kind, s))
    return [n for n in out if n]


def hex_label(s: ColumnStats) -> str:
    low, high = s.hex_min_length, s.hex_max_length
    if low is None or high is None:
        return "hexadecimal"
    if low != high:
        return f"hexadecimal ({low}-{high} digits, of several lengths)"
    return f"{low}-character hexadecimal" + (f" ({_HASHES[low]}-shaped)" if low in _HASHES else "")


def mixed_key_note(name: str, s: ColumnStats | None) -> str | None:
    """Two or more value shapes in a key, each with 5 % or more."""
    if s is None or s.numeric_fraction is None and s.uuid_fraction is None and s.hex_fraction is None:
        return None
    numeric, uuid, hexed = s.numeric_fraction or 0.0, s.uuid_fraction or 0.0, s.hex_fraction or 0.0
    shares = [("numeric", numeric), ("uuid", uuid), (hex_label(s), hexed), ("other", max(0.0, 1 - numeric - uuid - hexed))]
    present = [f"{v:.0%} {k}" for k, v in shares if v >= 0.05]
    if len(present) < 2:
        return None
    return f"{name} could be a key, yet mixes value shapes: {', '.join(present)}; a numeric cast or comparison drops the rest silently"


def flag_note(name: str, kind: str, s: ColumnStats | None, domain: ValueDomain | None) -> str | None:
    """A name that promises two states over more than two values."""
    words = set(pii.normalise(name).split("_"))
    if not words & {"is", "has", "flag", "yn", "ind"} or types.is_boolean(kind) or s is None or (s.distinct_count or 0) <= 2:
        return None
    if domain and domain.values:
        n = f"{len(domain.values) + domain.elided}"
        listed = ": " + ", ".join(f"{v.value}={v.count}" for v in domain.values) + (f", +{domain.elided} more" if domain.elided else "")
    else:
        n, listed = ("" if s.distinct_exact else "~") + str(s.distinct_count), ""
    return f"{name} is named like a yes/no flag, yet holds {n} distinct non-null values{listed}; reading it as two-valued misclassifies rows"


def granularity(s: ColumnStats) -> str:
    if (s.day_aligned or 0) < MATCH:
        return "hour"
    return "month" if (s.month_aligned or 0) >= MATCH else "day"


def _stamp(value: object) -> dt.datetime:
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return dt.datetime(value.year, value.month, value.day)


def continuity(s: ColumnStats | None) -> tuple[str, int, int, int, int] | None:
    """(granularity, span, distinct periods, missing, largest gap)."""
    if s is None or s.min_value is None or s.max_value is None or (s.day_aligned is None and s.month_aligned is None):
        return None
    unit = granularity(s)
    low, high = _stamp(s.min_value), _stamp(s.max_value)
    if unit not in s.periods:
        return None
    if unit == "month":
        span = (high.year - low.year) * 12 + high.month - low.month + 1
    else:
        span = int((high - low).total_seconds() // 3600) + 1 if unit == "hour" else (high - low).days + 1
    n, gap = s.periods[unit]
    return unit, span, n, max(0, span - n), gap or 0
