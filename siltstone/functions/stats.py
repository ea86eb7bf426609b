"""Aggregate expressions for column profiles.  Fractions never count nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_S = (946684800, 4102444800)  # the years 2000 to 2100
EPOCH_MS = (EPOCH_S[0] * 1000, EPOCH_S[1] * 1000)

#: Whole-value patterns: \A and \z, as $ would let a trailing newline pass.
SHAPES = {
    "upper": r"[A-Z]+([ -][A-Z]+)*",
    "person": r"[A-Z][a-z]+ [A-Z][a-z]+",
    "numeric": r"-?[0-9]+(\.[0-9]+)?",
    "integer": r"-?[0-9]+",
    "iso_date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "iso_datetime": r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}",
    "slash_date": r"[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "slash_datetime": r"[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}",
    "epoch_s": r"-?[0-9]{1,10}",
    "epoch_ms": r"-?[0-9]{1,13}",
    "uuid": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    "hex": r"[0-9a-fA-F]+",
}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def matches(c: Column, shape: str) -> Column:
    return c.rlike(r"\A" + SHAPES[shape] + r"\z")


def fraction(c: Column, predicate: Column) -> Column:
    """Share of the non-null values for which the predicate holds."""
    return F.avg(F.when(predicate, F.lit(1.0)).when(c.isNotNull(), F.lit(0.0)))


def mean_tokens(c: Column) -> Column:
    return F.avg((F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("double"))


def shape_group(c: Column) -> dict[str, Column]:
    return {"upper_fraction": fraction(c, matches(c, "upper")), "person_fraction": fraction(c, matches(c, "person")), "mean_tokens": mean_tokens(c)}


def _epoch(c: Column, unit: str, text: bool) -> tuple[Column, Column]:
    """(is of epoch shape, number); the number is null for any other shape, so that no cast can fail."""
    if not text:
        return c.isNotNull(), c.cast("bigint")
    ok = matches(c, unit)
    return ok, F.when(ok, c.try_cast("bigint"))


def type_group(c: Column, text: bool) -> dict[str, Column]:
    """How well the values fit another type than the declared one."""
    out: dict[str, Column] = {}
    if text:
        for shape in ("numeric", "integer", "iso_date", "iso_datetime", "slash_date", "slash_datetime"):
            out[f"{shape}_fraction"] = fraction(c, matches(c, shape))
        slash = matches(c, "slash_date") | matches(c, "slash_datetime")
        for name, at in (("first", 1), ("second", 4)):
            part = F.when(slash, F.substring(c, at, 2).try_cast("int"))
            out[f"slash_{name}_over_12"] = fraction(c, slash & (part > 12))
    for unit, (low, high) in (("epoch_s", EPOCH_S), ("epoch_ms", EPOCH_MS)):
        ok, number = _epoch(c, unit, text)
        inside = number.between(low, high)
        # of the values that have the shape, not of all
        out[f"{unit}_fraction"] = F.avg(F.when(ok & inside, F.lit(1.0)).when(ok, F.lit(0.0)))
        out[f"{unit}_min"], out[f"{unit}_max"] = F.min(F.when(inside, number)), F.max(F.when(inside, number))
    return out


def key_group(c: Column) -> dict[str, Column]:
    hexed = matches(c, "hex") & ~matches(c, "numeric")
    length = F.when(hexed, F.length(c))
    return {"uuid_fraction": fraction(c, matches(c, "uuid")), "hex_fraction": fraction(c, hexed), "hex_min_length": F.min(length), "hex_max_length": F.max(length)}


def alignment_group(c: Column) -> dict[str, Column]:
    """Share of the values that lie on the start of a day, of a month."""
    return {f"{unit}_aligned": fraction(c, c.cast("timestamp_ntz") == F.date_trunc(unit, c.cast("timestamp_ntz"))) for unit in ("day", "month")}


def between(unit: str, earlier: Column, later: Column) -> Column:
    """Whole units between two values truncated to the unit; only there do boundary and complete-unit counts agree."""
    if unit == "month":
        return (F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)
    if unit == "day":
        return F.datediff(later, earlier)
    return F.timestamp_diff("HOUR", earlier, later)
