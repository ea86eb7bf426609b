"""Personal data by column name, type and value shape.  A flag holds a category and a confidence, never a value."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass

from .. import types
from ..model import ColumnStats, PIIFlag

BLOCK_AT = 0.5  # from this confidence on a column may not be shown

_TOKENS: list[tuple[str, float, str]] = [
    ("email", 0.9, "e_?mail|email_address"),
    ("phone", 0.8, "phone|mobile|cell|fax|msisdn"),
    ("name", 0.75, "(?:first|last|full|given)_?name|surname|[fl]name"),
    ("address", 0.7, "address|addr|street|city|zip|postal|postcode"),
    ("government_id", 0.9, "ssn|nino|(?:tax|national)_?id|passport|tin"),
    ("financial", 0.8, "iban|card|cc_?num|account_?no|routing|cvv|salary"),
    ("credential", 0.95, "password|passwd|secret|api_?key|access_?token"),
    ("location", 0.6, "lat|lng|latitude|longitude|geo|coordinates"),
    ("dob", 0.85, "dob|birth_?date|date_of_birth|birth"),
]
EXACT = [(c, conf, re.compile(rf"(?:^|_)(?:{words})(?:_|$)")) for c, conf, words in _TOKENS]
GENERIC_NAME = re.compile(r"(?:^|_)name(?:_|$)")
FREE_TEXT = re.compile(r"(?:^|_)(?:comments?|notes?|message|body|feedback|review_text|bio|about)(?:_|$)")
THINGS = frozenset("table column file schema db database model type product brand company app service".split())
AGGREGATE = re.compile(r"_(?:count|cnt|sum|avg|pct|ratio)$")
GENERIC, FREE = 0.6, 0.5
PERSON, REFERENCE = 0.75, 0.3


def normalise(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def _type_allows(category: str, kind: str) -> bool:
    if category in ("email", "name", "free_text"):
        return types.is_string(kind)
    if category == "phone":
        return not (types.is_boolean(kind) or types.is_temporal(kind) or "TIME" in types.raw(kind))
    return True


def classify(name: str, kind: str) -> tuple[PIIFlag | None, bool]:
    """(flag, whether it is the generic *name* rule, which value shapes may move)."""
    n = normalise(name)
    if not types.is_string(kind) and AGGREGATE.search(n):
        return None, False
    for category, confidence, pattern in EXACT:
        if pattern.search(n) and _type_allows(category, kind):
            return PIIFlag(category, confidence), False
    if types.is_string(kind):
        for m in GENERIC_NAME.finditer(n):
            before = n[: m.start()].rsplit("_", 1)[-1]
            if before not in THINGS:
                return PIIFlag("name", GENERIC), True
        if FREE_TEXT.search(n):
            return PIIFlag("free_text", FREE), False
    return None, False


def detect(name: str, kind: str) -> PIIFlag | None:
    return classify(name, kind)[0]


def closed_enumeration(s: ColumnStats, rows: int | None) -> bool:
    """Few values that repeat a lot: at most 32, and at most 1 % of the non-null rows."""
    if not rows or s.distinct_count is None or s.distinct_count > 32:
        return False
    non_null = round((1 - (s.null_fraction or 0)) * rows)
    return bool(non_null) and s.distinct_count / non_null <= 0.01


def shape_verdict(confidence: float, s: ColumnStats, rows: int | None) -> float:
    """Person-shaped values raise a generic name, provable labels lower it, anything else leaves it blocked."""
    if s.person_fraction is None or 0.05 < s.person_fraction < 0.5:
        return confidence
    if s.person_fraction >= 0.5:
        return PERSON
    vocabulary = (s.upper_fraction or 0) >= 0.9 and s.distinct_count is not None and s.distinct_count <= 32
    return REFERENCE if vocabulary or (s.mean_tokens or 0) >= 3.5 or closed_enumeration(s, rows) else confidence


def refine(flag: PIIFlag | None, s: ColumnStats | None, generic: bool, rows: int | None) -> PIIFlag | None:
    if flag is None or s is None:
        return flag
    c = flag.confidence
    if s.is_unique and flag.category in ("email", "government_id", "financial"):
        c = min(0.95, c + 0.05)
    if flag.category in ("location", "address") and s.distinct_count is not None and s.distinct_count <= 5:
        c = max(0.1, c - 0.3)
    if generic:
        c = shape_verdict(c, s, rows)
    return PIIFlag(flag.category, round(c, 4))


@dataclass
class Override:
    """Clears a flag: one column (``identifier.column``), or a column name wherever a scope pattern matches."""

    column: str | None = None
    column_name: str | None = None
    scope: str = "*"
    reason: str = ""

    def covers(self, identifier: str, column: str) -> bool:
        if self.column:
            return self.column.lower() == f"{identifier}.{column}".lower()
        return bool(self.column_name) and self.column_name.lower() == column.lower() and fnmatch.fnmatch(identifier.lower(), self.scope.lower())


def overridden(overrides: list[Override], identifier: str, column: str) -> Override | None:
    return next((o for o in overrides if o.covers(identifier, column)), None)
