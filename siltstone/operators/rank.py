"""Which objects matter: size, joins, name and width."""

from __future__ import annotations

import math
import re
from collections import Counter

from ..model import ObjectMeta, Relationship

_UP = re.compile(r"(?:^|_)(?:fct|fact|dim|stg|mart|f|d)(?:_|$)", re.I)
_DOWN = re.compile(r"(?:^|_)(?:tmp|temp|bak|backup|old|scratch|test|deleted|archive|copy)(?:_|$)", re.I)


def naming_score(name: str, hints: list[str]) -> float:
    if any(h in name.lower() for h in hints):
        return 1.0
    return 0.15 if _DOWN.search(name) else 0.85 if _UP.search(name) else 0.5


def width_score(columns: int | None) -> float:
    n = columns or 0
    return 1.0 if 2 <= n <= 60 else 0.4 if n < 2 else max(0.2, 60 / n)


def rank(objects: list[ObjectMeta], edges: list[Relationship] | None = None, hints: list[str] | None = None, orphaned: set[str] | None = None) -> dict[str, float]:
    degree = Counter(x for r in edges or [] for x in (r.from_dataset, r.to_dataset))
    rows = {o.identifier: math.log1p(o.row_count or 0) for o in objects}
    most_rows, most_edges = max(rows.values(), default=0) or 1, max(degree.values(), default=0) or 1
    wanted = [h.strip().lower() for h in hints or [] if isinstance(h, str) and h.strip()]
    lost = {i.lower() for i in orphaned or ()}
    out = {}
    for o in objects:
        s = 0.35 * rows[o.identifier] / most_rows + 0.30 * degree[o.identifier] / most_edges + 0.20 * naming_score(o.name, wanted) + 0.15 * width_score(o.column_count)
        out[o.identifier] = round(s * (0.5 if o.identifier.lower() in lost else 1), 4)
    return out


def select(objects: list[ObjectMeta], scores: dict[str, float], full: bool = False, top: int = 25, small: int = 50) -> list[str]:
    """All objects if there are few, else those of highest rank."""
    names = sorted((o.identifier for o in objects), key=lambda i: (-scores.get(i, 0), i))
    return names if full or len(names) <= small else names[:top]
