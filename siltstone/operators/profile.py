"""Table profiles from aggregates alone."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from .. import types
from ..model import Column, ColumnMeta, ColumnStats, Dataset, PIIFlag, ValueCount, ValueDomain, json_safe
from ..sources.catalog import SparkCatalog
from . import naming, notes, pii

NEAR_UNIQUE = 0.75  # an approximate distinct count from this share of the rows on may be all of them
EXACT_COLUMNS = 8
PAIRS, REDUNDANT = 5, 3.0
DOMAIN_VALUES, DOMAIN_SHARE = 25, 0.1


def non_null_rows(s: ColumnStats, rows: int) -> int:
    return rows if s.null_fraction is None else round((1 - s.null_fraction) * rows)


def is_key(s: ColumnStats) -> bool:
    return bool(s.is_unique) and s.null_fraction in (0.0, None)


def escalate(source: SparkCatalog, identifier: str, rows: int, stats: dict[str, ColumnStats], most: int = EXACT_COLUMNS) -> None:
    """Exact distinct counts for the columns that look unique within the sketch's error."""
    near = []
    for s in stats.values():
        n = non_null_rows(s, rows)
        if s.distinct_count is not None and not s.distinct_exact and n > 0 and s.distinct_count >= NEAR_UNIQUE * n:
            near.append((abs(n - s.distinct_count), s.name, n))
    chosen = sorted(near)[:most]
    exact = source.exact_distinct_counts(identifier, [name for _, name, _ in chosen]) if chosen else {}
    for _, name, n in chosen:
        s = stats[name]
        s.distinct_count, s.distinct_exact, s.is_unique = exact[name], True, exact[name] == n == rows


def composite_candidates(stats: dict[str, ColumnStats], rows: int) -> list[list[str]]:
    """Column pairs worth proving: enough combinations, ids first, smallest product first, no look-alikes."""
    if any(is_key(s) for s in stats.values()):
        return []
    pool = [s for s in stats.values() if s.distinct_count and not s.is_unique and s.null_fraction in (0.0, None)]
    ranked = []
    for i, a in enumerate(pool):
        for b in pool[i + 1 :]:
            product = a.distinct_count * b.distinct_count
            slack = NEAR_UNIQUE ** sum(not x.distinct_exact for x in (a, b))
            if product >= rows * slack:
                pair = sorted((a, b), key=lambda x: (-x.distinct_count, x.name))
                ranked.append((-sum(naming.id_shaped(x.name) for x in (a, b)), product, (pair[0].name, pair[1].name)))
    kept, best = [], {}
    for _, product, pair in sorted(ranked):
        if any(c in best and product <= best[c] * REDUNDANT for c in pair):
            continue
        kept.append(list(pair))
        for c in pair:
            best.setdefault(c, product)
    return kept[:PAIRS]


def composite_keys(source: SparkCatalog, identifier: str, rows: int, stats: dict[str, ColumnStats]) -> list[list[str]]:
    pairs = composite_candidates(stats, rows) if rows else []
    counts = source.distinct_combination_counts(identifier, pairs) if pairs else {}
    return [p for p in pairs if counts.get(tuple(p)) == rows]


def value_domains(source: SparkCatalog, identifier: str, rows: int, stats: dict[str, ColumnStats], flagged: set[str], composite: set[str]) -> dict[str, ValueDomain]:
    """The values of columns with few of them; never of flagged columns or keys."""
    wanted = []
    for s in stats.values():
        n = rows * (1 - (s.null_fraction or 0.0))
        small = s.distinct_count and s.distinct_count <= DOMAIN_VALUES and s.distinct_count <= n * DOMAIN_SHARE
        if small and s.name not in flagged and s.name not in composite and not is_key(s):
            wanted.append(s.name)
    out = {}
    for name, (values, total) in (source.value_domain_counts(identifier, wanted, DOMAIN_VALUES) if wanted else {}).items():
        if total <= rows * (1 - (stats[name].null_fraction or 0.0)) * DOMAIN_SHARE:
            ordered = sorted(values, key=lambda v: -v[1])
            out[name] = ValueDomain([ValueCount(json_safe(v), n) for v, n in ordered], max(0, total - len(values)))
    return out


def profile_one(source: SparkCatalog, identifier: str, overrides: list[pii.Override] | None = None, blob_overrides: set[str] = frozenset(), now: dt.datetime | None = None) -> Dataset:
    df = source.frame(identifier)
    metas = [ColumnMeta(f.name, f.dataType.simpleString(), f.nullable, k) for k, f in enumerate(df.schema.fields)]
    meta = next(m for m in source.list_objects() if m.identifier == identifier)
    blobs = [c for c in metas if types.is_blob(c.data_type) and f"{identifier}.{c.name}".lower() not in blob_overrides]
    scanned = [c for c in metas if c not in blobs]
    flags: dict[str, tuple[PIIFlag | None, bool]] = {c.name: pii.classify(c.name, c.data_type) for c in metas}
    cleared = {c.name: flags[c.name][0] for c in metas if flags[c.name][0] and pii.overridden(overrides or [], identifier, c.name)}
    standing = {c: f for c, (f, _) in flags.items() if f and c not in cleared}
    plain = [c for c in scanned if c.name not in standing and not types.is_nested(c.data_type)]
    safe = {c.name for c in plain if types.is_numeric(c.data_type) or types.is_temporal(c.data_type) or types.is_boolean(c.data_type)}
    rows, stats = source.column_aggregates(
        identifier,
        scanned,
        min_max=safe,
        shape={c.name for c in scanned if flags[c.name][1] and c.name in standing},
        contradiction={c.name for c in plain if types.is_string(c.data_type) or types.is_integer(c.data_type)},
        key_shape={c.name for c in plain if types.is_string(c.data_type)},
        temporal={c.name for c in plain if types.is_temporal(c.data_type)},
    )
    sampled = source.scan(identifier)[1]
    if sampled:
        rows = source.row_count(identifier)
    else:
        source._rows[identifier] = rows
    composite: list[list[str]] = []
    if rows and not sampled:
        escalate(source, identifier, rows, stats)
        composite = composite_keys(source, identifier, rows, stats)
    members = {c for k in composite for c in k}
    domains = value_domains(source, identifier, rows, stats, set(standing) | set(cleared), members) if rows else {}
    out = Dataset(identifier, meta.object_type, rows, meta.byte_size, composite_keys=composite, profiled_at=(now or dt.datetime.now(dt.UTC)).isoformat())
    said: list[str] = [] if rows else ["empty table (no rows)"]
    for c in metas:
        s = stats.get(c.name)
        flag = pii.refine(*((standing.get(c.name), s)), generic=flags[c.name][1], rows=rows)
        col = Column(c.name, c.data_type, c.nullable, pii=flag, pii_overridden=cleared.get(c.name))
        if c in blobs:
            said.append(f"{c.name} holds bytes and was left out of the scan")
        if s:
            col.null_fraction, col.distinct_count, col.distinct_exact, col.is_unique = s.null_fraction, s.distinct_count, s.distinct_exact, s.is_unique
            col.min_value, col.max_value = json_safe(s.min_value), json_safe(s.max_value)
            col.value_domain = domains.get(c.name)
            if found := notes.continuity(s):
                col.temporal_granularity, col.temporal_span, col.temporal_periods, col.temporal_missing, col.temporal_largest_gap = found
            if rows:
                said += notes.contradiction_notes(c.name, c.data_type, s)
                if is_key(s) or c.name in members:
                    said.append(notes.mixed_key_note(c.name, s))
                said.append(notes.flag_note(c.name, c.data_type, s, domains.get(c.name)))
        out.columns.append(col)
    out.data_quality = [n for n in said if n]
    return out


def profile(source: SparkCatalog, identifiers: list[str], overrides: list[pii.Override] | None = None, blob_overrides: set[str] = frozenset(), on_complete: Callable[[Dataset], None] | None = None, threads: int = 4) -> list[Dataset]:
    """Profiles in the order asked for; several tables are scanned at once."""
    with ThreadPoolExecutor(max(1, threads)) as pool:
        jobs = [pool.submit(profile_one, source, i, overrides, blob_overrides) for i in identifiers]
        out = []
        for job in jobs:
            out.append(job.result())
            if on_complete:
                on_complete(out[-1])
    return out
