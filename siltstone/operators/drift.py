"""Drift against a pinned baseline: schema, volume, grain and semantic, ranked by what depends on it."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections import defaultdict
from dataclasses import dataclass, field

from ..model import Cache, Column, Dataset, Finding, Record, Relationship
from ..sources.catalog import SparkCatalog
from .relationships import overlap

IGNORE, HALF, BAND, ORPHANS_HIGH = 0.10, 0.5, 0.02, 0.2
SEVERITY = {"high": 0, "medium": 1, "low": 2}


@dataclass
class Project(Record):
    """What a transform project declares: models and what they read, sources, semantic definitions."""

    models: dict[str, list[str]] = field(default_factory=dict)  # model -> models and sources it reads
    relations: dict[str, str] = field(default_factory=dict)  # model -> the relation it builds
    sources: list[str] = field(default_factory=list)  # relations that sources name
    semantic_models: dict[str, dict] = field(default_factory=dict)  # name -> {model, columns, measures, dimensions}
    metrics: dict[str, dict] = field(default_factory=dict)  # name -> {measures, metrics}


@dataclass
class Snapshot:
    cache: Cache
    project: Project = field(default_factory=Project)
    taken_at: str = ""
    thin: bool = False  # metadata only, no profiles

    def to_dict(self) -> dict:
        return {"schema_version": 1, "cache": self.cache.to_dict(), "project": self.project.to_dict(), "taken_at": self.taken_at, "thin": self.thin}

    @classmethod
    def from_dict(cls, d: dict) -> Snapshot:
        if d.get("schema_version") != 1:
            raise ValueError("this baseline was written by another version; take a new snapshot")
        return cls(Cache.from_dict(d["cache"]), Project.from_dict(d["project"]), d["taken_at"], d["thin"])


def snapshot(source: SparkCatalog, cache: Cache | None, project: Project | None = None, now: dt.datetime | None = None) -> tuple[Snapshot, list[str]]:
    stamp = (now or dt.datetime.now(dt.UTC)).isoformat()
    if cache and cache.datasets:
        return Snapshot(cache, project or Project(), stamp), []
    return Snapshot(Cache(datasets=current_state(source)), project or Project(), stamp, True), ["no profile to pin: the baseline holds metadata only, so that grain and cardinality can't drift"]


def current_state(source: SparkCatalog) -> list[Dataset]:
    """Names, types and row counts, from metadata and footers."""
    out = []
    for o in source.list_objects():
        rows, columns = source.table_metadata(o.identifier)
        out.append(Dataset(o.identifier, o.object_type, rows, o.byte_size, [Column(c.name, c.data_type, c.nullable) for c in columns]))
    return out


def resolve_scope(names: list[str] | None, known: list[str]) -> set[str] | None:
    if not names:
        return None
    out = set()
    for n in names:
        hits = [k for k in known if k.lower() == n.lower() or k.lower().endswith("." + n.lower())]
        if not hits:
            raise LookupError(f"no object {n} in the baseline or the warehouse")
        out |= set(hits)
    return out


def schema_drift(base: list[Dataset], now: list[Dataset], scope: set[str] | None = None, old: Project | None = None, new: Project | None = None) -> list[Finding]:
    a, b = {d.identifier: d for d in base}, {d.identifier: d for d in now}
    seen = lambda i: scope is None or i in scope
    out = [Finding("schema", "table_added", i, "low", f"{i} is new") for i in sorted(b.keys() - a.keys()) if seen(i)]
    out += [Finding("schema", "table_dropped", i, "high", f"{i} is gone") for i in sorted(a.keys() - b.keys()) if seen(i)]
    for i in sorted(a.keys() & b.keys()):
        if not seen(i) or not a[i].columns:
            continue
        x, y = ({c.name.lower(): c for c in d.columns} for d in (a[i], b[i]))
        added, gone = [c for c in y if c not in x], [c for c in x if c not in y]
        out += [Finding("schema", "column_added", i, "low", f"{i}.{y[c].name} is new ({y[c].data_type})", y[c].name) for c in added]
        for c in gone:
            out.append(Finding("schema", "column_dropped", i, "high", f"{i}.{x[c].name} is gone", x[c].name))
            same = [y[n].name for n in added if y[n].data_type == x[c].data_type]
            if len(same) == 1:
                out.append(Finding("schema", "possible_rename", i, "low", f"{i}.{x[c].name} may now be {same[0]}: same type", x[c].name, data={"to": same[0]}))
        for c in (c for c in x if c in y):
            if x[c].data_type != y[c].data_type:
                out.append(Finding("schema", "column_retyped", i, "high", f"{i}.{x[c].name} was {x[c].data_type}, is {y[c].data_type}", x[c].name, data={"from": x[c].data_type, "to": y[c].data_type}))
            elif x[c].nullable != y[c].nullable:
                out.append(Finding("schema", "nullability_changed", i, "medium", f"{i}.{x[c].name} {'may now be null' if y[c].nullable else 'may no longer be null'}", x[c].name))
    if old and new:
        built_now = {r.lower() for r in new.relations.values()} | {s.lower() for s in new.sources}
        for r in sorted({r for r in old.relations.values() if r.lower() not in built_now}):
            if r in b and seen(r):
                out.append(Finding("schema", "orphan_relation", r, "medium", f"{r} still exists but no model builds it any more"))
        for s in new.sources:
            if not any(k.lower() == s.lower() or k.lower().endswith("." + s.lower()) for k in b):
                out.append(Finding("schema", "dangling_source", s, "high", f"source {s} has no object behind it"))
    return out


def volume_drift(base: list[Dataset], now: list[Dataset], scope: set[str] | None = None) -> list[Finding]:
    b, out = {d.identifier: d for d in now}, []
    for d in base:
        n = b.get(d.identifier)
        if n is None or d.row_count is None or n.row_count is None or scope is not None and d.identifier not in scope:
            continue
        was, is_ = d.row_count, n.row_count
        if was == is_:
            continue
        change = (is_ - was) / was if was else None
        if change is not None and abs(change) < IGNORE:
            continue
        severity = "low" if change is None or change > 0 else "high" if is_ == 0 or change <= -HALF else "medium"
        said = "was empty" if change is None else f"{change:+.0%}"
        out.append(Finding("volume", "row_count_changed", d.identifier, severity, f"{d.identifier} has {is_} rows, had {was} ({said})", exact=d.profiled_at is not None, data={"before": was, "after": is_}))
    return out


@dataclass
class GrainPlan:
    singles: dict[str, list[str]] = field(default_factory=dict)
    composites: dict[str, list[list[str]]] = field(default_factory=dict)
    edges: list[Relationship] = field(default_factory=list)


def grain_plan(base: Cache, now: list[Dataset], scope: set[str] | None = None) -> GrainPlan:
    """What the baseline proved and can still be asked."""
    live, plan = {d.identifier: {c.name.lower() for c in d.columns} for d in now}, GrainPlan()
    ok = lambda i, cols: i in live and {c.lower() for c in cols} <= live[i] and (scope is None or i in scope)
    for d in base.datasets:
        for key in [[c.name] for c in d.columns if c.is_unique and c.null_fraction in (0.0, None)]:
            if ok(d.identifier, key):
                plan.singles.setdefault(d.identifier, []).append(key[0])
        for key in d.composite_keys:
            if ok(d.identifier, key):
                plan.composites.setdefault(d.identifier, []).append(key)
    plan.edges = [r for r in base.relationships if r.verified and len(r.from_columns) == 1 and ok(r.from_dataset, r.from_columns) and ok(r.to_dataset, r.to_columns)]
    return plan


def grain_estimate(source: SparkCatalog, plan: GrainPlan) -> int:
    """Bytes that the plan's scans may read."""
    tables = [*plan.singles, *plan.composites, *(x for r in plan.edges for x in (r.from_dataset, r.to_dataset))]
    return sum(source.bytes_of(t) for t in tables)


def grain_drift(source: SparkCatalog, plan: GrainPlan) -> list[Finding]:
    out = []
    for i, cols in plan.singles.items():
        rows, counts = source.row_count(i), source.exact_distinct_counts(i, cols)
        for c in cols:
            if counts[c] < rows:
                out.append(Finding("grain", "key_lost_uniqueness", i, "high", f"{i}.{c} is no longer unique: {counts[c]} distinct over {rows} rows", c, data={"distinct": counts[c], "rows": rows}))
    for i, keys in plan.composites.items():
        rows = source.row_count(i)
        for k, n in source.distinct_combination_counts(i, keys).items():
            if n < rows:
                out.append(Finding("grain", "key_lost_uniqueness", i, "high", f"{i} ({', '.join(k)}) is no longer unique: {n} distinct over {rows} rows", data={"columns": list(k), "distinct": n, "rows": rows}))
    for r in plan.edges:
        got = overlap(source.frame(r.from_dataset), r.from_columns[0], source.frame(r.to_dataset), r.to_columns[0]).first()
        share = round(got.orphans / got.nonnull_fk, 4) if got.nonnull_fk else 0.0
        if share > (r.orphan_fraction or 0.0):
            out.append(Finding("grain", "join_orphans_increased", r.from_dataset, "high" if share >= ORPHANS_HIGH else "medium", f"{r.from_dataset}.{r.from_columns[0]} -> {r.to_dataset}.{r.to_columns[0]}: {share:.1%} orphans, were {r.orphan_fraction or 0:.1%}", r.from_columns[0], data={"before": r.orphan_fraction, "after": share}))
    return out


def definition_hash(d: dict) -> str:
    return hashlib.sha256(json.dumps(d, sort_keys=True, default=str).encode()).hexdigest()


def semantic_free_drift(old: Project, new: Project, now: list[Dataset]) -> list[Finding]:
    """Definitions that came, went or changed, and references to what isn't there."""
    out = []
    for kind in ("semantic_models", "metrics"):
        a, b = getattr(old, kind), getattr(new, kind)
        word = kind[:-1].replace("_", " ")
        out += [Finding("semantic", "definition_added", n, "low", f"{word} {n} is new") for n in sorted(b.keys() - a.keys())]
        out += [Finding("semantic", "definition_removed", n, "low", f"{word} {n} is gone") for n in sorted(a.keys() - b.keys())]
        out += [Finding("semantic", "definition_changed", n, "low", f"{word} {n} reads otherwise") for n in sorted(a.keys() & b.keys()) if definition_hash(a[n]) != definition_hash(b[n])]
    live = {d.identifier.lower(): {c.name.lower() for c in d.columns} for d in now}
    measures = {m for s in new.semantic_models.values() for m in s.get("measures", {})}
    for n, s in sorted(new.semantic_models.items()):
        model = s.get("model")
        if model not in new.models and model not in new.relations:
            out.append(Finding("semantic", "dangling_reference", n, "high", f"semantic model {n} reads model {model}, which the project lacks"))
            continue
        rel = (new.relations.get(model) or "").lower()
        cols = next((c for k, c in live.items() if k == rel or k.endswith("." + rel)), None) if rel else None
        for c in s.get("columns", []):
            if cols is not None and c.lower() not in cols:
                out.append(Finding("semantic", "dangling_reference", n, "high", f"semantic model {n} uses column {c}, which {rel} lacks", c))
    for n, m in sorted(new.metrics.items()):
        out += [Finding("semantic", "dangling_reference", n, "high", f"metric {n} uses measure {x}, which no semantic model has") for x in m.get("measures", []) if x not in measures]
        out += [Finding("semantic", "dangling_reference", n, "high", f"metric {n} uses metric {x}, which is not defined") for x in m.get("metrics", []) if x not in new.metrics]
    return out


def cardinality_plan(base: Cache, project: Project, now: list[Dataset]) -> dict[str, list[str]]:
    """Categorical dimensions whose baseline count is known and whose column is still there."""
    live = {d.identifier: {c.name for c in d.columns} for d in now}
    out: dict[str, list[str]] = {}
    for s in project.semantic_models.values():
        rel = project.relations.get(s.get("model"), s.get("model"))
        d = next((d for d in base.datasets if d.identifier == rel or d.name == rel), None)
        for c in s.get("dimensions", []):
            col = d.column(c) if d else None
            if col and col.distinct_count is not None and col.name in live.get(d.identifier, ()) and col.name not in out.get(d.identifier, []):
                out.setdefault(d.identifier, []).append(col.name)
    return out


def cardinality_drift(source: SparkCatalog, base: Cache, plan: dict[str, list[str]]) -> list[Finding]:
    out = []
    for i, cols in plan.items():
        for c, n in source.exact_distinct_counts(i, cols).items():
            was = base.dataset(i).column(c)
            slack = 0 if was.distinct_exact else BAND * was.distinct_count
            if abs(n - was.distinct_count) > slack:
                out.append(Finding("semantic", "dimension_cardinality_changed", i, "medium", f"{i}.{c} has {n} values, had {was.distinct_count}", c, exact=was.distinct_exact, data={"before": was.distinct_count, "after": n}))
    return out


def closure(edges: dict[str, set[str]], start: set[str]) -> set[str]:
    out, todo = set(start), list(start)
    while todo:
        for x in edges.get(todo.pop(), ()):
            if x not in out:
                out.add(x)
                todo.append(x)
    return out


def annotate_impacts(findings: list[Finding], project: Project) -> list[Finding]:
    """Models downstream of a table, through ref; metrics on their semantic models, and metrics on those."""
    down, up_metrics = defaultdict(set), defaultdict(set)
    for m, reads in project.models.items():
        for r in reads:
            down[r.lower()].add(m.lower())
    for m, d in project.metrics.items():
        for x in d.get("metrics", []):
            up_metrics[x].add(m)
    names = {m.lower(): m for m in project.models}
    for f in findings:
        bare = f.identifier.rsplit(".", 1)[-1].lower()
        start = {bare, f.identifier.lower()} | {m.lower() for m, r in project.relations.items() if r.lower() == f.identifier.lower() or r.lower().endswith("." + bare)}
        hit = closure(down, start)
        models = sorted(names[x] for x in hit if x in names)
        semantic = {n for n, s in project.semantic_models.items() if str(s.get("model", "")).lower() in hit} | ({f.identifier} & project.semantic_models.keys())
        measures = {x for n in semantic for x in project.semantic_models[n].get("measures", {})}
        direct = {m for m, d in project.metrics.items() if measures & set(d.get("measures", []))} | ({f.identifier} & project.metrics.keys())
        f.impacted_models, f.impacted_metrics = models, sorted(closure(up_metrics, direct))
    return findings


def rank_findings(findings: list[Finding]) -> list[Finding]:
    return sorted(findings, key=lambda f: (SEVERITY[f.severity], -len(f.impacted_models) - len(f.impacted_metrics), f.axis, f.identifier, f.column or ""))


def merge_report(stored: dict[str, list[Finding]], fresh: dict[str, list[Finding]], same_baseline: bool = True) -> dict[str, list[Finding]]:
    """Axes that were checked replace their old findings; a new baseline drops all old ones."""
    return (stored if same_baseline else {}) | fresh


def staleness(base: Snapshot, cache: Cache | None, now: dt.datetime, freshness_hours: int = 24) -> list[str]:
    out = []
    if base.thin:
        out.append("the baseline holds no profiles: keys and cardinality can't be compared")
    stamps = [d.profiled_at for d in (cache.datasets if cache else []) if d.profiled_at]
    if stamps:
        newest = max(map(dt.datetime.fromisoformat, stamps))
        if now - newest > dt.timedelta(hours=freshness_hours):
            out.append(f"the newest profile is older than {freshness_hours} h")
        if base.taken_at and newest > dt.datetime.fromisoformat(base.taken_at):
            out.append("tables were profiled after the baseline was taken: a new snapshot would pin them")
    return out


def check(source: SparkCatalog, base: Snapshot, project: Project | None = None, scope: set[str] | None = None, scan: bool = True) -> list[Finding]:
    """All axes; metadata axes always, scanning ones unless told not to."""
    now, new = current_state(source), project or base.project
    found = schema_drift(base.cache.datasets, now, scope, base.project, new) + volume_drift(base.cache.datasets, now, scope) + semantic_free_drift(base.project, new, now)
    if scan:
        found += grain_drift(source, grain_plan(base.cache, now, scope)) + cardinality_drift(source, base.cache, cardinality_plan(base.cache, new, now))
    return rank_findings(annotate_impacts(found, new))


PATCHABLE = ("column_added", "column_dropped", "column_retyped", "table_added")
ADVICE = {
    "table_dropped": "remove its source and the models that read it, or restore the table",
    "possible_rename": "if it is a rename, rename the column in the staging model and keep the old name as an alias",
    "nullability_changed": "review not_null tests on the column",
    "orphan_relation": "drop the relation or bring its model back",
    "dangling_source": "correct the source's name or schema",
    "row_count_changed": "find out whether the load was partial before building on it",
    "key_lost_uniqueness": "deduplicate upstream, or move the grain to a key that holds; a unique test keeps watch",
    "join_orphans_increased": "look for late or missing parents; a relationships test keeps watch",
    "definition_added": "none needed",
    "definition_removed": "check what still asks for it",
    "definition_changed": "check that its meaning changed on purpose",
    "dangling_reference": "define what is missing or correct the reference",
    "dimension_cardinality_changed": "review accepted values and dashboards that list them",
}


def reconcile(findings: list[Finding]) -> list[dict]:
    """A proposal for each finding: a mechanical re-scaffold where that is safe, advice elsewhere, a unique test for lost keys."""
    out = []
    for f in findings:
        p = {"identifier": f.identifier, "code": f.code, "column": f.column, "kind": "patch" if f.code in PATCHABLE else "advice"}
        p["text"] = f"scaffold the staging model of {f.identifier} again from its current columns" if f.code in PATCHABLE else ADVICE.get(f.code, "review")
        if f.code == "key_lost_uniqueness" and f.column:
            p["test"] = {"model": f.identifier.rsplit(".", 1)[-1], "column": f.column, "test": "unique"}
        out.append(p)
    return out
