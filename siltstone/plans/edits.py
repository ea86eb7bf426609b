"""Edits of a project: planned with a diff, validated, applied all or none."""

from __future__ import annotations

import datetime as dt
import difflib
import os
import re
import tempfile
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from ..model import Column, Dataset, Record
from ..sources.project import REF, SOURCE, TransformProject, digest
from ..sources.store import Store
from . import attribution, semantic
from .guard import Refused, assert_select_only

KINDS = {"model": ".sql", "macro": ".sql", "test": ".sql", "schema": ".yml", "semantic": ".yml", "seed": ".csv", "delete": ""}
SECRET = re.compile(r"(?i)(?:password|passwd|secret|api_key|private_key)\s*[:=]\s*['\"]?[^\s{'\"]{6,}|AKIA[0-9A-Z]{16}|-----BEGIN [A-Z ]*PRIVATE KEY")


@dataclass
class Edit(Record):
    path: str
    kind: str
    content: str = ""


@dataclass
class Plan(Record):
    id: str
    edits: list[dict]
    pins: dict[str, str]  # path -> hash of what is there now, "" for nothing
    diff: str
    warnings: list[str] = field(default_factory=list)
    created_at: str = ""


def contained(root: Path, path: str) -> Path:
    full = (root / path).resolve()
    if not full.is_relative_to(root.resolve()) or full == root.resolve():
        raise Refused(f"{path} lies outside the project")
    return full


def strip_jinja(sql: str) -> str:
    """A model as plain SQL: refs and sources by name, other expressions as literals, control blocks gone."""
    sql = re.sub(r"\{#.*?#\}", "", sql, flags=re.S)
    sql = REF.sub(lambda m: m[1], sql)
    sql = SOURCE.sub(lambda m: m[2], sql)
    sql = re.sub(r"\{\{\s*config\(.*?\)\s*\}\}", "", sql, flags=re.S)
    sql = re.sub(r"\{%.*?%\}", "", sql, flags=re.S)
    return re.sub(r"\{\{.*?\}\}", "1", sql, flags=re.S).strip().rstrip(";")


def validate(spark: SparkSession, edit: Edit) -> list[str]:
    """Refuses what must not be written; returns warnings."""
    if edit.kind not in KINDS:
        raise Refused(f"unknown kind of edit {edit.kind}: one of {', '.join(KINDS)}")
    if edit.kind != "delete" and not edit.path.endswith((KINDS[edit.kind], ".yaml" if KINDS[edit.kind] == ".yml" else KINDS[edit.kind])):
        raise Refused(f"{edit.path} is no place for a {edit.kind}: it ends in {KINDS[edit.kind]}")
    if edit.kind == "delete":
        return []
    if SECRET.search(edit.content):
        raise Refused(f"{edit.path} holds what looks like a secret")
    if edit.kind in ("model", "test"):
        assert_select_only(spark, strip_jinja(edit.content))
    elif edit.kind == "macro":
        opened, closed = (len(re.findall(rf"\{{%-?\s*{w}\b", edit.content)) for w in ("macro", "endmacro"))
        if opened != closed or not opened:
            raise Refused(f"{edit.path}: {opened} macros are opened, {closed} closed")
    elif edit.kind in ("schema", "semantic"):
        import yaml

        try:
            doc = yaml.safe_load(edit.content)
        except yaml.YAMLError as e:
            raise Refused(f"{edit.path}: {str(e).splitlines()[0]}") from None
        if not isinstance(doc, dict):
            raise Refused(f"{edit.path} must be a mapping")
        if edit.kind == "semantic":
            return validate_semantic(doc)
        for block in ("models", "sources"):
            for m in doc.get(block) or []:
                if not isinstance(m, dict) or not m.get("name"):
                    raise Refused(f"{edit.path}: every entry of {block} needs a name")
    return []


def validate_semantic(doc: dict, known: dict[str, set[str]] | None = None) -> list[str]:
    """Names, entities, measures and metric references of semantic YAML."""
    models, metrics = semantic.from_yaml(doc)
    known = known or {}
    measures = {x.name for m in models for x in m.measures} | known.get("measures", set())
    defined = {m.name for m in metrics} | known.get("metrics", set())
    warnings = []
    for m in models:
        if not m.entities:
            raise Refused(f"semantic model {m.name} has no entity")
        if m.measures and not (m.default_time or all(x.time_dimension for x in m.measures)):
            warnings.append(f"semantic model {m.name} has measures without a time dimension: they can't be grouped by time")
        names = [x.name for x in (*m.entities, *m.dimensions, *m.measures)]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise Refused(f"semantic model {m.name} defines {twice[0]} twice")
    for m in metrics:
        needs = {"simple": (m.measure,), "cumulative": (m.measure,), "ratio": (m.numerator, m.denominator), "derived": (m.expr,), "conversion": (m.base_measure, m.conversion_measure, m.entity)}.get(m.type)
        if needs is None:
            raise Refused(f"metric {m.name} has unknown type {m.type}")
        if not all(needs):
            raise Refused(f"metric {m.name} of type {m.type} lacks a parameter")
        for x in (m.measure, m.base_measure, m.conversion_measure):
            if x and x not in measures:
                raise Refused(f"metric {m.name} uses measure {x}, which is not defined")
        for x in (m.numerator, m.denominator, *m.metrics):
            if x and x not in defined:
                raise Refused(f"metric {m.name} uses metric {x}, which is not defined")
    return warnings


def deletion_errors(project: TransformProject, edits: Iterable[Edit]) -> list[str]:
    """Models that would read what the edits delete."""
    edits = list(edits)
    gone = {Path(e.path).stem for e in edits if e.kind == "delete" and e.path.endswith(".sql")}
    rewritten = {Path(e.path).stem: e.content for e in edits if e.kind == "model"}
    gone -= rewritten.keys()
    out = []
    for name, m in sorted(project.models.items()):
        if name not in gone:
            out += [f"{name} reads {r}, which would be deleted" for r in (REF.findall(rewritten[name]) if name in rewritten else m.refs) if r in gone]
    return out


def plan(spark: SparkSession, project: TransformProject, edits: list[Edit], store: Store, attribute_rows: bool = False, resolve: Callable[[str], str] | None = None, now: dt.datetime | None = None) -> Plan:
    """Validate, pin the present content, diff; nothing is written but the plan."""
    if not edits:
        raise Refused("a plan needs an edit")
    if len({e.path for e in edits}) < len(edits):
        raise Refused("two edits of one path")
    warnings, pins, diff = [], {}, []
    for e in edits:
        full = contained(project.root, e.path)
        warnings += validate(spark, e)
        old = full.read_text() if full.exists() else ""
        if e.kind == "delete" and not full.exists():
            raise Refused(f"{e.path} does not exist")
        pins[e.path] = digest(old) if full.exists() else ""
        diff += difflib.unified_diff(old.splitlines(), e.content.splitlines(), f"a/{e.path}", f"b/{e.path}", lineterm="")
        if e.kind == "model":
            name = Path(e.path).stem
            if name in project.documented:
                warnings += [f"{name}: {w}" for w in attribution.contract_warnings(spark, strip_jinja(e.content), project.documented[name])]
            if attribute_rows and old:
                try:
                    a = attribution.attribute(spark, old, e.content, resolve or project.resolve)
                    warnings += [f"{name}: {c.kind} {c.detail} changes the row count by {c.delta:+d}" for c in a.changes if c.delta is not None]
                    warnings += [f"{name}: {a.net_delta:+d} rows in all" + (", effects interact" if a.interacts else "")]
                except (attribution.Unattributable, LookupError, Refused, AnalysisException) as x:
                    warnings.append(f"{name}: rows can't be attributed: {str(x).strip().splitlines()[0]}")
    errors = deletion_errors(project, edits)
    if errors:
        raise Refused("; ".join(errors))
    stamp = (now or dt.datetime.now(dt.UTC)).isoformat()
    body = "\n".join(f"{e.path}\0{e.kind}\0{e.content}\0{pins[e.path]}" for e in edits)
    out = Plan("p" + digest(body)[:10], [e.to_dict() for e in edits], pins, "\n".join(diff), warnings, stamp)
    store.write(f"plans/{out.id}", out.to_dict())
    return out


def apply(project: TransformProject, plan_id: str, store: Store) -> list[str]:
    """Write all edits of a plan, or none: a file that changed since is a conflict."""
    doc = store.read(f"plans/{plan_id}")
    if doc is None:
        raise LookupError(f"no plan {plan_id}")
    p = Plan.from_dict(doc)
    targets = [(Edit.from_dict(e), contained(project.root, e["path"])) for e in p.edits]
    for e, full in targets:
        have = digest(full.read_text()) if full.exists() else ""
        if have != p.pins[e.path]:
            raise Refused(f"{e.path} has changed since the plan was made: plan again")
    before = {full: full.read_bytes() if full.exists() else None for _, full in targets}
    try:
        for e, full in targets:
            if e.kind == "delete":
                full.unlink()
                continue
            full.parent.mkdir(parents=True, exist_ok=True)
            fd, part = tempfile.mkstemp(dir=full.parent, prefix=f".{full.name}.")
            with os.fdopen(fd, "w") as f:
                f.write(e.content)
            os.replace(part, full)
    except OSError:
        for full, data in before.items():
            if data is None:
                full.unlink(missing_ok=True)
            else:
                full.write_bytes(data)
        raise
    return [e.path for e, _ in targets]


# scaffolds


def _dump(doc: dict) -> str:
    import yaml

    return yaml.safe_dump(doc, sort_keys=False, allow_unicode=True)


def column_doc(d: Dataset, c: Column, foreign: dict[str, tuple[str, str]]) -> dict:
    out: dict = {"name": c.name}
    tests: list = []
    if [c.name] in d.candidate_keys:
        tests.append("unique")
    if c.null_fraction == 0:
        tests.append("not_null")
    if c.name in foreign:
        to, field_ = foreign[c.name]
        tests.append({"relationships": {"to": f"ref('stg_{to}')", "field": field_}})
    if tests:
        out["tests"] = tests
    if c.pii:
        out["meta"] = {"pii": c.pii.category, "pii_confidence": c.pii.confidence}
    return out


def scaffold(datasets: list[Dataset], edges: list = (), folder: str = "models/staging") -> list[Edit]:
    """Sources, one staging model for each table, and their schema file with tests that the profile supports."""
    schemas: dict[str, list[Dataset]] = {}
    for d in datasets:
        schemas.setdefault(d.identifier.rpartition(".")[0] or "main", []).append(d)
    out = [Edit(f"{folder}/sources.yml", "schema", _dump({"version": 2, "sources": [{"name": s, "schema": s, "tables": [{"name": d.name} for d in ds]} for s, ds in sorted(schemas.items())]}))]
    for schema, ds in sorted(schemas.items()):
        for d in ds:
            columns = ",\n    ".join(c.name for c in d.columns)
            out.append(Edit(f"{folder}/stg_{d.name}.sql", "model", f"select\n    {columns}\nfrom {{{{ source('{schema}', '{d.name}') }}}}\n"))
            known = {x.identifier: x.name for x in datasets}
            foreign = {r.from_columns[0]: (known[r.to_dataset], r.to_columns[0]) for r in edges if r.from_dataset == d.identifier and len(r.from_columns) == 1 and r.to_dataset in known and r.confidence >= 0.8}
            doc = {"version": 2, "models": [{"name": f"stg_{d.name}", "columns": [column_doc(d, c, foreign) for c in d.columns]}]}
            out.append(Edit(f"{folder}/stg_{d.name}.yml", "schema", _dump(doc)))
    return out


def sample_value(kind: str) -> object:
    low = kind.lower()
    if "int" in low:
        return 1
    if low.startswith(("double", "float", "decimal")):
        return 1.5
    if low.startswith("bool"):
        return True
    return "2024-01-01" if low == "date" else "2024-01-01 00:00:00" if low.startswith("timestamp") else "a"


def scaffold_unit_test(spark: SparkSession, project: TransformProject, model: str, schemas: dict[str, dict[str, str]]) -> Edit:
    """A unit test with one typed row for each input: only the columns that the model reads, by lineage of the analyzed plan."""
    m = project.models[model]
    spark = spark.newSession()  # with views of its own: those of the caller stay
    inputs = {r: f"ref('{r}')" for r in m.refs} | {t: f"source('{s}', '{t}')" for s, t in m.sources}
    for name in inputs:
        if name not in schemas:
            raise LookupError(f"the columns of {name} are not known")
        spark.createDataFrame([], ", ".join(f"`{c}` {k}" for c, k in schemas[name].items())).createOrReplaceTempView(name)
    from . import inspect

    read = inspect.columns_read(spark.sql(strip_jinja(m.sql)))
    given = []
    for name, ref in inputs.items():
        used = [c for c in schemas[name] if c.lower() in read.get(name.lower(), set())] or list(schemas[name])[:1]
        given.append({"input": ref, "rows": [{c: sample_value(schemas[name][c]) for c in used}]})
    test = {"name": f"test_{model}", "model": model, "given": given, "expect": {"rows": []}}
    return Edit(f"models/unit_tests/{model}.yml", "schema", _dump({"version": 2, "unit_tests": [test]}))


def init_project(root: str | Path, name: str) -> list[str]:
    """An empty project; existing files are never overwritten."""
    root = Path(root)
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise Refused(f"{name} is not a project name")
    files = {"dbt_project.yml": _dump({"name": name, "version": "1.0.0", "profile": name, "model-paths": ["models"], "macro-paths": ["macros"]}), "models/.gitkeep": "", "macros/.gitkeep": "", ".gitignore": "target/\nlogs/\n.siltstone/\n"}
    if (root / "dbt_project.yml").exists():
        raise Refused("there is a project here already")
    made = []
    for path, text in files.items():
        full = root / path
        if not full.exists():
            full.parent.mkdir(parents=True, exist_ok=True)
            full.write_text(text)
            made.append(path)
    return made
