"""A transform project on disk: SQL models, schema and semantic YAML, and what they declare."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from ..operators.drift import Project
from ..plans import semantic

REF = re.compile(r"\{\{\s*ref\(\s*['\"](?:[\w.]+['\"]\s*,\s*['\"])?(\w+)['\"]\s*\)\s*\}\}")
SOURCE = re.compile(r"\{\{\s*source\(\s*['\"](\w+)['\"]\s*,\s*['\"](\w+)['\"]\s*\)\s*\}\}")
MATERIALIZED = re.compile(r"materialized\s*=\s*['\"](\w+)['\"]")
LAYER = re.compile(r"\{\{\s*config\([^}]*\bschema\s*=\s*['\"](\w+)['\"]")
SKIP = {"target", "dbt_packages", "logs", ".git", "venv", ".venv"}


def read_yaml(path: Path) -> dict:
    import yaml

    try:
        doc = yaml.safe_load(path.read_text()) or {}
    except yaml.YAMLError as e:
        raise ValueError(f"{path.name}: {str(e).splitlines()[0]}") from None
    return doc if isinstance(doc, dict) else {}


def discover(root: str | Path) -> list[Path]:
    """Folders below root that hold a dbt_project.yml, nearest first."""
    out = [p.parent for p in Path(root).rglob("dbt_project.yml") if not SKIP & set(p.relative_to(root).parts)]
    return sorted(out, key=lambda p: (len(p.parts), str(p)))


def find(root: str | Path) -> Path:
    found = discover(root)
    if not found:
        raise FileNotFoundError(f"no dbt_project.yml below {root}")
    if len(found) > 1 and len(found[0].parts) == len(found[1].parts):
        raise ValueError("several projects: name one of " + ", ".join(map(str, found)))
    return found[0]


@dataclass
class ModelFile:
    name: str
    path: str
    sql: str
    refs: list[str]
    sources: list[tuple[str, str]]
    materialized: str = "view"
    layer: str | None = None  # its config's schema


@dataclass
class TransformProject:
    root: Path
    name: str = ""
    models: dict[str, ModelFile] = field(default_factory=dict)
    documented: dict[str, list[str]] = field(default_factory=dict)  # model -> columns in schema files
    tests: list[dict] = field(default_factory=list)  # {model, column, test, args}
    sources: dict[tuple[str, str], str] = field(default_factory=dict)  # (source, table) -> relation
    semantic_docs: dict[str, dict] = field(default_factory=dict)  # path -> YAML
    column_meta: dict[tuple[str, str], dict] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    def relation(self, name: str) -> str:
        return name

    def resolve(self, name: str) -> str:
        """A ref or source, as Spark names its relation."""
        if "." in name:
            key = tuple(name.split(".", 1))
            if key not in self.sources:
                raise LookupError(f"source {name} is not declared")
            return self.sources[key]
        if name not in self.models:
            raise LookupError(f"model {name} does not exist")
        return self.relation(name)

    def semantic(self) -> tuple[list[semantic.Model], list[semantic.Metric]]:
        models, metrics = [], []
        for doc in self.semantic_docs.values():
            a, b = semantic.from_yaml(doc)
            models += a
            metrics += b
        return models, metrics

    def declared_keys(self) -> dict[str, list[list[str]]]:
        """Columns that schema files call unique, and combinations of them."""
        out: dict[str, list[list[str]]] = {}
        for t in self.tests:
            if t["test"] == "unique" and t["column"]:
                out.setdefault(t["model"], []).append([t["column"]])
            elif t["test"].endswith("unique_combination_of_columns"):
                out.setdefault(t["model"], []).append(list(t["args"].get("combination_of_columns", [])))
        return out

    def declared_edges(self) -> list[tuple[str, str, str, str]]:
        """(child, column, parent, column) of the relationships tests."""
        out = []
        for t in self.tests:
            if t["test"] == "relationships" and t["column"] and t["args"].get("to") and t["args"].get("field"):
                to = str(t["args"]["to"])
                ref = re.search(r"ref\(\s*['\"](\w+)['\"]", to) or re.search(r"source\(\s*['\"]\w+['\"]\s*,\s*['\"](\w+)['\"]", to)
                out.append((t["model"], t["column"], ref[1] if ref else to, t["args"]["field"]))
        return out

    def definitions(self) -> Project:
        """What drift compares: lineage, relations, sources, semantic definitions."""
        models, metrics = self.semantic()
        return Project(
            models={m.name: [*m.refs, *[t for _, t in m.sources]] for m in self.models.values()},
            relations={m: self.relation(m) for m in self.models},
            sources=sorted(set(self.sources.values())),
            semantic_models={
                m.name: {
                    "model": m.relation,
                    "columns": sorted({c for x in (*m.entities, *m.dimensions, *m.measures) if (c := semantic.physical(x.expr, x.name))}),
                    "measures": {x.name: {"agg": x.agg, "expr": x.expr} for x in m.measures},
                    "dimensions": [c for d in m.dimensions if d.type == "categorical" and (c := semantic.physical(d.expr, d.name))],
                    "entities": {e.name: e.type for e in m.entities},
                }
                for m in models
            },
            metrics={m.name: {"type": m.type, "measures": [x for x in (m.measure, m.base_measure, m.conversion_measure) if x], "metrics": [x for x in (m.numerator, m.denominator, *m.metrics) if x], "expr": m.expr, "filter": m.filter} for m in metrics},
        )

    def order(self) -> list[str]:
        """Models so that each follows those it reads."""
        out: list[str] = []
        state: dict[str, int] = {}

        def visit(name: str, path: tuple[str, ...]) -> None:
            if state.get(name) == 2 or name not in self.models:
                return
            if state.get(name) == 1:
                raise ValueError("models read each other in a circle: " + " -> ".join((*path[path.index(name) :], name)))
            state[name] = 1
            for r in self.models[name].refs:
                visit(r, (*path, name))
            state[name] = 2
            out.append(name)

        for name in sorted(self.models):
            visit(name, ())
        return out


def _tests(model: str, column: str | None, listed: Any) -> list[dict]:
    out = []
    for t in listed or []:
        if isinstance(t, str):
            out.append({"model": model, "column": column, "test": t, "args": {}})
        elif isinstance(t, dict):
            for k, v in t.items():
                args = dict(v) if isinstance(v, dict) else {}
                args |= args.pop("arguments", None) or {}
                out.append({"model": model, "column": column, "test": k.rsplit(".", 1)[-1], "args": args})
    return out


def load(root: str | Path) -> TransformProject:
    """Read the project; a broken YAML file is a warning, for the rest of the project still speaks."""
    root = Path(root)
    head = read_yaml(root / "dbt_project.yml")
    out = TransformProject(root, str(head.get("name", root.name)))
    folders = [root / p for p in head.get("model-paths") or ["models"]]
    for folder in folders:
        for p in sorted(folder.rglob("*.sql")) if folder.exists() else []:
            sql = p.read_text()
            kind = MATERIALIZED.search(sql)
            if p.stem in out.models:
                out.warnings.append(f"two models are called {p.stem}")
            out.models[p.stem] = ModelFile(p.stem, str(p.relative_to(root)), sql, list(dict.fromkeys(REF.findall(sql))), list(dict.fromkeys(SOURCE.findall(sql))), kind[1] if kind else "view", layer[1] if (layer := LAYER.search(sql)) else None)
        for p in sorted([*folder.rglob("*.yml"), *folder.rglob("*.yaml")]) if folder.exists() else []:
            try:
                doc = read_yaml(p)
            except ValueError as e:
                out.warnings.append(str(e))
                continue
            _schema(out, doc)
            if doc.get("semantic_models") or doc.get("metrics"):
                out.semantic_docs[str(p.relative_to(root))] = doc
    return out


def _schema(out: TransformProject, doc: dict) -> None:
    for m in doc.get("models") or []:
        name = m["name"]
        out.documented[name] = [c["name"] for c in m.get("columns") or []]
        out.tests += _tests(name, None, m.get("data_tests") or m.get("tests"))
        for c in m.get("columns") or []:
            out.tests += _tests(name, c["name"], c.get("data_tests") or c.get("tests"))
            if c.get("meta"):
                out.column_meta[name, c["name"]] = c["meta"]
    for s in doc.get("sources") or []:
        for t in s.get("tables") or []:
            schema = s.get("schema") or s["name"]
            out.sources[s["name"], t["name"]] = f"{schema}.{t.get('identifier') or t['name']}"
            for c in t.get("columns") or []:
                out.tests += _tests(t["name"], c["name"], c.get("data_tests") or c.get("tests"))


def manifest(path: str | Path) -> Project:
    """Lineage of a compiled manifest.json: models, what they read, the relations they build."""
    doc = json.loads(Path(path).read_text())
    out = Project()
    short = lambda key: key.rsplit(".", 1)[-1]
    for key, n in (doc.get("nodes") or {}).items():
        if n.get("resource_type", key.split(".")[0]) == "model":
            out.models[n["name"]] = [short(x) for x in (n.get("depends_on") or {}).get("nodes") or []]
            out.relations[n["name"]] = ".".join(x for x in (n.get("schema"), n.get("alias") or n["name"]) if x)
    out.sources = sorted({f"{n['schema']}.{n.get('identifier') or n['name']}" for n in (doc.get("sources") or {}).values()})
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
