"""Command line: each command prints one JSON line."""

from __future__ import annotations

import argparse
import dataclasses
import sys
from typing import Any

from . import envelope
from .config import load
from .engine import Engine
from .plans.edits import Edit
from .sources import demo
from .sources.store import FileStore, MemoryStore


def plain(x: Any) -> Any:
    if hasattr(x, "to_dict"):
        return x.to_dict()
    if dataclasses.is_dataclass(x):
        return dataclasses.asdict(x)
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return sorted(x) if isinstance(x, set) else x


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    top.add_argument("--data-dir")
    top.add_argument("--database")
    top.add_argument("--scope", action="append", default=[])
    top.add_argument("--repo-root", default=".")
    top.add_argument("--store", choices=["memory", "filesystem"], default="filesystem")
    top.add_argument("--confirm", type=int, help="bytes that may be scanned")
    top.add_argument("--budget", type=int, help="ceiling of scanned bytes")
    group = top.add_subparsers(dest="group", required=True)

    def add(g: argparse._SubParsersAction, name: str, *args: tuple[str, dict]) -> None:
        p = g.add_parser(name)
        for flag, kw in args:
            p.add_argument(flag, **kw)

    names, yes = ("names", {"nargs": "*"}), lambda f: (f, {"action": "store_true"})
    g = group.add_parser("connect").add_subparsers(dest="command", required=True)
    add(g, "test")
    g = group.add_parser("explore").add_subparsers(dest="command", required=True)
    add(g, "inventory", yes("--rank"))
    add(g, "profile", names, yes("--refresh"), yes("--check-cumulative"))
    add(g, "relationships", yes("--verify"), yes("--refresh"))
    add(g, "map", yes("--full"), yes("--verify"), yes("--refresh"))
    add(g, "diagram", yes("--full"))
    add(g, "query", ("sql", {}), yes("--batch"))
    add(g, "cluster", ("name", {}), ("--features", {"nargs": "+"}), ("--k", {"type": int}))
    add(g, "semantic", ("metrics", {"nargs": "*"}), ("--group-by", {"nargs": "+"}), ("--where", {}), ("--order-by", {"nargs": "+"}), ("--grain", {}), ("--limit", {"type": int}))
    g = group.add_parser("maintain").add_subparsers(dest="command", required=True)
    for c in ("snapshot", "semantic", "reconcile"):
        add(g, c)
    for c in ("check", "schema", "volume", "grain"):
        add(g, c, names)
    g = group.add_parser("transform").add_subparsers(dest="command", required=True)
    add(g, "init", ("name", {}))
    add(g, "plan", ("--path", {"required": True}), ("--kind", {"default": "model"}), ("--file", {}), yes("--rows"))
    add(g, "apply", ("plan", {}))
    add(g, "plans")
    add(g, "scaffold", names)
    add(g, "test", ("model", {}))
    add(g, "build", ("target", {}), ("--select", {"nargs": "+"}))
    g = group.add_parser("semantic").add_subparsers(dest="command", required=True)
    for c in ("define", "update"):
        add(g, c, ("--path", {"required": True}), ("--file", {"required": True}))
    g = group.add_parser("demo").add_subparsers(dest="command", required=True)
    add(g, "write", ("folder", {}))
    add(g, "digest")
    return top


def run(a: argparse.Namespace, engine: Engine) -> Any:
    text = lambda f: sys.stdin.read() if f in (None, "-") else open(f).read()  # noqa: E731, SIM115
    e = engine
    match (a.group, a.command):
        case ("connect", "test"):
            return e.connect_test()
        case ("explore", "inventory"):
            return e.inventory(a.rank)
        case ("explore", "profile"):
            return e.profile(a.names, a.refresh, a.check_cumulative)
        case ("explore", "relationships"):
            return e.relationships(a.verify, a.refresh)
        case ("explore", "map"):
            c = e.map(a.full, a.refresh, a.verify)
            return {"datasets": [d.identifier for d in c.datasets], "relationships": len(c.relationships), "quality_notes": {d.identifier: d.data_quality for d in c.datasets if d.data_quality}}
        case ("explore", "diagram"):
            return e.diagram(a.full)
        case ("explore", "query"):
            return e.query_batch(a.sql) if a.batch else e.query(a.sql)
        case ("explore", "cluster"):
            return e.cluster(a.name, a.features, a.k)
        case ("explore", "semantic"):
            return e.semantic_query(a.metrics, a.group_by, a.where, a.order_by, a.grain, a.limit) if a.metrics else e.semantic_list()
        case ("maintain", "snapshot"):
            snap, notes = e.snapshot()
            return {"taken_at": snap.taken_at, "thin": snap.thin, "notes": notes}
        case ("maintain", "check"):
            found, notes = e.check(a.names)
            return {"findings": found, "notes": notes}
        case ("maintain", "schema" | "volume" | "grain"):
            return getattr(e, f"{a.command}_drift")(a.names)
        case ("maintain", "semantic"):
            return e.semantic_drift()
        case ("maintain", "reconcile"):
            return e.reconcile()
        case ("transform", "init"):
            return e.init_project(a.repo_root, a.name)
        case ("transform", "plan"):
            return e.plan([Edit(a.path, a.kind, "" if a.kind == "delete" else text(a.file))], a.rows)
        case ("transform", "apply"):
            return e.apply(a.plan)
        case ("transform", "plans"):
            return e.plans()
        case ("transform", "scaffold"):
            return e.scaffold(a.names)
        case ("transform", "test"):
            return e.scaffold_unit_test(a.model)
        case ("transform", "build"):
            return e.build(a.target, a.select)
        case ("semantic", "define"):
            return e.semantic_define(a.path, text(a.file))
        case ("semantic", "update"):
            return e.semantic_update(a.path, text(a.file))
    raise ValueError(f"no command {a.group} {a.command}")


def main(argv: list[str] | None = None, spark: Any = None) -> int:
    a = parser().parse_args(argv)
    name = f"{a.group} {a.command}"
    try:
        if a.group == "demo":
            from pyspark.sql import SparkSession

            data = {"digest": demo.digest()} if a.command == "digest" else demo.write(spark or SparkSession.builder.getOrCreate(), a.folder)
        else:
            config = load(f"{a.repo_root}/siltstone.yml")
            config.scope = a.scope or config.scope
            config.budget_bytes = a.budget or config.budget_bytes
            store = MemoryStore() if a.store == "memory" else FileStore(f"{a.repo_root}/.siltstone")
            data = run(a, Engine(spark=spark, data_dir=a.data_dir, database=a.database, store=store, config=config, project_root=a.repo_root, confirm=a.confirm))
        envelope.emit(envelope.success(name, plain(data)))
        return 0
    except Exception as e:  # one line for every outcome
        envelope.emit(envelope.failure(name, e))
        return 1


if __name__ == "__main__":
    sys.exit(main())
