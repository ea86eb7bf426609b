"""Where maps, baselines, drift reports, query and spend logs and edit plans are kept."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import os
import tempfile
from pathlib import Path
from typing import Any, Protocol

DOCUMENTS = ("cache", "snapshot", "drift")
LOGS = ("queries", "spend")


class Store(Protocol):
    def read(self, name: str) -> dict | None: ...
    def write(self, name: str, doc: dict) -> None: ...
    def append(self, log: str, row: dict) -> None: ...
    def rows(self, log: str) -> list[dict]: ...
    def plans(self) -> list[str]: ...


class MemoryStore:
    """Keeps everything in this process; the default for library use."""

    def __init__(self) -> None:
        self._docs: dict[str, str] = {}
        self._logs: dict[str, list[dict]] = {}

    def read(self, name: str) -> dict | None:
        return json.loads(self._docs[name]) if name in self._docs else None

    def write(self, name: str, doc: dict) -> None:
        self._docs[name] = json.dumps(doc, default=str)

    def append(self, log: str, row: dict) -> None:
        self._logs.setdefault(log, []).append(row)

    def rows(self, log: str) -> list[dict]:
        return list(self._logs.get(log, []))

    def plans(self) -> list[str]:
        return sorted(k.removeprefix("plans/") for k in self._docs if k.startswith("plans/"))


class FileStore:
    """JSON files in a folder of the project; each is replaced as a whole, so that no reader sees half of one."""

    def __init__(self, root: str | Path):
        self.root = Path(root)

    def _path(self, name: str, suffix: str) -> Path:
        p = (self.root / f"{name}{suffix}").resolve()
        if not p.is_relative_to(self.root.resolve()):
            raise ValueError(f"{name} lies outside the store")
        return p

    def read(self, name: str) -> dict | None:
        p = self._path(name, ".json")
        return json.loads(p.read_text()) if p.exists() else None

    def write(self, name: str, doc: dict) -> None:
        p = self._path(name, ".json")
        p.parent.mkdir(parents=True, exist_ok=True)
        fd, part = tempfile.mkstemp(dir=p.parent, prefix=f".{p.name}.")
        with os.fdopen(fd, "w") as f:
            json.dump(doc, f, indent=1, sort_keys=True, default=str)
        os.replace(part, p)

    def append(self, log: str, row: dict) -> None:
        p = self._path(log, ".jsonl")
        p.parent.mkdir(parents=True, exist_ok=True)
        with p.open("a") as f:
            f.write(json.dumps(row, default=str) + "\n")

    def rows(self, log: str) -> list[dict]:
        p = self._path(log, ".jsonl")
        return [json.loads(x) for x in p.read_text().splitlines() if x.strip()] if p.exists() else []

    def plans(self) -> list[str]:
        return sorted(p.stem for p in (self.root / "plans").glob("*.json")) if (self.root / "plans").exists() else []


def spent(store: Store, unit: str = "bytes", since: dt.datetime | None = None, connector: str = "spark") -> float:
    """Sum of one unit of the spend log; settlements that give back are negative rows."""
    out = 0.0
    for r in store.rows("spend"):
        if r.get("unit") == unit and r.get("connector", connector) == connector and (since is None or dt.datetime.fromisoformat(r["at"]) >= since):
            out += r["amount"]
    return out


def resolve(name: str, *args: Any) -> Any:
    """``package.module:factory`` -> what the factory makes; "memory" and "filesystem" are built in."""
    if name == "memory":
        return MemoryStore()
    if name == "filesystem":
        return FileStore(*args)
    module, sep, attr = name.partition(":")
    if not sep or not module or not attr:
        raise ValueError(f"{name} is neither memory, filesystem nor package.module:factory")
    factory = getattr(importlib.import_module(module), attr, None)
    if not callable(factory):
        raise ValueError(f"{attr} of {module} can't be called")
    return factory(*args)
