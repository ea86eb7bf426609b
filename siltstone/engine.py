"""The engine: one object for one session and one caller; its methods return records."""

from __future__ import annotations

import datetime as dt
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession

from . import progress
from .config import Config, load
from .model import Cache, Dataset, Finding, QueryResult, Relationship, match_identifier, relation_verdict
from .operators import cluster as clusters
from .operators import cumulative, diagram, drift, profile, rank, relationships
from .plans import attribution, edits, firewall, guard, inspect, runner, semantic
from .plans.costs import Gate
from .sources import project as projects
from .sources.catalog import SparkCatalog
from .sources.store import FileStore, MemoryStore, Store


class Engine:
    def __init__(self, *, spark: SparkSession | None = None, data_dir: str | None = None, database: str | None = None, source: SparkCatalog | None = None, store: Store | None = None, config: Config | None = None, project_root: str | None = None, confirm: int | None = None, paradigm: str = "free", quiet: bool = True):
        self.config = config or Config()
        self.spark = spark or SparkSession.builder.getOrCreate()
        data_dir, database = data_dir or self.config.data_dir, database or self.config.database
        self.source = source or SparkCatalog(self.spark, data_dir, database, self.config.scope, sample_bytes=self.config.max_full_profile_bytes)
        self.store = store or MemoryStore()
        self.project_root = project_root
        self.gate = Gate(self.store, paradigm, self.config.budget_bytes, confirm, self.source.connector)
        self.quiet = quiet

    @classmethod
    def from_repo(cls, root: str, **kw: Any) -> Engine:
        """Settings from ``siltstone.yml``, kept state in ``.siltstone`` of a repository."""
        base = Path(root)
        kw.setdefault("config", load(base / "siltstone.yml"))
        kw.setdefault("store", FileStore(base / ".siltstone"))
        kw.setdefault("project_root", root)
        return cls(**kw)

    # state

    def cache(self) -> Cache:
        doc = self.store.read("cache")
        return Cache.from_dict(doc) if doc and doc.get("schema_version") == Cache().schema_version else Cache()

    def _save(self, cache: Cache) -> Cache:
        cache.provenance |= {"connector": self.source.connector, "saved_at": dt.datetime.now(dt.UTC).isoformat()}
        self.store.write("cache", cache.to_dict())
        return cache

    def _resolve(self, names: list[str]) -> list[str]:
        known, out = self.source.identifiers(), []
        for n in names:
            hits = [k for k in known if k.lower() == n.lower()] or [k for k in known if k.lower().endswith("." + n.lower())]
            if len(hits) != 1:
                raise LookupError(f"{n} is ambiguous: {', '.join(hits)}" if hits else f"no object {n} in scope")
            out.append(hits[0])
        return list(dict.fromkeys(out))

    def _fresh(self, d: Dataset | None, now: dt.datetime) -> bool:
        """Profiled within the window, and its columns are still the same."""
        if d is None or not d.profiled_at:
            return False
        if now - dt.datetime.fromisoformat(d.profiled_at) > dt.timedelta(hours=self.config.profile_freshness_hours):
            return False
        fields = self.source.frame(d.identifier).schema.fields
        return d.signature() == sorted((f.name, f.dataType.simpleString(), f.nullable) for f in fields)

    def _bytes(self, identifiers: list[str]) -> int:
        return sum(inspect.scan_bytes(self.source.frame(i)) for i in identifiers)

    def _profiled(self, identifiers: list[str], refresh: bool = False) -> Cache:
        """Profiles of the named objects: those that are fresh are kept, each new one is saved as it is done."""
        cache, now = self.cache(), dt.datetime.now(dt.UTC)
        stale = [i for i in identifiers if refresh or not self._fresh(cache.dataset(i), now)]
        bar = None if self.quiet else progress.Progress(len(stale), "profiled")

        def keep(d: Dataset) -> None:
            relationships.annotate(d, self._declared_keys(d))
            cache.datasets = [x for x in cache.datasets if x.identifier != d.identifier] + [d]
            self._save(cache)
            if bar:
                bar.step(d.identifier)

        if stale:
            with self.gate.spend(self._bytes(stale), "profile"):
                profile.profile(self.source, stale, self.config.pii_overrides, self.config.blob_overrides, keep)
        return cache

    def project(self) -> projects.TransformProject | None:
        if not self.project_root:
            return None
        try:
            return projects.load(projects.find(self.project_root))
        except FileNotFoundError:
            return None

    def _need_project(self) -> projects.TransformProject:
        p = self.project()
        if p is None:
            raise FileNotFoundError("there is no transform project: init_project() makes one")
        return p

    def _declared_keys(self, d: Dataset) -> list[list[str]]:
        p = self.project()
        return p.declared_keys().get(d.name, []) if p else []

    # explore

    def connect_test(self) -> dict:
        return self.source.capabilities() | {"objects": len(self.source.identifiers())}

    def inventory(self, ranked: bool = False) -> list[dict]:
        """Metadata alone: nothing is scanned."""
        objects = self.source.list_objects()
        scores = rank.rank(objects, self.cache().relationships, self.config.rank_hints) if ranked else {}
        rows = [o.to_dict() | ({"rank_score": scores[o.identifier]} if ranked else {}) for o in objects]
        return sorted(rows, key=lambda r: (-r.get("rank_score", 0), r["identifier"]))

    def profile(self, names: list[str], refresh: bool = False, check_cumulative: bool = False) -> list[Dataset]:
        ids = self._resolve(names)
        cache = self._profiled(ids, refresh)
        out = [cache.dataset(i) for i in ids]
        if check_cumulative:
            for d in out:
                candidate, said = cumulative.find_candidate(d)
                if candidate:
                    with self.gate.spend(self._bytes([d.identifier]), "running totals"):
                        rows = [(r.measure, r.observations, r.decreases) for r in cumulative.probe(self.source.frame(d.identifier), candidate).collect()]
                    said = [*said, *cumulative.notes_of(rows, candidate)]
                d.data_quality += [n for n in said if n not in d.data_quality]
            self._save(cache)
        return out

    def _edges(self, datasets: list[Dataset]) -> tuple[list[Relationship], list[str]]:
        inferred = relationships.infer(datasets, self.config.affixes).edges
        inferred, _, _ = relationships.fold_replicas(inferred, datasets)
        p = self.project()
        declared, lost = relationships.declared_edges(p.declared_edges(), [d.identifier for d in datasets]) if p else ([], [])
        return relationships.merge(inferred, declared), lost

    def relationships(self, verify: bool = False, refresh: bool = False) -> list[Relationship]:
        cache = self._profiled(self.source.identifiers(), refresh)
        edges, _ = self._edges(cache.datasets)
        if verify:
            probed = relationships.probes(self.source, edges)
            with self.gate.spend(self._bytes(sorted({x for r in probed for x in (r.from_dataset, r.to_dataset)})), "verify"):
                edges = relationships.verify(self.source, edges)
            self._note_orphans(cache, edges)
        cache.relationships = edges
        self._save(cache)
        return edges

    @staticmethod
    def _note_orphans(cache: Cache, edges: list[Relationship]) -> None:
        """Joins that the data contradict become notes of the table that holds the reference."""
        for r, said in relationships.orphan_findings(edges):
            d = cache.dataset(r.from_dataset)
            if d and said not in d.data_quality:
                d.data_quality.append(said)

    def map(self, full: bool = False, refresh: bool = False, verify: bool = False) -> Cache:
        """Inventory, rank, profile what matters, annotate, infer joins, verify, rank again, save."""
        objects = self.source.list_objects()
        old = self.cache()
        scores = rank.rank(objects, old.relationships, self.config.rank_hints)
        chosen = rank.select(objects, scores, full, self.config.profile_top_n)
        cache = self._profiled(chosen, refresh)
        live = {o.identifier for o in objects}
        cache.datasets = [d for d in cache.datasets if d.identifier in live]
        edges, lost = self._edges(cache.datasets)
        if verify:
            probed = relationships.probes(self.source, edges)
            with self.gate.spend(self._bytes(sorted({x for r in probed for x in (r.from_dataset, r.to_dataset)})), "verify"):
                edges = relationships.verify(self.source, edges)
            self._note_orphans(cache, edges)
        measured = {r.key(): r for r in old.relationships if r.verified}
        for r in edges:
            if not r.verified and r.key() in measured:
                r.verified, r.orphan_fraction, r.confidence = True, measured[r.key()].orphan_fraction, measured[r.key()].confidence
        known = {d.identifier for d in cache.datasets}
        cache.datasets += [Dataset(o.identifier, o.object_type, o.row_count, o.byte_size) for o in objects if o.identifier not in known]
        p = self.project()
        orphaned = self.orphans() if p else set()
        again = rank.rank(self.source.list_objects(), edges, self.config.rank_hints, orphaned)
        for d in cache.datasets:
            d.rank_score = again.get(d.identifier)
        cache.relationships = edges
        cache.provenance["unresolved_declarations"] = lost
        return self._save(cache)

    def orphans(self) -> set[str]:
        """Relations in a schema that the project builds into, which it neither builds nor declares."""
        p = self._need_project()
        ours = {m.lower() for m in p.models} | {t.lower() for _, t in p.sources} | {r.lower() for r in p.sources.values()}
        schemas = {i.rpartition(".")[0].lower() for i in self.source.identifiers() if i.rpartition(".")[2].lower() in p.models}
        return {i for i in self.source.identifiers() if i.rpartition(".")[0].lower() in schemas and i.rpartition(".")[2].lower() not in ours and i.lower() not in ours}

    def diagram(self, full: bool = False, max_entities: int = 40) -> diagram.Diagram:
        return diagram.render(self.cache(), full, max_entities)

    def query(self, sql: str) -> QueryResult:
        """One SELECT behind the firewall, its result capped and shaped."""
        q = self.config.query
        root = guard.assert_select_only(self.spark, sql)
        names = inspect.relations(root)
        if self.config.auto_profile:
            known = self.source.identifiers()
            ids = [h[0] for n in names if len(h := [k for k in known if k.lower() == n.lower() or k.lower().endswith("." + n.lower())]) == 1]
            cache = self._profiled(ids)
        else:
            cache = self.cache()
        got = firewall.inspect_query(self.spark, sql, cache, q.max_rows)
        with self.gate.spend(inspect.scan_bytes(got.df), "query"):
            rows = self._collect(got, q.max_rows + 1, q.timeout_seconds)
        notes = [*got.warnings, *(["the engine capped the result"] if got.capped_by_engine else [])]
        out = QueryResult(got.df.columns, [t for _, t in got.df.dtypes], [list(r) for r in rows[: q.max_rows]], len(rows) > q.max_rows, notes)
        self.store.append("queries", {"at": dt.datetime.now(dt.UTC).isoformat(), "sql": sql, "tables": got.tables, "rows": len(out.cells)})
        return firewall.shape(out, q.max_cell_chars, q.max_payload_bytes)

    def _collect(self, got: firewall.Inspected, n: int, seconds: float | None) -> list:
        import threading
        import uuid

        tag = f"siltstone-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        late = threading.Event()
        timer = threading.Timer(seconds, lambda: (late.set(), self.spark.interruptTag(tag))) if seconds else None
        try:
            if timer:
                timer.start()
            return got.df.limit(n).collect()
        except Exception:
            if late.is_set():
                raise TimeoutError(f"the query ran for more than {seconds:g} s and was cancelled") from None
            raise
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(tag)

    def object_gap(self, sql: str) -> list[dict]:
        """What stands between a statement and the firewall's verdict: objects that are missing, ambiguous or not profiled."""
        cache, now, out = self.cache(), dt.datetime.now(dt.UTC), []
        known = self.source.identifiers()
        for name in inspect.relations(guard.assert_select_only(self.spark, sql)):
            hits = match_identifier(name, known)
            if len(hits) == 1 and self._fresh(cache.dataset(hits[0]), now):
                continue
            gap = "ambiguous" if len(hits) > 1 else "unprofiled" if hits else relation_verdict(name, known, {k.rpartition(".")[0] for k in known}) or "missing"
            out.append({"relation": name, "gap": gap, "identifiers": hits, "bytes": self._bytes(hits) if len(hits) == 1 else None})
        return out

    def query_batch(self, text: str) -> list[dict]:
        """Several statements, a verdict for each; they share one profile, one price, which is asked for once, and one payload limit."""
        statements = guard.split_statements(text)
        if len(statements) > self.config.query.max_statements:
            raise guard.Refused(f"{len(statements)} statements; at most {self.config.query.max_statements} are run together")
        names, price = [], 0
        for sql, _ in statements:
            try:
                names += inspect.relations(guard.assert_select_only(self.spark, sql))
                price += inspect.scan_bytes(self.spark.sql(sql))
            except Exception:  # noqa: BLE001 - its own verdict follows below
                continue
        if self.config.auto_profile:
            ids = list(dict.fromkeys(h[0] for n in names if len(h := match_identifier(n, self.source.identifiers())) == 1))
            cache, now = self.cache(), dt.datetime.now(dt.UTC)
            price += self._bytes([i for i in ids if not self._fresh(cache.dataset(i), now)])
            self.gate.preflight(price)
            self._profiled(ids)
        else:
            self.gate.preflight(price)
        left, out = self.config.query.max_payload_bytes, []
        for sql, line in statements:
            try:
                got = self.query(sql)
                got = firewall.shape(got, self.config.query.max_cell_chars, max(2, left))
                left -= sum(len(str(r).encode()) + 1 for r in got.cells)
                out.append({"line": line, "sql": sql, "ok": True, "result": got})
            except (guard.Refused, LookupError, TimeoutError) as e:
                out.append({"line": line, "sql": sql, "ok": False, "message": str(e)})
        return out

    def cluster(self, name: str, features: list[str] | None = None, k: int | None = None) -> clusters.Clusters:
        (i,) = self._resolve([name])
        cache = self._profiled([i])
        chosen = clusters.features_of(cache.dataset(i), cache.relationships, features, self.config.cluster)
        with self.gate.spend(self._bytes([i]), "cluster"):
            return clusters.cluster(self.source.frame(i), chosen, self.config.cluster, k)

    def _layer(self) -> semantic.SemanticLayer:
        p = self._need_project()
        models, metrics = p.semantic()

        def frame(relation: str):
            known = self.source.identifiers()
            ids = match_identifier(relation, known)
            if len(ids) != 1:
                said = {"missing": "not in its schema", "foreign": "in a schema that this source does not have", None: "not in the warehouse"}
                raise LookupError(f"{relation} is {'ambiguous' if ids else said[relation_verdict(relation, known, {k.rpartition('.')[0] for k in known})]}")
            return self.source.frame(ids[0])

        return semantic.SemanticLayer(models, metrics, frame, self.cache())

    def semantic_list(self) -> dict:
        return self._layer().list_definitions()

    def semantic_query(self, metrics: list[str], group_by: list[str] | None = None, where: str | None = None, order_by: list[str] | None = None, grain: str | None = None, limit: int | None = None) -> QueryResult:
        q = semantic.SemanticQuery(metrics, group_by or [], where, order_by or [], grain, limit)
        layer = self._layer()
        layer.screen(q)
        with self.gate.spend(inspect.scan_bytes(layer.compile(q)), "metrics"):
            return layer.query(q, self.config.query.max_rows)

    # maintain

    def snapshot(self) -> tuple[drift.Snapshot, list[str]]:
        p = self.project()
        snap, notes = drift.snapshot(self.source, self.cache(), p.definitions() if p else None)
        self.store.write("snapshot", snap.to_dict())
        self.store.write("drift", {"baseline": snap.taken_at, "axes": {}})
        return snap, notes

    def _baseline(self) -> drift.Snapshot:
        doc = self.store.read("snapshot")
        if doc is None:
            raise LookupError("there is no baseline: snapshot() takes one")
        return drift.Snapshot.from_dict(doc)

    def _report(self, base: drift.Snapshot, fresh: dict[str, list[Finding]]) -> list[Finding]:
        doc = self.store.read("drift") or {}
        stored = {k: [Finding.from_dict(f) for f in v] for k, v in (doc.get("axes") or {}).items()}
        p = self.project()
        new = p.definitions() if p else base.project
        for found in fresh.values():
            drift.annotate_impacts(found, new)
        merged = drift.merge_report(stored, fresh, doc.get("baseline") == base.taken_at)
        self.store.write("drift", {"baseline": base.taken_at, "axes": {k: [f.to_dict() for f in v] for k, v in merged.items()}})
        return drift.rank_findings([f for v in fresh.values() for f in v])

    def _scope(self, base: drift.Snapshot, names: list[str] | None) -> set[str] | None:
        return drift.resolve_scope(names, [*{d.identifier for d in base.cache.datasets} | set(self.source.identifiers())])

    def schema_drift(self, names: list[str] | None = None) -> list[Finding]:
        base, p = self._baseline(), self.project()
        return self._report(base, {"schema": drift.schema_drift(base.cache.datasets, drift.current_state(self.source), self._scope(base, names), base.project, p.definitions() if p else base.project)})

    def volume_drift(self, names: list[str] | None = None) -> list[Finding]:
        base = self._baseline()
        return self._report(base, {"volume": drift.volume_drift(base.cache.datasets, drift.current_state(self.source), self._scope(base, names))})

    def grain_drift(self, names: list[str] | None = None) -> list[Finding]:
        base = self._baseline()
        plan = drift.grain_plan(base.cache, drift.current_state(self.source), self._scope(base, names))
        with self.gate.spend(drift.grain_estimate(self.source, plan), "grain"):
            return self._report(base, {"grain": drift.grain_drift(self.source, plan)})

    def semantic_drift(self) -> list[Finding]:
        base, p = self._baseline(), self.project()
        new, now = p.definitions() if p else base.project, drift.current_state(self.source)
        found = drift.semantic_free_drift(base.project, new, now)
        plan = drift.cardinality_plan(base.cache, new, now)
        with self.gate.spend(self._bytes(list(plan)), "cardinality"):
            found += drift.cardinality_drift(self.source, base.cache, plan)
        return self._report(base, {"semantic": found})

    def check(self, names: list[str] | None = None) -> tuple[list[Finding], list[str]]:
        """All axes; those that need no scan are returned even where the scans are refused."""
        base = self._baseline()
        found = [*self.schema_drift(names), *self.volume_drift(names)]
        notes = drift.staleness(base, self.cache(), dt.datetime.now(dt.UTC), self.config.profile_freshness_hours)
        try:
            found += [*self.grain_drift(names), *self.semantic_drift()]
        except guard.Refused as e:
            notes.append(f"scanning axes were not checked: {e}")
        return drift.rank_findings(found), notes

    def reconcile(self, findings: list[Finding] | None = None) -> list[dict]:
        if findings is None:
            findings, _ = self.check()
        out = drift.reconcile(findings)
        now = {d.identifier: d for d in drift.current_state(self.source)}
        for p in out:
            if p["kind"] == "patch" and p["identifier"] in now:
                p["edits"] = [e.to_dict() for e in edits.scaffold([now[p["identifier"]]])[1:]]
        return out

    # transform

    def init_project(self, root: str, name: str) -> list[str]:
        self.project_root = self.project_root or root
        return edits.init_project(root, name)

    def scaffold(self, names: list[str]) -> list[edits.Edit]:
        ids = self._resolve(names)
        cache = self._profiled(ids)
        return edits.scaffold([cache.dataset(i) for i in ids], cache.relationships)

    def scaffold_unit_test(self, model: str) -> edits.Edit:
        p = self._need_project()
        schemas = {}
        for i in self.source.identifiers():
            schemas[i.rpartition(".")[2]] = {f.name: f.dataType.simpleString() for f in self.source.frame(i).schema.fields}
        return edits.scaffold_unit_test(self.spark, p, model, schemas)

    def plan(self, changes: list[edits.Edit], attribute_rows: bool = False) -> edits.Plan:
        p = self._need_project()

        def resolve(name: str) -> str:
            """As the session names it: registered tables go by their view."""
            relation = p.resolve(name)
            ids = [k for k in self.source.identifiers() if k.lower() == relation.lower() or k.rpartition(".")[2].lower() == relation.lower()]
            return f"`{ids[0].rpartition('.')[2]}`" if len(ids) == 1 else relation

        return edits.plan(self.spark, p, changes, self.store, attribute_rows, resolve)

    def apply(self, plan_id: str) -> list[str]:
        return edits.apply(self._need_project(), plan_id, self.store)

    def plans(self) -> list[str]:
        return self.store.plans()

    def attribute(self, before: str, after: str) -> attribution.Attribution:
        return attribution.attribute(self.spark, before, after)

    def build(self, target: str, select: list[str] | None = None, sources: dict[str, str] | None = None) -> list[runner.Built]:
        p = self._need_project()
        cost = sum(v or 0 for v in runner.estimate(self.spark, p, target, select, sources).values())
        with self.gate.spend(cost, "build"):
            return runner.build(self.spark, p, target, select, sources)

    def semantic_define(self, path: str, content: str) -> edits.Plan:
        return self._semantic_edit(path, content, must_exist=False)

    def semantic_update(self, path: str, content: str) -> edits.Plan:
        return self._semantic_edit(path, content, must_exist=True)

    def _semantic_edit(self, path: str, content: str, must_exist: bool) -> edits.Plan:
        p = self._need_project()
        if (p.root / path).exists() != must_exist:
            raise guard.Refused(f"{path} {'does not exist: define it' if must_exist else 'exists: update it'}")
        return self.plan([edits.Edit(path, "semantic", content)])

    def close(self) -> None:
        self.source.close()
