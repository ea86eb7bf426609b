"""Semantic-layer metrics compiled to DataFrames.

Models name a relation, entities, dimensions and measures; metrics build on measures or on other metrics:
simple, ratio, derived, cumulative and conversion.  Measures are aggregated at the grain asked for before
metrics meet, so that joins between metrics hold one row for each group; dimension tables are joined on an
entity that is primary or unique there, so that no join can multiply facts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import Cache, QueryResult
from ..operators import pii
from .firewall import shape
from .guard import Refused

GRAINS = ("day", "week", "month", "quarter", "year")
_REF = re.compile(r"\{\{\s*(Dimension|TimeDimension|Entity)\(\s*['\"]([\w.]+)['\"]\s*(?:,\s*['\"](\w+)['\"]\s*)?\)\s*\}\}")


@dataclass
class Measure:
    name: str
    agg: str = "sum"
    expr: str | None = None
    time_dimension: str | None = None
    percentile: float | None = None


@dataclass
class Dimension:
    name: str
    type: str = "categorical"  # or time
    expr: str | None = None


@dataclass
class Entity:
    name: str
    type: str = "foreign"  # primary, unique, foreign, natural
    expr: str | None = None


@dataclass
class Model:
    name: str
    relation: str
    entities: list[Entity] = field(default_factory=list)
    dimensions: list[Dimension] = field(default_factory=list)
    measures: list[Measure] = field(default_factory=list)
    default_time: str | None = None

    @property
    def primary(self) -> Entity | None:
        return next((e for e in self.entities if e.type in ("primary", "unique")), None)


@dataclass
class Metric:
    name: str
    type: str = "simple"
    measure: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    expr: str | None = None
    metrics: list[str] = field(default_factory=list)
    window: str | None = None  # "7 days"
    grain_to_date: str | None = None
    base_measure: str | None = None
    conversion_measure: str | None = None
    entity: str | None = None
    filter: str | None = None


@dataclass
class SemanticQuery:
    metrics: list[str]
    group_by: list[str] = field(default_factory=list)
    where: str | None = None
    order_by: list[str] = field(default_factory=list)
    grain: str | None = None
    limit: int | None = None


def physical(expr: str | None, name: str) -> str | None:
    """The column a field stands for; None where it is computed."""
    if expr is None:
        return name
    return expr if re.fullmatch(r"[A-Za-z_]\w*", expr.strip()) else None


class SemanticLayer:
    def __init__(self, models: list[Model], metrics: list[Metric], frame: Callable[[str], DataFrame], cache: Cache | None = None):
        self.models, self.metrics = {m.name: m for m in models}, {m.name: m for m in metrics}
        self.frame, self.cache = frame, cache
        self.measures = {x.name: (m, x) for m in models for x in m.measures}

    # definitions

    def model_of(self, metric: str) -> list[Model]:
        m = self._metric(metric)
        names = [m.measure, m.base_measure, m.conversion_measure]
        own = [self.measures[n][0] for n in names if n and n in self.measures]
        below = [x for x in (m.numerator, m.denominator, *m.metrics) if x]
        return list({x.name: x for x in [*own, *(y for b in below for y in self.model_of(b))]}.values())

    def reachable(self, model: Model) -> dict[str, tuple[Model, Dimension]]:
        """entity__dimension tokens of the model itself and of models its entities lead to."""
        out = {}
        if model.primary:
            out |= {f"{model.primary.name}__{d.name}": (model, d) for d in model.dimensions}
        for e in model.entities:
            for other in self.models.values():
                if other is not model and any(x.name == e.name and x.type in ("primary", "unique") for x in other.entities):
                    out |= {f"{e.name}__{d.name}": (other, d) for d in other.dimensions if f"{e.name}__{d.name}" not in out}
        return out

    def list_definitions(self) -> dict:
        out = {}
        for name, m in sorted(self.metrics.items()):
            sets = [set(self.reachable(x)) for x in self.model_of(name)]
            out[name] = {"type": m.type, "dimensions": sorted(set.intersection(*sets) if sets else set()) + ["metric_time"]}
        return {"metrics": out, "semantic_models": sorted(self.models)}

    def _metric(self, name: str) -> Metric:
        if name not in self.metrics:
            raise Refused(f"unknown metric {name}; known: {', '.join(sorted(self.metrics))}")
        return self.metrics[name]

    # compilation

    def screen(self, q: SemanticQuery) -> list[str]:
        """Refuse to group by personal data: the profile decides where it speaks, else the name does."""
        notes = []
        for metric in q.metrics:
            for model in self.model_of(metric):
                for token in q.group_by:
                    name, _ = self.split(token)
                    hit = self.reachable(model).get(name)
                    if hit is None:
                        continue
                    owner, d = hit
                    column = physical(d.expr, d.name)
                    known = None
                    if self.cache and column:
                        ds = next((x for x in self.cache.datasets if x.identifier == owner.relation or x.name == owner.relation), None)
                        known = ds.column(column) if ds else None
                    flag = known.pii if known else pii.detect(d.name, "string")
                    if flag and flag.confidence >= pii.BLOCK_AT:
                        raise Refused(f"{token} would show personal data ({flag.category} {flag.confidence:.2f})")
                    if flag:
                        notes.append(f"{token} is weakly flagged as {flag.category}")
        return list(dict.fromkeys(notes))

    def split(self, token: str) -> tuple[str, str | None]:
        head, _, tail = token.rpartition("__")
        return (head, tail) if head and tail in GRAINS else (token, None)

    def base(self, model: Model, tokens: list[str], where: str | None, time_dim: str | None, grain: str | None, own_filter: str | None = None) -> DataFrame:
        """Facts with a column g<i> for each token, filtered."""
        df = self.frame(model.relation)
        refs = [(k, n, g) for text in (where, own_filter) if text for k, n, g in _REF.findall(text)]
        wanted = {t: self.split(t) for t in tokens} | {n: self.split(n) for _, n, _ in refs}
        joins: dict[str, Model] = {}
        exprs: dict[str, Column] = {}
        reach = self.reachable(model)
        for token, (name, own_grain) in wanted.items():
            if name == "metric_time":
                if time_dim is None:
                    raise Refused(f"{model.name} has no time dimension for metric_time")
                exprs[token] = F.date_trunc(own_grain or grain or "day", F.expr(time_dim))
                continue
            hit = reach.get(name)
            if hit is None:
                mine = next((e for e in model.entities if e.name == name), None)
                if mine is None:
                    raise Refused(f"{token} can't be reached from {model.name}")
                exprs[token] = F.expr(mine.expr or mine.name)
                continue
            owner, d = hit
            raw = d.expr or d.name
            if owner is model:
                c = F.expr(raw)
            else:
                entity = name.split("__", 1)[0]
                joins[entity] = owner
                c = F.col(f"`{entity}::{d.name}`")
            exprs[token] = F.date_trunc(own_grain or grain or "day", c) if d.type == "time" and (own_grain or grain) else c
        for entity, owner in joins.items():
            key = next(e for e in owner.entities if e.name == entity and e.type in ("primary", "unique"))
            mine = next(e for e in model.entities if e.name == entity)
            cols = [F.expr(d.expr or d.name).alias(f"{entity}::{d.name}") for d in owner.dimensions]
            right = self.frame(owner.relation).select(F.expr(key.expr or key.name).alias(f"{entity}::key"), *cols)
            df = df.withColumn(f"{entity}::fk", F.expr(mine.expr or mine.name)).join(right, F.col(f"`{entity}::fk`") == F.col(f"`{entity}::key`"), "left")
        slots = {t: f"g::{i}" for i, t in enumerate(wanted)}
        df = df.withColumns({slots[t]: c for t, c in exprs.items()})
        for text in (where, own_filter):
            if text:
                df = df.where(F.expr(_REF.sub(lambda m: f"`{slots[m[2]]}`", text)))
        return df.withColumns({f"g{i}": F.col(f"`{slots[t]}`") for i, t in enumerate(tokens)})

    def aggregate(self, model: Model, x: Measure) -> Column:
        c = F.expr(x.expr or x.name) if (x.expr or x.name) != "*" else F.lit(1)
        kinds = {
            "sum": F.sum, "min": F.min, "max": F.max, "average": F.avg, "avg": F.avg, "median": F.median, "count": F.count,
            "count_distinct": F.count_distinct, "sum_boolean": lambda v: F.sum(v.cast("int")), "percentile": lambda v: F.percentile(v, x.percentile or 0.5),
        }
        if x.agg not in kinds:
            raise Refused(f"measure {x.name} has unknown aggregation {x.agg}")
        return kinds[x.agg](c)

    def time_of(self, model: Model, x: Measure) -> str | None:
        name = x.time_dimension or model.default_time or next((d.name for d in model.dimensions if d.type == "time"), None)
        d = next((d for d in model.dimensions if d.name == name), None)
        return (d.expr or d.name) if d else None

    def compile_metric(self, name: str, q: SemanticQuery) -> DataFrame:
        """g0..gn and the metric's value, one row a group."""
        m = self._metric(name)
        keys = [f"g{i}" for i in range(len(q.group_by))]
        if m.type == "simple":
            model, x = self._measure(m.measure)
            return self.base(model, q.group_by, q.where, self.time_of(model, x), q.grain, m.filter).groupBy(*keys).agg(self.aggregate(model, x).alias(name))
        if m.type == "ratio":
            both = self.meet([self.compile_metric(m.numerator, q).withColumnRenamed(m.numerator, "n::"), self.compile_metric(m.denominator, q).withColumnRenamed(m.denominator, "d::")], keys)
            return both.select(*keys, F.try_divide(F.col("`n::`").cast("double"), F.col("`d::`").cast("double")).alias(name))
        if m.type == "derived":
            both = self.meet([self.compile_metric(x, q) for x in m.metrics], keys)
            return both.select(*keys, F.expr(m.expr).alias(name))
        if m.type == "cumulative":
            return self.cumulative(m, q, keys)
        if m.type == "conversion":
            return self.conversion(m, q, keys)
        raise Refused(f"metric {name} has unknown type {m.type}")

    def _measure(self, name: str | None) -> tuple[Model, Measure]:
        if name not in self.measures:
            raise Refused(f"unknown measure {name}")
        return self.measures[name]

    def meet(self, parts: list[DataFrame], keys: list[str]) -> DataFrame:
        """Full join on the group keys, null keys included; each side has one row a group."""

        def pair(a: DataFrame, b: DataFrame) -> DataFrame:
            if not keys:
                return a.crossJoin(b)
            b = b.withColumnsRenamed({k: f"r{k}" for k in keys})
            on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys])
            there = a.withColumn("a::", F.lit(True))
            both = there.join(b, on, "full")
            return both.withColumns({k: F.when(F.col("`a::`"), F.col(k)).otherwise(F.col(f"r{k}")) for k in keys}).drop("a::", *[f"r{k}" for k in keys])

        return reduce(pair, parts)

    def cumulative(self, m: Metric, q: SemanticQuery, keys: list[str]) -> DataFrame:
        """Running total over metric_time: unbounded, over a trailing window, or since the start of a period."""
        model, x = self._measure(m.measure)
        if x.agg not in ("sum", "count", "sum_boolean"):
            raise Refused("a running total needs a measure that adds up")
        at = next((i for i, t in enumerate(q.group_by) if self.split(t)[0] == "metric_time"), None)
        if at is None:
            return self.base(model, q.group_by, q.where, self.time_of(model, x), q.grain, m.filter).groupBy(*keys).agg(self.aggregate(model, x).alias(m.name))
        part = self.base(model, q.group_by, q.where, self.time_of(model, x), q.grain, m.filter).groupBy(*keys).agg(self.aggregate(model, x).alias("v::"))
        others = [F.col(k) for i, k in enumerate(keys) if i != at]
        time = F.col(keys[at])
        if m.grain_to_date:
            over = Window.partitionBy(*others, F.date_trunc(m.grain_to_date, time)).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        elif m.window:
            n, unit = m.window.split()
            unit = unit.lower().rstrip("s")
            if unit in ("month", "quarter", "year"):
                return self.months_back(m, part, keys, at, int(n) * {"month": 1, "quarter": 3, "year": 12}[unit])
            seconds = int(n) * {"hour": 3600, "day": 86400, "week": 7 * 86400}.get(unit, 0)
            if not seconds:
                raise Refused("a trailing window is given in hours, days, weeks, months, quarters or years")
            # seconds of the wall clock as range order: a trailing window needs no self-join, and a day that is 23 hours long is a day
            clock = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), time.cast("timestamp_ntz"))
            over = Window.partitionBy(*others).orderBy(clock).rangeBetween(-(seconds - 1), 0)
        else:
            over = Window.partitionBy(*others).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
        return part.select(*keys, F.sum(F.col("`v::`")).over(over).alias(m.name))

    def months_back(self, m: Metric, part: DataFrame, keys: list[str], at: int, months: int) -> DataFrame:
        """Total over (t - months, t]: a join of the periods, of which there is a row each, as months differ in length."""
        old = part.withColumnsRenamed({k: f"r{k}" for k in keys} | {"v::": "w::"})
        t, s = F.col(keys[at]).cast("timestamp_ntz"), F.col(f"r{keys[at]}").cast("timestamp_ntz")
        on = (s <= t) & (s > t - F.make_ym_interval(F.lit(0), F.lit(months)))
        for i, k in enumerate(keys):
            if i != at:
                on = on & F.col(k).eqNullSafe(F.col(f"r{k}"))
        return part.join(old, on).groupBy(*keys).agg(F.sum(F.col("`w::`")).alias(m.name))

    def conversion(self, m: Metric, q: SemanticQuery, keys: list[str]) -> DataFrame:
        """Share of base events that the same entity follows by a conversion event within the window."""
        base_model, base = self._measure(m.base_measure)
        conv_model, conv = self._measure(m.conversion_measure)
        ent = lambda model: next((e.expr or e.name for e in model.entities if e.name == m.entity), None)
        if ent(base_model) is None or ent(conv_model) is None:
            raise Refused(f"conversion metric {m.name} needs entity {m.entity} in both models")
        tb, tc = self.time_of(base_model, base), self.time_of(conv_model, conv)
        left = self.base(base_model, q.group_by, q.where, tb, q.grain, m.filter).where(F.expr(base.expr or "true").cast("boolean") if base.agg == "sum_boolean" else F.lit(True))
        left = left.select(*keys, F.expr(ent(base_model)).alias("e::"), F.expr(tb).alias("t::"))
        right = self.frame(conv_model.relation).where(F.expr(conv.expr).cast("boolean") if conv.agg == "sum_boolean" else F.lit(True)).select(F.expr(ent(conv_model)).alias("e::"), F.expr(tc).alias("t::"))
        # the next conversion of the entity, from one sorted pass instead of a range join; where the window has a fixed length, an
        # entity is cut into stretches of that length, a conversion counting in its own and in the one before, so that none is one task
        stretch = F.lit(0).cast("long")
        n, _, unit = (m.window or "").partition(" ")
        size = int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 7 * 86400}.get(unit.lower().rstrip("s"), 0) if m.window else 0
        if size:
            stretch = F.floor(F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("`t::`").cast("timestamp_ntz")) / size)
            # clocks that change move a stretch by up to an hour
            slack = math.ceil(3600 / size) if isinstance(right.schema["t::"].dataType, T.TimestampType) or isinstance(left.schema["t::"].dataType, T.TimestampType) else 0
            right = right.withColumn("s::", F.explode(F.sequence(stretch - F.lit(1 + slack), stretch + F.lit(slack))))
        else:
            right = right.withColumn("s::", stretch)
        left = left.withColumn("s::", stretch)
        union = left.withColumn("base::", F.lit(True)).unionByName(right.withColumn("base::", F.lit(False)), allowMissingColumns=True)
        ahead = Window.partitionBy("e::", "s::").orderBy(F.col("`t::`"), F.col("`base::`").desc()).rowsBetween(0, Window.unboundedFollowing)
        nxt = F.min(F.when(~F.col("`base::`"), F.col("`t::`"))).over(ahead)
        rows = union.withColumn("next::", nxt).where(F.col("`base::`"))
        done = F.col("`next::`").isNotNull()
        if m.window:
            n, unit = m.window.split()
            done = done & (F.col("`next::`") <= F.expr(f"`t::` + interval {int(n)} {unit.rstrip('s')}"))
        return rows.groupBy(*keys).agg(F.avg(F.when(done, 1.0).otherwise(0.0)).alias(m.name))

    def compile(self, q: SemanticQuery) -> DataFrame:
        if not q.metrics:
            raise Refused("name at least one metric")
        if q.grain and q.grain not in GRAINS:
            raise Refused(f"unknown grain {q.grain}")
        keys = [f"g{i}" for i in range(len(q.group_by))]
        df = self.meet([self.compile_metric(m, q) for m in q.metrics], keys)
        df = df.select(*[F.col(k).alias(t) for k, t in zip(keys, q.group_by, strict=True)], *[F.col(m) for m in q.metrics])
        if q.order_by:
            df = df.orderBy(*[F.desc(F.col(t[1:])) if t.startswith("-") else F.asc(F.col(t)) for t in q.order_by])
        return df.limit(q.limit) if q.limit is not None else df

    def query(self, q: SemanticQuery, max_rows: int = 50) -> QueryResult:
        notes = self.screen(q)
        df = self.compile(q)
        rows = df.limit(max_rows + 1).collect()
        return shape(QueryResult(df.columns, [t for _, t in df.dtypes], [list(r) for r in rows[:max_rows]], len(rows) > max_rows, notes))


def from_yaml(doc: dict) -> tuple[list[Model], list[Metric]]:
    """Models and metrics of parsed semantic YAML."""
    models = []
    for m in doc.get("semantic_models") or []:
        rel = re.sub(r"^ref\(['\"](.+)['\"]\)$", r"\1", str(m.get("model", m["name"])))
        make = lambda kind, rows: [kind(**{k: v for k, v in r.items() if k in kind.__dataclass_fields__}) for r in rows or []]
        measures = [Measure(x["name"], x.get("agg", "sum"), str(x["expr"]) if x.get("expr") is not None else None, x.get("agg_time_dimension"), (x.get("agg_params") or {}).get("percentile")) for x in m.get("measures") or []]
        models.append(Model(m["name"], rel, make(Entity, m.get("entities")), make(Dimension, m.get("dimensions")), measures, (m.get("defaults") or {}).get("agg_time_dimension")))
    metrics = []
    name_of = lambda v: v.get("name") if isinstance(v, dict) else v
    for m in doc.get("metrics") or []:
        p = m.get("type_params") or {}
        conv, cum = p.get("conversion_type_params") or {}, p.get("cumulative_type_params") or {}
        metrics.append(
            Metric(
                m["name"], m.get("type", "simple"), name_of(p.get("measure")), name_of(p.get("numerator")), name_of(p.get("denominator")), p.get("expr"), [name_of(x) for x in p.get("metrics") or []],
                p.get("window") or conv.get("window") or cum.get("window"), p.get("grain_to_date") or cum.get("grain_to_date"), name_of(conv.get("base_measure")), name_of(conv.get("conversion_measure")), conv.get("entity"), m.get("filter"),
            )
        )
    return models, metrics
