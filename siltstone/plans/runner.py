"""Builds a project's models in a development database and runs its tests as counts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import quoted
from ..model import Record
from ..sources.project import TransformProject
from . import attribution, inspect
from .guard import Refused, assert_select_only

PRODUCTION = re.compile(r"(?i)(?:^|_)(?:prod|production|prd|live|release|main)(?:_|$)")


@dataclass
class Built(Record):
    model: str
    relation: str
    materialized: str
    status: str = "ok"
    message: str = ""
    failures: dict[str, int] = field(default_factory=dict)


def assert_dev(target: str) -> str:
    if PRODUCTION.search(target):
        raise Refused(f"{target} names a production target: build into a development database")
    if not re.fullmatch(r"\w+", target):
        raise Refused(f"{target} is not a database name")
    return target


def schema_name(target: str, layer: str | None = None) -> str:
    """The database of a layer in a target: ``<target>`` or ``<target>_<layer>``."""
    return assert_dev(target) if not layer else f"{assert_dev(target)}_{layer}"


def selected(project: TransformProject, select: list[str] | None) -> list[str]:
    """Models by name; ``+m`` with what it reads, ``m+`` with what reads it."""
    order = project.order()
    if not select:
        return order
    up = {m: set(project.models[m].refs) & set(order) for m in order}
    want: set[str] = set()
    for s in select:
        name = s.strip("+")
        if name not in up:
            raise LookupError(f"model {name} does not exist")
        want.add(name)
        if s.startswith("+"):
            todo = [name]
            while todo:
                new = up[todo.pop()] - want
                want |= new
                todo += new
        if s.endswith("+"):
            for m in order:
                if up[m] & want:
                    want.add(m)
    return [m for m in order if m in want]


def compiled(project: TransformProject, target: str, model: str, built: set[str], sources: dict[str, str] | None = None) -> str:
    """The model's SQL; models of the target by their database, sources through the given names."""

    def resolve(name: str) -> str:
        if "." in name:
            rel = project.resolve(name)
            return (sources or {}).get(name, rel)
        if name not in project.models:
            raise LookupError(f"{model} reads {name}, which is no model")
        return f"`{schema_name(target, project.models[name].layer)}`.`{name}`"

    return attribution.render(project.models[model].sql, resolve)


def estimate(spark: SparkSession, project: TransformProject, target: str, select: list[str] | None = None, sources: dict[str, str] | None = None) -> dict[str, int | None]:
    """Bytes that each model may scan; None where what it reads isn't built yet."""
    out: dict[str, int | None] = {}
    for m in selected(project, select):
        try:
            sql = compiled(project, target, m, set(out), sources)
            assert_select_only(spark, sql)
            out[m] = inspect.scan_bytes(spark.sql(sql))
        except Refused:
            raise
        except Exception:  # a relation that doesn't exist yet has no size
            out[m] = None
    return out


def build(spark: SparkSession, project: TransformProject, target: str, select: list[str] | None = None, sources: dict[str, str] | None = None, test: bool = True) -> list[Built]:
    """Each model after those it reads; what reads a failed one is skipped."""
    for database in sorted({schema_name(target)} | {schema_name(target, m.layer) for m in project.models.values()}):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    out: dict[str, Built] = {}
    for name in selected(project, select):
        m = project.models[name]
        database = schema_name(target, m.layer)
        r = out[name] = Built(name, f"{database}.{name}", m.materialized)
        lost = [x for x in m.refs if x in out and out[x].status != "ok"]
        if lost:
            r.status, r.message = "skipped", f"{lost[0]} was not built"
            continue
        try:
            sql = compiled(project, target, name, set(out), sources)
            assert_select_only(spark, sql)
            if m.materialized in ("table", "incremental"):
                spark.sql(sql).write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
            else:
                spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS {sql}")
        except Exception as e:
            r.status, r.message = "error", str(e).strip().splitlines()[0]
            continue
    for name, r in out.items() if test else ():  # once all are built, for a test may read two models
        tests = [t for t in project.tests if t["model"] == name and r.status == "ok"]
        try:
            for label, n in failures(spark, project, target, tests).items():
                if n:
                    r.failures[label] = n
                    r.status = "failed tests"
        except AnalysisException as e:
            r.status, r.message = "error", str(e).strip().splitlines()[0]
    return list(out.values())


def failures(spark: SparkSession, project: TransformProject, target: str, tests: list[dict]) -> dict[str, int]:
    """Failures of the tests of one model: those of single rows come from one pass over it, the others from a job each."""
    out: dict[str, int] = {}
    by_row = [t for t in tests if t["test"] in ("not_null", "accepted_values")]
    label = lambda t: f"{t['test']}:{t['column'] or ''}"
    if by_row:
        m = project.models[by_row[0]["model"]]
        df = spark.table(f"`{schema_name(target, m.layer)}`.`{m.name}`")

        def broken(t: dict) -> Column:
            c = quoted(t["column"])
            return c.isNull() if t["test"] == "not_null" else c.isNotNull() & ~c.cast("string").isin([str(v) for v in t["args"].get("values", [])])

        row = df.agg(*[F.count(F.when(broken(t), 1)).alias(f"f{i}") for i, t in enumerate(by_row)]).first()
        out = {label(t): row[i] for i, t in enumerate(by_row)}
    return out | {label(t): failing(spark, project, target, t) for t in tests if t not in by_row}


def failing(spark: SparkSession, project: TransformProject, target: str, t: dict) -> int:
    """How many rows (or values) break a schema test."""
    place = lambda model: f"`{schema_name(target, project.models[model].layer)}`.`{model}`"
    df = spark.table(place(t["model"]))
    c = quoted(t["column"]) if t["column"] else None
    kind, args = t["test"], t["args"]
    if kind == "unique":
        return df.where(c.isNotNull()).groupBy(c).count().where("count > 1").count()
    if kind == "unique_combination_of_columns":
        return df.groupBy(*[quoted(x) for x in args.get("combination_of_columns", [])]).count().where("count > 1").count()
    if kind == "relationships":
        hit = re.search(r"ref\(\s*['\"](\w+)['\"]", str(args.get("to", "")))
        parent = spark.table(place(hit[1]) if hit else str(args.get("to")))
        keys = parent.select(quoted(args["field"]).alias("k")).distinct()
        return df.where(c.isNotNull()).join(keys, c == F.col("k"), "left_anti").count()
    raise Refused(f"unknown test {kind}")


def assertions(df: DataFrame, not_null: list[str] = (), unique: list[str] = ()) -> DataFrame:
    """test, column, failures of a DataFrame: not_null tests in one pass."""
    parts = []
    if not_null:
        agg = df.agg(*[F.count(F.when(quoted(c).isNull(), 1)).alias(f"f{i}") for i, c in enumerate(not_null)])
        parts.append(agg.select(F.inline(F.array(*[F.struct(F.lit("not_null").alias("test"), F.lit(c).alias("column_name"), F.col(f"f{i}").alias("failures")) for i, c in enumerate(not_null)]))))
    for c in unique:
        twice = df.where(quoted(c).isNotNull()).groupBy(quoted(c)).count().where("count > 1")
        parts.append(twice.agg(F.count(F.lit(1)).alias("failures")).select(F.lit("unique").alias("test"), F.lit(c).alias("column_name"), "failures"))
    if not parts:
        raise ValueError("no test was asked for")
    return reduce(DataFrame.unionByName, parts)
