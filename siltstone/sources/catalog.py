"""The Spark catalog, or a directory of files, as a read-only source of tables and of their aggregates."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import types
from ..functions import stats
from ..functions.stats import quoted
from ..model import ColumnMeta, ColumnStats, ObjectMeta, QueryResult, json_safe
from ..plans.inspect import scan_bytes

BATCH = 50  # columns in one aggregate: bounds the size of generated code
FINE = ("hour", "day", "month")  # units of time, each a part of the next
_VIEWS: dict[str, set[str]] = {}  # session -> temporary views that sources registered, which they may replace


def within(identifier: str, scope: Iterable[str] | None) -> bool:
    """Whether an identifier lies in the allowed namespaces."""
    scope = list(scope or [])
    return not scope or any(identifier.lower() == s.lower() or identifier.lower().startswith(s.lower() + ".") for s in scope)


class SparkCatalog:
    """Tables by identifier.  Opening a directory registers each Parquet or CSV file as ``<namespace>.<stem>``."""

    connector = "spark"

    def __init__(self, spark: SparkSession, data_dir: str | None = None, database: str | None = None, scope: Iterable[str] | None = None, namespace: str = "main", sample_bytes: int | None = None):
        if data_dir is None and database is None:
            raise ValueError("name a data directory or a database: there is no silent default")
        self.spark, self.data_dir, self.database, self.scope, self.namespace = spark, data_dir, database, list(scope or []), namespace
        self.sample_bytes = sample_bytes
        self._frames: dict[str, DataFrame] = {}
        self._bytes: dict[str, int] = {}
        self._rows: dict[str, int] = {}
        self._types: dict[str, str] = {}
        if data_dir is not None:
            self._open_dir(data_dir)
        else:
            self._open_database(database)

    def _open_dir(self, data_dir: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(data_dir)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            raise FileNotFoundError(data_dir)
        for f in sorted(fs.listStatus(path), key=lambda f: f.getPath().getName()):
            name = f.getPath().getName()
            stem, _, kind = name.rpartition(".")
            if kind.lower() not in ("parquet", "csv", "json", "orc") or not stem:
                continue
            read = self.spark.read
            where = f.getPath().toString()
            df = read.csv(where, header=True, inferSchema=True) if kind.lower() == "csv" else getattr(read, kind.lower())(where)
            self.add(stem, df, int(fs.getContentSummary(f.getPath()).getLength()))

    def _open_database(self, database: str) -> None:
        if not self.spark.catalog.databaseExists(database):
            raise LookupError(f"no database {database}")
        for t in self.spark.catalog.listTables(database):
            ident = f"{database}.{t.name}"
            self._types[ident] = "view" if (t.tableType or "").upper() in ("VIEW", "TEMPORARY") else "table"
            self._frames[ident] = self.spark.table(f"`{database}`.`{t.name}`" if not t.isTemporary else f"`{t.name}`")

    def add(self, name: str, df: DataFrame, byte_size: int | None = None, object_type: str = "table", view: bool = True) -> str:
        """Register a DataFrame; also as a temporary view, so that SQL can name it.  Views of others are never replaced."""
        if view:
            own = self._own_views()
            if name.lower() not in own and any(t.isTemporary and t.name.lower() == name.lower() for t in self.spark.catalog.listTables()):
                raise ValueError(f"the session has a temporary view {name} of its own: drop or rename it")
            df.createOrReplaceTempView(name)
            own.add(name.lower())
        ident = f"{self.namespace}.{name}"
        self._frames[ident] = df
        self._types[ident] = object_type
        if byte_size is not None:
            self._bytes[ident] = byte_size
        self._rows.pop(ident, None)
        return ident

    def _own_views(self) -> set[str]:
        return _VIEWS.setdefault(str(self.spark._jsparkSession.sessionUUID()), set())

    def bytes_of(self, identifier: str) -> int:
        """The files' size where it is known, else what the plan's leaves may read."""
        size = self._bytes.get(identifier)
        return scan_bytes(self.frame(identifier)) if size is None else size

    # inventory

    def capabilities(self) -> dict:
        return {"connector": self.connector, "dialect": "spark", "read_only": True, "paradigm": "free_local", "version": self.spark.version, "scope": self.scope}

    def identifiers(self) -> list[str]:
        return sorted(i for i in self._frames if within(i, self.scope))

    def frame(self, identifier: str) -> DataFrame:
        if identifier not in self._frames or not within(identifier, self.scope):
            raise LookupError(f"no table {identifier} in scope")
        return self._frames[identifier]

    def list_objects(self, include_views: bool = True) -> list[ObjectMeta]:
        """Names, sizes and widths without a scan; counts only where already known."""
        out = []
        for i in self.identifiers():
            kind = self._types.get(i, "table")
            if kind == "view" and not include_views:
                continue
            schema, _, name = i.rpartition(".")
            out.append(ObjectMeta(i, kind, schema, name, self._rows.get(i), self._bytes.get(i), len(self._frames[i].columns)))
        return out

    def list_namespace_objects(self, schema: str) -> list[str]:
        return [i.rpartition(".")[2] for i in self.identifiers() if i.rpartition(".")[0].lower() == schema.lower()]

    def row_count(self, identifier: str) -> int:
        """Exact; Parquet answers from footers."""
        if identifier not in self._rows:
            self._rows[identifier] = self.frame(identifier).count()
        return self._rows[identifier]

    def table_metadata(self, identifier: str) -> tuple[int, list[ColumnMeta]]:
        fields = self.frame(identifier).schema.fields
        return self.row_count(identifier), [ColumnMeta(f.name, f.dataType.simpleString(), f.nullable, k) for k, f in enumerate(fields)]

    # aggregates

    def scan(self, identifier: str) -> tuple[DataFrame, bool]:
        """The table, or a sample of it beyond the byte threshold; and whether it is a sample."""
        df = self.frame(identifier)
        if self.sample_bytes is None or (size := self.bytes_of(identifier)) <= self.sample_bytes:
            return df, False
        percent = max(round(100 * self.sample_bytes / size, 2), 0.01)
        return df.sample(percent / 100, seed=0), True

    def column_aggregates(self, identifier: str, columns: list[ColumnMeta], *, min_max: set[str] = frozenset(), shape: set[str] = frozenset(), contradiction: set[str] = frozenset(), key_shape: set[str] = frozenset(), temporal: set[str] = frozenset()) -> tuple[int, dict[str, ColumnStats]]:
        """One pass for each 50 columns; every statistic of a batch comes from one aggregate row."""
        df, sampled = self.scan(identifier)
        n_rows, out = 0, {}
        for at in range(0, max(len(columns), 1), BATCH):
            part = columns[at : at + BATCH]
            exprs = [F.count(F.lit(1)).alias("n_total")]
            for i, c in enumerate(part):
                v = quoted(c.name)
                group = {"nn": F.count(v)}
                nested = types.is_nested(c.data_type)
                if not nested:
                    group["nd"] = F.approx_count_distinct(v)
                if c.name in min_max:
                    group |= {"min_value": F.min(v), "max_value": F.max(v)}
                if c.name in shape:
                    group |= stats.shape_group(v)
                if c.name in contradiction:
                    group |= stats.type_group(v, types.is_string(c.data_type))
                if c.name in key_shape:
                    group |= stats.key_group(v)
                if c.name in temporal:
                    group |= stats.alignment_group(v)
                exprs += [e.alias(f"{k}__{i}") for k, e in group.items()]
            row = df.agg(*exprs).first().asDict()
            n_rows = row["n_total"]
            for i, c in enumerate(part):
                got = {k.rpartition("__")[0]: v for k, v in row.items() if k.endswith(f"__{i}")}
                nn, nd = got.pop("nn"), got.pop("nd", None)
                s = ColumnStats(c.name, non_null=nn, null_fraction=1 - nn / n_rows if n_rows else None, distinct_count=nd if n_rows else None)
                if n_rows and nd is not None and not sampled:
                    s.is_unique = nd == nn == n_rows
                for k, v in got.items():
                    setattr(s, k, v)
                out[c.name] = s
        for c in columns:
            if c.name in temporal and n_rows:
                out[c.name].periods = self.periods(df, c)
        return n_rows, out

    def periods(self, df: DataFrame, column: ColumnMeta) -> dict[str, tuple[int, int]]:
        """unit -> (distinct periods, most periods missing between two neighbours), in one pass: coarser units are made from the finest."""
        units = [u for u in FINE if u in types.units_of(column.data_type)]
        if not units:
            return {}
        finest = df.select(F.date_trunc(units[0], quoted(column.name)).cast("timestamp_ntz").alias("p")).where("p is not null").distinct()
        each = [period_gaps(finest, "p", u).select(F.lit(u).alias("unit"), "distinct_periods", "largest_gap") for u in units]
        return {r.unit: (r.distinct_periods, r.largest_gap) for r in reduce(DataFrame.unionByName, each).collect()}

    def exact_distinct_counts(self, identifier: str, columns: list[str]) -> dict[str, int]:
        """One statement that reads each column once; several distincts in one aggregate would multiply its rows."""
        df = self.frame(identifier)
        one = [df.select(quoted(c).alias("v")).where("v is not null").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("c"), "n") for c in columns]
        return {r.c: r.n for r in reduce(DataFrame.unionByName, one).collect()} if one else {}

    def distinct_combination_counts(self, identifier: str, combinations: list[list[str]]) -> dict[tuple[str, ...], int]:
        """Nulls count as values, so rows with nulls are combinations as well.  One statement for all combinations."""
        df = self.frame(identifier)
        one = [df.select(*[quoted(x) for x in c]).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n") for i, c in enumerate(combinations)]
        return {tuple(combinations[r.i]): r.n for r in reduce(DataFrame.unionByName, one).collect()} if one else {}

    def value_domain_counts(self, identifier: str, columns: list[str], limit: int = 25) -> dict[str, tuple[list[tuple], int]]:
        """Most frequent values and the exact number of distinct values, all columns in one statement."""
        df = self.frame(identifier)
        kinds = dict(df.dtypes)
        tall = reduce(DataFrame.unionByName, [value_counts(df, c) for c in columns])
        order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
        size = F.count(F.lit(1)).over(Window.partitionBy("column_name"))
        rows = tall.withColumn("total", size).withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).orderBy("column_name", "r").collect()
        out: dict[str, tuple[list[tuple], int]] = {c: ([], 0) for c in columns}
        for r in rows:
            values, _ = out[r.column_name]
            values.append((_typed(r.value, kinds[r.column_name]), r.n))
            out[r.column_name] = (values, r.total)
        return out

    # caller SQL

    def run_query(self, sql: str, max_rows: int = 50, timeout_seconds: float | None = 30) -> QueryResult:
        """Run one guarded SELECT, at most max_rows rows, cancelled after the timeout."""
        from ..plans.guard import assert_select_only

        assert_select_only(self.spark, sql)
        tag = f"siltstone-{uuid.uuid4().hex}"
        self.spark.addTag(tag)
        timer = threading.Timer(timeout_seconds, lambda: self.spark.interruptTag(tag)) if timeout_seconds else None
        try:
            if timer:
                timer.start()
            df = self.spark.sql(sql)
            rows = df.limit(max_rows + 1).collect()
        finally:
            if timer:
                timer.cancel()
            self.spark.removeTag(tag)
        return QueryResult([c for c, _ in df.dtypes], [t for _, t in df.dtypes], [[json_safe(v) for v in r] for r in rows[:max_rows]], len(rows) > max_rows)

    def close(self) -> None:
        own = self._own_views()
        for i in self._frames:
            name = i.rpartition(".")[2]
            if self.data_dir is not None and name.lower() in own:
                self.spark.catalog.dropTempView(name)
                own.discard(name.lower())
        self._frames.clear()


def _typed(text: str | None, kind: str):
    if text is None:
        return None
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return int(text)
    if kind in ("float", "double") or kind.startswith("decimal"):
        return float(text)
    return text == "true" if kind == "boolean" else text


def value_counts(df: DataFrame, column: str) -> DataFrame:
    v = quoted(column)
    return df.where(v.isNotNull()).groupBy(v.cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(column).alias("column_name"), "value", "n")


def period_gaps(df: DataFrame, column: str, unit: str) -> DataFrame:
    """distinct_periods, largest_gap.  The window has no partition, but a row for each period only."""
    p = df.select(F.date_trunc(unit, quoted(column)).cast("timestamp_ntz").alias("period")).where("period is not null").distinct()
    step = stats.between(unit, F.lag("period").over(Window.orderBy("period")), F.col("period"))
    return p.withColumn("gap", step - 1).agg(F.count(F.lit(1)).alias("distinct_periods"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("largest_gap"))
