"""A query for each operator of the engine, and the SQL it is checked with."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import envelope, types
from .functions import stats
from .functions.stats import quoted
from .model import Cache, ColumnMeta, Dataset
from .operators import cluster as clusters
from .operators import cumulative, diagram, drift, pii, profile, rank, relationships
from .operators.unpivot import unpivot_json_object
from .plans import attribution, costs, edits, firewall, guard, inspect, runner, semantic
from .sources.catalog import SparkCatalog, period_gaps
from .sources.store import MemoryStore

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "embeddings", "pages", "benchmark", "conversations")
COLUMNS = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"},
    "part": {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"},
    "orders": {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"},
    "events": {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"},
    "documents": {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "conversations": {"conv_id": "bigint", "turn": "bigint", "role": "string", "text": "string"},
}
EDGES = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id")]


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        ALL[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> SparkCatalog:
    """The tables by name.  Only those asked for are opened."""
    out = SparkCatalog(spark, database="default")
    out._frames.clear()
    for n in names:
        out.add(n, table(spark, sf_dir, n))
    return out


def rows(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    return spark.createDataFrame(data, schema)


# profiles

def metas(df: DataFrame) -> list[ColumnMeta]:
    return [ColumnMeta(f.name, f.dataType.simpleString(), f.nullable, k) for k, f in enumerate(df.schema.fields)]


for _t, _cols in COLUMNS.items():
    _flat = [c for c, k in _cols.items() if not types.is_nested(k)]  # of nested columns only nulls are counted
    _num = [c for c, k in _cols.items() if types.is_numeric(k)]

    def _nulls(spark: SparkSession, sf_dir: str, t: str = _t) -> DataFrame:
        src = source(spark, sf_dir, (t,))
        n, got = src.column_aggregates(f"main.{t}", metas(src.frame(f"main.{t}")))
        return rows(spark, "column_name string, n_rows long, non_null long, null_fraction double", [(c, n, x.non_null, x.null_fraction) for c, x in got.items()])

    ALL[f"profile_null_fraction_{_t}"] = _nulls
    ORACLES[f"profile_null_fraction_{_t}"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count({c}) AS non_null, CASE WHEN count(*) > 0 THEN 1 - count({c})::DOUBLE / count(*) END AS null_fraction FROM {_t}" for c in _cols)

    def _distinct(spark: SparkSession, sf_dir: str, t: str = _t, cols: list = _flat) -> DataFrame:
        return rows(spark, "column_name string, distinct_exact long", list(source(spark, sf_dir, (t,)).exact_distinct_counts(f"main.{t}", cols).items()))

    ALL[f"profile_exact_distinct_{_t}"] = _distinct
    ORACLES[f"profile_exact_distinct_{_t}"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_exact FROM {_t}" for c in _flat)

    if _num:

        def _ends(spark: SparkSession, sf_dir: str, t: str = _t, num: list = _num) -> DataFrame:
            src = source(spark, sf_dir, (t,))
            _, got = src.column_aggregates(f"main.{t}", [m for m in metas(src.frame(f"main.{t}")) if m.name in num], min_max=set(num))
            real = lambda v: None if v is None else float(v) + 0.0  # noqa: E731 - the extremes of a column of zeros may be either zero
            return rows(spark, "column_name string, min_value double, max_value double", [(c, real(x.min_value), real(x.max_value)) for c, x in got.items()])

        ALL[f"profile_min_max_{_t}"] = _ends
        ORACLES[f"profile_min_max_{_t}"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c})::DOUBLE + 0.0::DOUBLE AS min_value, max({c})::DOUBLE + 0.0::DOUBLE AS max_value FROM {_t}" for c in _num)

DOMAINS = {"orders": ["o_orderstatus", "o_orderpriority"], "lineitem": ["l_returnflag", "l_linestatus", "l_linenumber"], "customer": ["c_mktsegment", "c_nationkey"], "part": ["p_brand", "p_type"], "events": ["event_type"], "documents": ["lang", "source"], "conversations": ["role"], "embeddings": ["label"]}
for _t, _names in DOMAINS.items():

    def _domain(spark: SparkSession, sf_dir: str, t: str = _t, names: list = _names) -> DataFrame:
        got = source(spark, sf_dir, (t,)).value_domain_counts(f"main.{t}", names)
        text = lambda v: str(v).lower() if isinstance(v, bool) else str(v)
        return rows(spark, "column_name string, value string, n long, total_distinct long, rank long", [(c, text(v), n, total, k + 1) for c, (values, total) in got.items() for k, (v, n) in enumerate(values)])

    ALL[f"value_domain_{_t}"] = _domain
    ORACLES[f"value_domain_{_t}"] = (
        "SELECT column_name, value, n, total_distinct, rank FROM (SELECT *, count(*) OVER (PARTITION BY column_name) AS total_distinct, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM {_t} WHERE {c} IS NOT NULL GROUP BY {c}" for c in _names)
        + ")) WHERE rank <= 25"
    )


def frac(pattern: str, c: str) -> str:
    return f"avg(CASE WHEN regexp_full_match({c}, '{pattern}') THEN 1.0::DOUBLE WHEN {c} IS NOT NULL THEN 0.0::DOUBLE END)"


for _t, _c in (("nation", "n_name"), ("region", "r_name"), ("part", "p_name"), ("customer", "c_name"), ("customer", "c_mktsegment")):

    def _shape(spark: SparkSession, sf_dir: str, t: str = _t, c: str = _c) -> DataFrame:
        return table(spark, sf_dir, t).agg(*[e.alias(k) for k, e in stats.shape_group(quoted(c)).items()])

    ALL[f"shape_stats_{_c}"] = _shape
    ORACLES[f"shape_stats_{_c}"] = f"SELECT {frac(stats.SHAPES['upper'], _c)} AS upper_fraction, {frac(stats.SHAPES['person'], _c)} AS person_fraction, avg((length({_c}) - length(replace({_c}, ' ', '')) + 1)::DOUBLE) AS mean_tokens FROM {_t}"

VALUES = ["2024-01-31", "2024-02-01 10:00:00", "2024-02-01T10:00:00", "31/01/2024", "01/31/2024", "01/02/2024 10:00:00", "42", "-4.5", "12345678901234567890", "1700000000", "1700000000000", "550e8400-e29b-41d4-a716-446655440000", "d41d8cd98f00b204e9800998ecf8427e", "abc", "abc\n", "", None]
VALUES_SQL = "(VALUES " + ", ".join("(NULL::VARCHAR)" if v is None else "('" + v.replace("\n", "' || chr(10) || '") + "')" for v in VALUES) + ") AS t(v)"


def _type_sql(c: str, rel: str, text: bool = True) -> str:
    parts = [f"{frac(stats.SHAPES[s], c)} AS {s}_fraction" for s in ("numeric", "integer", "iso_date", "iso_datetime", "slash_date", "slash_datetime")] if text else []
    if text:
        slash = f"regexp_full_match({c}, '{stats.SHAPES['slash_date']}') OR regexp_full_match({c}, '{stats.SHAPES['slash_datetime']}')"
        parts += [f"avg(CASE WHEN ({slash}) AND TRY_CAST(substr({c}, {at}, 2) AS INTEGER) > 12 THEN 1.0::DOUBLE WHEN {c} IS NOT NULL THEN 0.0::DOUBLE END) AS slash_{n}_over_12" for n, at in (("first", 1), ("second", 4))]
    for unit, (low, high) in (("epoch_s", stats.EPOCH_S), ("epoch_ms", stats.EPOCH_MS)):
        ok = f"regexp_full_match({c}, '{stats.SHAPES[unit]}')" if text else f"{c} IS NOT NULL"
        number = f"TRY_CAST(CASE WHEN {ok} THEN {c} END AS BIGINT)"
        parts.append(f"avg(CASE WHEN {ok} AND {number} BETWEEN {low} AND {high} THEN 1.0::DOUBLE WHEN {ok} THEN 0.0::DOUBLE END) AS {unit}_fraction")
        parts += [f"{f}(CASE WHEN {number} BETWEEN {low} AND {high} THEN {number} END) AS {unit}_{f}" for f in ("min", "max")]
    return f"SELECT {', '.join(parts)} FROM {rel}"


@query("type_contradiction_strings", _type_sql("v", VALUES_SQL))
def type_contradiction_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "v string", [(v,) for v in VALUES]).agg(*[e.alias(k) for k, e in stats.type_group(F.col("v"), True).items()])


@query("type_contradiction_orders_key", _type_sql("o_orderkey", "orders", False))
def type_contradiction_orders_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(*[e.alias(k) for k, e in stats.type_group(F.col("o_orderkey"), False).items()])


_HEXED = f"regexp_full_match(v, '{stats.SHAPES['hex']}') AND NOT regexp_full_match(v, '{stats.SHAPES['numeric']}')"


@query(
    "key_shape_strings",
    f"SELECT {frac(stats.SHAPES['uuid'], 'v')} AS uuid_fraction, avg(CASE WHEN {_HEXED} THEN 1.0::DOUBLE WHEN v IS NOT NULL THEN 0.0::DOUBLE END) AS hex_fraction, min(CASE WHEN {_HEXED} THEN length(v) END) AS hex_min_length, max(CASE WHEN {_HEXED} THEN length(v) END) AS hex_max_length FROM {VALUES_SQL}",
)
def key_shape_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, "v string", [(v,) for v in VALUES]).agg(*[e.alias(k) for k, e in stats.key_group(F.col("v")).items()])


for _t, _c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate")):

    def _aligned(spark: SparkSession, sf_dir: str, t: str = _t, c: str = _c) -> DataFrame:
        return table(spark, sf_dir, t).agg(*[e.alias(k) for k, e in stats.alignment_group(quoted(c)).items()])

    ALL[f"temporal_alignment_{_t}"] = _aligned
    ORACLES[f"temporal_alignment_{_t}"] = "SELECT " + ", ".join(f"avg(CASE WHEN {_c} = date_trunc('{u}', {_c}) THEN 1.0::DOUBLE WHEN {_c} IS NOT NULL THEN 0.0::DOUBLE END) AS {u}_aligned" for u in ("day", "month")) + f" FROM {_t}"
    for _u in ("day", "month", "hour"):

        def _gaps(spark: SparkSession, sf_dir: str, t: str = _t, c: str = _c, u: str = _u) -> DataFrame:
            return period_gaps(table(spark, sf_dir, t), c, u)

        ALL[f"temporal_continuity_{_t}_{_u}"] = _gaps
        ORACLES[f"temporal_continuity_{_t}_{_u}"] = f"SELECT count(*) AS distinct_periods, coalesce(max(gap), 0) AS largest_gap FROM (SELECT date_diff('{_u}', lag(p) OVER (ORDER BY p), p) - 1 AS gap FROM (SELECT DISTINCT date_trunc('{_u}', {_c}) AS p FROM {_t} WHERE {_c} IS NOT NULL))"


# keys and joins


@query("distinct_combination_lineitem", "SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS combinations, (SELECT count(*) FROM lineitem) AS n_rows")
def distinct_combination_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    src, key = source(spark, sf_dir, ("lineitem",)), ["l_orderkey", "l_linenumber"]
    return rows(spark, "combinations long, n_rows long", [(src.distinct_combination_counts("main.lineitem", [key])[tuple(key)], src.row_count("main.lineitem"))])


@query("overlap_probe_all", " UNION ALL ".join(f"SELECT '{a}.{x}->{b}.{y}' AS edge, count(c.{x}) AS nonnull_fk, count(CASE WHEN c.{x} IS NOT NULL AND p.{y} IS NULL THEN 1 END) AS orphans FROM {a} c LEFT JOIN (SELECT DISTINCT {y} FROM {b}) p ON c.{x} = p.{y}" for a, x, b, y in EDGES))
def overlap_probe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = [relationships.overlap(table(spark, sf_dir, a), x, table(spark, sf_dir, b), y).select(F.lit(f"{a}.{x}->{b}.{y}").alias("edge"), "nonnull_fk", "orphans") for a, x, b, y in EDGES]
    return reduce(DataFrame.unionByName, one)


@query("cumulative_probe_events", "SELECT 'value' AS measure, count(CASE WHEN value IS NOT NULL AND p IS NOT NULL THEN 1 END) AS observations, count(CASE WHEN value < p THEN 1 END) AS decreases FROM (SELECT value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)")
def cumulative_probe_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cumulative.probe(table(spark, sf_dir, "events"), cumulative.Candidate("user_id", "ts", ["value"]))


CLUSTERED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("cluster_null_counts_lineitem", "SELECT count(*) AS sampled, coalesce(sum(CASE WHEN " + " OR ".join(f"{c} IS NULL" for c in CLUSTERED) + " THEN 1 ELSE 0 END), 0)::BIGINT AS dropped, " + ", ".join(f"coalesce(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 0)::BIGINT AS null_{c}" for c in CLUSTERED) + " FROM lineitem")
def cluster_null_counts_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.null_counts(table(spark, sf_dir, "lineitem").select(*CLUSTERED), CLUSTERED)


@query("cluster_kmeans_lineitem")
def cluster_kmeans_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = clusters.cluster(table(spark, sf_dir, "lineitem"), CLUSTERED, clusters.Limits())
    return rows(spark, "cluster int, size long, " + ", ".join(f"{c} double" for c in CLUSTERED), [(i, n, *[m[c] for c in CLUSTERED]) for i, (n, m) in enumerate(zip(got.sizes, got.centroids, strict=True))])


# three groups far apart, of which sizes and centres are exact
_FAR = "c_custkey % 3 * 40 + 10 + c_custkey % 5 * 0.1::DOUBLE", "c_custkey % 3 * 4 + 1 + c_custkey % 5 * 0.1::DOUBLE"


@query("cluster_separable_customers", f"SELECT count(*) AS size, round(avg({_FAR[0]}), 6) AS spend, round(avg({_FAR[1]}), 6) AS visits FROM customer GROUP BY c_custkey % 3")
def cluster_separable_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    group, step = F.col("c_custkey") % 3, F.col("c_custkey") % 5 * F.lit(0.1)
    df = table(spark, sf_dir, "customer").select("c_custkey", (group * 40 + 10 + step).alias("spend"), (group * 4 + 1 + step).alias("visits"))
    got = clusters.cluster(df, ["spend", "visits"], clusters.Limits())
    return rows(spark, "size long, spend double, visits double", [(n, round(m["spend"], 6), round(m["visits"], 6)) for n, m in zip(got.sizes, got.centroids, strict=True)])


@query("unpivot_json_events", "SELECT e.event_id, k.key AS key, json_extract_string(e.props, '$.' || k.key) AS value FROM events e, LATERAL (SELECT unnest(json_keys(e.props)) AS key) k")
def unpivot_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivot_json_object(table(spark, sf_dir, "events"), "props", ["event_id"])


# client-side policy, over measured tables


def mapped(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> tuple[SparkCatalog, Cache]:
    src = source(spark, sf_dir, names)
    ds = [relationships.annotate(d) for d in profile.profile(src, src.identifiers())]
    return src, Cache(datasets=ds, relationships=relationships.infer(ds).edges)


def named(spark: SparkSession, names: tuple[str, ...] = TABLES) -> list[Dataset]:
    from .model import Column

    return [Dataset(f"main.{t}", columns=[Column(c, k) for c, k in COLUMNS[t].items()]) for t in names]


@query("pii_flags", "SELECT * FROM (VALUES ('customer', 'c_name', 'name', 0.6::DOUBLE), ('nation', 'n_name', 'name', 0.6::DOUBLE), ('part', 'p_name', 'name', 0.6::DOUBLE), ('region', 'r_name', 'name', 0.6::DOUBLE), ('supplier', 's_name', 'name', 0.6::DOUBLE)) t(table_name, column_name, category, confidence)")
def pii_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = [(t, c, f.category, f.confidence) for t, cols in COLUMNS.items() for c, k in cols.items() if (f := pii.detect(c, k))]
    return rows(spark, "table_name string, column_name string, category string, confidence double", out)


@query("pii_refined", "SELECT * FROM (VALUES ('nation', 'n_name', 0.6::DOUBLE), ('region', 'r_name', 0.3::DOUBLE)) t(table_name, column_name, confidence)")
def pii_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = mapped(spark, sf_dir, ("nation", "region"))
    return rows(spark, "table_name string, column_name string, confidence double", [(d.name, c.name, c.pii.confidence) for d in cache.datasets for c in d.columns if c.pii])


@query("inventory", " UNION ALL ".join(f"SELECT 'main.{t}' AS identifier, (SELECT count(*) FROM {t}) AS row_count, {len(COLUMNS[t])}::BIGINT AS column_count" for t in TABLES))
def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = source(spark, sf_dir)
    return rows(spark, "identifier string, row_count long, column_count long", [(o.identifier, src.row_count(o.identifier), o.column_count) for o in src.list_objects()])


def _keyed(table_name: str, column: str) -> str:
    return f"(SELECT count(*) > 0 AND count(*) = count(DISTINCT {column}) FROM {table_name})"


# an edge of each pair of columns whose names match and of which the second is a key; doc_id is one in both tables
@query("inferred_relationships", " UNION ALL ".join(f"SELECT '{a}' AS from_table, '{x}' AS from_column, '{b}' AS to_table, '{y}' AS to_column WHERE {_keyed(b, y)}" for a, x, b, y in [*EDGES, ("documents", "doc_id", "labels", "doc_id")]))
def inferred_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = source(spark, sf_dir)
    edges = relationships.infer(relationships.measure(src, src.identifiers())).edges
    return rows(spark, "from_table string, from_column string, to_table string, to_column string", [(r.from_dataset.split(".")[-1], r.from_columns[0], r.to_dataset.split(".")[-1], r.to_columns[0]) for r in edges])


# which columns a key may be: ids first; a table is keyed by the first that is unique
_KEYS = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "nation": "n_nationkey", "pages": "page_id", "embeddings": "vec_id", "benchmark": "item_id"}


@query("candidate_keys", " UNION ALL ".join(f"SELECT '{t}' AS table_name, CASE WHEN {_keyed(t, c)} THEN '{c}' ELSE '' END AS grain" for t, c in _KEYS.items()))
def candidate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = mapped(spark, sf_dir, tuple(_KEYS))
    return rows(spark, "table_name string, grain string", [(d.name, ",".join(d.grain or [])) for d in cache.datasets])


_DEGREE = {t: sum((t == a) + (t == b) for a, _, b, _ in EDGES) for t in TABLES}


@query(
    "rank_objects",
    "WITH t AS (" + " UNION ALL ".join(f"SELECT 'main.{t}' AS identifier, ln(1 + (SELECT count(*) FROM {t})) AS n, {d} AS degree" for t, d in _DEGREE.items()) + ")"
    " SELECT identifier, round(0.35 * n / (SELECT max(n) FROM t) + 0.3 * degree / (SELECT max(degree) FROM t) + 0.2 * 0.5 + 0.15, 4)::DOUBLE AS score FROM t",
)
def rank_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = source(spark, sf_dir)
    for i in src.identifiers():
        src.row_count(i)
    edges = relationships.declared_edges(EDGES, src.identifiers())[0]
    return rows(spark, "identifier string, score double", sorted(rank.rank(src.list_objects(), edges).items()))


@query("diagram_edges")
def diagram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = mapped(spark, sf_dir, ("customer", "nation", "region", "orders"))
    return rows(spark, "line string", [(x.strip(),) for x in diagram.render(cache).mermaid.splitlines()])


@query("firewall_verdicts", "SELECT * FROM (VALUES ('name', 'refused'), ('count', 'allowed'), ('max_name', 'refused'), ('union', 'refused'), ('where', 'allowed'), ('cte', 'refused'), ('region', 'warned'), ('window', 'allowed'), ('insert', 'refused')) t(statement, verdict)")
def firewall_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = mapped(spark, sf_dir, ("customer", "nation", "region"))
    tries = {
        "name": "SELECT c_name FROM customer", "count": "SELECT count(c_name) AS n FROM customer", "max_name": "SELECT max(upper(c_name)) AS m FROM customer",
        "union": "SELECT c_mktsegment FROM customer UNION SELECT c_name FROM customer", "where": "SELECT c_custkey FROM customer WHERE c_name LIKE 'A%'",
        "cte": "WITH x AS (SELECT c_name AS y FROM customer) SELECT y FROM x", "region": "SELECT r_name FROM region",
        "window": "SELECT c_custkey, row_number() OVER (ORDER BY c_name) AS r FROM customer", "insert": "INSERT INTO region SELECT 1, 'a'",
    }
    out = []
    for name, sql in tries.items():
        try:
            out.append((name, "warned" if firewall.inspect_query(spark, sql, cache).warnings else "allowed"))
        except ValueError:
            out.append((name, "refused"))
    return rows(spark, "statement string, verdict string", out)


# drift: changed copies of tables against the tables themselves


def drifted(spark: SparkSession, sf_dir: str, profiled: bool = True) -> tuple[SparkCatalog, Cache]:
    """A baseline of orders and customer, and a source in which they changed.  Without profiles: names, types and counts."""
    src = source(spark, sf_dir, ("orders", "customer"))
    base = [relationships.annotate(d) for d in profile.profile(src, src.identifiers())] if profiled else drift.current_state(src)
    cache = Cache(datasets=base, relationships=relationships.verify(src, relationships.infer(base).edges) if profiled else [])
    orders, customer = src.frame("main.orders"), src.frame("main.customer")
    late = orders.where("o_orderstatus = 'O'").withColumn("o_custkey", -F.col("o_custkey"))
    changed = SparkCatalog(spark, database="default")
    changed._frames.clear()
    renamed = orders.unionByName(late).withColumnRenamed("o_orderpriority", "o_urgency").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    changed.add("orders", renamed, view=False)
    changed.add("customer", customer.where("c_nationkey < 10"), view=False)
    return changed, cache


def findings(spark: SparkSession, found: list) -> DataFrame:
    data = [(f.axis, f.code, f.identifier, f.column, f.severity, json.dumps(f.data, sort_keys=True)) for f in found]
    return rows(spark, "axis string, code string, identifier string, column_name string, severity string, data string", data)


@query("drift_schema", "SELECT * FROM (VALUES ('column_added', 'o_urgency', 'low'), ('column_dropped', 'o_orderpriority', 'high'), ('column_retyped', 'o_totalprice', 'high'), ('possible_rename', 'o_orderpriority', 'low')) t(code, column_name, severity)")
def drift_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, cache = drifted(spark, sf_dir, profiled=False)
    return findings(spark, drift.schema_drift(cache.datasets, drift.current_state(changed))).select("code", "column_name", "severity")


@query("drift_volume", "SELECT 'main.orders' AS identifier, (SELECT count(*) FROM orders) AS before, (SELECT count(*) + count(CASE WHEN o_orderstatus = 'O' THEN 1 END) FROM orders) AS after UNION ALL SELECT 'main.customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM customer WHERE c_nationkey < 10)")
def drift_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, cache = drifted(spark, sf_dir, profiled=False)
    found = drift.volume_drift(cache.datasets, drift.current_state(changed))
    return rows(spark, "identifier string, before long, after long", [(f.identifier, f.data["before"], f.data["after"]) for f in found])


@query("drift_grain", "SELECT 'o_orderkey' AS column_name, 'key_lost_uniqueness' AS code, 'high' AS severity UNION ALL SELECT 'o_custkey', 'join_orphans_increased', CASE WHEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') + (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey < 10)) >= 0.2 * (SELECT count(*) FROM orders) THEN 'high' ELSE 'medium' END")
def drift_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, cache = drifted(spark, sf_dir)
    found = drift.grain_drift(changed, drift.grain_plan(cache, drift.current_state(changed)))
    return findings(spark, [f for f in found if f.identifier == "main.orders"]).select("column_name", "code", "severity").distinct()


@query("drift_cardinality", "SELECT 'c_nationkey' AS column_name, (SELECT count(DISTINCT c_nationkey) FROM customer WHERE c_nationkey < 10) AS after")
def drift_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, cache = drifted(spark, sf_dir)
    project = drift.Project(relations={"customer": "main.customer"}, semantic_models={"customers": {"model": "customer", "dimensions": ["c_nationkey"]}})
    found = drift.cardinality_drift(changed, cache, drift.cardinality_plan(cache, project, drift.current_state(changed)))
    return rows(spark, "column_name string, after long", [(f.column, f.data["after"]) for f in found])


# row attribution


def attributed(spark: SparkSession, sf_dir: str, before: str, after: str) -> DataFrame:
    source(spark, sf_dir, ("orders", "customer", "nation"))
    got = attribution.attribute(spark, before, after)
    data = [(c.kind, c.delta, got.baseline_rows, got.authored_rows, got.interacts) for c in got.changes]
    return rows(spark, "kind string, delta long, baseline_rows long, authored_rows long, interacts boolean", data)


@query("attribution_predicate_replaced", "WITH c AS (SELECT (SELECT count(*) FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O') AS b, (SELECT count(*) FROM orders WHERE o_totalprice > 5000 AND o_orderstatus = 'O') AS a) SELECT 'predicate_replaced' AS kind, a - b AS delta, b AS baseline_rows, a AS authored_rows, false AS interacts FROM c")
def attribution_predicate_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir, "{{ config(materialized='table') }} select * from {{ ref('orders') }} where o_totalprice > 1000 and o_orderstatus = 'O'", "select * from {{ ref('orders') }} where o_totalprice > 5000 and o_orderstatus = 'O'")


@query("attribution_join_side", "WITH c AS (SELECT (SELECT count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey) AS b, (SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey) AS a) SELECT 'join_side_changed' AS kind, a - b AS delta, b AS baseline_rows, a AS authored_rows, false AS interacts FROM c")
def attribution_join_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir, "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey", "select c_custkey, o_orderkey from customer inner join orders on c_custkey = o_custkey")


_AB = "'{kind}' AS kind, a - b AS delta, b AS baseline_rows, a AS authored_rows, false AS interacts FROM (SELECT (SELECT count(*) FROM ({before})) AS b, (SELECT count(*) FROM ({after})) AS a)"
_O = "select o_orderkey from orders"
ATTRIBUTED = {
    "predicate_added": (_O, f"{_O} where o_totalprice > 5000"),
    "predicate_removed": (f"{_O} where o_totalprice > 5000", _O),
    "join_added": ("select c_custkey from customer", "select c_custkey from customer inner join orders on c_custkey = o_custkey"),
    "join_removed": ("select c_custkey from customer inner join orders on c_custkey = o_custkey", "select c_custkey from customer"),
    "join_condition_changed": ("select c_custkey from customer left join orders on c_custkey = o_custkey", "select c_custkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F'"),
    "distinct_added": ("select o_custkey from orders", "select distinct o_custkey from orders"),
    "distinct_removed": ("select distinct o_orderstatus from orders", "select o_orderstatus from orders"),
    "group_by_changed": ("select o_custkey, count(*) as n from orders group by o_custkey", "select o_orderstatus, count(*) as n from orders group by o_orderstatus"),
    "source_changed": ("select * from orders", "select * from customer"),
}
for _k, (_before, _after) in ATTRIBUTED.items():

    def _change(spark: SparkSession, sf_dir: str, before: str = _before, after: str = _after) -> DataFrame:
        return attributed(spark, sf_dir, before, after)

    ALL[f"attribution_{_k}"], ORACLES[f"attribution_{_k}"] = _change, "SELECT " + _AB.format(kind=_k, before=_before, after=_after)


@query(
    "attribution_interaction",
    "WITH c AS (SELECT count(DISTINCT o_custkey) FILTER (o_orderstatus = 'O') AS b, count(*) AS a, count(DISTINCT o_custkey) AS p, count(*) FILTER (o_orderstatus = 'O') AS d FROM orders) SELECT kind, v - b AS delta, b AS baseline_rows, a AS authored_rows, p + d - 2 * b <> a - b AS interacts FROM (SELECT *, 'predicate_removed' AS kind, p AS v FROM c UNION ALL SELECT *, 'distinct_removed', d FROM c)",
)
def attribution_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attributed(spark, sf_dir, "select distinct o_custkey from orders where o_orderstatus = 'O'", "select o_custkey from orders")


# metrics


def layer(spark: SparkSession, sf_dir: str) -> semantic.SemanticLayer:
    m, d, e = semantic.Measure, semantic.Dimension, semantic.Entity
    models = [
        semantic.Model("orders", "orders", [e("order", "primary", "o_orderkey"), e("customer", "foreign", "o_custkey")], [d("status", expr="o_orderstatus"), d("ordered_at", "time", "o_orderdate")], [m("revenue", "sum", "o_totalprice"), m("order_count", "count", "o_orderkey"), m("buyers", "count_distinct", "o_custkey"), m("open_orders", "sum_boolean", "o_orderstatus = 'O'")], "ordered_at"),
        semantic.Model("customers", "customer", [e("customer", "primary", "c_custkey"), e("nation", "foreign", "c_nationkey")], [d("segment", expr="c_mktsegment")], [m("customer_count", "count", "c_custkey")]),
        semantic.Model("views", "events", [e("event", "primary", "event_id"), e("user", "foreign", "user_id")], [d("at", "time", "ts"), d("kind", expr="event_type")], [m("views", "sum_boolean", "event_type = 'view'"), m("purchases", "sum_boolean", "event_type = 'purchase'")], "at"),
    ]
    x = semantic.Metric
    metrics = [
        x("revenue", measure="revenue"), x("order_count", measure="order_count"), x("buyers", measure="buyers"), x("customer_count", measure="customer_count"),
        x("average_order", "ratio", numerator="revenue", denominator="order_count"), x("orders_per_buyer", "derived", expr="order_count / buyers", metrics=["order_count", "buyers"]),
        x("revenue_to_date", "cumulative", measure="revenue"), x("revenue_7d", "cumulative", measure="revenue", window="7 days"), x("revenue_mtd", "cumulative", measure="revenue", grain_to_date="month"),
        x("revenue_3m", "cumulative", measure="revenue", window="3 months"),
        x("open_revenue", measure="revenue", filter="{{ Dimension('order__status') }} = 'O'"), x("view_to_purchase", "conversion", base_measure="views", conversion_measure="purchases", entity="user", window="1 day"),
    ]
    return semantic.SemanticLayer(models, metrics, lambda n: table(spark, sf_dir, n))


METRICS: dict[str, tuple[semantic.SemanticQuery, str]] = {
    "metric_simple_revenue_by_month": (semantic.SemanticQuery(["revenue"], ["metric_time"], grain="month"), "SELECT date_trunc('month', o_orderdate) AS metric_time, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1"),
    "metric_ratio_average_order_by_segment": (semantic.SemanticQuery(["average_order"], ["customer__segment"]), "SELECT c_mktsegment AS customer__segment, round(sum(o_totalprice) / count(o_orderkey), 2) AS average_order FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "metric_derived_orders_per_buyer": (semantic.SemanticQuery(["orders_per_buyer"], ["order__status"]), "SELECT o_orderstatus AS order__status, round(count(o_orderkey)::DOUBLE / count(DISTINCT o_custkey), 2) AS orders_per_buyer FROM orders GROUP BY 1"),
    "metric_cumulative_revenue": (semantic.SemanticQuery(["revenue_to_date"], ["metric_time__month"]), "SELECT metric_time__month, round(sum(v) OVER (ORDER BY metric_time__month), 2) AS revenue_to_date FROM (SELECT date_trunc('month', o_orderdate) AS metric_time__month, sum(o_totalprice) AS v FROM orders GROUP BY 1)"),
    "metric_cumulative_window": (semantic.SemanticQuery(["revenue_7d"], ["metric_time"]), "SELECT metric_time, round(sum(v) OVER (ORDER BY metric_time RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), 2) AS revenue_7d FROM (SELECT date_trunc('day', o_orderdate) AS metric_time, sum(o_totalprice) AS v FROM orders GROUP BY 1)"),
    "metric_cumulative_months": (semantic.SemanticQuery(["revenue_3m"], ["metric_time", "order__status"]), "WITH d AS (SELECT date_trunc('day', o_orderdate) AS metric_time, o_orderstatus AS order__status, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT a.metric_time, a.order__status, round(sum(b.v), 2) AS revenue_3m FROM d a JOIN d b ON a.order__status = b.order__status AND b.metric_time <= a.metric_time AND b.metric_time > a.metric_time - INTERVAL 3 MONTH GROUP BY 1, 2"),
    "metric_grain_to_date": (semantic.SemanticQuery(["revenue_mtd"], ["metric_time"]), "SELECT metric_time, round(sum(v) OVER (PARTITION BY date_trunc('month', metric_time) ORDER BY metric_time), 2) AS revenue_mtd FROM (SELECT date_trunc('day', o_orderdate) AS metric_time, sum(o_totalprice) AS v FROM orders GROUP BY 1)"),
    "metric_filtered_where": (semantic.SemanticQuery(["open_revenue", "order_count"], ["customer__segment"], where="{{ Dimension('customer__segment') }} <> 'BUILDING'"), "SELECT c_mktsegment AS customer__segment, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS open_revenue, count(o_orderkey) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1"),
    "metric_conversion": (semantic.SemanticQuery(["view_to_purchase"]), "SELECT round(avg(CASE WHEN EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 DAY) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS view_to_purchase FROM events v WHERE v.event_type = 'view'"),
}
for _n, (_q, _sql) in METRICS.items():

    def _metric(spark: SparkSession, sf_dir: str, q: semantic.SemanticQuery = _q) -> DataFrame:
        df = layer(spark, sf_dir).compile(q)
        return df.select(*[F.round(quoted(c), 2).alias(c) if t in ("double",) or t.startswith("decimal") else quoted(c) for c, t in df.dtypes])

    ALL[_n], ORACLES[_n] = _metric, _sql

# SQL that callers may write; the second text is for DuckDB where it differs

SQL: dict[str, tuple[str, str | None]] = {
    "join_inner": ("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F'", None),
    "join_right": ("SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'", None),
    "join_full": ("SELECT s_nationkey, n_nationkey, count(*) AS n FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey GROUP BY s_nationkey, n_nationkey", None),
    "join_cross": ("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation", None),
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey"),
    "join_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "join_range": ("SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey BETWEEN r_regionkey * 3 AND r_regionkey * 3 + 4", None),
    "join_lateral": ("SELECT c_custkey, m FROM customer, LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) x", None),
    "setop_union": ("SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer", None),
    "setop_union_all": ("SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "setop_intersect": ("SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region", None),
    "setop_except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region", None),
    "window_row_number": ("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders", None),
    "window_rank": ("SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS r, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS d FROM orders", None),
    "window_lag": ("SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS l FROM orders", None),
    "window_ntile": ("SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS q FROM orders", None),
    "window_first_last": ("SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)", None),
    "window_running_count": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders", None),
    "window_percent": ("SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS c FROM orders", None),
    "agg_grouping_sets": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", None),
    "agg_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "agg_cube": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", None),
    "agg_filter": ("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, max(o_totalprice) AS m FROM orders GROUP BY o_orderpriority HAVING count(*) > 1", None),
    "agg_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", None),
    "select_distinct": ("SELECT DISTINCT p_brand, p_type FROM part", None),
    "topk_orders": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "cte_nested": ("WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT o_custkey, n FROM a JOIN b ON n = m", None),
    "subquery_scalar": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)", None),
}
for _n, (_sql, _duck) in SQL.items():

    def _run(spark: SparkSession, sf_dir: str, sql: str = _sql) -> DataFrame:
        source(spark, sf_dir, TABLES[:8])
        return spark.sql(sql)

    ALL[_n], ORACLES[_n] = _run, _duck or _sql


@query("limit_clamp", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 51")
def limit_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = mapped(spark, sf_dir, ("orders",))
    return firewall.inspect_query(spark, "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100000", cache, 50).df


# tests of models, lineage, statements, spending

_TESTED = ("o_orderkey", "o_custkey", "o_orderdate")


@query(
    "model_tests_orders",
    " UNION ALL ".join(f"SELECT 'not_null' AS test, '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS failures FROM orders" for c in _TESTED)
    + "".join(f" UNION ALL SELECT 'unique', '{c}', (SELECT count(*) FROM (SELECT {c} FROM orders WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))" for c in _TESTED[:2]),
)
def model_tests_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runner.assertions(table(spark, sf_dir, "orders"), list(_TESTED), list(_TESTED[:2]))


@query("lineage_columns_read", "SELECT * FROM (VALUES ('customer', 'c_custkey'), ('customer', 'c_mktsegment'), ('orders', 'o_custkey'), ('orders', 'o_orderstatus'), ('orders', 'o_totalprice')) t(relation, column_name)")
def lineage_columns_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    source(spark, sf_dir, ("orders", "customer"))
    df = spark.sql("WITH o AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT c_mktsegment, sum(o_totalprice) AS s FROM o JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
    return rows(spark, "relation string, column_name string", sorted((t, c) for t, cols in inspect.columns_read(df).items() for c in cols))


@query("statement_split", "SELECT * FROM (VALUES (1, 'SELECT 1'), (2, 'SELECT '';'' AS s'), (3, 'SELECT 2')) t(line, statement)")
def statement_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "SELECT 1;\nSELECT ';' AS s;\n-- a comment; ends here\nSELECT 2"
    return rows(spark, "line int, statement string", [(line, s.split("\n")[-1]) for s, line in guard.split_statements(text)])


@query("spend_total", "SELECT 70::BIGINT AS spent, 30::BIGINT AS remaining")
def spend_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = costs.Gate(MemoryStore(), ceiling=100)
    with gate.spend(90, "scan"):
        pass
    gate.settle(90, 70, "scan")
    return rows(spark, "spent long, remaining long", [(gate.used(), gate.ceiling - gate.used())])


@query("reconcile_proposals", "SELECT * FROM (VALUES ('column_added', 'patch'), ('column_dropped', 'patch'), ('column_retyped', 'patch'), ('possible_rename', 'advice')) t(code, kind)")
def reconcile_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, cache = drifted(spark, sf_dir, profiled=False)
    found = drift.schema_drift(cache.datasets, drift.current_state(changed))
    return rows(spark, "code string, kind string", [(p["code"], p["kind"]) for p in drift.reconcile(found)])


# notes, over values that show one trait each

NOTED = {
    "iso_date": (["2024-01-31", "2024-02-01"], "%Y-%m-%d"),
    "iso_stamp": (["2024-02-01T10:00:00", "2024-02-01 11:00:00"], "%Y-%m-%d %H:%M:%S"),
    "day_first": (["31/01/2024", "01/02/2024"], "%d/%m/%Y"),
    "month_first": (["01/31/2024", "01/02/2024"], "%m/%d/%Y"),
    "either_order": (["01/02/2024", "03/04/2024"], "ambiguous"),
    "no_order": (["31/01/2024", "01/31/2024"], None),
    "whole_text": (["1", "22", "12345678901234567890"], "whole numbers"),
    "decimal_text": (["1.5", "2.25"], "numeric text"),
    "epoch_text": (["1700000000", "1700000001"], "epoch seconds"),
    "prose": (["ab", "cd"], None),
    "has_flag": (["yes", "no", "maybe"], "yes/no flag"),
}
_SAID = ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "ambiguous", "%d/%m/%Y", "%m/%d/%Y", "epoch seconds", "whole numbers", "numeric text", "yes/no flag")


@query("notes_on_values", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{said}')" for c, (_, said) in NOTED.items() if said) + ") t(column_name, said)")
def notes_on_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for c, (values, _) in NOTED.items():
        src = SparkCatalog(spark, database="default")
        src._frames.clear()
        src.add("noted", rows(spark, f"{c} string", [(v,) for v in values for _ in range(40)]), view=False)
        (d,) = profile.profile(src, ["main.noted"])
        out += [(c, next(s for s in _SAID if s in n)) for n in d.data_quality if n.startswith(c) and any(s in n for s in _SAID)]
    return rows(spark, "column_name string, said string", out)


@query("temporal_notes_orders", "SELECT column_name, granularity, date_diff(granularity, lo, hi) + 1 AS span, n AS periods, date_diff(granularity, lo, hi) + 1 - n AS missing FROM (SELECT 'o_orderdate' AS column_name, 'day' AS granularity, min(p) AS lo, max(p) AS hi, count(*) AS n FROM (SELECT DISTINCT date_trunc('day', o_orderdate) AS p FROM orders))")
def temporal_notes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = source(spark, sf_dir, ("orders",))
    (d,) = profile.profile(src, ["main.orders"])
    c = d.column("o_orderdate")
    return rows(spark, "column_name string, granularity string, span long, periods long, missing long", [(c.name, c.temporal_granularity, c.temporal_span, c.temporal_periods, c.temporal_missing)])


# drift of what needs no scan


def _plain(name: str, *columns: tuple[str, str, bool]) -> Dataset:
    from .model import Column

    return Dataset(f"main.{name}", row_count=1, columns=[Column(c, k, n) for c, k, n in columns])


_OLD = [_plain("orders", ("id", "bigint", False), ("note", "string", True)), _plain("gone", ("id", "bigint", False)), _plain("old_model", ("id", "bigint", False))]
_NEW = [_plain("orders", ("id", "bigint", True), ("note", "string", True)), _plain("come", ("id", "bigint", False)), _plain("old_model", ("id", "bigint", False))]


def _projects() -> tuple[drift.Project, drift.Project]:
    model = lambda columns: {"model": "stg", "measures": {"total": {"agg": "sum"}}, "dimensions": [], "columns": columns}
    old = drift.Project(models={"stg": ["orders"], "old": []}, relations={"stg": "main.stg", "old": "main.old_model"}, semantic_models={"sales": model(["id"]), "left": model([])}, metrics={"revenue": {"measures": ["total"]}, "count": {"measures": ["total"]}}, sources=["main.orders"])
    new = drift.Project(models={"stg": ["orders"], "mart": ["stg"]}, relations={"stg": "main.orders", "mart": "main.mart"}, semantic_models={"sales": model(["id", "lost"]), "extra": {**model([]), "model": "nowhere"}}, metrics={"revenue": {"measures": ["total"], "filter": "x"}, "share": {"measures": [], "metrics": ["revenue", "unknown"]}}, sources=["main.orders", "main.absent"])
    return old, new


@query("drift_schema_objects", "SELECT * FROM (VALUES ('table_added', 'main.come', 'low'), ('table_dropped', 'main.gone', 'high'), ('nullability_changed', 'main.orders', 'medium'), ('orphan_relation', 'main.old_model', 'medium'), ('dangling_source', 'main.absent', 'high')) t(code, identifier, severity)")
def drift_schema_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, drift.schema_drift(_OLD, _NEW, None, *_projects())).select("code", "identifier", "severity")


@query("drift_semantic_definitions", "SELECT * FROM (VALUES ('definition_added', 'extra', 'low'), ('definition_removed', 'left', 'low'), ('definition_changed', 'sales', 'low'), ('definition_added', 'share', 'low'), ('definition_removed', 'count', 'low'), ('definition_changed', 'revenue', 'low'), ('dangling_reference', 'extra', 'high'), ('dangling_reference', 'sales', 'high'), ('dangling_reference', 'share', 'high')) t(code, identifier, severity)")
def drift_semantic_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, drift.semantic_free_drift(*_projects(), _NEW)).select("code", "identifier", "severity")


@query("drift_impacts_ranked", "SELECT * FROM (VALUES (1, 'column_dropped', 'main.orders', 'mart,stg', 'revenue,share'), (2, 'table_dropped', 'main.gone', '', ''), (3, 'nullability_changed', 'main.orders', 'mart,stg', 'revenue,share'), (4, 'table_added', 'main.come', '', '')) t(rank, code, identifier, models, metrics)")
def drift_impacts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drift.schema_drift(_OLD[:2], [_plain("orders", ("id", "bigint", True)), _NEW[1]])
    ranked = drift.rank_findings(drift.annotate_impacts(found, _projects()[1]))
    return rows(spark, "rank int, code string, identifier string, models string, metrics string", [(i + 1, f.code, f.identifier, ",".join(f.impacted_models), ",".join(f.impacted_metrics)) for i, f in enumerate(ranked)])


# names of relations, declared keys, overrides


@query("relations_named", "SELECT * FROM (VALUES (1, 'orders'), (2, 'main.customer'), (3, 'nation')) t(n, relation)")
def relations_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "WITH orders2 AS (SELECT * FROM orders), c AS (SELECT * FROM main.customer) SELECT * FROM orders2 JOIN c ON true WHERE EXISTS (SELECT 1 FROM nation)"
    return rows(spark, "n int, relation string", [(i + 1, r) for i, r in enumerate(inspect.relations(inspect.parsed(spark, sql)))])


@query("declared_joins", "SELECT * FROM (VALUES ('main.orders', 'o_custkey', 'main.customer', 'c_custkey', 1.0::DOUBLE, ''), ('', '', '', '', NULL, 'orders.x -> nowhere.y')) t(from_dataset, from_column, to_dataset, to_column, confidence, unresolved)")
def declared_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, lost = relationships.declared_edges([("orders", "o_custkey", "raw.main.customer", "c_custkey"), ("orders", "x", "nowhere", "y")], source(spark, sf_dir, ("orders", "customer")).identifiers())
    found = [(r.from_dataset, r.from_columns[0], r.to_dataset, r.to_columns[0], r.confidence, "") for r in edges] + [("", "", "", "", None, x) for x in lost]
    return rows(spark, "from_dataset string, from_column string, to_dataset string, to_column string, confidence double, unresolved string", found)


@query("pii_overridden", "SELECT * FROM (VALUES ('customer', 'c_name', true), ('nation', 'n_name', false)) t(table_name, column_name, cleared)")
def pii_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = source(spark, sf_dir, ("customer", "nation"))
    got = profile.profile(src, src.identifiers(), [pii.Override(column="main.customer.c_name")])
    return rows(spark, "table_name string, column_name string, cleared boolean", [(d.name, c.name, c.pii is None) for d in got for c in d.columns if c.pii or c.pii_overridden])


# unnesting, recursion, metric definitions, edits, what may leave

_VERDICTS = {
    "unnest_own_column": ("SELECT k, v FROM region LATERAL VIEW explode(array(r_regionkey)) x AS v LATERAL VIEW explode(array(r_regionkey)) y AS k", "allowed"),
    "unnest_flagged": ("SELECT v FROM customer LATERAL VIEW explode(split(c_name, ' ')) x AS v", "refused"),
    "unnest_counted": ("SELECT count(v) AS n FROM customer LATERAL VIEW explode(split(c_name, ' ')) x AS v", "allowed"),
    "unnest_literal": ("SELECT v FROM region LATERAL VIEW explode(array(1, 2)) x AS v", "refused"),
    "unnest_sequence": ("SELECT v FROM region LATERAL VIEW explode(sequence(1, r_regionkey)) x AS v", "refused"),
    "unknown_function": ("SELECT mask_it(c_name) AS m FROM customer", "refused"),
    "star": ("SELECT * FROM customer", "refused"),
    "scalar_subquery": ("SELECT (SELECT max(c_name) FROM customer) AS m", "refused"),
    "length_averaged": ("SELECT avg(length(c_name)) AS l FROM customer", "allowed"),
    "grouped_unshown": ("SELECT count(*) AS n FROM customer GROUP BY c_name", "allowed"),
    "two_statements": ("SELECT 1; SELECT 2", "refused"),
    "unknown_table": ("SELECT 1 AS x FROM nowhere", "refused"),
}


@query("firewall_shapes", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, (_, v) in _VERDICTS.items()) + ") t(statement, verdict)")
def firewall_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = mapped(spark, sf_dir, ("customer", "region"))

    def verdict(sql: str) -> str:
        try:
            guard.assert_select_only(spark, sql)
            firewall.inspect_query(spark, sql, cache)
            return "allowed"
        except (ValueError, LookupError, AnalysisException):
            return "refused"

    return rows(spark, "statement string, verdict string", [(k, verdict(sql)) for k, (sql, _) in _VERDICTS.items()])


@query("relations_of_recursion", "SELECT 'nation' AS relation")
def relations_of_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql = "WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT k - 1 FROM r WHERE k > 0) SELECT k FROM r"
    return rows(spark, "relation string", [(x,) for x in inspect.relations(inspect.parsed(spark, sql))])


_SHARED = ["customer__segment", "metric_time", "order__ordered_at", "order__status"]
_DEFINED = {"revenue": _SHARED, "average_order": _SHARED, "customer_count": ["customer__segment", "metric_time"], "view_to_purchase": ["event__at", "event__kind", "metric_time"]}


@query("semantic_definitions", "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{d}')" for m, ds in _DEFINED.items() for d in ds) + ") t(metric, dimension)")
def semantic_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = layer(spark, sf_dir).list_definitions()["metrics"]
    return rows(spark, "metric string, dimension string", [(m, d) for m in _DEFINED for d in known[m]["dimensions"]])


@query("semantic_screening", "SELECT * FROM (VALUES ('customer__email', 'refused'), ('customer__segment', 'allowed')) t(token, verdict)")
def semantic_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = layer(spark, sf_dir)
    base.models["customers"].dimensions.append(semantic.Dimension("email", expr="c_name"))
    out = []
    for token in ("customer__email", "customer__segment"):
        try:
            base.screen(semantic.SemanticQuery(["revenue"], [token]))
            out.append((token, "allowed"))
        except ValueError:
            out.append((token, "refused"))
    return rows(spark, "token string, verdict string", out)


_EDITS = {
    "model_select": (edits.Edit("models/a.sql", "model", "select * from {{ ref('b') }}"), "allowed"),
    "model_ddl": (edits.Edit("models/a.sql", "model", "drop table b"), "refused"),
    "model_two": (edits.Edit("models/a.sql", "model", "select 1; select 2"), "refused"),
    "model_suffix": (edits.Edit("models/a.yml", "model", "select 1"), "refused"),
    "macro_open": (edits.Edit("macros/m.sql", "macro", "{% macro m() %} 1"), "refused"),
    "macro_closed": (edits.Edit("macros/m.sql", "macro", "{% macro m() %} 1 {% endmacro %}"), "allowed"),
    "schema_list": (edits.Edit("models/s.yml", "schema", "- a"), "refused"),
    "schema_map": (edits.Edit("models/s.yml", "schema", "models:\n- name: a\n"), "allowed"),
    "semantic_lost": (edits.Edit("models/m.yml", "semantic", "metrics:\n- name: x\n  type: simple\n  type_params: {measure: nothing}\n"), "refused"),
    "kind_unknown": (edits.Edit("a.txt", "note", "x"), "refused"),
}


@query("edit_verdicts", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, (_, v) in _EDITS.items()) + ") t(edit, verdict)")
def edit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def verdict(e: edits.Edit) -> str:
        try:
            edits.validate(spark, e)
            return "allowed"
        except (ValueError, AnalysisException):
            return "refused"

    return rows(spark, "edit string, verdict string", [(k, verdict(e)) for k, (e, _) in _EDITS.items()])


@query("jinja_stripped", "SELECT 'select a, 1 from orders join raw_t where 1' AS statement")
def jinja_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "{{ config(materialized='table') }}{# note #}select a, {{ var('x') }} from {{ ref('orders') }} join {{ source('raw', 'raw_t') }}{% if x %} where {{ y }}{% endif %};"
    return rows(spark, "statement string", [(" ".join(edits.strip_jinja(text).split()),)])


@query("scaffolded_files", "SELECT * FROM (VALUES ('models/staging/sources.yml'), ('models/staging/stg_customer.sql'), ('models/staging/stg_customer.yml'), ('models/staging/stg_orders.sql'), ('models/staging/stg_orders.yml')) t(path)")
def scaffolded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, cache = mapped(spark, sf_dir, ("customer", "orders"))
    return rows(spark, "path string", [(e.path,) for e in edits.scaffold(cache.datasets, cache.relationships)])


@query("redacted_messages", "SELECT * FROM (VALUES ('refused'), ('password=*** and jdbc://me:***@host')) t(said)")
def redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = envelope.failure("query", guard.Refused("password=hunter22 and jdbc://me:secret@host"))
    return rows(spark, "said string", [(got["reason"],), (got["message"],)])


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of lineitem: counts, exact distincts and safe extremes of each column."""
    src = source(spark, sf_dir, ("lineitem",))
    df = src.frame("main.lineitem")
    metas = [ColumnMeta(f.name, f.dataType.simpleString(), f.nullable, k) for k, f in enumerate(df.schema.fields)]
    n, got = src.column_aggregates("main.lineitem", metas, min_max={c.name for c in metas if types.is_numeric(c.data_type)})
    exact = src.exact_distinct_counts("main.lineitem", [c.name for c in metas])
    data = [(c.name, c.data_type, n, round((1 - (got[c.name].null_fraction or 0)) * n), got[c.name].null_fraction, exact[c.name]) for c in metas]
    return rows(spark, "column_name string, data_type string, n_rows long, non_null long, null_fraction double, distinct_exact long", data)
