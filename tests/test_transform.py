import pytest
from siltstone.engine import Engine
from siltstone.plans import edits, runner
from siltstone.plans.edits import Edit
from siltstone.plans.guard import Refused
from siltstone.sources import demo, project

FILES = {
    "dbt_project.yml": "name: shop\n",
    "models/staging/sources.yml": "version: 2\nsources:\n  - name: raw\n    schema: main\n    tables: [{name: orders}, {name: customers}]\n",
    "models/staging/stg_orders.sql": "select order_id, customer_id, ordered_at, status from {{ source('raw', 'orders') }}",
    "models/staging/stg_customers.sql": "{{ config(materialized='table') }}\nselect customer_id, country from {{ source('raw', 'customers') }}",
    "models/fct_orders.sql": "select o.order_id, o.status, c.country from {{ ref('stg_orders') }} o join {{ ref('stg_customers') }} c on o.customer_id = c.customer_id where o.status <> 'returned'",
    "models/schema.yml": """
version: 2
models:
  - name: stg_orders
    columns:
      - {name: order_id, tests: [unique, not_null]}
      - {name: status, tests: [{accepted_values: {values: [placed, shipped]}}]}
      - name: customer_id
        tests: [{relationships: {to: ref('stg_customers'), field: customer_id}}]
  - name: fct_orders
    columns: [{name: order_id}, {name: status}, {name: region}]
""",
    "models/semantic.yml": """
semantic_models:
  - name: orders
    model: ref('stg_orders')
    defaults: {agg_time_dimension: ordered_at}
    entities: [{name: order, type: primary, expr: order_id}]
    dimensions: [{name: status, type: categorical}, {name: ordered_at, type: time}]
    measures: [{name: order_count, agg: count, expr: order_id}]
metrics:
  - {name: orders, type: simple, type_params: {measure: order_count}}
""",
}


@pytest.fixture
def root(tmp_path):
    for path, text in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    return tmp_path


@pytest.fixture
def engine(spark, root):
    e = Engine(spark=spark, data_dir=str(root), project_root=str(root))
    for t, df in demo.tables(spark).items():
        e.source.add(t, df)
    yield e
    e.close()


def test_project_source(root):
    p = project.load(project.find(root))
    assert p.name == "shop" and p.order() == ["stg_orders", "stg_customers", "fct_orders"]
    assert p.models["fct_orders"].refs == ["stg_orders", "stg_customers"] and p.models["stg_customers"].materialized == "table"
    assert p.declared_edges() == [("stg_orders", "customer_id", "stg_customers", "customer_id")]
    assert p.declared_keys() == {"stg_orders": [["order_id"]]}
    assert p.resolve("raw.orders") == "main.orders"
    with pytest.raises(LookupError):
        p.resolve("nothing")
    d = p.definitions()
    assert d.models["fct_orders"] == ["stg_orders", "stg_customers"] and d.metrics["orders"]["measures"] == ["order_count"]
    (root / "models/bad.yml").write_text("a: [")
    assert project.load(root).warnings


def test_circles_and_missing_projects(root, tmp_path_factory):
    (root / "models/staging/stg_orders.sql").write_text("select * from {{ ref('fct_orders') }}")
    with pytest.raises(ValueError, match="circle"):
        project.load(root).order()
    with pytest.raises(FileNotFoundError):
        project.find(tmp_path_factory.mktemp("empty"))


def test_plan_and_apply(engine, root):
    new = FILES["models/fct_orders.sql"].replace("o.status <> 'returned'", "o.status = 'placed'")
    p = engine.plan([Edit("models/fct_orders.sql", "model", new), Edit("models/new.sql", "model", "select 1 as x")])
    assert p.id.startswith("p") and len(p.id) == 11 and "-select o.order_id" in p.diff and "+select 1 as x" in p.diff
    assert any("region is documented but not selected" in w for w in p.warnings)
    assert (root / "models/fct_orders.sql").read_text() != new and engine.plans() == [p.id]
    assert engine.apply(p.id) == ["models/fct_orders.sql", "models/new.sql"]
    assert (root / "models/fct_orders.sql").read_text() == new
    with pytest.raises(Refused, match="changed since"):
        engine.apply(p.id)
    with pytest.raises(LookupError):
        engine.apply("p0000000000")


def test_conflict_writes_nothing(engine, root):
    p = engine.plan([Edit("models/a.sql", "model", "select 1 as a"), Edit("models/fct_orders.sql", "model", "select 2 as b")])
    (root / "models/fct_orders.sql").write_text("select 3 as c")
    with pytest.raises(Refused):
        engine.apply(p.id)
    assert not (root / "models/a.sql").exists()


@pytest.mark.parametrize(
    "edit",
    [
        Edit("../x.sql", "model", "select 1 as a"),
        Edit("models/x.sql", "model", "drop table y"),
        Edit("models/x.sql", "schema", "version: 2"),
        Edit("models/x.yml", "schema", "a: ["),
        Edit("models/x.yml", "schema", "models: [{columns: []}]"),
        Edit("models/x.yml", "schema", "password: 'hunter2hunter2'"),
        Edit("macros/x.sql", "macro", "{% macro a() %} select 1"),
        Edit("models/x.yml", "semantic", "metrics: [{name: m, type: simple, type_params: {measure: nothing}}]"),
        Edit("models/stg_nothing.sql", "delete"),
        Edit("models/staging/stg_orders.sql", "delete"),
        Edit("models/x.sql", "unknown", ""),
    ],
)
def test_refused_edits(engine, edit):
    with pytest.raises(Refused):
        engine.plan([edit])


def test_rows_are_attributed(engine):
    new = FILES["models/staging/stg_orders.sql"] + " where status = 'placed'"
    p = engine.plan([Edit("models/staging/stg_orders.sql", "model", new)], attribute_rows=True)
    assert any("predicate_added" in w or "rows in all" in w for w in p.warnings)


def test_strip_jinja():
    assert edits.strip_jinja("{{ config(x=1) }}{# c #}select {{ var('a') }} as a from {{ ref('m') }} {% if x %}where 1 = 1{% endif %};") == "select 1 as a from m where 1 = 1"


def test_build_and_tests(engine, spark, root):
    target = "siltstone_dev"
    sources = {"raw.orders": "orders", "raw.customers": "customers"}
    spark.sql(f"DROP DATABASE IF EXISTS {target} CASCADE")
    try:
        for t, df in demo.tables(spark).items():  # persistent views can't read temporary ones
            if t in ("orders", "customers"):
                spark.sql(f"CREATE DATABASE IF NOT EXISTS {target}")
                df.write.mode("overwrite").saveAsTable(f"{target}.raw_{t}")
                sources[f"raw.{t}"] = f"{target}.raw_{t}"
        got = {b.model: b for b in engine.build(target, sources=sources)}
        assert got["stg_customers"].status == "ok" and got["fct_orders"].status == "ok"
        assert got["stg_orders"].status == "failed tests" or got["stg_orders"].failures
        assert got["stg_orders"].failures["accepted_values:status"] > 0 and got["stg_orders"].failures["relationships:customer_id"] > 0
        assert "unique:order_id" not in got["stg_orders"].failures
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {target} CASCADE")


def test_selection_and_targets(root, spark):
    p = project.load(root)
    assert runner.selected(p, ["+fct_orders"]) == ["stg_orders", "stg_customers", "fct_orders"]
    assert runner.selected(p, ["stg_orders+"]) == ["stg_orders", "fct_orders"]
    assert runner.selected(p, ["stg_orders"]) == ["stg_orders"]
    assert runner.schema_name("dev", "staging") == "dev_staging"
    for bad in ("prod", "my_production", "live", "a;b"):
        with pytest.raises(Refused):
            runner.assert_dev(bad)
    out = runner.assertions(spark.createDataFrame([(1, None), (1, "a")], "a int, b string"), ["a", "b"], ["a"]).collect()
    assert {(r.test, r.column_name): r.failures for r in out} == {("not_null", "a"): 0, ("not_null", "b"): 1, ("unique", "a"): 1}


def test_scaffolds(engine):
    made = {e.path: e for e in engine.scaffold(["orders", "customers"])}
    assert set(made) == {"models/staging/sources.yml", "models/staging/stg_orders.sql", "models/staging/stg_orders.yml", "models/staging/stg_customers.sql", "models/staging/stg_customers.yml"}
    assert "unique" in made["models/staging/stg_orders.yml"].content and "pii: email" in made["models/staging/stg_customers.yml"].content
    for e in made.values():
        edits.validate(engine.spark, e)


def test_unit_test_scaffold_has_only_what_is_read(engine):
    import yaml

    e = engine.scaffold_unit_test("stg_customers")
    given = yaml.safe_load(e.content)["unit_tests"][0]["given"]
    assert given == [{"input": "source('raw', 'customers')", "rows": [{"customer_id": 1, "country": "a"}]}]


def test_metrics_of_the_project(engine):
    assert "orders" in str(engine.semantic_list())
    engine.source.add("stg_orders", engine.source.frame("main.orders"))
    got = engine.semantic_query(["orders"], ["order__status"], order_by=["order__status"])
    assert sum(r[-1] for r in got.cells) == 6000


def test_semantic_edits(engine, root):
    with pytest.raises(Refused, match="exists"):
        engine.semantic_define("models/semantic.yml", FILES["models/semantic.yml"])
    p = engine.semantic_update("models/semantic.yml", FILES["models/semantic.yml"].replace("name: orders, type", "name: all_orders, type"))
    engine.apply(p.id)
    assert "all_orders" in project.load(root).definitions().metrics


def test_init(tmp_path):
    assert "dbt_project.yml" in edits.init_project(tmp_path, "fresh")
    assert project.load(tmp_path).name == "fresh"
    with pytest.raises(Refused):
        edits.init_project(tmp_path, "fresh")
    with pytest.raises(Refused):
        edits.init_project(tmp_path / "x", "not a name")


def test_k_means_against_plain_loops():
    import numpy as np
    from siltstone.operators import cluster

    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.2, (60, 2)) for c in ((0, 0), (5, 5), (0, 6))])
    inertia, centres = min((cluster.k_means(x, 3, [0, 3, i]) for i in range(10)), key=lambda f: f[0])
    own = np.array([min(range(3), key=lambda c: ((p - centres[c]) ** 2).sum()) for p in x])
    assert abs(inertia - sum(((x[own == c] - x[own == c].mean(0)) ** 2).sum() for c in range(3))) < 1e-6
    assert sorted(np.bincount(own)) == [60, 60, 60]
    total = 0.0
    for i, p in enumerate(x):
        d = np.sqrt(((x - p) ** 2).sum(1))
        a = d[own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d[own == c].mean() for c in range(3) if c != own[i])
        total += (b - a) / max(a, b)
    assert abs(cluster.silhouette(x, own) - total / len(x)) < 1e-9


def test_clusters_of_few_points(spark):
    from siltstone.operators import cluster

    two = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(60)], "a double, b double")
    assert cluster.cluster(two, ["a", "b"]).sizes == [30, 30]
    for k in (0, 1, 3):
        with pytest.raises(ValueError):
            cluster.cluster(two, ["a", "b"], k=k)
    with pytest.raises(ValueError):
        cluster.cluster(spark.createDataFrame([(1.0, 1.0)] * 60, "a double, b double"), ["a", "b"])
    odd = spark.createDataFrame([(float(i % 3) * 50 + i % 5 * 0.1, float(i % 3)) for i in range(300)] + [(None, 1.0), (2.0, None)], "a double, b double")
    got = cluster.cluster(odd, ["a", "b"])
    assert got.k == 3 and got.sizes == [100, 100, 100] and got.dropped == 2


def test_views_of_the_caller_are_not_replaced(spark, tmp_path):
    from siltstone.sources.catalog import SparkCatalog

    spark.range(3).write.parquet(str(tmp_path / "mine_alone.parquet"))
    spark.range(7).createOrReplaceTempView("mine_alone")
    with pytest.raises(ValueError, match="mine_alone"):
        SparkCatalog(spark, data_dir=str(tmp_path))
    assert spark.table("mine_alone").count() == 7
    spark.catalog.dropTempView("mine_alone")
    source = SparkCatalog(spark, data_dir=str(tmp_path))
    assert spark.table("mine_alone").count() == 3
    SparkCatalog(spark, data_dir=str(tmp_path))  # its own it may replace
    source.close()
    assert not spark.catalog.tableExists("mine_alone")


def test_sizes_of_catalog_tables_are_estimated(spark, tmp_path):
    from siltstone.operators import drift
    from siltstone.plans.costs import Gate, OverBudget
    from siltstone.sources.catalog import SparkCatalog
    from siltstone.sources.store import MemoryStore

    spark.range(5000).write.parquet(str(tmp_path / "t"))
    source = SparkCatalog(spark, database="default", sample_bytes=10)
    source._frames.clear()
    name = source.add("sized_t", spark.read.parquet(str(tmp_path / "t")), view=False)
    assert source.bytes_of(name) > 1000 and source.scan(name)[1]
    assert drift.grain_estimate(source, drift.GrainPlan(singles={name: ["id"]})) > 1000
    with pytest.raises(OverBudget):
        Gate(MemoryStore(), "billed", 100, 100).preflight(None)


def test_trailing_windows_where_clocks_change(spark):
    """Seven days are seven days in the week in which one of them has 23 hours, and months are calendar months."""
    import datetime as dt

    from siltstone.plans import semantic

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        days = spark.sql("SELECT cast(date_add(DATE '2024-02-20', cast(id AS int)) AS timestamp) AS at, 1 AS one FROM range(40)")
        model = semantic.Model("m", "t", [semantic.Entity("x", "primary", "one")], [semantic.Dimension("at", "time", "at")], [semantic.Measure("n", "sum", "one")], "at")
        metrics = [semantic.Metric("week", "cumulative", measure="n", window="7 days"), semantic.Metric("month", "cumulative", measure="n", window="1 month")]
        layer = semantic.SemanticLayer([model], metrics, lambda _: days)
        week = layer.compile(semantic.SemanticQuery(["week"], ["metric_time"])).orderBy("metric_time").collect()
        assert [r.week for r in week] == [min(i + 1, 7) for i in range(40)]
        month = {r.metric_time.date(): r.month for r in layer.compile(semantic.SemanticQuery(["month"], ["metric_time"])).collect()}
        assert month[dt.date(2024, 3, 25)] == 29 and month[dt.date(2024, 3, 30)] == 30
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_what_a_statement_lacks(spark, tmp_path):
    from siltstone.engine import Engine

    spark.range(5).write.parquet(str(tmp_path / "gap_a.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "gap_b.parquet"))
    e = Engine(spark=spark, data_dir=str(tmp_path))
    e.profile(["gap_a"])
    gaps = e.object_gap("SELECT * FROM gap_a JOIN gap_b USING (id) JOIN main.nowhere USING (id) JOIN other.place USING (id)")
    assert [(g["relation"], g["gap"]) for g in gaps] == [("gap_b", "unprofiled"), ("main.nowhere", "missing"), ("other.place", "foreign")] and gaps[0]["bytes"] > 0
    got = e.query_batch("SELECT count(*) AS n FROM gap_a; SELECT count(*) AS n FROM gap_b")
    assert [g["result"].cells for g in got] == [[[5]], [[5]]] and e.object_gap("SELECT * FROM gap_b") == []
    e.close()


@pytest.mark.parametrize("window", ["2 hours", "1 day", "3 days", "1 month", None])
@pytest.mark.parametrize("zoned", [False, True])
def test_conversions_against_plain_loops(spark, window, zoned):
    """One entity holds most rows; stretches of the window's length lose no conversion at their borders."""
    import datetime as dt
    import random

    from siltstone.plans import semantic

    rng = random.Random(4)
    start = dt.datetime(2024, 3, 1)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3]), start + dt.timedelta(minutes=30 * rng.randrange(3000)), rng.choice(["view", "buy", "look"])) for _ in range(400)]
    df = spark.createDataFrame(rows, f"who long, at {'timestamp' if zoned else 'timestamp_ntz'}, kind string")
    m = semantic.Measure
    model = semantic.Model("m", "t", [semantic.Entity("who", "foreign", "who"), semantic.Entity("x", "primary", "at")], [semantic.Dimension("at", "time", "at")], [m("views", "sum_boolean", "kind = 'view'"), m("buys", "sum_boolean", "kind = 'buy'")], "at")
    metric = semantic.Metric("rate", "conversion", base_measure="views", conversion_measure="buys", entity="who", window=window)
    got = semantic.SemanticLayer([model], [metric], lambda _: df).compile(semantic.SemanticQuery(["rate"])).first().rate
    length = {"2 hours": dt.timedelta(hours=2), "1 day": dt.timedelta(days=1), "3 days": dt.timedelta(days=3)}.get(window)

    def ends(at):
        if window == "1 month":
            return at.replace(month=at.month + 1) if at.day <= 30 or at.month != 3 else at.replace(month=4, day=30)
        return at + length if length else dt.datetime.max

    views = [(w, at) for w, at, kind in rows if kind == "view"]
    hit = [any(k == "buy" and u == w and at <= t <= ends(at) for u, t, k in rows) for w, at in views]
    assert abs(got - sum(hit) / len(hit)) < 1e-12


def test_clusters_are_of_all_rows(spark):
    from siltstone.operators import cluster

    got = cluster.cluster(spark.range(30000).selectExpr("cast(id % 3 * 40 + id % 5 * 0.1 AS double) AS a", "cast(id % 3 * 4 + id % 5 * 0.1 AS double) AS b"), ["a", "b"])
    assert got.k == 3 and got.sizes == [10000] * 3 and got.rows == 30000
    assert all(abs(c["a"] - 40 * i - 0.2) < 1e-9 for i, c in enumerate(sorted(got.centroids, key=lambda c: c["a"])))


def test_clusters_by_passes_against_plain_loops(spark):
    import numpy as np
    from siltstone.operators import cluster

    rng = np.random.default_rng(5)
    raw = np.concatenate([rng.normal(c, 0.4, (n, 2)) for n, c in ((500, (0, 0)), (300, (5, 5)), (7, (0, 90)))])
    df = spark.createDataFrame(raw.tolist(), "a double, b double").repartition(5)
    got = cluster.cluster(df, ["a", "b"], cluster.Limits(candidates=64))
    x = (raw - raw.mean(0)) / raw.std(0)
    means = (np.array([[c["a"], c["b"]] for c in got.centroids]) - raw.mean(0)) / raw.std(0)
    own = cluster.distances(x, means).argmin(1)
    assert np.bincount(own).tolist() == got.sizes and np.allclose([x[own == c].mean(0) for c in range(got.k)], means)
    assert abs(got.inertia - cluster.distances(x, means).min(1).sum()) < 1e-6
    total = 0.0
    for i, p in enumerate(x):
        d = ((x - p) ** 2).sum(1)
        a = d[own == own[i]].sum() / ((own == own[i]).sum() - 1)
        b = min(d[own == c].mean() for c in range(got.k) if c != own[i])
        total += (b - a) / max(a, b)
    assert abs(dict(got.sweep)[got.k] - total / len(x)) < 1e-4
    rows = cluster.Rows(df, ["a", "b"])
    (centres, sums), *_ = cluster.lloyd(rows, [np.array([[0.0, 0.0], [1e3, 1e3], [2e3, 2e3]])])  # two of them get no rows at first
    assert (sums[:, 0] > 0).all() and sums[:, 0].sum() == len(x)


def test_inferred_edges_need_no_profile_of_texts(spark, small, tmp_path, monkeypatch):
    from siltstone import queries
    from siltstone.operators import profile, relationships
    from siltstone.sources.catalog import SparkCatalog

    odd = SparkCatalog(spark, database="default", namespace="odd")
    odd._frames.clear()
    for name, sql in {
        "customers": "SELECT id AS customerid, id % 3 AS email_key, concat('c', id) AS name FROM range(50)",
        "visits": "SELECT id AS visit_id, id % 60 AS customer_id, cast(id AS string) AS shop_key, id AS raceId FROM range(200)",
        "shops": "SELECT cast(id AS string) AS id, cast(id AS string) AS x_shop_key, 'text' AS note FROM range(9)",
        "races": "SELECT id, id AS race_id FROM range(0)",
        "keyless": "SELECT id % 2 AS a, array(id) AS customer_id FROM range(8)",
    }.items():
        odd.add(name, spark.sql(sql), view=False)
    for src in (queries.source(spark, small), odd):
        full = [relationships.annotate(d) for d in profile.profile(src, src.identifiers())]
        want, got = relationships.infer(full), relationships.infer(relationships.measure(src, src.identifiers()))
        assert want.edges and got == want
    read, edges = set(), relationships.infer(relationships.measure(src := queries.source(spark, small), src.identifiers())).edges
    for method in ("column_aggregates", "exact_distinct_counts", "distinct_combination_counts", "value_domain_counts"):
        def spied(self, identifier, columns, *a, _f=getattr(SparkCatalog, method), **k):
            read.update(getattr(c, "name", str(c)) for c in columns)
            return _f(self, identifier, columns, *a, **k)

        monkeypatch.setattr(SparkCatalog, method, spied)
    assert queries.ALL["inferred_relationships"](spark, small).count() == len(edges)
    assert "o_orderkey" in read and not read & {"text", "html", "props", "url", "l_shipdate", "l_returnflag", "l_extendedprice"}
