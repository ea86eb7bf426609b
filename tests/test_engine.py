import datetime as dt
import json

import pytest
from siltstone import config, envelope
from siltstone.engine import Engine
from siltstone.operators import cumulative
from siltstone.plans.costs import Gate, NeedsConfirmation, OverBudget
from siltstone.plans.guard import Refused, split_statements
from siltstone.sources import demo
from siltstone.sources.catalog import SparkCatalog
from siltstone.sources.store import FileStore, MemoryStore, resolve, spent


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop") / "data")
    demo.write(spark, folder)
    return folder


@pytest.fixture(scope="module")
def engine(spark, shop):
    e = Engine(spark=spark, data_dir=shop)
    e.map(verify=True)
    yield e
    e.close()


def test_demo_is_the_same_each_time_and_create_only(spark, shop):
    assert demo.digest() == demo.digest()
    with pytest.raises(Exception, match="exists"):
        demo.write(spark, shop)


def test_no_silent_default(spark):
    with pytest.raises(ValueError, match="no silent default"):
        Engine(spark=spark)
    with pytest.raises(LookupError):
        Engine(spark=spark, database="nowhere")


def test_inventory_scans_nothing(spark, shop):
    e = Engine(spark=spark, data_dir=shop)
    rows = e.inventory()
    assert {r["name"] for r in rows} == set(demo.SCHEMAS) and all(r["row_count"] is None and r["byte_size"] > 0 for r in rows)
    assert e.inventory(ranked=True)[0]["rank_score"] > 0
    assert e.connect_test()["objects"] == 7


def test_map_finds_the_faults(engine):
    c = engine.cache()
    by = {d.name: d for d in c.datasets}
    assert by["orders"].grain == ["order_id"] and sorted(by["stock_levels"].grain) == ["snapshot_date", "store_id"]
    said = " ".join(n for d in c.datasets for n in d.data_quality)
    assert "epoch" in said.lower() or "seconds" in said
    assert any("mixes value shapes" in n for n in by["web_events"].data_quality)
    assert any("opened" in n for n in by["stores"].data_quality)
    stock = by["stock_levels"].column("snapshot_date")
    assert (stock.temporal_granularity, stock.temporal_missing, stock.temporal_largest_gap) == ("day", 3, 3)
    assert by["customers"].column("email").pii.category == "email"
    edges = {(r.from_dataset, r.from_columns[0], r.to_dataset): r for r in c.relationships}
    r = edges["main.orders", "customer_id", "main.customers"]
    assert r.verified and 0 < r.orphan_fraction < 0.02


def test_fresh_profiles_are_kept(engine):
    before = engine.cache().dataset("main.orders").profiled_at
    engine.profile(["orders"])
    assert engine.cache().dataset("main.orders").profiled_at == before
    engine.profile(["orders"], refresh=True)
    assert engine.cache().dataset("main.orders").profiled_at != before
    with pytest.raises(LookupError):
        engine.profile(["nothing"])


def test_running_totals(engine):
    (d,) = engine.profile(["stock_levels"], check_cumulative=True)
    assert any("units_sold_to_date looks cumulative" in n for n in d.data_quality)
    assert not any("units_on_hand looks cumulative" in n for n in d.data_quality)
    assert cumulative.find_candidate(d)[0].entity == "store_id"


def test_queries_behind_the_firewall(engine):
    got = engine.query("SELECT country, count(email) AS n FROM customers GROUP BY country ORDER BY country")
    assert got.columns == ["country", "n"] and sum(r[1] for r in got.cells) == 800
    for sql in ("SELECT email FROM customers", "SELECT max(email) FROM customers", "SELECT upper(full_name) AS x FROM customers", "WITH c AS (SELECT email AS e FROM customers) SELECT e FROM c", "SELECT country FROM customers UNION SELECT email FROM customers"):
        with pytest.raises(Refused, match="personal data"):
            engine.query(sql)
    for sql in ("DROP TABLE customers", "SELECT 1; SELECT 2", "INSERT INTO orders SELECT * FROM orders", "SELECT * FROM nowhere", "CREATE TABLE x AS SELECT 1"):
        with pytest.raises((Refused, Exception)):
            engine.query(sql)
    many = engine.query("SELECT order_id FROM orders")
    assert len(many.cells) == 50 and many.truncated and many.notes
    assert engine.store.rows("queries")[-1]["tables"] == ["main.orders"]


def test_batches(engine):
    got = engine.query_batch("SELECT count(*) AS n FROM orders;\n-- a comment; with a semicolon\nSELECT email FROM customers;\nSELECT ';' AS s FROM stores LIMIT 1")
    assert [g["ok"] for g in got] == [True, False, True] and got[0]["result"].cells == [[6000]]
    with pytest.raises(Refused):
        engine.query_batch(";".join(["SELECT 1 AS x FROM stores"] * 11))
    assert [s for s, _ in split_statements("SELECT 1\nSELECT 2")] == ["SELECT 1", "SELECT 2"]


def test_clusters(engine):
    got = engine.cluster("order_lines", ["quantity", "amount"], k=2)
    assert got.k == 2 and sum(got.sizes) == got.rows and set(got.centroids[0]) == {"quantity", "amount"}
    with pytest.raises(ValueError):
        engine.cluster("customers", ["email", "country"])


def test_diagram_shows_no_value(engine):
    d = engine.diagram()
    assert d.mermaid.startswith("erDiagram") and d.edge_count >= 4 and "example.com" not in d.mermaid


def test_drift_against_a_baseline(spark, shop, tmp_path):
    e = Engine(spark=spark, data_dir=shop, store=FileStore(tmp_path))
    with pytest.raises(LookupError):
        e.check()
    e.map(verify=True)
    e.snapshot()
    found, notes = e.check()
    assert found == [] and notes == []
    orders = e.source.frame("main.orders")
    e.source.add("orders", orders.unionByName(orders.limit(3000)).withColumnRenamed("status", "state"), 1)
    found, _ = e.check()
    codes = {(f.code, f.identifier) for f in found}
    assert {("column_dropped", "main.orders"), ("column_added", "main.orders"), ("possible_rename", "main.orders"), ("row_count_changed", "main.orders"), ("key_lost_uniqueness", "main.orders")} <= codes
    assert [f.severity for f in found] == sorted((f.severity for f in found), key=["high", "medium", "low"].index)
    fixes = e.reconcile(found)
    assert any(p.get("edits") for p in fixes) and any(p.get("test", {}).get("test") == "unique" for p in fixes)
    assert (tmp_path / "drift.json").exists() and (tmp_path / "snapshot.json").exists()


def test_gate():
    g = Gate(MemoryStore(), "billed")
    with pytest.raises(NeedsConfirmation) as e:
        g.preflight(10)
    assert e.value.estimate == 10
    g.ceiling, g.confirmed = 100, 60
    with g.spend(60, "scan"):
        assert g.used() == 60
        with pytest.raises(OverBudget):
            g.preflight(50)
    g.settle(60, 20, "scan")
    assert g.used() == 20 and spent(g.store) == 20
    assert spent(g.store, since=dt.datetime.now(dt.UTC) + dt.timedelta(hours=1)) == 0
    free = Gate(MemoryStore())
    free.preflight(1 << 60)


def test_billed_engine_needs_a_budget(spark, shop):
    e = Engine(spark=spark, data_dir=shop, paradigm="billed")
    with pytest.raises(NeedsConfirmation):
        e.profile(["orders"])
    e.gate.ceiling = e.gate.confirmed = 1 << 40
    assert e.profile(["orders"]) and e.gate.used() > 0


def test_sampled_profiles_judge_no_key(spark, shop):
    e = Engine(spark=spark, data_dir=shop, config=config.Config(max_full_profile_bytes=20_000))
    (d,) = e.profile(["orders"])
    assert d.column("order_id").is_unique is None and d.row_count == 6000


def test_scope_narrows(spark, shop):
    s = SparkCatalog(spark, shop, scope=["main.orders"])
    assert s.identifiers() == ["main.orders"]
    with pytest.raises(LookupError):
        s.frame("main.customers")


def test_stores(tmp_path):
    for s in (MemoryStore(), FileStore(tmp_path / "s")):
        assert s.read("cache") is None and s.rows("queries") == [] and s.plans() == []
        s.write("cache", {"a": 1})
        s.write("plans/p1", {"id": "p1"})
        s.append("queries", {"sql": "x"})
        assert s.read("cache") == {"a": 1} and s.rows("queries") == [{"sql": "x"}] and s.plans() == ["p1"]
    with pytest.raises(ValueError):
        FileStore(tmp_path / "s").write("../x", {})
    assert isinstance(resolve("memory"), MemoryStore) and isinstance(resolve("siltstone.sources.store:MemoryStore"), MemoryStore)
    for bad in ("nonsense", "siltstone.sources.store:nothing"):
        with pytest.raises(ValueError):
            resolve(bad)


def test_envelope():
    assert envelope.success("x", {"a": [1]})["ok"]
    for bad in ({"password": "x"}, {"rows": [[1]]}, {"a": [{"api_key": "z"}]}):
        with pytest.raises(envelope.Unsafe):
            envelope.success("x", bad)
    assert envelope.redact("jdbc://me:pw@host password=abc") == "jdbc://me:***@host password=***"
    assert envelope.failure("x", NeedsConfirmation("n", 5)) == {"ok": False, "command": "x", "reason": "needs_confirmation", "message": "n", "estimate_bytes": 5}
    assert envelope.reason_for(KeyError("x")) == "not_found" and envelope.reason_for(RuntimeError()) == "internal_error"


def test_config(tmp_path):
    (tmp_path / "c.yml").write_text("query: {max_rows: 5}\nprofile_top_n: 3\npii_overrides: [{column_name: full_name, reason: invented}]\n")
    c = config.load(tmp_path / "c.yml")
    assert c.query.max_rows == 5 and c.profile_top_n == 3 and c.pii_overrides[0].covers("a.b", "full_name")
    assert config.load(tmp_path / "none.yml").query.max_payload_bytes == 16384
    for bad in ({"nope": 1}, {"query": {"nope": 1}}):
        with pytest.raises(ValueError):
            config.from_dict(bad)


def test_command_line(spark, shop, tmp_path, capsys):
    from siltstone.cli import main

    def call(*args):
        code = main(["--data-dir", shop, "--repo-root", str(tmp_path), *args], spark)
        return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert call("connect", "test")[1]["data"]["objects"] == 7
    assert call("explore", "query", "SELECT count(*) AS n FROM stores")[1]["data"]["cells"] == [[12]]
    code, out = call("explore", "query", "SELECT email FROM customers")
    assert code == 1 and out["reason"] == "refused"
    assert call("maintain", "check")[1]["reason"] == "not_found"
    assert len(call("explore", "map")[1]["data"]["datasets"]) == 7
    assert call("maintain", "snapshot")[1]["ok"] and call("maintain", "schema")[1]["data"] == []
    assert call("demo", "digest")[1]["data"]["digest"] == demo.digest()


def test_silhouette_rows_come_from_all_of_the_table(spark):
    from siltstone.operators import cluster

    rows = spark.range(2000).selectExpr("cast(id as double) AS a", "cast(id % 7 as double) AS b").orderBy("a").coalesce(1)
    limits = cluster.Limits(silhouette_rows=500)
    got = [r.a for r in cluster.probe_rows(rows, ["a", "b"], limits).collect()]
    assert len(got) == 500 and 800 < sum(got) / 500 < 1200 and max(got) > 1900
    assert sorted(got) == sorted(r.a for r in cluster.probe_rows(rows.repartition(5), ["a", "b"], limits).collect())
