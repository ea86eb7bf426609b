from collections import Counter

from siltstone.llm import queries, sharding

from pyspark.sql import functions as F


def key(r):
    return tuple(str(x) for x in r)


def test_a_permutation_of_all_rows(spark, medium):
    got = queries.op2_sharding(spark, medium).collect()
    want = spark.read.parquet(f"{medium}/documents.parquet").collect()
    assert Counter(key(r)[:5] for r in got) == Counter(key(r) for r in want)
    assert [(r.shard, r.position) for r in got] == [(0, i) for i in range(len(got))]
    assert [r.doc_id for r in got] != sorted(r.doc_id for r in got)


def test_against_brute_force(spark, medium):
    p = sharding.Params(seed=5, bucket_bytes=200_000)
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    got = sharding.shuffle(docs, p).collect()
    n = 1 + max(r.shard for r in got)
    assert n > 5
    hashed = docs.select("doc_id", F.pmod(sharding.record_hash(docs, 5), F.lit(n)).alias("b"), sharding.record_hash(docs, 6).alias("h")).collect()
    for b in range(n):
        rows = sorted((r for r in hashed if r.b == b), key=lambda r: r.h)
        want = [rows[i].doc_id for i in sharding.fisher_yates(len(rows), 5, b)]
        assert [r.doc_id for r in got if r.shard == b] == want
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) < 2 * min(sizes.values())


def test_result_does_not_depend_on_partitions(odd_docs):
    p = sharding.Params(bucket_bytes=300_000)
    a, b = sharding.shuffle(odd_docs.repartition(3), p).collect(), sharding.shuffle(odd_docs.coalesce(1), p).collect()
    assert [key(r) for r in a] == [key(r) for r in b]


def test_odd_rows_and_clashing_names(odd_docs):
    got = sharding.shuffle(odd_docs)
    assert got.columns[:4] == ["doc_id", "text", "lang", "source"] and got.columns[-2:] == ["shard", "position"]
    assert {"shard_src", "position_src"} <= set(got.columns)
    rows = got.collect()
    assert Counter(key(r)[:-2] for r in rows) == Counter(key(r) for r in odd_docs.collect())


def test_empty_table(no_docs):
    assert sharding.shuffle(no_docs).collect() == []


def test_permutation_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s, 0).tolist()) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert sharding.fisher_yates(0, 1, 1).tolist() == [] and sharding.fisher_yates(1, 1, 1).tolist() == [0]


def test_map_and_nested_columns(spark):
    df = spark.sql("SELECT 1 AS a, map('k', 1) AS m, array(1, null) AS l UNION ALL SELECT null, null, null")
    assert sharding.shuffle(df).count() == 2


def test_written_shards(spark, medium, tmp_path):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    back = sharding.write_shards(docs, str(tmp_path / "out"), sharding.Params(bucket_bytes=500_000))
    assert back.count() == 1000
    assert len(list((tmp_path / "out").glob("*.parquet"))) == back.select("shard").distinct().count()


def test_a_record_repeated_by_a_third_of_all_is_spread(spark):
    p = sharding.Params(bucket_bytes=2000)
    rows = [(7, "the same record", 1)] * 300 + [(i, f"record {i}", None) for i in range(100, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    got = sharding.shuffle(docs, p).collect()
    assert Counter((r.doc_id, r.text, r.shard_src) for r in got) == Counter(rows)
    sizes = Counter(r.shard for r in got)
    hot = Counter(r.shard for r in got if r.doc_id == 7)
    assert len(sizes) > 8 and max(hot.values()) < 80 and max(sizes.values()) < 160
    again = sharding.shuffle(docs.repartition(7), p).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_maps_at_any_depth(spark):
    docs = spark.createDataFrame([(1, [{"a": 1}], ({"b": 2},)), (2, None, None)], "doc_id long, l array<map<string,int>>, s struct<m:map<string,int>>")
    assert sorted(r.doc_id for r in sharding.shuffle(docs).collect()) == [1, 2]
    assert sorted(r.doc_id for r in sharding.shuffle(docs.union(docs)).collect()) == [1, 1, 2, 2]
