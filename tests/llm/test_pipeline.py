import corpus_pipeline as cp
import pytest

from pyspark.sql import functions as F

from siltstone.llm import decontam, langid, packing, sanitise


def stages(spark, sf_dir, docs, tmp_path):
    out = [docs]
    for k, (name, f) in enumerate(cp.STAGES):
        got = f(spark, out[-1], sf_dir)
        got.write.parquet(str(tmp_path / f"{k}-{name}"))
        out.append(spark.read.parquet(str(tmp_path / f"{k}-{name}")))
    return out


@pytest.fixture(scope="module")
def ran(spark, medium, tmp_path_factory):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    return stages(spark, medium, docs, tmp_path_factory.mktemp("stages"))


def test_each_stage_returns_documents_and_decides(ran):
    docs = ran[0]
    for got in ran[1:-1]:
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
    sizes = [d.count() for d in ran[:-1]]
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4]


def test_each_stage_against_brute_force(spark, medium, ran):
    texts = [{r.doc_id: r.text for r in d.collect()} for d in ran[:-1]]
    # language: what the model, scored directly, accepts
    p = langid.Params()
    model = langid.fit(ran[0], p)
    ids = list(texts[0])
    accepted = {i for i, s in zip(ids, langid.score([texts[0][i] for i in ids], model, p), strict=True) if s[4]}
    assert set(texts[1]) == accepted
    # near copies: one of each group found by all pairs
    from test_simhash import brute_groups

    groups = brute_groups(sorted(texts[1].items()))
    left = set(texts[1]) - {d for g in groups for d in sorted(g)[1:]}
    assert left <= set(texts[2]) and len(set(texts[2]) - left) <= 0.05 * len(left)
    # decontamination: naive search for items as runs of tokens
    items = [" ".join(decontam.tokens(r.text)) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    dirty = {d for d, t in texts[2].items() if any(f" {i} " in f" {' '.join(decontam.tokens(t))} " for i in items)}
    assert set(texts[2]) - set(texts[3]) == dirty and dirty
    # sanitising: same documents, entities gone, and the terms that disclose them
    from test_sanitise import brute_classes, brute_ratios

    p = sanitise.Params()
    near = {}
    for (c, t), ratio in brute_classes(texts[3].values(), p).items():
        near.setdefault(c, {})[t] = ratio
    terms = brute_ratios(list(dict.fromkeys(texts[3].values())), p)
    assert texts[3].keys() == texts[4].keys()
    assert all(texts[4][d] == sanitise.rewrite(t, terms, p.remove_at, near)[0] for d, t in texts[3].items())
    # packing: the tokens of what is left, once each
    from test_packing import decoded, whole

    order = sorted(texts[4])
    pieces = decoded(ran[-1].collect())
    assert {d for d, _ in pieces} == set(order) and all(whole(pieces, d) == texts[4][d] for d in order)


def test_run_equals_its_stages(spark, medium, ran):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, cp.run(spark, medium).collect())) == sorted(map(key, ran[-1].collect()))


def test_n_chars_follows_the_text(ran):
    assert ran[4].where(F.length("text") != F.col("n_chars")).count() == 0


def test_odd_and_empty_documents(spark, medium, odd_docs, no_docs, tmp_path):
    got = stages(spark, medium, odd_docs, tmp_path / "odd")
    assert all(d.columns == odd_docs.columns for d in got[:-1])
    assert {d for r in got[-1].collect() for d in r.doc_ids} <= {1, 2, 7, 8, None}
    assert all(d.count() == 0 for d in stages(spark, medium, no_docs, tmp_path / "none"))


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["language", "near_copies", "decontaminate", "private", "pack"]
    assert cp.ORACLE_SQL is None
    assert packing.Params().tiers
