import random

from siltstone.llm import queries
from siltstone.llm import tokencount as tc


def test_counts_equal_the_tokenizers_own(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in queries.op1_token_counts(spark, medium).collect()}
    assert [got[r.doc_id] for r in rows] == tc.brute_counts([r.text for r in rows], tc.Params())


def test_odd_rows(odd_docs):
    got = tc.token_counts(odd_docs).collect()
    rows = odd_docs.collect()
    want = tc.brute_counts([r.text for r in rows], tc.Params())
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(zip((r.doc_id for r in rows), want, strict=True), key=key)
    assert all(r.n_pretokens is None for r in got if r.n_tokens is None)


def test_empty_table(no_docs):
    assert tc.token_counts(no_docs).collect() == []


def test_tables_change_speed_only(odd_docs):
    small = tc.Params(frequent=2, cached=2, fan_in=2)
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(tc.token_counts(odd_docs, small).collect(), key=key) == sorted(tc.token_counts(odd_docs).collect(), key=key)


def test_summary_keeps_frequent_pieces():
    from collections import Counter

    counts = Counter({"a": 100, "b": 60, **{f"x{i}": 1 for i in range(50)}})
    assert set(tc.trim(counts, 2)) == {"a", "b"}


def test_frequent_over_many_partitions(spark):
    docs = spark.createDataFrame([(i, f" alpha beta w{i}") for i in range(200)], "doc_id long, text string").repartition(9)
    assert set(tc.frequent_pretokens(docs, tc.Params(frequent=4, fan_in=2))) >= {" alpha", " beta"}


def test_pieces_of_any_text_add_up():
    """Every border of pieces is one of pre-tokens, whatever white space, marks and scripts surround it."""
    p = tc.Params()
    measure = tc.measurer(p)
    pieces = tc.Pieces({}, 1000, measure, tc.bulk_measurer(p))
    rng = random.Random(1)
    alphabet = [" ", " ", " ", "\n", "\n", "\t", "\xa0", "\x1c", "\x85", "\u3000", "\r\n", "  ", "a", "b", "word", "y ", ".\n", "'s", "é", "\u4e2d", "\u017f", "1", "\u00b2", ".", "!", "_", "\x00", "e\u0301"]
    for _ in range(3000):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(5)] + [None]
        assert pieces.totals(texts) == [None if t is None else measure(t) for t in texts]


def test_other_patterns_are_split_whole(odd_docs):
    other = tc.Params(pattern=r"\s+|\S+")
    got = {(r.doc_id, r.n_pretokens, r.n_tokens) for r in tc.token_counts(odd_docs, other).collect()}
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got == {(d, None if t is None else len(tc.splitter(other)(t)), n) for (d, t), n in zip(texts, tc.brute_counts([t for _, t in texts], other), strict=True)}
