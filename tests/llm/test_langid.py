import numpy as np

from siltstone.llm import langid, queries


def test_held_out_accuracy(spark, medium):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").orderBy("doc_id").collect()]
    p = langid.Params(train_per_language=60, landmarks_per_language=30)
    by = {}
    for lang, text in rows[:500]:
        by.setdefault(lang, []).append((lang, text))
    model = langid.train([x for v in by.values() for x in v[:60]], p)
    held = rows[500:]
    got = langid.score([t for _, t in held], model, p)
    right = [g[0] == lang for g, (lang, _) in zip(got, held, strict=True)]
    assert np.mean(right) >= 0.97
    assert np.mean([g[4] for g in got]) >= 0.97


def test_query(spark, medium):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = queries.op10_language(spark, medium).collect()
    assert len(rows) == len(truth)
    assert np.mean([truth[r.doc_id] == r.language for r in rows]) >= 0.98


TEXTS = [("en", "the cat sat on the mat with the hat"), ("en", "this is that and those are these"), ("de", "der hund und die katze sind nicht hier"), ("de", "ich habe das nicht gesehen und nicht gewusst")]


def test_scores_equal_the_dense_kernel():
    """Nystroem features and ridge in the plain form, from sets of n-grams."""
    p = langid.Params()
    grams = langid.Grams()
    sets = [set(grams.of(t).tolist()) for _, t in TEXTS]
    order = [2, 3, 0, 1]  # by language, as train() has them
    sets = [sets[i] for i in order]
    k = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    kll = np.array([[k(a, b) for b in sets] for a in sets])
    val, vec = np.linalg.eigh(kll)
    z = kll @ (vec / np.sqrt(val))
    y = np.array([[1, -1], [1, -1], [-1, 1], [-1, 1]], float)
    zc, yc = z - z.mean(0), y - y.mean(0)
    w = np.linalg.solve(zc.T @ zc + p.ridge * np.eye(4), zc.T @ yc)
    new = "the dog and the katze"
    g = set(grams.of(new).tolist())
    want = (np.array([k(g, s) for s in sets]) @ (vec / np.sqrt(val)) - z.mean(0)) @ w + y.mean(0)
    model = langid.train(TEXTS, p)
    (got,) = langid.score([new], model, p)
    assert abs(got[1] - want.max()) < 1e-3 and got[0] == ["de", "en"][int(want.argmax())]


def test_grams_are_the_distinct_ones():
    g = langid.Grams()
    assert len(g.of("ab")) == 3 and len(g.of("aaaa")) == 4 and len(g.of("AB")) == 3
    long = "abcdefgh" * 200_000
    assert sorted(g.of(long).tolist()) == sorted(g.of("abcdefgh" * 3).tolist())


def test_rejections(spark):
    p = langid.Params()
    model = langid.train(TEXTS * 3, p)
    junk, blank, none, marks = langid.score(["zqxj vkqz 42 xqz kvq jjx qqq", "  ", None, "!!! 123"], model, p)
    assert junk[4] is False and (blank[0], none[0], marks[0]) == (None, None, None) and not (blank[4] or none[4] or marks[4])


def test_odd_rows(odd_docs, no_docs):
    rows = langid.identify(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    kept = langid.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {3, 4, 5, 6}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.identify(no_docs).collect() == [] and langid.keep_identified(no_docs).collect() == []


def test_without_labels_nothing_with_letters_goes(spark):
    df = spark.createDataFrame([(1, "words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [(r.doc_id, r.language, r.accepted) for r in langid.identify(df).orderBy("doc_id").collect()] == [(1, None, True), (2, None, False), (3, None, False)]


def test_sample_is_bounded_and_repeatable(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    a, b = (langid.sample(d, langid.Params(train_per_language=20)) for d in (docs, docs.repartition(7)))
    assert a == b and len(a) == 80


def test_copies_of_one_text_do_not_crowd_out_the_sample(spark):
    rows = [(i, "the same english text over and over", "en") for i in range(1000)] + [(1000 + i, f"english text number {i} with words", "en") for i in range(300)]
    rows += [(2000 + i, f"deutscher text nummer {i} mit worten", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sample(docs, langid.Params(train_per_language=200))
    assert len(got) == len(set(got)) == 400 and {a for a, _ in got} == {"en", "de"}


def test_acceptance_does_not_depend_on_length():
    """Varied texts of trained languages, of which bounded landmarks know ever fewer distinct n-grams."""
    rng = np.random.default_rng(5)

    def vocabulary(letters):
        p = rng.dirichlet(np.full(len(letters), 1.0))
        return ["".join(rng.choice(list(letters), rng.integers(2, 10), p=p)) for _ in range(40_000)]

    words = {"a": vocabulary("abcdefghijklmnop"), "b": vocabulary("klmnopqrstuvwxyz")}

    def text(lang, chars):
        at = np.minimum(rng.zipf(1.2, chars // 3) - 1, 39_999)
        return " ".join(words[lang][i] for i in at)[:chars]

    p = langid.Params(landmarks_per_language=32, train_per_language=32)
    model = langid.train([(lang, text(lang, 600)) for lang in words for _ in range(32)], p)
    for lang in words:
        short, long = (langid.score([text(lang, n)], model, p)[0] for n in (1000, 1_000_000))
        assert short[0] == long[0] == lang and short[4] and long[4]
        assert abs(short[3] - long[3]) < 0.1
    # noise is rejected at any length
    for n in (1000, 200_000):
        assert not langid.score(["".join(rng.choice(list("0123456789#%&@a"), n))], model, p)[0][4]


def test_windows_hold_every_ngram_once():
    text = "".join(map(chr, range(100, 1100)))
    parts = list(langid.windows(text, 64))
    assert max(map(len, parts)) <= 64 + 3
    assert [x[i : i + 4] for x in parts for i in range(len(x) - 3)] == [text[i : i + 4] for i in range(len(text) - 3)]
    assert list(langid.windows("short", 64)) == ["short"] and list(langid.windows("", 64)) == [""]
