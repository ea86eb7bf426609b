import random

from siltstone.llm import decontam, queries


def naive_tiles(doc, item, least):
    """Textbook greedy string tiling: scan all starts for the longest unmarked match, mark, repeat."""
    n = min(least, len(item))
    md, mi = [False] * len(doc), [False] * len(item)
    total = 0
    while n:
        best, at = 0, []
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not md[i + k] and not mi[j + k]:
                    k += 1
                if k > best:
                    best, at = k, [(i, j)]
                elif k == best and k:
                    at.append((i, j))
        if best < n:
            break
        for i, j in at:
            if not any(md[i : i + best]) and not any(mi[j : j + best]):
                md[i : i + best] = mi[j : j + best] = [True] * best
                total += best
    return total


def test_tiles_against_brute_force():
    rng = random.Random(2)
    for _ in range(150):
        item = [rng.randint(0, 3) for _ in range(rng.randint(1, 14))]
        doc = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        tiles = decontam.tile(doc, item, 3)
        assert sum(k for _, _, k in tiles) == naive_tiles(doc, item, 3)
        for i, j, k in tiles:
            assert doc[i : i + k] == item[j : j + k]


def test_query_against_brute_force(spark, medium):
    docs = [(r.doc_id, decontam.tokens(r.text)) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    items = [(r.item_id, decontam.tokens(r.text)) for r in spark.read.parquet(f"{medium}/benchmark.parquet").collect()]
    p = decontam.Params()
    seeds = {}
    for k, words in items:
        for j in range(len(words) - p.min_tile + 1):
            seeds.setdefault(tuple(words[j : j + p.min_tile]), set()).add(k)
    want = set()
    for d, words in docs:
        for k in {k for i in range(len(words)) for k in seeds.get(tuple(words[i : i + p.min_tile]), ())}:
            item = dict(items)[k]
            cover = sum(n for _, _, n in decontam.tile(words, item, p.min_tile)) / len(item)
            if cover >= p.min_coverage:
                want.add((d, k, round(cover, 9)))
    got = queries.op7_decontaminate(spark, medium).collect()
    assert {(r.doc_id, r.item_id, round(r.coverage, 9)) for r in got} == want and want


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def pairs(spark, texts, items=((1, ITEM),), p=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs, bench, p).collect()}


def test_reordered_passages_case_and_punctuation(spark):
    w = ITEM.split()
    reordered = " ".join(w[13:] + ["filler", "words"] + w[6:13] + ["more"] + w[:6])
    loud = "Before. " + ", ".join(w).upper() + "! After."
    third = "x y z " + " ".join(w[:6]) + " and so on"
    got = pairs(spark, [reordered, loud, third, "nothing of it"])
    assert set(got) == {(0, 1), (1, 1)}
    assert got[0, 1].coverage == 1.0 and got[0, 1].tiles == 3 and got[0, 1].longest == 7
    assert got[1, 1].tiles == 1 and got[1, 1].longest == 20


def test_passage_far_inside_a_very_long_text(spark):
    got = pairs(spark, ["so it goes " * 60_000 + ITEM + " on and on" * 60_000])
    assert got[0, 1].coverage == 1.0


def test_short_repeated_and_odd_items(spark):
    items = [(1, "two words"), (2, None), (3, ""), (4, ITEM), (4, ITEM), (None, "an item that has no id at all"), (5, "...")]
    got = pairs(spark, ["these are two words", ITEM, "here an item that has no id at all stands", None, "", "..."], items)
    assert set(got) == {(0, 1), (1, 4), (2, None)}


def test_slices_do_not_change_the_result(spark, medium):
    docs, bench = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "benchmark"))
    key = lambda r: tuple(r)
    one = sorted(map(key, decontam.contaminated(docs, bench).collect()))
    many = sorted(map(key, decontam.contaminated(docs, bench, decontam.Params(slice_seeds=200)).collect()))
    assert one == many


def test_dropping_keeps_all_else(spark, odd_docs, no_docs, medium):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while seven quiet owls")], "item_id long, text string")
    left = decontam.drop_contaminated(odd_docs, bench)
    assert left.columns == odd_docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(["3", "4", "5", "6", "None", "None", "7", "8"])
    assert decontam.drop_contaminated(no_docs, bench).collect() == []
    none = bench.where("item_id = 0")
    assert decontam.drop_contaminated(odd_docs, none).count() == odd_docs.count()
    assert decontam.contaminated(odd_docs, none).collect() == []
    assert decontam.contaminated(no_docs, bench).collect() == []


def test_items_may_have_any_id(spark):
    text = "the quick brown fox jumps over the lazy dog while seven owls watch"
    docs = spark.createDataFrame([("a", f"so {text} indeed")], "doc_id string, text string")
    items = spark.createDataFrame([("x-1", text), (None, text + " again and again")], "item_id string, text string")
    assert {r.item_id for r in decontam.contaminated(docs, items).collect()} == {"x-1", None}
    assert decontam.drop_contaminated(docs, items).count() == 0
