import random
from collections import defaultdict

from pyspark.sql import functions as F

from siltstone.llm import packing, queries, tokencount


def tokens_of(texts):
    return [n or 0 for n in tokencount.brute_counts(texts, tokencount.Params())]


def check(rows, p, lengths):
    """Every token once, windows not overfull, no overlap, step groups of the right size."""
    windows, groups = defaultdict(list), defaultdict(set)
    total = 0
    for r in rows:
        if r.window_id is None:
            assert (r.n_tokens, r.tier, r.offset, r.step_group) == (0, None, None, None)
            continue
        windows[r.window_id].append((r.offset, r.n_tokens, r.tier))
        groups[r.step_group].add((r.window_id, r.tier))
        total += r.n_tokens
    assert total == sum(lengths)
    for spans in windows.values():
        spans.sort()
        at = 0
        for offset, n, tier in spans:
            assert offset == at and n <= tier
            at += n
        assert at <= spans[0][2] and len({s[2] for s in spans}) == 1 and spans[0][2] in p.tiers
    for members in groups.values():
        assert sum(t for _, t in members) <= max(p.step_tokens, max(p.tiers)) and len({t for _, t in members}) == 1
    return windows


def test_query(spark, medium):
    texts = [r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    rows = queries.op5_packing(spark, medium).collect()
    windows = check(rows, packing.Params(), tokens_of(texts))
    used = sum(n for w in windows.values() for _, n, _ in w) / sum(w[0][2] for w in windows.values())
    assert used > 0.95
    assert {r.doc_id for r in rows} == set(range(1000))


def test_against_brute_force_packer(spark):
    """A plain re-statement of the rules, quadratic, gives the same windows."""
    p = packing.Params(tiers=(8, 32), step_tokens=64)
    rng = random.Random(3)
    for _ in range(20):
        lengths = [rng.randint(1, 32) for _ in range(rng.randint(1, 60))]
        window, offset, tier, _ = packing.pack(lengths, p)
        wins = []  # [tier, used]
        want = [None] * len(lengths)
        queue = {8: [], 32: []}
        for i, n in enumerate(lengths):
            queue[8 if n <= 8 else 32].append(i)
        for size in (32, 8):
            mine = sorted(queue[size], key=lambda i: (-lengths[i], i))
            first = len(wins)
            for i in mine:
                fits = [(size - wins[w][1], w) for w in range(first, len(wins)) if size - wins[w][1] >= lengths[i]]
                w = min(fits)[1] if fits else len(wins)
                if not fits:
                    wins.append([size, 0])
                want[i] = (w, wins[w][1])
                wins[w][1] += lengths[i]
            if size == 32:
                waiting = sorted(queue[8], key=lambda i: (-lengths[i], i))
                for w in sorted(range(first, len(wins)), key=lambda w: (-(size - wins[w][1]), w)):
                    for i in list(waiting):
                        if lengths[i] <= size - wins[w][1]:
                            want[i] = (w, wins[w][1])
                            wins[w][1] += lengths[i]
                            waiting.remove(i)
                queue[8] = waiting
        assert list(zip(window, offset, strict=True)) == want
        assert [p.tiers[t] for t in tier] == [w[0] for w in wins]


def test_long_documents_are_cut_and_shards_are_bounded(spark):
    p = packing.Params(tiers=(4, 16), step_tokens=32, shard_pieces=20)
    docs = spark.createDataFrame([(i, "w " * (i % 50)) for i in range(100)], "doc_id long, text string")
    rows = packing.packed(docs, p, packing.n_words(F.col("text"))).collect()
    check(rows, p, [i % 50 for i in range(100)])
    assert len({r.window_id.split("-")[0] for r in rows if r.window_id}) > 5
    assert sorted((r.piece, r.n_tokens) for r in rows if r.doc_id == 49) == [(0, 16), (1, 16), (2, 16), (3, 1)]


def test_steps_weigh_alike():
    p = packing.Params(tiers=(64,), step_tokens=256)
    lengths = [64] * 8 + [33] * 8 + [40] * 16
    window, _, tier, group = packing.pack(lengths, p)
    cost = defaultdict(int)
    for n, w in zip(lengths, window, strict=True):
        cost[group[w]] += n * n
    assert max(cost.values()) < 1.2 * min(cost.values())


def test_odd_rows(odd_docs):
    rows = packing.packed(odd_docs).collect()
    texts = [r.text or "" for r in odd_docs.collect()]
    check(rows, packing.Params(), tokens_of(texts))
    assert sum(r.window_id is None for r in rows) == sum(not t for t in texts)
    assert rows and len(rows) >= len(texts)


def test_order_of_rows_does_not_matter(odd_docs):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, packing.packed(odd_docs.repartition(5)).collect())) == sorted(map(key, packing.packed(odd_docs.coalesce(1)).collect()))


def test_empty_table(no_docs):
    assert packing.packed(no_docs).collect() == []


def test_exact_tokens_cut_texts_without_spaces(spark):
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(20_000)), "some plain words", "", None]
    rows = packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    lengths = tokens_of(texts)
    check(rows, packing.Params(), lengths)
    for i, n in enumerate(lengths):
        assert sum(r.n_tokens for r in rows if r.doc_id == i) == n and any(r.doc_id == i for r in rows)
    assert lengths[0] > 8192 and sum(r.doc_id == 0 for r in rows) > 1


def decoded(rows):
    """(document, piece) -> text of its tokens, after the layout of each window is checked."""
    out = {}
    enc = tokencount.encoder(tokencount.Params())
    for r in rows:
        assert r.n_tokens == sum(r.lengths) == len(r.token_ids) and len(r.doc_ids) == len(r.pieces) == len(r.lengths)
        if r.window_id is None:
            assert r.n_tokens == 0 and r.tier is None
            out.setdefault((r.doc_ids[0], 0), []).append(b"")
            continue
        assert r.n_tokens <= r.tier
        at = 0
        for d, piece, n in zip(r.doc_ids, r.pieces, r.lengths, strict=True):
            out.setdefault((d, piece), []).append(enc.decode_bytes(r.token_ids[at : at + n]))
            at += n
    return out


def whole(pieces, d):
    return b"".join(pieces[k][0] for k in sorted(k for k in pieces if k[0] == d)).decode()


def test_windows_lose_no_token(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = queries.op5_packing_windows(spark, medium).collect()
    pieces = decoded(rows)
    assert {d: whole(pieces, d) for d, _ in pieces} == {r.doc_id: r.text for r in docs.collect()}
    layout = queries.op5_packing(spark, medium)
    assert {r.window_id: r.n for r in layout.where("window_id is not null").groupBy("window_id").agg(F.sum("n_tokens").alias("n")).collect()} == {r.window_id: r.n_tokens for r in rows if r.window_id}


def test_windows_of_odd_rows(odd_docs, no_docs):
    pieces = decoded(packing.token_windows(odd_docs).collect())
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(r.text or "")
    for d, some in texts.items():
        if len(some) == 1:
            assert whole(pieces, d) == some[0]
    assert [x.decode() for x in pieces[1, 0]] == texts[1]
    assert packing.token_windows(no_docs).collect() == []


def test_windows_over_several_shards(spark):
    p = packing.Params(tiers=(8, 32), step_tokens=64, shard_tokens=100, shard_pieces=20)
    docs = spark.createDataFrame([(f"d{i}", f"w{i} " * (i % 40)) for i in range(60)], "doc_id string, text string")
    rows = packing.token_windows(docs, p).collect()
    pieces = decoded(rows)
    assert all(whole(pieces, f"d{i}") == f"w{i} " * (i % 40) for i in range(60))
    assert len({r.window_id.split("-")[0] for r in rows if r.window_id}) > 5
    assert {r.doc_id for r in packing.packed(docs, p).collect()} == {f"d{i}" for i in range(60)}  # ids of any type


def test_a_row_repeated_by_a_third_of_all_is_spread(spark):
    p = packing.Params(tiers=(8,), step_tokens=64, shard_pieces=50)
    docs = spark.createDataFrame([(7, "one two three")] * 200 + [(i, f"text {i}") for i in range(100, 500)], "doc_id long, text string")
    rows = packing.packed(docs, p, packing.n_words(F.col("text"))).collect()
    check(rows, p, [3] * 200 + [2] * 400)
    shards = defaultdict(int)
    for r in rows:
        shards[r.window_id.split("-")[0]] += 1
    assert len(shards) == 12 and max(shards.values()) < 100
