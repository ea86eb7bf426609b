import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

from siltstone.llm import queries, simhash


def brute_groups(rows, radius=20):
    """All pairs by exact Hamming distance, then connected components.  rows: (doc_id, text)."""
    vectors = simhash.Vectors()
    prints = [simhash.fingerprint(t, vectors) for _, t in rows]
    live = [i for i, f in enumerate(prints) if f is not None]
    if not live:
        return set()
    bits = np.array([np.frombuffer(prints[i], np.uint64) for i in live])
    up = list(range(len(live)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a in range(len(live)):
        d = np.bitwise_count(bits[a + 1 :] ^ bits[a]).sum(1)
        for b in np.flatnonzero(d <= radius):
            up[root(a)] = root(a + 1 + int(b))
    out = defaultdict(list)
    for a, i in enumerate(live):
        out[root(a)].append(rows[i][0])
    return {tuple(sorted(g, key=str)) for g in out.values() if len(g) > 1}


def found_groups(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.group_id].append(r.doc_id)
    return {tuple(sorted(g, key=str)) for g in out.values()}


def test_query_against_all_pairs(spark, medium):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{medium}/documents.parquet").collect()]
    rows = queries.op4_simhash(spark, medium).collect()
    want, got = brute_groups(docs), found_groups(rows)
    pairs = lambda gs: {p for g in gs for p in itertools.combinations(g, 2)}
    assert pairs(got) <= pairs(want)
    assert len(pairs(got)) >= 0.95 * len(pairs(want))
    for r in rows:
        assert r.group_size == len([x for x in rows if x.group_id == r.group_id])
        assert r.keep == (r.doc_id == r.group_id)
        assert r.group_id == min(x.doc_id for x in rows if x.group_id == r.group_id)


def test_counts_bound_the_distance_from_below():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(1 << 62), 1 << 62, (2, 500, 2))
    fine = np.abs(simhash.counts_of(a).astype(int) - simhash.counts_of(b).astype(int)).sum(1)
    exact = np.bitwise_count((a ^ b).view(np.uint64)).sum(1)
    assert (fine <= exact).all()
    assert (simhash.counts_of(a).sum(1) == np.bitwise_count(a.view(np.uint64)).sum(1)).all()


@pytest.mark.parametrize("size", [1, 2, 40, 400])
def test_matching_in_one_cell_is_exact(size):
    """Small cells list all near pairs, hot cells a spanning forest of them: the same components."""
    rng = np.random.default_rng(size)
    centre = rng.integers(-(1 << 62), 1 << 62, (max(1, size // 10), 2))
    fp = centre[rng.integers(0, len(centre), size)]
    flip = (rng.random((size, 128)) < 0.04).reshape(size, 2, 64)
    fp = fp ^ np.packbits(flip, axis=2).view(np.int64).reshape(size, 2)
    fp = np.unique(fp, axis=0)
    coarse = np.bitwise_count(fp.view(np.uint16)).reshape(len(fp), 8).astype(np.int8)
    a, b = (fp[rows] for rows in simhash.match(np.zeros(len(fp)), fp, coarse, 20))
    up = {tuple(x): tuple(x) for x in fp.tolist()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert np.bitwise_count((np.array(x) ^ np.array(y)).view(np.uint64)).sum() <= 20
        up[root(tuple(x))] = root(tuple(y))
    d = np.bitwise_count((fp[:, None] ^ fp[None]).view(np.uint64)).sum(2)
    for i, j in zip(*np.nonzero(d <= 20), strict=True):
        assert root(tuple(fp[i].tolist())) == root(tuple(fp[j].tolist()))


def test_recall_of_edited_copies(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(5000)]
    rows, truth = [], []
    for g in range(150):
        text = rng.choices(words, k=150)
        for c in range(2):
            now = list(text)
            for _ in range(6 * c):
                now[rng.randrange(150)] = rng.choice(words)
            rows.append((2 * g + c, " ".join(now)))
        truth.append((2 * g, 2 * g + 1))
    got = found_groups(simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert all(len(g) == 2 and g in set(truth) for g in got)
    assert len(got) >= 0.95 * len(truth)


def test_star_joins_give_the_same_groups(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").limit(400)
    a = found_groups(simhash.near_copies(docs).collect())
    b = found_groups(simhash.near_copies(docs, simhash.Params(one_task_edges=0)).collect())
    assert a == b and a


def test_long_chain_by_star_joins(spark):
    from siltstone.llm.common import Written

    edges = spark.createDataFrame([(0, i, 0, i + 1) for i in range(40)] + [(7, 1, 7, 2)], "a_hi long, a_lo long, b_hi long, b_lo long")
    got = simhash.star_components(edges, Written(spark)).collect()
    assert {(r.hi, r.lo): (r.root_hi, r.root_lo) for r in got} == {**{(0, i): (0, 0) for i in range(41)}, (7, 1): (7, 1), (7, 2): (7, 1)}


def test_hot_group_stays_whole(spark):
    text = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(i, text if i % 2 else text + f" extra{i % 7}") for i in range(3000)], "doc_id long, text string")
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == 3000 and {r.group_size for r in rows} == {3000} and sum(r.keep for r in rows) == 1
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [0]


def test_odd_rows(odd_docs):
    rows = simhash.near_copies(odd_docs).collect()
    assert sorted((r.doc_id, r.keep) for r in rows) == [(1, False), (1, True), (2, False)]
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 7, 8] and ids.count(None) == 2


def test_null_ids_of_a_group(spark):
    docs = spark.createDataFrame([(None, "same words here now"), (5, "same words here now"), (None, "same words here now")], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(docs).collect()] == [5]
    assert sum(r.keep for r in simhash.near_copies(docs).collect()) == 1
    none = spark.createDataFrame([(None, "same words here now")] * 3, "doc_id long, text string")
    assert simhash.keep_one(none).count() == 1


def test_empty_table(no_docs):
    assert simhash.near_copies(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []


def pairs_at(rng, n, distance):
    """n unrelated fingerprints, and one at exactly this distance of each."""
    a = rng.integers(0, 256, (n, 16), np.uint8)
    flips = np.zeros((n, 128), np.uint8)
    np.put_along_axis(flips, rng.random((n, 128)).argsort(1)[:, :distance], 1, 1)
    return a.view(np.int64), (a ^ np.packbits(flips, axis=1)).view(np.int64)


@pytest.mark.parametrize("block_rows", [1 << 20, 1500])
def test_no_pair_within_the_radius_is_left_out(spark, block_rows):
    """Pairs at the radius itself and just below all share a group, those one bit beyond it do not."""
    from siltstone.llm.common import Written

    rng, p, store = np.random.default_rng(8), simhash.Params(block_rows=block_rows), Written(spark)
    sides = {d: pairs_at(rng, 1000, d) for d in (18, 20, 21)}
    rows = np.concatenate([x for both in sides.values() for x in both]).tolist()
    prints = store.put(spark.createDataFrame([tuple(x) for x in rows], "hi long, lo long"), "prints")
    roots = simhash.components(store.put(simhash.near_edges(prints, len(rows), p, store), "edges"), store, p).collect()
    root = {(r.hi, r.lo): (r.root_hi, r.root_lo) for r in roots}
    together = {d: sum(tuple(x) in root and root[tuple(x)] == root.get(tuple(y)) for x, y in zip(a.tolist(), b.tolist(), strict=True)) for d, (a, b) in sides.items()}
    assert together == {18: 1000, 20: 1000, 21: 0}


@pytest.mark.parametrize("radius", [0, 3, 9, 20, 27])
@pytest.mark.parametrize("pieces", [6, 7, 11, 16])
def test_reaches_leave_no_distance_out(radius, pieces):
    """To miss every piece takes more than radius differing bits; the pieces tile the fingerprint."""
    cut = simhash.reaches(radius, pieces)
    assert sum(reach + 1 for _, _, reach in cut) == radius + 1
    assert [at for at, _, _ in cut] == np.cumsum([0] + [bits for _, bits, _ in cut])[:-1].tolist() and sum(bits for _, bits, _ in cut) == 128


@pytest.mark.parametrize("block", [900, 350])
def test_linked_against_all_pairs(block):
    """Groups of many near copies (cells that are hot, with strangers in them) and chains."""
    rng = np.random.default_rng(block)
    centre = rng.integers(-(1 << 62), 1 << 62, (6, 2))[rng.choice(6, 900, p=[0.6, 0.2, 0.1, 0.05, 0.03, 0.02])]
    rate = rng.choice([0.01, 0.06, 0.12, 0.5], 900)
    fp = centre ^ np.packbits((rng.random((900, 128)) < rate[:, None]).reshape(900, 2, 64), axis=2).view(np.int64).reshape(900, 2)
    fp = np.unique(fp, axis=0)[rng.permutation(len(np.unique(fp, axis=0)))]
    block = len(fp) if block == 900 else block
    near = np.bitwise_count((fp[:, None] ^ fp[None]).view(np.uint64)).sum(2) <= 20
    one = simhash.linked(fp, block, 20)
    i, j = np.nonzero(near)
    asked = (i < block) & ((j >= block) | (block == len(fp)))
    assert (one[i[asked]] == one[j[asked]]).all()
    both = np.arange(len(fp))
    simhash.unite(both, i, j)
    assert (both[one] == both).all()  # nothing is joined that isn't connected
    assert block < len(fp) or (one == both).all()


def test_hot_cells_are_cut_into_blocks(spark):
    """Blocks of a few rows give the same groups: each pair of blocks is searched."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(60):
        text = rng.choices(words, k=120)
        for c in range(5):
            now = list(text)
            for _ in range(2 * c):
                now[rng.randrange(120)] = rng.choice(words)
            rows.append((5 * g + c, " ".join(now)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = (found_groups(simhash.near_copies(docs, p).collect()) for p in (simhash.Params(), simhash.Params(block_rows=20)))
    assert sum(map(len, a)) >= 0.95 * 300 and sum(len(set(x) & set(y)) for x in a for y in b) >= 0.98 * sum(map(len, a))
    assert brute_groups(rows) == a or sum(map(len, a)) <= sum(map(len, brute_groups(rows)))
