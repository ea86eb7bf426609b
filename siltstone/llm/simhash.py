"""Near copies by SimHash, found through per-segment bit counts.

Fingerprint: 128 bits, the sign of the sum of the +-1 hash vectors of a text's distinct words.
Embedding: the fingerprint's 64 segments of two bits map to their bit counts (0, 1, 2).  The
Manhattan distance of two count vectors is a lower bound of the Hamming distance.
Grid range-join: the 128 bits are cut into a few pieces of about 18 bits, and each piece is a grid whose cells are its
values.  Every piece has a reach; the reaches sum to radius - pieces + 1, so that two fingerprints within the radius are
within the reach of some piece (else they would differ in radius + 1 bits at least).  Each cell is joined with all
cells within its reach, and what meets there is verified by the exact distance: no pair within the radius is left out.
Fingerprints lie in blocks by hash, and each pair of blocks is a task; a block travels as one packed row, written once.
Within a pair of blocks a union of what is found is kept, and the links to its roots are all that leaves the task: a group
of m texts costs m - 1 links.  Cells of many rows are searched breadth first (``match``) before neighbouring cells are
joined, and of a large neighbouring cell the rows already in the same group are passed over.  No cell, partner list or
group is capped.  Work grows with the square of the distinct fingerprints: of a pair of blocks about 0.8 % of all pairs
are verified.  Groups are connected components.

Edge cases: null and blank texts have no fingerprint and belong to no group.  A text without
words (only signs) is compared whole.  Equal texts have equal fingerprints: repeated rows and
exact copies always share a group.  Ties cannot arise: the kept document of a group is that with
the smallest doc_id (null ids last), then the smallest row key; of rows equal in id and text one
stays.  An empty table gives no rows.  Other columns are carried by ``keep_one`` and never read;
its working columns take names that the input lacks.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, col, free_name, row_key, small_batches, worker_cache

WORDS = re.compile(r"\w+")
SEGMENTS = 64
DEAR = 5  # verifying a pair, with the skew of the cells, against the look-up of a cell; measured


@dataclass
class Params:
    radius: int = 20  # of 128 bits
    block_rows: int = 1 << 20  # rows of a block at most, on average
    task_rows: int = 1 << 16  # tables of fewer than ``spread`` blocks are cut into smaller ones, down to this
    spread: int = 8
    one_task_edges: int = 1_000_000  # up to so many edges one task joins the groups, beyond it star joins do


class Vectors:
    """Word -> row of +-1; the table is emptied when full."""

    ROWS = 1 << 17

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.bits = np.empty((self.ROWS, 128), np.int8)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.row) + len(words) > self.ROWS:
            self.row.clear()
        new = [w for w in words if w not in self.row]
        if new:
            at = len(self.row)
            raw = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in new)
            self.bits[at : at + len(new)] = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 16), axis=1).view(np.int8) * 2 - 1
            self.row.update(zip(new, range(at, at + len(new)), strict=True))
        return self.bits[[self.row[w] for w in words]]


def fingerprint(text: str | None, vectors: Vectors) -> bytes | None:
    """16 bytes, or None for a null or blank text."""
    if text is None or not text.strip():
        return None
    words = list(set(WORDS.findall(text.lower())))
    if not words:
        return xxhash.xxh3_128_digest(text.strip().encode("utf-8", "surrogatepass"))
    total = np.zeros(128, np.int64)
    for i in range(0, len(words), 4096):
        total += vectors.rows(words[i : i + 4096]).sum(0, dtype=np.int32)
    return np.packbits(total > 0).tobytes()


def fingerprint_column(docs: DataFrame):
    """struct<hi: long, lo: long> of ``text``; null where there is no fingerprint."""
    small_batches(docs.sparkSession)
    kind = pa.struct([("hi", pa.int64()), ("lo", pa.int64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vectors = worker_cache("simhash").setdefault("vectors", Vectors())
        for texts in batches:
            raw = [fingerprint(t, vectors) for t in texts.to_pylist()]
            both = np.frombuffer(b"".join(x or bytes(16) for x in raw), np.int64).reshape(-1, 2)
            yield pa.StructArray.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], fields=list(kind), mask=pa.array([x is None for x in raw], pa.bool_()))

    return F.arrow_udf(run, "hi long, lo long")(col("text"))


def reaches(radius: int, pieces: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, reach) of each piece; a reach of -1: the piece isn't needed."""
    ends = [128 * i // pieces for i in range(pieces + 1)]
    spare = radius - pieces + 1
    return [(at, end - at, spare // pieces + (i < spare % pieces)) for i, (at, end) in enumerate(itertools.pairwise(ends))]


def cells_in_reach(bits: int, reach: int) -> int:
    return sum(math.comb(bits, k) for k in range(reach + 1))


def pieces_for(rows: int, radius: int) -> list[tuple[int, int, int]]:
    """The cheapest cut for a block of so many rows: few long pieces have many cells in reach, many short ones many rows in a cell."""

    def cost(cut: list[tuple[int, int, int]]) -> float:
        return sum(cells_in_reach(bits, reach) * (1 / max(1, rows) + DEAR / 2**bits) for _, bits, reach in cut)

    return min((reaches(radius, pieces) for pieces in range(6, 17)), key=cost)  # from 6 on: a grid of 2^22 cells fits memory


def cells_of(fp: np.ndarray, at: int, bits: int) -> np.ndarray:
    """The value of a piece of each fingerprint; fp: n x 2 of int64."""
    hi, lo = fp.view(np.uint64).T
    if at >= 64:
        raw = hi >> np.uint64(at - 64)
    elif at + bits <= 64:
        raw = lo >> np.uint64(at)
    else:
        raw = (lo >> np.uint64(at)) | (hi << np.uint64(64 - at))
    return (raw & np.uint64((1 << bits) - 1)).astype(np.int64)


def counts_of(fp: np.ndarray) -> np.ndarray:
    """n x 64 bit counts of the two-bit segments; fp: n x 2 of int64."""
    b = np.ascontiguousarray(fp).view(np.uint8)
    pair = (b & 0x55) + ((b >> 1) & 0x55)
    return np.stack([(pair >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(fp), SEGMENTS)


def near(fp: np.ndarray, coarse: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which candidate pairs (rows a, b) are within the radius: Manhattan bound first, then exactly."""
    bound = np.abs(coarse[a] - coarse[b]).sum(1, dtype=np.int16) <= radius
    out = np.zeros(len(bound), bool)
    i = np.flatnonzero(bound)
    x = (fp[a[i]] ^ fp[b[i]]).view(np.uint64)  # of a negative number the bits of its absolute value would be counted
    out[i] = np.bitwise_count(x).sum(1, dtype=np.int16) <= radius
    return out


def match(cell: np.ndarray, fp: np.ndarray, coarse: np.ndarray, radius: int, direct: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs (rows a, b) among rows that share a cell: all for small cells, a spanning forest for others."""
    order = np.argsort(cell)
    key = cell[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    room = np.repeat(np.where(sizes <= direct, starts + sizes, 0), sizes)  # end of the row's cell, 0 for hot ones
    left, right = [], []
    at = np.flatnonzero(room)
    for s in range(1, direct):
        at = at[at + s < room[at]]
        if not len(at):
            break
        for i in range(0, len(at), 1 << 18):
            a, b = order[at[i : i + (1 << 18)]], order[at[i : i + (1 << 18)] + s]
            hit = near(fp, coarse, a, b, radius)
            left.append(a[hit])
            right.append(b[hit])
    for start, size in zip(starts[sizes > direct], sizes[sizes > direct], strict=True):
        fresh = order[start : start + size]
        while len(fresh):
            todo, fresh = [fresh[0]], fresh[1:]
            while todo and len(fresh):
                x = todo.pop()
                hit = near(fp, coarse, np.full(len(fresh), x), fresh, radius)
                found = fresh[hit]
                left.append(np.full(len(found), x))
                right.append(found)
                todo.extend(found.tolist())
                fresh = fresh[~hit]
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of rows a and b; label: each row's root, the smallest row of its group."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while len(a) and not np.array_equal(up := label[label], label):
            label[:] = up


def linked(fp: np.ndarray, block: int, radius: int, hot: int = 48) -> np.ndarray:
    """Each row's root after all near pairs of the first ``block`` rows with the others are joined, or with one another
    if there are no others; fp: n x 2, without repeats."""
    n, own = len(fp), block == len(fp)
    label, counts, cut = np.arange(n), counts_of(fp).astype(np.int8), pieces_for(max(block, n - block), radius)
    for at, bits, reach in cut:
        if reach >= 0:
            unite(label, *match(cells_of(fp, at, bits), fp, counts, radius))
    for at, bits, reach in cut:
        cell, root = cells_of(fp, at, bits), label.copy()
        asked = np.arange(block)[np.lexsort((root[:block], cell[:block]))]
        held = asked if own else np.arange(block, n)[np.lexsort((root[block:], cell[block:]))]
        asking, place = cell[asked], cell[held] * n + root[held]
        size = np.bincount(cell[held], minlength=1 << bits)
        first = np.r_[0, np.cumsum(size)]
        full = size > 0
        (a_hi, a_lo), (b_hi, b_lo) = (np.ascontiguousarray(fp[rows].view(np.uint64).T) for rows in (asked, held))
        for flips in itertools.chain.from_iterable(itertools.combinations(range(bits), k) for k in range(1, reach + 1)):
            to = asking ^ sum(1 << f for f in flips)
            row = np.flatnonzero(full[to] & (to > asking) if own else full[to])
            start, end = first[to[row]], first[to[row] + 1]
            large = np.flatnonzero(end - start > hot)
            if len(large):  # rows of one cell and root lie together: they are left out where the row that asks has this root
                same = to[row[large]] * n + root[asked[row[large]]]
                after = np.searchsorted(place, same, "right")
                row, start, end = np.r_[row, row[large]], np.r_[start, after], np.r_[end, end[large]]
                end[large] = np.searchsorted(place, same, "left")
            sizes = end - start
            total = np.cumsum(sizes)
            i = 0
            while i < len(row):
                j = max(i + 1, int(np.searchsorted(total, total[i] - sizes[i] + (1 << 20), "right")))
                m = sizes[i:j]
                a = np.repeat(row[i:j], m)
                b = np.arange(len(a)) + np.repeat(start[i:j] - (np.cumsum(m) - m), m)
                d = np.bitwise_count(a_lo[a] ^ b_lo[b])
                half = np.flatnonzero(d <= radius)
                a, b = a[half], b[half]
                hit = d[half] + np.bitwise_count(a_hi[a] ^ b_hi[b]) <= radius
                if hit.any():
                    unite(label, asked[a[hit]], held[b[hit]])
                i = j
    return label


def near_edges(prints: DataFrame, n: int, p: Params, store: Written) -> DataFrame:
    """a.hi, a.lo, b.hi, b.lo: edges between distinct fingerprints (hi, lo) that connect what pairs within the radius connect."""
    blocks = max(1, math.ceil(n / p.block_rows), min(p.spread, math.ceil(n / p.task_rows)))
    width = min(blocks, 512)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        block, hi, lo = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("block", "hi", "lo"))
        order = np.lexsort((lo, hi, block))
        block, fp = block[order], np.stack([hi, lo], 1)[order]
        for k in np.unique(block).tolist():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "fp": pa.array([fp[block == k].tobytes()], pa.binary())})

    kind = pa.schema([(c, pa.int64()) for c in ("a_hi", "a_lo", "b_hi", "b_lo")])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                one = np.frombuffer(r["fp"], np.int64).reshape(-1, 2)
                own = r["block"] == r["with"]
                fp = one if own else np.concatenate([one, np.frombuffer(r["fp_with"], np.int64).reshape(-1, 2)])
                label = linked(fp, len(one), p.radius)
                rows = np.flatnonzero(label != np.arange(len(fp)))
                both = np.concatenate([fp[label[rows]], fp[rows]], 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in range(4)], schema=kind)

    spread = prints.select("hi", "lo", F.pmod(F.xxhash64("hi", "lo"), F.lit(blocks)).cast("int").alias("block"))
    packed = store.put(spread.repartitionById(width, F.col("block") % width).mapInArrow(pack, "block int, fp binary"), "blocks")
    # a product of partitions reads blocks where they lie: one copy of either side is written, however many blocks there are
    other = packed.select(F.col("block").alias("with"), F.col("fp").alias("fp_with")).repartitionById(width, F.col("with") % width)
    pairs = packed.repartitionById(width, F.col("block") % width).hint("shuffle_replicate_nl").join(other, F.col("block") <= F.col("with"))
    return pairs.select("block", "fp", "with", "fp_with").mapInArrow(join, "a_hi long, a_lo long, b_hi long, b_lo long").distinct()


def components(edges: DataFrame, store: Written, p: Params) -> DataFrame:
    """(hi, lo) -> the smallest (root_hi, root_lo) of its connected component."""
    if edges.count() <= p.one_task_edges:
        kind = pa.schema([(c, pa.int64()) for c in ("hi", "lo", "root_hi", "root_lo")])

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            up: dict[tuple[int, int], tuple[int, int]] = {}

            def root(x: tuple[int, int]) -> tuple[int, int]:
                while (y := up.setdefault(x, x)) != x:
                    up[x] = x = up[y] if y in up else y
                return x

            for b in batches:
                cols = [b[i].to_pylist() for i in range(4)]
                for a_hi, a_lo, b_hi, b_lo in zip(*cols, strict=True):
                    r, s = root((a_hi, a_lo)), root((b_hi, b_lo))
                    if r != s:
                        up[max(r, s)] = min(r, s)
            rows = [(*x, *root(x)) for x in list(up)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], schema=kind)

        return edges.coalesce(1).mapInArrow(unite, "hi long, lo long, root_hi long, root_lo long")
    return star_components(edges, store)


def star_components(edges: DataFrame, store: Written) -> DataFrame:
    """Alternating large-star and small-star joins until the edges stay the same."""
    now = edges.select(F.struct(F.col("a_hi").alias("hi"), F.col("a_lo").alias("lo")).alias("u"), F.struct(F.col("b_hi").alias("hi"), F.col("b_lo").alias("lo")).alias("v"))
    seen, turn = None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        now = store.put(small.where("u != v").distinct(), f"star-{turn}")
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if turn > 0:
            store.drop(f"star-{turn - 1}")
        if mark == seen:
            break
        seen, turn = mark, turn + 1
    nodes = now.select("u", F.col("v").alias("r")).union(now.select(F.col("v").alias("u"), F.col("v").alias("r"))).distinct()
    return nodes.select("u.hi", "u.lo", F.col("r.hi").alias("root_hi"), F.col("r.lo").alias("root_lo"))


def members(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, key, root_hi, root_lo of every row that has a fingerprint; written, hence read cheaply."""
    store = Written(docs.sparkSession)
    own = docs.select(col("doc_id").alias("doc_id"), row_key(docs).alias("key"), fingerprint_column(docs).alias("fp"))
    prints = store.put(own.select("doc_id", "key", "fp.hi", "fp.lo").where("hi is not null"), "prints")
    distinct = store.put(prints.select("hi", "lo").distinct(), "distinct")
    edges = store.put(near_edges(distinct, distinct.count(), p, store), "edges")
    roots = store.put(components(edges, store, p), "roots")
    joined = prints.join(roots, ["hi", "lo"], "left")
    return joined.select("doc_id", "key", F.coalesce("root_hi", "hi").alias("root_hi"), F.coalesce("root_lo", "lo").alias("root_lo"))


def keeper() -> Column:
    """Which row of a group stays: smallest id, null ids last, then smallest key."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))


def near_copies(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, group_id, group_size, keep: the rows of all groups of two or more."""
    own = members(docs, p or Params())
    groups = own.groupBy("root_hi", "root_lo").agg(F.count(F.lit(1)).alias("group_size"), keeper().alias("k")).where("group_size > 1")
    rows = own.join(groups, ["root_hi", "root_lo"])
    one = Window.partitionBy("root_hi", "root_lo", "key", "doc_id").orderBy("key")
    first = F.row_number().over(one) == 1
    return rows.select("doc_id", F.col("k.doc_id").alias("group_id"), "group_size", (first & (F.col("key") == F.col("k.key")) & F.col("doc_id").eqNullSafe(F.col("k.doc_id"))).alias("keep"))


def keep_one(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents with one row left of each group, with their own columns."""
    store = Written(docs.sparkSession)
    own = members(docs, p or Params())
    groups = own.groupBy("root_hi", "root_lo").agg(F.count(F.lit(1)).alias("size"), keeper().alias("k")).where("size > 1")
    rows = own.join(groups, ["root_hi", "root_lo"])
    verdict = rows.groupBy("key").agg(F.first(F.col("key") != F.col("k.key")).alias("out"), F.count(F.lit(1)).alias("n"))
    verdict = store.put(verdict.where("out or n > 1"), "verdict")
    size = {r.out: r.n for r in verdict.groupBy("out").agg(F.count(F.lit(1)).alias("n")).collect()}

    def side(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df) if n <= 4_000_000 else df  # 8 bytes a key: 32 MB at most, else a sort-merge join

    key = free_name(docs, "key__")
    keyed = docs.withColumn(key, row_key(docs))
    gone = verdict.where("out").select(F.col("key").alias(key))
    rest = keyed.join(side(gone, size.get(True, 0)), key, "left_anti") if size.get(True) else keyed
    if size.get(False):
        again = verdict.where("not out").select(F.col("key").alias(key))
        number = free_name(docs, "number__")
        twice = rest.join(side(again, size[False]), key, "left_semi").withColumn(number, F.row_number().over(Window.partitionBy(key).orderBy(key))).where(col(number) == 1).drop(number)
        rest = rest.join(side(again, size[False]), key, "left_anti").unionByName(twice)
    return rest.drop(key)
