"""Benchmark decontamination by greedy string tiling.

Seeds: every run of ``min_tile`` tokens of a benchmark item is hashed; documents are tokenised once,
a rolling (Karp-Rabin) hash runs over their token ids and joins the seed table.  For each (document,
item) that shares a seed, running Karp-Rabin greedy string tiling marks the longest non-overlapping
matches again and again, down to ``min_tile`` tokens, so that the passages of an item count in any
order.  coverage = tiled tokens / tokens of the item; at ``min_coverage`` the pair is reported.

The seed table is broadcast in slices of at most ``slice_seeds`` seeds; a benchmark beyond that is
joined slice by slice, so that what is broadcast never grows with the benchmark.

Edge cases: null, blank or wordless texts match nothing.  An item shorter than ``min_tile`` tokens
has one seed, itself whole.  Repeated documents are each reported; repeated item rows are used
once; an item_id with two texts is two items.  Equal-length matches are tiled in order of the
document's position, then the item's.  An empty documents or benchmark table gives no pairs.
Case and punctuation are ignored.  Very long texts are tokenised whole.  Only doc_id, text, item_id, which keep their types, are read; ``drop_contaminated`` carries
all other columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import col, free_name, small_batches

WORDS = re.compile(r"\w+")
MULT = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
HIT = "coverage:double,tiles:int,longest:int"


@dataclass
class Params:
    min_tile: int = 5
    min_coverage: float = 0.5
    slice_seeds: int = 1_000_000


def tokens(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = h * MULT + ids[i : i + len(h)]
    h ^= h >> np.uint64(29)
    return h * MIX


def tile(doc: list[int] | np.ndarray, item: list[int], min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document start, item start, length) of the tiles, longest first.

    Each round takes the longest matches between unmarked runs.  Maximal matches are found by
    extending shared runs of ``min_tile`` tokens, looked up by value, so no hash is trusted.
    """
    doc, item = list(doc), list(item)
    n = min(min_tile, len(item))
    if not n:
        return []
    mark_d, mark_i = bytearray(len(doc)), bytearray(len(item))
    where: dict[tuple, list[int]] = {}
    for j in range(len(item) - n + 1):
        where.setdefault(tuple(item[j : j + n]), []).append(j)
    pairs = [(i, j) for i in range(len(doc) - n + 1) for j in where.get(tuple(doc[i : i + n]), ())]
    tiles: list[tuple[int, int, int]] = []
    while True:
        found = []
        for i, j in pairs:
            if i and j and doc[i - 1] == item[j - 1] and not mark_d[i - 1] and not mark_i[j - 1]:
                continue  # starts further left
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not mark_d[i + k] and not mark_i[j + k]:
                k += 1
            if k >= n:
                found.append((-k, i, j))
        if not found:
            return tiles
        found.sort()
        longest = -found[0][0]
        for k, i, j in found:
            if -k < longest:
                break
            if not any(mark_d[i : i - k]) and not any(mark_i[j : j - k]):
                mark_d[i : i - k] = mark_i[j : j - k] = b"\1" * -k
                tiles.append((i, j, -k))
        pairs = [(i, j) for i, j in pairs if not mark_d[i] and not mark_i[j]]


class Index:
    """The items of one slice: token ids, seeds in sorted order, which items own a seed."""

    def __init__(self, items: list[tuple[int | None, list[str]]], p: Params):
        self.p = p
        self.vocab: dict[str, int] = {}
        self.items = [(k, [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]) for k, words in items]
        self.owner: dict[int, dict[int, list[int]]] = {}  # run length -> seed -> items
        for x, (_, ids) in enumerate(self.items):
            n = min(p.min_tile, len(ids))
            for h in set(rolling(np.array(ids, np.uint64), n).tolist()):
                self.owner.setdefault(n, {}).setdefault(h, []).append(x)
        self.seeds = {n: np.array(sorted(o), np.uint64) for n, o in self.owner.items()}
        # a bitmap of seed hashes answers nearly every lookup with one read
        self.maybe = {}
        for n, s in self.seeds.items():
            bits = np.zeros(1 << 20, bool)
            bits[(s >> np.uint64(44)).astype(np.int64)] = True
            self.maybe[n] = bits

    def hits(self, text: str | None) -> list[tuple[int | None, float, int, int]]:
        get = self.vocab.get
        words = tokens(text)
        if not words:
            return []
        ids = np.fromiter(map(get, words, repeat(0)), np.uint64, len(words))
        cands: dict[int, list[np.ndarray]] = {}
        for n, seeds in self.seeds.items():
            h = rolling(ids, n)
            at = np.flatnonzero(self.maybe[n][(h >> np.uint64(44)).astype(np.int64)])
            if len(at):
                x = h[at]
                at = at[seeds[np.minimum(np.searchsorted(seeds, x), len(seeds) - 1)] == x]
            for i in at.tolist():
                for x in self.owner[n][int(h[i])]:
                    cands.setdefault(x, []).append(i)
        out = []
        for x, starts in cands.items():
            key, item = self.items[x]
            n = min(self.p.min_tile, len(item))
            # only tokens inside a shared seed can be tiled; gaps are closed with a token no item has
            near = np.zeros(len(ids), bool)
            for i in starts:
                near[i : i + n] = True
            runs: list[int] = []
            last = -2
            for i in np.flatnonzero(near).tolist():
                if i != last + 1:
                    runs.append(-1)
                runs.append(int(ids[i]))
                last = i
            tiles = tile(runs, item, self.p.min_tile)
            covered = sum(k for _, _, k in tiles) / len(item)
            if covered >= self.p.min_coverage:
                out.append((key, covered, len(tiles), max(k for _, _, k in tiles)))
        return sorted(out, key=lambda r: (r[0] is None, *([] if r[0] is None else [r[0]]), -r[1]))


def slices(benchmark: DataFrame, p: Params) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items, in slices that hold a bounded number of seeds."""
    part, seeds = [], 0
    rows = benchmark.select(col("item_id").alias("item_id"), col("text").alias("text")).where("text is not null").distinct()
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        words = tokens(r.text)
        if not words:
            continue
        part.append((r.item_id, words))
        seeds += len(words)
        if seeds >= p.slice_seeds:
            yield part
            part, seeds = [], 0
    if part:
        yield part


def hits_column(docs: DataFrame, items: list, p: Params, item_type: T.DataType):
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((items, p))
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(item_type)), ("coverage", pa.float64()), ("tiles", pa.int32()), ("longest", pa.int32())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = Index(*shared.value)
        for texts in batches:
            yield pa.array([[dict(zip(("item_id", "coverage", "tiles", "longest"), h, strict=True)) for h in index.hits(t)] for t in texts.to_pylist()], kind)

    return F.arrow_udf(run, f"array<struct<item_id:{item_type.simpleString()},{HIT}>>")(col("text"))


def contaminated(docs: DataFrame, benchmark: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, item_id, coverage, tiles, longest: the pairs at or over the coverage threshold."""
    p = p or Params()
    out = None
    for items in slices(benchmark, p):
        one = docs.select(col("doc_id").alias("doc_id"), F.inline(hits_column(docs, items, p, benchmark.schema["item_id"].dataType)))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.select(col("doc_id").alias("doc_id"), *[F.lit(None).cast(k).alias(c) for c, k in (("item_id", benchmark.schema["item_id"].dataType), ("coverage", "double"), ("tiles", "int"), ("longest", "int"))]).where("false")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents that cover no item up to the threshold, with their own columns."""
    p = p or Params()
    name = free_name(docs, "hits__")
    for items in slices(benchmark, p):
        docs = docs.withColumn(name, F.size(hits_column(docs, items, p, benchmark.schema["item_id"].dataType))).where(col(name) == 0).drop(name)
    return docs
