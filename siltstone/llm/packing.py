"""Hierarchical multi-length packing.

A document is routed to the smallest context tier that holds it; one longer than the largest tier is
cut into pieces, full windows and a rest, that are routed on their own, so that no token is lost.
Tiers are packed from the longest to the shortest: first best-fit decreasing of the tier's own
pieces, then the gaps of its windows are filled with pieces of shorter tiers, largest first; what is
left of a shorter tier is packed in windows of its own.  Windows of a tier form step groups of
``step_tokens`` tokens; the windows are dealt to the groups heaviest first, by attention cost (sum
of squared lengths), each to the lightest group with room, so that steps weigh alike.

Lengths are the exact token counts of the tokenizer (``tokencount``); another length column can be given.  ``packed``
gives the layout, a row for each piece: only ids and lengths travel.  ``token_windows`` gives the windows themselves, a row
for each with its token ids, the documents and their borders.  Pieces are spread over packing shards by a hash, each
of a bounded number of pieces (and of tokens, where those travel) and packed on its own.  Rows repeated in id and
text, of which there may be any number, are spread by their place in the table as well.

Edge cases: null and empty texts have length 0; they are returned with null window columns.  Equal
lengths are packed in order of id (null ids last), then of row hash.  Repeated rows are packed
each.  An empty table gives no rows.  Very long texts are cut, never shortened.  Only doc_id, which keeps its type,
and text are read, other columns never.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokencount
from .common import Written, col, row_key, small_batches, struct

PLACED = [("piece", T.IntegerType()), ("n_tokens", T.IntegerType()), ("tier", T.IntegerType()), ("window_id", T.StringType()), ("offset", T.IntegerType()), ("step_group", T.StringType())]


@dataclass
class Params:
    tiers: tuple[int, ...] = (512, 2048, 8192)
    step_tokens: int = 65536
    shard_pieces: int = 100_000
    shard_tokens: int = 1 << 21  # where token ids travel


class Space:
    """Open windows by free room: the fullest one that still fits comes first."""

    def __init__(self) -> None:
        self.room: list[tuple[int, int]] = []

    def put(self, free: int, window: int) -> None:
        if free > 0:
            bisect.insort(self.room, (free, window))

    def fit(self, n: int) -> tuple[int, int] | None:
        i = bisect.bisect_left(self.room, (n, -1))
        return self.room.pop(i) if i < len(self.room) else None


def fill_gaps(gaps: list[tuple[int, int]], queue: list[int], lengths: list[int], place, by_length: list[int]) -> list[int]:
    """Fill each gap, largest first, with the longest waiting pieces that fit.  queue: piece numbers,
    longest first; by_length: their negated lengths.  Returns the pieces that are left."""
    after = list(range(1, len(queue) + 1))  # next living position at or after, with path halving
    alive = list(range(len(queue) + 1))

    def find(i: int) -> int:
        while alive[i] != i:
            alive[i] = alive[alive[i]]
            i = alive[i]
        return i

    for free, window in sorted(gaps, key=lambda g: (-g[0], g[1])):
        i = find(bisect.bisect_left(by_length, -free))
        while i < len(queue):
            place(queue[i], window)
            free -= lengths[queue[i]]
            alive[i] = after[i]
            if free <= 0:
                break
            i = find(max(i, bisect.bisect_left(by_length, -free)))
    return [x for i, x in enumerate(queue) if alive[i] == i]


def pack(lengths: list[int], p: Params) -> tuple[list[int], list[int], list[int], list[int]]:
    """lengths in canonical order, 1..largest tier.  (window, offset) of each piece, (tier, group) of each window."""
    tiers = sorted(p.tiers)
    home = [bisect.bisect_left(tiers, n) for n in lengths]
    queues = [sorted((i for i, t in enumerate(home) if t == k), key=lambda i: (-lengths[i], i)) for k in range(len(tiers))]
    window_of, offset_of = [-1] * len(lengths), [0] * len(lengths)
    tier, used, cost = [], [], []

    def place(i: int, w: int) -> None:
        window_of[i], offset_of[i] = w, used[w]
        used[w] += lengths[i]
        cost[w] += lengths[i] ** 2

    for k in range(len(tiers) - 1, -1, -1):
        space = Space()
        first = len(tier)
        for i in queues[k]:
            got = space.fit(lengths[i])
            if got is None:
                tier.append(k)
                used.append(0)
                cost.append(0)
                free, w = tiers[k], len(tier) - 1
            else:
                free, w = got
            place(i, w)
            space.put(free - lengths[i], w)
        for lower in range(k - 1, -1, -1):
            gaps = [(tiers[k] - used[w], w) for w in range(first, len(tier)) if used[w] < tiers[k]]
            if gaps and queues[lower]:
                queues[lower] = fill_gaps(gaps, queues[lower], lengths, place, [-lengths[i] for i in queues[lower]])
    group = [0] * len(tier)
    for k, size in enumerate(tiers):
        mine = sorted((w for w in range(len(tier)) if tier[w] == k), key=lambda w: (-cost[w], w))
        per = max(1, p.step_tokens // size)
        heap = [(0, g, per) for g in range(math.ceil(len(mine) / per))]
        for w in mine:
            load, g, room = heapq.heappop(heap)
            group[w] = g
            if room > 1:
                heapq.heappush(heap, (load + cost[w], g, room - 1))
    return window_of, offset_of, tier, group


def n_words(text: Column) -> Column:
    """Whitespace-separated words, a length for those who have no tokenizer."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def spread(pieces: DataFrame, p: Params, store: Written, carried: bool) -> DataFrame:
    """Pieces (doc_id, key, piece, n_tokens[, tokens]) with their shard, dealt to it."""
    sums = pieces.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    shards = max(1, math.ceil(sums[0] / p.shard_pieces), math.ceil((sums[1] or 0) / p.shard_tokens) if carried else 0)
    place = F.lit(0).cast("long")
    if shards > 1:
        again = store.put(pieces.where("piece = 0").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "again")
        n = again.count()
        if n:
            side = F.broadcast(again) if n <= 1_000_000 else again  # 8 bytes a key
            pieces = pieces.join(side.withColumn("twice", F.lit(True)), "key", "left")
            place = F.when(F.col("twice"), F.monotonically_increasing_id()).otherwise(place)
    at = F.pmod(F.xxhash64("doc_id", "key", "piece", "place"), F.lit(shards)).cast("int")
    dealt = pieces.withColumn("place", place).select("doc_id", "key", "piece", "n_tokens", *(["tokens"] if carried else []), at.alias("shard"))
    return dealt.repartitionById(shards, F.col("shard"))


def shard_of(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, int, list[int], list[int]] | None:
    """A shard's pieces, its number, their canonical order and lengths."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    t = pa.Table.from_batches(held)
    ids, keys, piece = (t[c].to_pylist() for c in ("doc_id", "key", "piece"))
    nothing = next((x for x in ids if x is not None), 0)
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, nothing if ids[i] is None else ids[i], keys[i], piece[i]))
    return t, t["shard"][0].as_py(), order, t["n_tokens"].to_pylist()


def lengths_of(docs: DataFrame, length: Column | None, tokenizer: tokencount.Params | None, store: Written) -> DataFrame:
    n = tokencount.counted_column(docs, tokenizer).getField("n_tokens") if length is None else length
    return store.put(docs.select(col("doc_id").alias("doc_id"), row_key(docs).alias("key"), F.coalesce(n, F.lit(0)).cast("long").alias("n")), "lengths")


def packed(docs: DataFrame, p: Params | None = None, length: Column | None = None, tokenizer: tokencount.Params | None = None) -> DataFrame:
    """doc_id, piece, n_tokens, tier (its size), window_id, offset, step_group: one row for each piece."""
    p = p or Params()
    store = Written(docs.sparkSession)
    lens, top = lengths_of(docs, length, tokenizer, store), max(p.tiers)
    cut = F.expr(f"transform(sequence(0L, (n - 1) div {top}), i -> cast(least({top}L, n - i * {top}L) as int))")
    pieces = spread(lens.where("n > 0").select("doc_id", "key", F.posexplode(cut).alias("piece", "n_tokens")), p, store, False)
    fields = [("doc_id", lens.schema["doc_id"].dataType), *PLACED]
    tiers = sorted(p.tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shard_of(batches)
        if got is None:
            return
        t, shard, order, n = got
        lengths = [n[i] for i in order]
        window, offset, tier, group = pack(lengths, p)
        for at in range(0, len(order), 10_000):
            k = range(at, min(at + 10_000, len(order)))
            rows = t.select(["doc_id", "piece", "n_tokens"]).take([order[i] for i in k]).combine_chunks()
            w = [window[i] for i in k]
            columns = {
                "tier": pa.array([tiers[tier[x]] for x in w], pa.int32()),
                "window_id": pa.array([f"{shard}-{x}" for x in w], pa.string()),
                "offset": pa.array([offset[i] for i in k], pa.int32()),
                "step_group": pa.array([f"{shard}-{tiers[tier[x]]}-{group[x]}" for x in w], pa.string()),
            }
            for name, values in columns.items():
                rows = rows.append_column(name, values)
            yield from rows.to_batches()

    done = pieces.mapInArrow(run, struct(*fields))
    empty = lens.where("n <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(0).alias("n_tokens"), *[F.lit(None).cast(kind).alias(n) for n, kind in PLACED[2:]])
    return done.unionByName(empty)


def token_pieces(docs: DataFrame, top: int, tokenizer: tokencount.Params | None = None) -> Column:
    """The token ids of ``text`` in pieces of up to ``top``, each as little-endian 16-bit numbers, 32-bit ones if the vocabulary has more
    than those hold; one empty piece where there are none."""
    t = tokenizer or tokencount.Params()
    shared = docs.sparkSession.sparkContext.broadcast(tokencount.vocabulary(t))
    kind = width(t)

    def cut(text: str | None, encode) -> list[bytes]:
        ids = np.array(encode(text) if text else [], kind)
        return [ids[i : i + top].tobytes() for i in range(0, max(1, len(ids)), top)]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = tokencount.new_encoder(t, shared.value).encode_ordinary  # not kept: later stages need the memory
        for texts in batches:
            yield pa.array([cut(x, encode) for x in texts.to_pylist()], pa.list_(pa.binary()))

    return F.arrow_udf(run, "array<binary>")(col("text"))


def width(t: tokencount.Params) -> str:
    """The type of number that holds every token id."""
    return "<u2" if len(tokencount.vocabulary(t).splitlines()) <= 1 << 16 else "<i4"


def numbers(cells: pa.ChunkedArray, kind: str) -> pa.Array:
    """All numbers that binary cells hold, one behind the other."""
    return pa.array(np.frombuffer(b"".join(x for c in cells.chunks for x in c.to_pylist()), kind).astype(np.int32))


def token_windows(docs: DataFrame, p: Params | None = None, tokenizer: tokencount.Params | None = None) -> DataFrame:
    """window_id, tier, step_group, n_tokens, doc_ids, pieces, lengths, token_ids: one row for each window.

    ``lengths`` cuts ``token_ids`` into the pieces, in order; the pieces of a document, in order, are its tokens.  A document
    without tokens has a row of its own with a null window_id."""
    p = p or Params()
    spark = docs.sparkSession
    small_batches(spark)
    store = Written(spark)
    stored = width(tokenizer or tokencount.Params())
    tokens = docs.select(col("doc_id").alias("doc_id"), row_key(docs).alias("key"), F.posexplode(token_pieces(docs, max(p.tiers), tokenizer)).alias("piece", "tokens"))
    rows = store.put(tokens.select("doc_id", "key", "piece", F.expr(f"cast(octet_length(tokens) div {np.dtype(stored).itemsize} as int)").alias("n_tokens"), "tokens"), "tokens")
    pieces = spread(rows.where("n_tokens > 0"), p, store, True)
    kind = rows.schema["doc_id"].dataType
    ints = T.ArrayType(T.IntegerType())
    fields = [("window_id", T.StringType()), ("tier", T.IntegerType()), ("step_group", T.StringType()), ("n_tokens", T.IntegerType()), ("doc_ids", T.ArrayType(kind)), ("pieces", ints), ("lengths", ints), ("token_ids", ints)]
    tiers = sorted(p.tiers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = shard_of(batches)
        if got is None:
            return
        t, shard, order, n = got
        window, offset, tier, group = pack([n[i] for i in order], p)
        inside: list[list[int]] = [[] for _ in tier]
        for i, w in enumerate(window):
            inside[w].append(i)
        for at in range(0, len(tier), 64):
            some = range(at, min(at + 64, len(tier)))
            rows = [order[i] for w in some for i in sorted(inside[w], key=offset.__getitem__)]
            ends = np.cumsum([0, *(len(inside[w]) for w in some)]).astype(np.int32)
            part = t.take(rows)
            ids, flat = part["doc_id"].combine_chunks(), numbers(part["tokens"], stored)
            sizes = np.array([n[i] for i in rows], np.int64)
            long = np.r_[0, np.cumsum(sizes)][ends].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), v) for e, v in ((ends, ids), (ends, part["piece"].combine_chunks()), (ends, part["n_tokens"].combine_chunks()), (long, flat))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{shard}-{w}" for w in some], pa.string()),
                    pa.array([tiers[tier[w]] for w in some], pa.int32()),
                    pa.array([f"{shard}-{tiers[tier[w]]}-{group[w]}" for w in some], pa.string()),
                    pa.array(np.diff(long), pa.int32()),
                    *lists,
                ],
                names=[f for f, _ in fields],
            )

    done = pieces.mapInArrow(run, struct(*fields))
    alone = rows.where("n_tokens = 0").select(*[F.lit(None).cast(k).alias(c) for c, k in fields[:3]], F.lit(0).alias("n_tokens"), F.array("doc_id").alias("doc_ids"), *[F.array(F.lit(x)).cast(ints).alias(c) for c, x in (("pieces", 0), ("lengths", 0))], F.array().cast(ints).alias("token_ids"))
    return done.unionByName(alone)
