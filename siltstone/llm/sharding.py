"""Sharding by a two-pass external shuffle.

Pass 1 scatters records uniformly into buckets that fit in memory, by a seeded hash of the record;
the number of buckets follows from the corpus' bytes.  Pass 2 holds one bucket at a time, brings
it into a canonical order and shuffles it by Fisher-Yates with a generator seeded by (seed,
bucket).  Partition i of the result is bucket i in its final order, so that writing it yields one
file a shard.  The result depends on the rows and the seed alone, not on files, tasks or retries.

Records that repeat, by any number, are counted first (map-side); one of each is then spread as so many copies, each
with its number in its hash, so that no bucket gets them all.

Edge cases: null columns and null ids are hashed and ordered like values.  Equal records (by 128 bits of hash) keep
their number; their mutual order has no meaning.  Maps at any depth are hashed as JSON text.  A record larger than a bucket
makes its bucket that large.  An empty table gives no rows.  Input columns named ``shard`` or
``position`` are returned as ``shard_src`` and ``position_src``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, col, small_batches, without_clash


@dataclass
class Params:
    seed: int = 20240
    bucket_bytes: int = 48 << 20  # text and columns of a bucket, uncompressed


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A permutation of range(n): swap each place, last first, with a random one up to it."""
    order = list(range(n))
    if n > 1:
        draw = np.random.default_rng([seed, bucket]).random(n)
        top = np.arange(n, 0, -1)
        for i, j in zip(range(n - 1, 0, -1), (draw * top).astype(np.int64).tolist(), strict=False):
            order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def record_hash(df: DataFrame, seed: int) -> Column:
    """Seeded 64-bit hash of a whole record; columns that hold maps, which have no hash, enter as JSON text."""
    parts = [F.lit(seed)]
    for f in df.schema.fields:
        c = col(f.name)
        parts += [c.isNull(), F.to_json(F.struct(c)) if holds_map(f.dataType) else c]
    return F.xxhash64(*parts)


def holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and holds_map(kind.elementType))


def with_copy_numbers(df: DataFrame, seed: int) -> DataFrame:
    """The rows with ``shard`` and ``position``: two hashes of the record and, if it repeats, the number of the copy."""
    hashed = df.withColumn("shard", record_hash(df, seed)).withColumn("position", record_hash(df, seed + 1))
    store = Written(df.sparkSession)
    again = store.put(hashed.groupBy("shard", "position").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    n = again.count()
    if not n:
        return hashed
    side = F.broadcast(again) if n <= 1_000_000 else again  # 24 bytes a record
    once = hashed.join(side.drop("n"), ["shard", "position"], "left_anti")
    rest = hashed.join(side.drop("n"), ["shard", "position"], "left_semi").groupBy("shard", "position").agg(F.first(F.struct(*[col(c) for c in df.columns])).alias("record"))
    copies = rest.join(side, ["shard", "position"]).select("record", "shard", "position", F.explode(F.expr("sequence(0L, n - 1)")).alias("copy"))
    copies = copies.select("record.*", F.xxhash64("shard", "copy").alias("shard"), F.xxhash64("position", "copy").alias("position"))
    return once.select(*[col(c) for c in df.columns], "shard", "position").unionByName(copies)


def total_bytes(df: DataFrame) -> int:
    """Bytes of all records: strings and binaries by length, other columns 8 each."""
    parts = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            parts.append(F.coalesce(F.octet_length(col(f.name)), F.lit(0)).cast("long"))
        elif isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType):
            parts.append(F.length(F.to_json(F.struct(col(f.name)))).cast("long"))
        else:
            parts.append(F.lit(8).cast("long"))
    each = parts[0]
    for x in parts[1:]:
        each = each + x
    return df.agg(F.sum(each)).first()[0] or 0


def shuffle(df: DataFrame, p: Params | None = None) -> DataFrame:
    """All columns, shard, position (from 0 in each shard), in shard and position order."""
    p = p or Params()
    small_batches(df.sparkSession)
    df = without_clash(df, ("shard", "position"))
    n = max(1, math.ceil(total_bytes(df) / p.bucket_bytes))
    seed, names = p.seed, df.columns
    hashed = with_copy_numbers(df, seed).withColumn("shard", F.pmod("shard", F.lit(n)).cast("int"))
    out_type = T.StructType([*hashed.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        bucket = held[0]["shard"][0].as_py()
        order = pc.sort_indices(pa.chunked_array([b["position"] for b in held])).to_numpy().astype(np.int64)
        order = order[fisher_yates(len(order), seed, bucket)]
        place = held[0].schema.get_field_index("position")
        offsets = np.cumsum([0, *(b.num_rows for b in held)])
        for at in range(0, len(order), 512):
            part = order[at : at + 512]
            which = np.searchsorted(offsets, part, side="right") - 1
            pieces, back = [], np.empty(len(part), np.int64)
            done = 0
            for k in np.unique(which):
                mine = np.flatnonzero(which == k)
                pieces.append(held[k].take(pa.array(part[mine] - offsets[k])))
                back[mine] = np.arange(done, done + len(mine))
                done += len(mine)
            got = pa.Table.from_batches(pieces).take(pa.array(back)).combine_chunks().to_batches()[0]
            yield got.set_column(place, got.schema.field(place), pa.array(np.arange(at, at + len(part), dtype=np.int64)))

    # the bucket is the partition: no second hash, hence no two buckets in one task
    return hashed.repartitionById(n, F.col("shard")).mapInArrow(run, out_type).select(*[col(c) for c in names], "shard", "position")


def write_shards(df: DataFrame, path: str, p: Params | None = None) -> DataFrame:
    """Shuffle and write one Parquet file a shard; rows lie in their final order."""
    shuffle(df, p).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
