"""k-means over all rows of numeric features, with the number of clusters chosen by the silhouette of all rows.

Passes go over the rows, and a task returns sums only.  Up to ``candidates`` points, drawn by k-means||, are weighted with
the rows nearest to them, and each number of clusters with each restart is fitted on these: that is where it starts from.
Lloyd's rounds then go over all rows, all fits in one pass, until the centres stand still.  The silhouette is that of squared
distances, which sums make exact in one pass; with plain distances it would take all pairs of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types
from ..functions.stats import quoted
from ..model import Dataset, Relationship
from . import naming

ROUNDS, STILL = 300, 1e-9  # of Lloyd; what all centres of a fit may move, squared, once they stand still
SETTLED = 1e-4  # the same for passes over a table: scikit-learn's default, with which the reference fits
BLOCK = 2048  # rows whose distances to all centres of all fits lie in memory at once


@dataclass
class Limits:
    candidates: int = 1024
    min_rows: int = 50
    k_min: int = 2
    k_max: int = 8
    silhouette_rows: int = 5000
    max_features: int = 20
    seed: int = 0
    restarts: int = 10


@dataclass
class Clusters:
    features: list[str]
    k: int
    sizes: list[int]
    centroids: list[dict[str, float]]
    inertia: float
    sweep: list[tuple[int, float]]
    rows: int
    dropped: int
    notes: list[str] = field(default_factory=list)


def features_of(d: Dataset, edges: list[Relationship], wanted: list[str] | None = None, limits: Limits | None = None) -> list[str]:
    """Numeric columns that describe: no ids, keys, constants or personal data; the caller's list where given."""
    limits = limits or Limits()
    if wanted:
        for w in wanted:
            c = d.column(w)
            if c is None or not types.is_numeric(c.data_type):
                raise ValueError(f"{w} is not a numeric column of {d.identifier}")
            if c.pii:
                raise ValueError(f"{w} is flagged as {c.pii.category}")
        chosen = list(wanted)
    else:
        fks = {c.lower() for r in edges if r.from_dataset == d.identifier for c in r.from_columns}
        chosen = [
            c.name
            for c in d.columns
            if types.is_numeric(c.data_type) and c.pii is None and not c.is_unique and c.name.lower() not in fks and not naming.id_shaped(c.name) and (c.distinct_count or 0) > 1
        ][: limits.max_features]
    if not 2 <= len(chosen) <= limits.max_features:
        raise ValueError(f"clustering needs 2 to {limits.max_features} features, found {len(chosen)}")
    return chosen


def null_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """sampled, dropped (any feature null), and nulls of each feature, over the same rows."""
    any_null = F.lit(False)
    for f in features:
        any_null = any_null | quoted(f).isNull()
    each = [F.coalesce(F.sum(quoted(f).isNull().cast("long")), F.lit(0)).alias(f"null_{f}") for f in features]
    return df.agg(F.count(F.lit(1)).alias("sampled"), F.coalesce(F.sum(any_null.cast("long")), F.lit(0)).alias("dropped"), *each)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared, rows by centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


def k_means(x: np.ndarray, k: int, seed: list[int], rounds: int = ROUNDS, weights: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Inertia and centres from a k-means++ start.  A centre that loses all its points moves to the one farthest from its own."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(x)) if weights is None else weights
    centres = x[rng.choice(len(x), p=w / w.sum())][None]
    while len(centres) < k:
        d = distances(x, centres).min(1) * w
        total = d.sum()
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))]])
    for _ in range(rounds):
        d = distances(x, centres)
        own = d.argmin(1)
        sizes = np.bincount(own, w, k)
        new = np.stack([np.bincount(own, x[:, j] * w, k) for j in range(x.shape[1])], 1) / np.where(sizes > 0, sizes, 1)[:, None]
        for lost in np.flatnonzero(sizes == 0):
            far = int(d[np.arange(len(x)), own].argmax())
            new[lost], d[far] = x[far], 0
        moved = float(((new - centres) ** 2).sum())
        centres = new
        if moved <= STILL:
            break
    return float((distances(x, centres).min(1) * w).sum()), centres


def silhouette(x: np.ndarray, own: np.ndarray) -> float:
    """For arrays in memory, by plain distances of all pairs.  Mean of (b - a) / max(a, b): a the mean distance to the row's own cluster, b that to the nearest other one; 0 for a cluster of one."""
    ids, own = np.unique(own, return_inverse=True)
    if not 1 < len(ids) < len(x):
        return -1.0
    sizes = np.bincount(own)
    member = np.eye(len(ids))[own]
    out = np.zeros(len(x))
    for at in range(0, len(x), 1000):
        i = np.arange(at, min(at + 1000, len(x)))
        sums = np.sqrt(distances(x[i], x)) @ member
        mine = sizes[own[i]]
        a = sums[np.arange(len(i)), own[i]] / np.maximum(mine - 1, 1)
        means = sums / sizes
        means[np.arange(len(i)), own[i]] = np.inf
        b = means.min(1)
        out[i] = np.where(mine > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0)
    return float(out.mean())


def hash_order(rows: DataFrame, features: list[str], limits: Limits) -> DataFrame:
    return rows.orderBy(F.xxhash64(F.lit(limits.seed), *[quoted(f) for f in features]), *[quoted(f) for f in features])


def probe_rows(rows: DataFrame, features: list[str], limits: Limits) -> DataFrame:
    """Some rows from all over the table, those of smallest seeded hash.  cluster() reads all rows and doesn't use it."""
    return hash_order(rows, features, limits).limit(limits.silhouette_rows)


def blocks(batches: Iterable[pa.RecordBatch], mean: np.ndarray, spread: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows and their standard scores, some at a time."""
    for b in batches:
        for packed in b[0]:
            raw = np.frombuffer(packed.as_buffer()).reshape(-1, len(mean))
            for at in range(0, len(raw), BLOCK):
                yield raw[at : at + BLOCK], (raw[at : at + BLOCK] - mean) / spread


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as the bytes of one array, rows by features."""
    for b in batches:
        raw = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) + 0.0
        yield pa.RecordBatch.from_arrays([pa.array([raw.tobytes()], pa.binary())], names=["rows"])


def uniform(raw: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each row, and the number in (0, 1) that it stands for: the same for equal rows, wherever they lie."""
    h = np.full(len(raw), salt, np.uint64)
    for j in range(raw.shape[1]):
        h = (h ^ np.ascontiguousarray(raw[:, j]).view(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    return h, ((h >> np.uint64(11)).astype(float) + 0.5) / 2**53


def nearest(x: np.ndarray, fits: np.ndarray) -> np.ndarray:
    """For each fit (fits, k, features) and row the centre next to it, the first one of equals."""
    r, k, f = fits.shape
    flat = np.concatenate([-2 * fits, (fits * fits).sum(2, keepdims=True)], 2).swapaxes(0, 1).reshape(k * r, f + 1)
    d = (flat @ np.concatenate([x, np.ones((len(x), 1))], 1).T).reshape(k, r, len(x))
    kind = np.int8 if k < 128 else np.int32
    best, own = d[0], np.zeros((r, len(x)), kind)
    for j in range(1, k):
        np.maximum(own, (d[j] < best).view(np.int8) * kind(j), out=own)
        best = np.minimum(best, d[j])
    return own


class Rows:
    """The complete rows of a table, read once and kept in packed form, 8 bytes a number, in memory or on disk until close()."""

    def __init__(self, df: DataFrame, features: list[str]):
        cols = [quoted(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)]
        of = [F.col(f"f{i}") for i in range(len(features))]
        whole = F.lit(True)
        for c in of:
            whole = whole & c.isNotNull() & ~F.isnan(c)
        numbers = df.select(*cols)
        each = [g for i, c in enumerate(of) for g in (F.avg(F.when(whole, c)).alias(f"mean{i}"), F.stddev_pop(F.when(whole, c)).alias(f"spread{i}"), F.count_if(c.isNull()).alias(f"null{i}"))]
        got = numbers.agg(F.count(F.lit(1)).alias("all"), F.count_if(whole).alias("n"), *each).first()
        self.width, self.all, self.n = len(features), got["all"], got["n"]
        packed, tasks = numbers.where(whole).mapInArrow(pack, "rows binary"), min(df.sparkSession.sparkContext.defaultParallelism, -(-self.n // 10000))
        self.frame = (packed.repartition(tasks) if numbers.rdd.getNumPartitions() < tasks else packed).persist()
        self.nulls = [got[f"null{i}"] for i in range(len(features))]
        self.mean = np.array([got[f"mean{i}"] or 0.0 for i in range(len(features))])
        self.spread = np.array([got[f"spread{i}"] or 1.0 for i in range(len(features))])

    def collect(self, work: Callable[[Iterator[tuple[np.ndarray, np.ndarray]]], np.ndarray]) -> list[np.ndarray]:
        """What the work makes of each task's blocks, in the order of tasks."""
        mean, spread = self.mean, self.spread

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([work(blocks(batches, mean, spread)).tobytes()], pa.binary())], names=["part"])

        return [np.frombuffer(r.part) for r in self.frame.mapInArrow(task, "part binary").collect()]

    def close(self) -> None:
        self.frame.unpersist()

    def draw(self, many: int, salt: int, apart: np.ndarray | None = None) -> np.ndarray:
        """Distinct points, raw: each as likely as any other, or in proportion to the squared distance from the points given."""
        width = self.width

        def least(keys: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(keys, return_index=True)  # equal rows have equal keys
            return keys[:many], points[at[:many]]

        def work(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            kept, points = np.zeros(0), np.zeros((0, width))
            for raw, x in parts:
                key = uniform(raw, salt)[1]
                if apart is not None:
                    d = distances(x, apart).min(1)
                    far = d > 1e-12 * (1 + (x * x).sum(1))
                    raw, key = raw[far], -np.log(key[far]) / d[far]
                if len(kept) == many:
                    raw, key = raw[key < kept[-1]], key[key < kept[-1]]
                if len(key):
                    kept, points = least(np.concatenate([kept, key]), np.concatenate([points, raw]))
            return np.concatenate([kept[:, None], points], 1)

        got = np.concatenate([p.reshape(-1, width + 1) for p in self.collect(work)])
        return least(got[:, 0], got[:, 1:])[1]

    def summary(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows next to each of the points: their number and mean."""
        width = self.width

        def work(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            sums = np.zeros((len(points), width + 1))
            for _, x in parts:
                own = distances(x, points).argmin(1)
                sums[:, 0] += np.bincount(own, minlength=len(points))
                for j in range(width):
                    sums[:, j + 1] += np.bincount(own, x[:, j], len(points))
            return sums

        sums = sum(p.reshape(-1, width + 1) for p in self.collect(work))
        sums = sums[sums[:, 0] > 0]
        return sums[:, 0], sums[:, 1:] / sums[:, :1]

    def assign(self, fits: list[np.ndarray]) -> list[np.ndarray]:
        """Of each centre of each fit the rows next to it: number, sums, sum of squared lengths."""
        width = self.width

        def work(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            sums = [np.zeros((*f.shape[:2], width + 2)) for f in fits]
            for _, x in parts:
                of = np.concatenate([np.ones((len(x), 1)), x, (x * x).sum(1, keepdims=True)], 1)
                for f, s in zip(fits, sums, strict=True):
                    own = nearest(x, f)
                    for j in range(f.shape[1]):
                        s[:, j] += (own == j).astype(float) @ of
            return np.concatenate([s.ravel() for s in sums])

        flat, out, at = sum(self.collect(work)), [], 0
        for f in fits:
            size = f.shape[0] * f.shape[1] * (width + 2)
            out.append(flat[at : at + size].reshape(*f.shape[:2], width + 2))
            at += size
        return out

    def farthest(self, centres: np.ndarray) -> np.ndarray:
        def work(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            most, point = -1.0, np.zeros(centres.shape[1])
            for _, x in parts:
                d = distances(x, centres).min(1)
                if d.max() > most:
                    most, point = d.max(), x[d.argmax()]
            return np.concatenate([[most], point])

        return max(self.collect(work), key=lambda p: (p[0], p[1:].tolist()))[1:]

    def silhouettes(self, fits: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
        """Of each fit (centres, sums of assign) over all rows.  A row's mean squared distance to a cluster is that to the mean plus the cluster's variance."""
        known = []
        for centres, s in fits:
            means = s[:, 1:-1] / np.maximum(s[:, :1], 1)
            known.append((centres, s[:, 0], means, np.maximum(s[:, -1] / np.maximum(s[:, 0], 1) - (means * means).sum(1), 0)))

        def work(parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
            out = np.zeros(len(known))
            for _, x in parts:
                at = np.arange(len(x))
                for i, (centres, sizes, means, variance) in enumerate(known):
                    own = nearest(x, centres[None])[0]
                    d = np.where(sizes > 0, distances(x, means) + variance, np.inf)
                    mine = sizes[own]
                    a = d[at, own] * mine / np.maximum(mine - 1, 1)
                    d[at, own] = np.inf
                    b = d.min(1)
                    out[i] += np.where(mine > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()
            return out

        return [float(v) / self.n for v in sum(self.collect(work))]


def within(sums: np.ndarray) -> float:
    """Inertia around the means."""
    return float(np.maximum(sums[:, -1] - (sums[:, 1:-1] ** 2).sum(1) / np.maximum(sums[:, 0], 1), 0).sum())


def same(a: np.ndarray, b: np.ndarray) -> bool:
    d = distances(a, b)
    return sorted(d.argmin(1)) == list(range(len(a))) and float(d.min(1).sum()) <= STILL


def lloyd(rows: Rows, fits: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(centres, sums of assign) of each fit once it stands still; all fits share the passes.  A centre that loses all its rows moves to the row farthest from its own."""
    done: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(fits)
    now = list(fits)
    for turn in range(ROUNDS):
        open_ = [i for i, d in enumerate(done) if d is None]
        if not open_:
            break
        by_size: dict[int, list[int]] = {}
        for i in open_:
            by_size.setdefault(len(now[i]), []).append(i)
        got = rows.assign([np.stack([now[i] for i in g]) for g in by_size.values()])
        for i, s in ((i, s) for g, many in zip(by_size.values(), got, strict=True) for i, s in zip(g, many, strict=True)):
            lost = np.flatnonzero(s[:, 0] == 0)
            new = np.where(s[:, :1] > 0, s[:, 1:-1] / np.maximum(s[:, :1], 1), now[i])
            if turn == ROUNDS - 1 or not len(lost) and float(((new - now[i]) ** 2).sum()) <= SETTLED:
                done[i] = (now[i], s)
                continue
            if len(lost):
                new[lost[0]] = rows.farthest(now[i])
            now[i] = new
    return done


def cluster(df: DataFrame, features: list[str], limits: Limits | None = None, k: int | None = None) -> Clusters:
    limits = limits or Limits()
    if k is not None and k < 2:
        raise ValueError(f"k is {k}; at least 2 clusters make sense")
    rows = Rows(df, features)
    try:
        return fitted(rows, features, limits, k)
    finally:
        rows.close()


def fitted(rows: Rows, features: list[str], limits: Limits, k: int | None) -> Clusters:
    n = rows.n
    if n < max(limits.k_min, 2):
        raise ValueError(f"{n} rows without nulls are too few to cluster")
    many = max(limits.candidates, 16 * (k or limits.k_max))
    raw = rows.draw(many // 4, limits.seed)
    points = len(raw)  # all distinct ones, where they are fewer than asked for
    # no more clusters than distinct points: with as many, each would be one of its own
    if k is not None and k > points:
        raise ValueError(f"k is {k}; there are {points} distinct points")
    if points < 2:
        raise ValueError("all rows without nulls are one point")
    most = min(limits.k_max, points if points <= 2 else points - 1)
    if points == many // 4:
        for turn in (1, 2):
            more = rows.draw(many * 3 // 8, limits.seed + turn, (raw - rows.mean) / rows.spread)
            raw = np.concatenate([raw, more])
    weights, few = rows.summary((raw - rows.mean) / rows.spread)
    sizes = [k] if k else list(range(min(limits.k_min, most), most + 1))
    starts: list[np.ndarray] = []
    for size in sizes:
        for i in range(limits.restarts):
            start = k_means(few, size, [limits.seed, size, i], weights=weights)[1]
            if not any(len(s) == size and same(s, start) for s in starts):
                starts.append(start)
    fits = lloyd(rows, starts)
    best = [min((f for f in fits if len(f[0]) == size), key=lambda f: within(f[1])) for size in sizes]
    score = dict(zip(sizes, rows.silhouettes(best), strict=True))
    sweep = [(size, round(score[size], 4)) for size in sizes]
    size = max(sizes, key=lambda c: (score[c], -c))
    sums = best[sizes.index(size)][1]
    members = [(int(s[0]), (s[1:-1] / s[0] * rows.spread + rows.mean).tolist()) for s in sums if s[0] > 0]
    members.sort(key=lambda m: (-m[0], m[1]))
    counts = [m[0] for m in members]
    notes = [f"a cluster holds under 1 % of the rows ({c} of {n}): likely outliers" for c in counts if c < 0.01 * n]
    if n < limits.min_rows:
        notes.append(f"only {n} rows: clusters of so few mean little")
    if rows.all > n:
        notes.append(f"{rows.all - n} of {rows.all} rows were left out for nulls: " + ", ".join(f"{f} {c}" for f, c in zip(features, rows.nulls, strict=True) if c))
    return Clusters(features, size, counts, [dict(zip(features, m[1], strict=True)) for m in members], within(sums), sweep, n, rows.all - n, notes)
