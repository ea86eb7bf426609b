"""Language ID with string kernels.

Method: the blended-spectrum presence kernel k(x, y) = number of distinct character n-grams
(n = 1..4, lower case) that x and y share, normalised by sqrt(k(x,x) k(y,y)); N-grams live in 2^18
hash buckets, so that the kernel is exact over buckets.  Landmarks from each language give
Nystroem features z = K(x, L) K(L, L)^(-1/2); one-versus-rest kernel ridge regression is solved in
that space.  Scoring is a batched matrix product over presence rows: K(x, L) A with K = P B' is
P (B' A), and B' A is folded once, so that a text costs the sum of its n-grams' rows of (grams x languages).

The number of distinct n-grams, and the share of them that bounded landmarks know, depends on length.
So a text of over ``window`` characters is scored in equal windows of at most that many, which overlap
by three and cover all of it; score, margin and coverage are those of the mean over its windows.

Training rows are a bounded sample: ``train_per_language`` labelled rows of each language, those
with the smallest text hash, distinct texts.  Every character of every text is scored.

Edge cases: a null, blank or letterless text has no language (``language`` null, rejected).  A text
that shares too few of its n-grams with the landmarks, or scores two languages alike, is rejected
but keeps the best guess.  Rows with a null label are scored, not trained on.  Without labelled
rows there is no model: every text with letters has a null language and is accepted.  Repeated
rows are each scored, and train as one text; ties between languages go to the first in alphabetical order; an
empty table gives no rows; other columns are not read, so that clashing names cannot matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, free_name, small_batches

BITS = 18
ORDERS = 4
CHUNK = 1 << 20
FIELDS = "language string, score double, margin double, coverage double, accepted boolean"


@dataclass
class Params:
    train_per_language: int = 300  # bound of the training sample
    landmarks_per_language: int = 64
    ridge: float = 1e-2
    min_coverage: float = 0.5  # share of a text's n-grams that the landmarks know
    min_margin: float = 1e-3
    window: int = 1024  # characters that are scored together


class Grams:
    """Distinct n-gram buckets of a text, by a scratch table in which the last writer wins."""

    def __init__(self) -> None:
        self.scratch = np.zeros(1 << BITS, np.int32)

    def _chunk(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts, h = [], c
        for n in range(1, ORDERS + 1):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + c[n - 1 :]
            x = h ^ (h >> np.uint32(15))
            parts.append((x * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - BITS))
        ids = np.concatenate(parts)
        order = np.arange(len(ids), dtype=np.int32)
        self.scratch[ids] = order
        return ids[self.scratch[ids] == order]

    def of(self, text: str) -> np.ndarray:
        text = text.lower()
        if len(text) <= CHUNK:
            return self._chunk(text)
        step = CHUNK - ORDERS + 1
        return np.unique(np.concatenate([np.unique(self._chunk(text[i : i + CHUNK])) for i in range(0, len(text) - ORDERS + 1, step)]))


def windows(text: str, size: int) -> Iterator[str]:
    """Equal parts of at most about ``size`` characters, the n-grams across each border in the part before it."""
    n = max(1, -(-len(text) // size))
    for k in range(n):
        yield text[len(text) * k // n : len(text) * (k + 1) // n + (ORDERS - 1) * (k < n - 1)]


def has_letters(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(rows: list[tuple[str, str]], p: Params) -> dict | None:
    """rows: (language, text).  Returns the folded model: bucket -> slot, slot x language weights."""
    grams, by = Grams(), {}
    for lang, text in rows:
        if lang is not None and has_letters(text):
            by.setdefault(lang, []).append(grams.of(text))
    if not by:
        return None
    langs = sorted(by)
    landmarks = [g for lang in langs for g in by[lang][: p.landmarks_per_language]]
    known = np.unique(np.concatenate(landmarks))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[known] = np.arange(len(known), dtype=np.int32)

    def presence(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(known)), np.float32)
        for i, g in enumerate(sets):
            s = slot[g]
            out[i, s[s >= 0]] = 1 / np.sqrt(len(g))
        return out

    b = presence(landmarks)
    k_ll = (b @ b.T).astype(np.float64)
    val, vec = np.linalg.eigh(k_ll)
    keep = val > 1e-6 * val[-1]
    root = vec[:, keep] / np.sqrt(val[keep])
    every = [(j, g) for j, lang in enumerate(langs) for g in by[lang]]
    z = np.concatenate([presence([g for _, g in every[i : i + 64]]) @ b.T for i in range(0, len(every), 64)]) @ root
    y = np.full((len(every), len(langs)), -1.0)
    y[np.arange(len(every)), [j for j, _ in every]] = 1.0
    mean_z, mean_y = z.mean(0), y.mean(0)
    zc = z - mean_z
    w = np.linalg.solve(zc.T @ zc + p.ridge * np.eye(z.shape[1]), zc.T @ (y - mean_y))
    return {"langs": langs, "slot": slot, "weights": (b.T @ (root @ w)).astype(np.float32), "bias": (mean_y - mean_z @ w).astype(np.float32)}


def score(texts: list[str | None], model: dict | None, p: Params) -> list[tuple]:
    """(language, score, margin, coverage, accepted) of each text."""
    out: list[tuple] = [(None, None, None, None, False)] * len(texts)
    live = [i for i, t in enumerate(texts) if has_letters(t)]
    if model is None:
        for i in live:
            out[i] = (None, None, None, None, True)
        return out
    grams, slot, weights, langs = Grams(), model["slot"], model["weights"], model["langs"]
    for i in live:
        got, cover, n = np.zeros(len(langs)), 0.0, 0
        for part in windows(texts[i].lower(), p.window):
            g = grams._chunk(part)
            s = slot[g]
            s = s[s >= 0]
            got += weights[s].sum(0) / np.sqrt(len(g))
            cover += len(s) / len(g)
            n += 1
        got, cover = got / n + model["bias"], cover / n
        best = int(got.argmax())
        top = got[best]
        gap = top - np.delete(got, best).max() if len(langs) > 1 else np.inf
        ok = bool(cover >= p.min_coverage and gap >= p.min_margin)
        out[i] = (langs[best], float(top), float(gap) if np.isfinite(gap) else None, float(cover), ok)
    return out


def sample(docs: DataFrame, p: Params) -> list[tuple[str, str]]:
    """The training rows: per language the distinct texts of smallest hash, up to the bound."""
    h = F.xxhash64(F.col("text"))
    labelled = docs.select(col("lang").alias("lang"), col("text").alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy("h")
    # only distinct (language, hash) travel here, combined before the exchange, so that copies of a text take one place
    texts = labelled.select("lang", h.alias("h")).distinct()
    chosen = texts.withColumn("r", F.row_number().over(first)).where(F.col("r") <= p.train_per_language)
    kept = {(r.lang, r.h) for r in chosen.select("lang", "h").collect()}
    if not kept:
        return []
    wanted = docs.sparkSession.createDataFrame(sorted(kept), "lang string, h long")
    rows = labelled.withColumn("h", h).join(F.broadcast(wanted), ["lang", "h"]).dropDuplicates(["lang", "h"])
    return [(r.lang, r.text) for r in sorted(rows.collect(), key=lambda r: (r.lang, r.h))]


def fit(docs: DataFrame, p: Params) -> dict | None:
    return train(sample(docs, p), p)


def scored_column(docs: DataFrame, p: Params):
    """A struct column with the result for ``text``, made by one Arrow pass over whole texts."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, p))
    kind = pa.struct([("language", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("coverage", pa.float64()), ("accepted", pa.bool_())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model.value
        for texts in batches:
            cols = list(zip(*score(texts.to_pylist(), m, p), strict=True)) or [()] * 5
            yield pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))

    return F.arrow_udf(run, FIELDS)(col("text"))


def identify(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, language, score, margin, coverage, accepted: one row for each input row."""
    return docs.select(col("doc_id"), scored_column(docs, p or Params()).alias("r")).select("doc_id", "r.*")


def keep_identified(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    name = free_name(docs, "accepted__")
    scored = docs.withColumn(name, scored_column(docs, p or Params()).getField("accepted"))
    return scored.where(col(name)).drop(name)
