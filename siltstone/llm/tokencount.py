"""Token counts by a map-side two-tier lookup.

The unit of the lookup is a piece: a run of pre-tokens up to the next space or line feed before a character that is no
white space.  ``PATTERN`` begins a pre-token at every such place and looks at nothing before it, so that the pre-tokens
and tokens of a piece depend on the piece alone.  A text is thus split by plain searches instead of the pattern, which
costs more than the encoding.  Patterns not in ``SPACED`` make the whole text one piece.

Tier 1 is a broadcast table piece -> numbers of pre-tokens and tokens for the pieces that are frequent in the corpus;
tier 2 is a cache in each Python worker, filled by encoding what tier 1 misses.  No text and no pre-token of a text is
shuffled: each task makes a Misra-Gries summary of at most ``frequent`` words of all its texts, and only these
summaries travel, merged in a tree.  The tables are for speed only: both hold exact lengths, so counts equal
those of the tokenizer itself.  The vocabulary is read by the driver and broadcast.

Edge cases: a null text has null counts, an empty one 0.  Special-token strings count as ordinary
text.  Whole texts are encoded, however long.  Repeated rows repeat; an empty table gives no rows;
only doc_id and text are read; doc_id keeps its type.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, small_batches, worker_cache

#: Pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: Patterns whose pre-tokens never cross a single space or line feed between two characters that are no white space.
SPACED = {PATTERN}
MARKS = ".,;:!?*#$%&+-/=<>()[]{}\"_|~^@"
BREAK = re.compile(r"(?=[ \n]\S)")
LONGEST = 64  # characters of a piece that a cache keeps


@dataclass
class Params:
    vocabulary: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = PATTERN
    frequent: int = 1 << 15  # size of tier 1 and of each summary
    cached: int = 1 << 19  # size of tier 2 in each worker
    fan_in: int = 64  # summaries merged by one task


def vocabulary(p: Params) -> bytes:
    with open(p.vocabulary, "rb") as f:
        return f.read()


def encoder(p: Params, data: bytes | None = None):
    """The tokenizer, one in each process; ``data``: the vocabulary file, else it is read."""
    home = worker_cache("tokenizers")
    key = (p.vocabulary, p.pattern)
    if key not in home:
        home[key] = new_encoder(p, data)
    return home[key]


def new_encoder(p: Params, data: bytes | None = None):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (data or vocabulary(p)).splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=p.pattern, mergeable_ranks=ranks, special_tokens={})


def splitter(p: Params):
    import regex

    return regex.compile(p.pattern).findall


class Irregular(KeyError):
    """What a plain split at spaces gives is no piece."""


class Pieces(dict):
    """Tier 1 with tier 2 behind it: a miss is measured once and kept until the table is full.

    The key of a piece is the piece without the space that it begins with; one that begins with a line feed has it, and the
    start of a text, which begins with neither, has a space instead.  Values are numbers of pre-tokens << 32 | tokens,
    which add up.  ``measure`` gives that of a piece, ``measure_all`` those of many words of letters behind one sign."""

    def __init__(self, frequent: dict[str, int], room: int, measure, measure_all):
        super().__init__(frequent)
        self.frequent, self.room, self.measure, self.measure_all = frequent, room + len(frequent), measure, measure_all

    def totals(self, texts: list[str | None]) -> list[int | None]:
        """The values of whole texts.  What they have and the table lacks is measured together."""
        held, new = [], set()
        for text in texts:
            if text is None:
                held.append((0, ()))
                continue
            pieces = text.replace("\n", " \n").split(" ")
            pieces[0] = " " + pieces[0]
            found = list(map(self.get, pieces))
            missing = list(compress(pieces, map(not_, found)))
            new.update(missing)
            held.append((sum(filter(None, found)), missing))
        self.learn(new)
        return [None if text is None else self.total(text, n, missing) for text, (n, missing) in zip(texts, held, strict=True)]

    def total(self, text: str, known: int, missing: list[str]) -> int:
        try:
            return known + sum(map(self.__getitem__, missing))
        except Irregular:
            first, *rest = BREAK.split(text)
            return sum((self.measure(first), *[self[x.removeprefix(" ")] for x in rest]))

    def learn(self, new: set[str]) -> None:
        """Measure the words of letters among new keys in two calls, instead of one a miss."""
        if len(self) + len(new) > self.room:
            self.clear()
            self.update(self.frequent)
        words = {w.rstrip(MARKS) for w in new}
        for sign, some in ((" ", [w for w in words if w.isalpha()]), ("\n", [w for w in words if w[:1] == "\n" and w[1:].isalpha()])):
            if some := [w for w in some if len(w) <= LONGEST and w not in self]:
                self.update(zip(some, self.measure_all([w.removeprefix("\n") for w in some], sign), strict=True))

    def __missing__(self, key: str) -> int:
        if not key or (key[0].isspace() and key[0] != " " and (key[0] != "\n" or len(key) == 1 or key[1].isspace())):
            raise Irregular
        word = key.rstrip(MARKS)
        if len(word) < len(key) and (word[1:] if word[:1] == "\n" else word.lstrip(" ")).isalpha():  # marks behind letters are one pre-token
            got = self[word] + self[" " + key[len(word) :]]
        else:
            got = self.measure(key[1:] if key[0] == " " else key if key[0] == "\n" else " " + key)
        if len(key) <= LONGEST and len(self) < self.room:
            self[key] = got
        return got


def trim(counts: Counter, k: int) -> Counter:
    """Misra-Gries: subtract the (k+1)-th largest count, keep what is positive."""
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def frequent_pretokens(docs: DataFrame, p: Params) -> list[str]:
    """Pieces, with the space before them, that are frequent in the whole corpus, most frequent first."""
    k = p.frequent
    kind = pa.schema([("node", pa.int64()), ("pieces", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])

    def row(node: int, counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"node": [node], "pieces": [list(counts)], "counts": [list(counts.values())]}, schema=kind)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts: Counter = Counter()
        for b in batches:
            for text in b["text"].to_pylist():
                if text:
                    counts.update(text.split())
            if len(counts) > 8 * k:
                counts = trim(counts, k)
        if counts:
            yield row(TaskContext.get().partitionId(), trim(counts, k))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        node = 0
        for b in batches:
            for node, pieces, n in zip(b["node"].to_pylist(), b["pieces"].to_pylist(), b["counts"].to_pylist(), strict=True):
                counts.update(dict(zip(pieces, n, strict=True)))
                counts = trim(counts, k) if len(counts) > 8 * k else counts
        if counts:
            yield row(node, trim(counts, k))

    schema = "node long, pieces array<string>, counts array<long>"
    texts = docs.select(col("text").alias("text"))
    level, width = texts.mapInArrow(summarise, schema), texts.rdd.getNumPartitions()
    while width > p.fan_in:
        width = -(-width // p.fan_in)
        level = level.repartition(width, F.expr(f"node div {p.fan_in}")).mapInArrow(merge, schema)
    top = level.repartition(1).mapInArrow(merge, schema).first()  # a shuffle: coalesce would summarise all texts in one task
    if top is None:
        return []
    return [" " + w for w, _ in sorted(zip(top.pieces, top.counts, strict=True), key=lambda x: (-x[1], x[0]))]


def measurer(p: Params, data: bytes | None = None):
    """piece -> number of pre-tokens << 32 | number of tokens."""
    encode, split = encoder(p, data).encode_ordinary, splitter(p)
    return lambda piece: len(split(piece)) << 32 | len(encode(piece))


def bulk_measurer(p: Params, data: bytes | None = None):
    """The same for many words of letters, each behind the sign, in one call: no other token of theirs begins with it."""
    enc = encoder(p, data)
    begins = {sign: np.array([enc.decode_single_token_bytes(i)[:1] == sign.encode() for i in range(enc.n_vocab)]) for sign in (" ", "\n")}

    def run(words: list[str], sign: str) -> list[int]:
        tokens = np.array(enc.encode_ordinary(sign + sign.join(words)), np.int64)
        at = np.flatnonzero(begins[sign][tokens])
        pretokens = 2 if sign == "\n" else 1  # a line feed is one of its own
        return ((pretokens << 32) | np.diff(np.append(at, len(tokens)))).tolist()

    return run


def packed_table(pieces: list[str], p: Params) -> tuple[str, bytes]:
    """The compact form that is broadcast: keys joined by a byte that none of them has, two lengths of a byte each."""
    measure = measurer(p)
    sized = [(w[1:], n) for w in pieces if "\0" not in w and (n := measure(w)) >> 32 < 256 and n & 0xFFFFFFFF < 256]
    return "\0".join(w for w, _ in sized), bytes(x for _, n in sized for x in (n >> 32, n & 0xFF))


def chunks(texts: list[str | None], size: int = 1 << 18) -> Iterator[list[str | None]]:
    """Neighbouring texts of about so many characters together, so that a table can hold what they bring."""
    part, n = [], 0
    for text in texts:
        part.append(text)
        n += len(text or "")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


def counted_column(docs: DataFrame, p: Params | None = None):
    """struct<n_pretokens: long, n_tokens: long> of ``text``."""
    p = p or Params()
    spark = docs.sparkSession
    small_batches(spark)
    spaced = p.pattern in SPACED
    table = packed_table(frequent_pretokens(docs, p), p) if spaced else ("", b"")
    shared = spark.sparkContext.broadcast((*table, vocabulary(p)))
    stamp = uuid.uuid4().hex
    kind = pa.struct([("n_pretokens", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        home = worker_cache("lengths")
        if home.get("stamp") != stamp:
            words, lengths, data = shared.value
            known = dict(zip(words.split("\0"), (a << 32 | b for a, b in zip(lengths[::2], lengths[1::2], strict=True)), strict=True)) if lengths else {}
            home["table"], home["stamp"] = Pieces(known, p.cached, measurer(p, data), bulk_measurer(p, data)), stamp
        pieces = home["table"]
        for batch in batches:
            out: list[int | None] = []
            for texts in chunks(batch.to_pylist()):
                out += pieces.totals(texts) if spaced else [None if t is None else pieces.measure(t) for t in texts]
            n, t = ([None if x is None else x >> 32 for x in out], [None if x is None else x & 0xFFFFFFFF for x in out])
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(t, pa.int64())], fields=list(kind))

    return F.arrow_udf(run, "n_pretokens long, n_tokens long")(col("text"))


def token_counts(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens: one row for each input row."""
    return docs.select(col("doc_id").alias("doc_id"), counted_column(docs, p).alias("r")).select("doc_id", "r.*")


def brute_counts(texts: list[str | None], p: Params) -> list[int | None]:
    """The same by the tokenizer's own pass over each text."""
    enc = encoder(p)
    return [None if t is None else len(enc.encode_ordinary(t)) for t in texts]


