"""Information-theoretic sanitisation.

Protected entities c are the values of personal identifiers and credentials (mail and IP addresses,
phone, card, account and social numbers, keys and passwords), and each class of these values as a whole.
IC(c) = log2(N / n_c) over all N documents; a term t discloses c by PMI(c; t) = log2(n_ct N / (n_c n_t)), where n_ct counts
documents in which t stands within ``window`` words of c and n_t all documents with t.  PMI(c; c) = IC(c), so
every mention of c itself exceeds any threshold and is generalised to its class, ``[EMAIL]``.  A term
with PMI / IC >= ``remove_at`` is removed, one >= ``generalise_at`` becomes ``[WORD]`` (``[NUMBER]`` if it has digits).
A term that discloses a value (a person's name beside one mail address) goes in whatever document it stands.  A term that
discloses a class (the ``token =`` before keys) tells what stood beside it, so it goes within ``window`` words of the
entities of that class; as few values stand in several documents, this is where most evidence is.  For a class, n_ct / n_t is taken at
the lower end of its 95 % (Wilson) interval, so that a few meetings by chance don't disclose it.  Names of persons are no class;
they are found as terms.

Documents are distinct texts in all these counts: copies of one text (rows equal in the 64-bit hash of
the whole text) are one observation.  A pair (c, t) needs ``min_joint`` independent documents.  Edited copies of one
text are not: texts that agree in the smallest hash of the word pairs beyond the windows are one, and since edits change
that hash for some copies, each text that repeats one takes ``stray`` off the number.  (Texts with fewer than 8 pairs beyond
the windows are taken as they are.)  Both are shares of counts, alike at every size.

Classes are sought in the order credential, mail, IP, social, card, phone, account number; what one
takes the next cannot.  Counts cover all documents and whole texts.  Only entity windows and text hashes are shuffled;
n_t is counted map-side in one pass for the terms in question, which are broadcast: themselves up to ``slice_terms``, beyond
that as a Bloom filter of 16 MB, whose false hits the join with the terms drops.  The rows with
a term are counted by how many copies their text has, and each count is divided by it.  The terms that disclose something are broadcast
to the one rewriting pass in slices of ``slice_terms``; about 100 bytes a term in each worker.

Edge cases: a null text stays null with zero counts, an empty one empty.  Entities of a
class are taken from left to right, the longest first, and never overlap.  Ties of a term between entities: the higher ratio counts.
Letters of the words before credentials are ASCII, of either case.
Repeated rows are each rewritten, and count as one document.  A document without entities and disclosing terms returns
unchanged, to the byte.  An empty table gives no rows.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, col, small_batches

WORDS = re.compile(r"\w+")
DIGITS = re.compile(r"\d\d|\d\.\d")  # without one of these no pattern of NUMBERS can match
CREDENTIAL = re.compile(
    r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[pousr]_\w{20,}|(?<!\w)xox[abprs]-[\w-]{10,}|(?<!\w)sk-[\w-]{16,}|(?<!\w)eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*"
    r"|-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)"
    r"|(?ai:(?<=password)|(?<=passwd)|(?<=secret)|(?<=token)|(?<=api_key)|(?<=api-key)|(?<=apikey)|(?<=pwd))[\"']?\s*[:=]\s*[\"']?(?P<value>[^\s\"',;]{6,})",
    re.S,
)
SIGNS = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "eyJ", "PRIVATE KEY")
NAMES = ("password", "passwd", "secret", "token", "api_key", "api-key", "apikey", "pwd")
EMAIL = re.compile(r"(?<![\w.+%-])\w[\w.+%-]*+(?<=[\w+%-])@[^\W_](?:[\w-]*\w)?(?:\.[^\W_](?:[\w-]*\w)?)+")
NUMBERS = [
    ("IP", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)")),
    ("SSN", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("CARD", re.compile(r"(?<![\w.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\w)|(?<![\w.])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\w)")),
    ("PHONE", re.compile(r"(?<!\w)\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)")),
    ("ACCOUNT", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)|(?<![\w.])\d{9,}(?!\w)")),
]


@dataclass
class Params:
    window: int = 10
    min_joint: int = 3
    remove_at: float = 0.95
    generalise_at: float = 0.85
    slice_terms: int = 500_000
    stray: float = 0.25  # of a text's edited copies, how many may differ in the hash that marks them as such


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of the protected mentions, in order, without overlap."""
    found = []
    rest = text  # what earlier classes found is blanked, so that a phone number can't reach into an address
    if may_hold_credential(text):
        found += [(*(m.span("value") if m["value"] else m.span()), "CREDENTIAL") for m in CREDENTIAL.finditer(text)]
        rest = blanked(rest, found)
    if "@" in rest:
        found += (new := [(*m.span(), "EMAIL") for m in EMAIL.finditer(rest)])
        rest = blanked(rest, new)
    if DIGITS.search(rest):
        for name, pattern in NUMBERS:
            found += (new := [(*m.span(), name) for m in pattern.finditer(rest)])
            rest = blanked(rest, new)
    return sorted(found)


def may_hold_credential(text: str) -> bool:
    """Whether the text has a string without which CREDENTIAL can't match; plain searches are far cheaper than the pattern."""
    if any(s in text for s in SIGNS):
        return True
    low = text.lower()
    return any(n in low for n in NAMES)


def blanked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a control character for each one of the spans."""
    if not spans:
        return text
    parts, at = [], 0
    for a, b, _ in spans:
        parts += (text[at:a], "\x01" * (b - a))
        at = b
    return "".join(parts) + text[at:]


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def with_copies(texts: DataFrame, store: Written) -> tuple[DataFrame, int]:
    """text, copies (rows that have this text) and the number of distinct texts; only hashes are shuffled."""
    h = F.xxhash64("text")
    groups = texts.groupBy(h.alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    total = groups.agg(F.count(F.lit(1))).first()[0]
    repeated = store.put(groups.where("copies > 1"), "copies")
    n = repeated.count()
    if not n:
        return texts.withColumn("copies", F.lit(1).cast("long")), total
    side = F.broadcast(repeated) if n <= 4_000_000 else repeated  # 16 bytes a text: 64 MB at most, else a sort-merge join
    return texts.withColumn("h", h).join(side, "h", "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies")), total


def sightings(text: str, window: int) -> tuple[set[tuple[str, int, str | None]], int, int]:
    """(class, entity, term) for each term near the entity, term None: the entity itself; hash of the text; hash of what is beyond the windows."""
    spans = entities(text)
    out: set[tuple[str, int, str | None]] = set()
    if not spans:
        return out, 0, 0
    at, toks = 0, []  # words between entities; an entity is one token, (None, its hash)
    for start, end, name in spans:
        toks += [(w, 0, "") for w in WORDS.findall(text[at:start].lower())]
        toks.append((None, xxhash.xxh3_64_intdigest(f"{name} {text[start:end].lower()}") - (1 << 63), name))
        at = end
    toks += [(w, 0, "") for w in WORDS.findall(text[at:].lower())]
    beyond, rest = [], 0  # from ``rest`` on no window begins
    for i, (w, entity, name) in enumerate(toks):
        if w is not None:
            continue
        out.add((name, entity, None))
        for j in range(max(0, i - window), min(len(toks), i + window + 1)):
            term = toks[j][0]
            if term is not None:
                out.add((name, entity, term))
        beyond.append((rest, max(rest, i - window)))
        rest = max(rest, i + window + 1)
    beyond.append((rest, max(rest, len(toks))))
    whole = text_hash(text)
    pairs = {f"{toks[j][0]} {toks[j + 1][0]}" for a, b in beyond for j in range(a, b - 1)}
    mark = min(map(text_hash, pairs)) if len(pairs) >= 8 else whole
    return out, whole, mark


def observations(text: str, window: int) -> dict[tuple[int, str | None], int]:
    """(entity, term) -> hash of the whole text, for each term near the entity; term None: the entity itself."""
    seen, whole, _ = sightings(text, window)
    return {(entity, term): whole for _, entity, term in seen}


class Bloom:
    """A set of 64-bit hashes in 16 MB; may say yes too often."""

    BITS, HASHES = 27, 4

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = np.zeros(1 << (self.BITS - 3), np.uint8) if bits is None else bits

    def at(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(self.HASHES):
            yield (hashes + np.uint64(k) * step) & np.uint64((1 << self.BITS) - 1)

    def add(self, hashes: np.ndarray) -> None:
        for i in self.at(hashes):
            np.bitwise_or.at(self.bits, i >> np.uint64(3), np.uint8(1) << (i & np.uint64(7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for i in self.at(hashes):
            out &= (self.bits[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def hashes_of(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def wanted_terms(terms: DataFrame, most: int):
    """The terms as a set, or the bits of a Bloom filter if they are many; the filter is filled by up to 8 tasks."""
    if terms.count() <= most:
        return frozenset(r.term for r in terms.toLocalIterator())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom()
        for b in batches:
            own.add(hashes_of(b["term"].to_pylist()))
        yield pa.RecordBatch.from_pydict({"bits": [own.bits.tobytes()]})

    all_bits = Bloom()
    for r in terms.coalesce(8).mapInArrow(fill, "bits binary").toLocalIterator():
        all_bits.bits |= np.frombuffer(r.bits, np.uint8)
    return all_bits.bits


def count_terms(texts: DataFrame, terms: DataFrame, p: Params) -> DataFrame:
    """term, n_t (distinct texts that have it) from (text, copies), in one pass; has terms besides those asked for."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted_terms(terms, p.slice_terms))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        exact = isinstance(wanted, frozenset)
        bloom = None if exact else Bloom(wanted)
        for b in batches:
            found: list[str] = []
            copies: list[int] = []
            for text, n in zip(b["text"].to_pylist(), b["copies"].to_pylist(), strict=True):
                words = WORDS.findall(text.lower())
                if exact:
                    some = wanted.intersection(words)
                else:
                    own = list(set(words))
                    some = [w for w, yes in zip(own, bloom.has(hashes_of(own)).tolist(), strict=True) if yes]
                found += some
                copies += [n] * len(some)
            yield pa.RecordBatch.from_pydict({"term": pa.array(found, pa.string()), "copies": pa.array(copies, pa.int64())})

    rows = texts.mapInArrow(hits, "term string, copies long").groupBy("term", "copies").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n_t"))


def disclosing(docs: DataFrame, p: Params) -> DataFrame:
    """cls, term, ratio: the terms over a threshold, with cls null those that disclose a value, else those that disclose the class."""
    spark = docs.sparkSession
    store = Written(spark)
    texts = docs.select(col("text").alias("text")).where("text is not null")
    window = p.window
    kind = pa.schema([("cls", pa.string()), ("entity", pa.int64()), ("term", pa.string()), ("whole", pa.int64()), ("mark", pa.int64())])

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)
        for b in batches:
            for text in b["text"]:
                seen, whole, mark = sightings(text.as_py(), window)
                rows += [(None, e, t, whole, mark) for _, e, t in seen]
                rows += [(c, 0, t, whole, mark) for c, t in {(c, t) for c, _, t in seen}]
                if len(rows) > 20_000:
                    yield packed()
                    rows.clear()
        yield packed()

    seen = texts.mapInArrow(observe, "cls string, entity long, term string, whole long, mark long").groupBy("cls", "entity", "term", "mark").agg(F.count_distinct("whole").alias("n"))
    seen = store.put(seen.groupBy("cls", "entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("marks")), "seen")
    joint = seen.where(F.col("term").isNotNull() & (F.col("marks") - F.lit(p.stray) * (F.col("n") - F.col("marks")) >= p.min_joint))
    terms = store.put(joint.select("term").distinct(), "terms")
    if terms.isEmpty():
        return spark.createDataFrame([], "cls string, term string, ratio double")
    texts, n_docs = with_copies(texts, store)
    alone = seen.where("term is null").select("cls", "entity", F.col("n").alias("n_c")).where(F.col("n_c") < n_docs)
    # few entities reach the number that a term needs: they are looked up by a join on both
    both = joint.alias("j").join(alone.alias("a"), F.col("j.entity").eqNullSafe(F.col("a.entity")) & F.col("j.cls").eqNullSafe(F.col("a.cls")))
    both = both.select("j.cls", "j.term", "j.n", "a.n_c").join(count_terms(texts, terms, p), "term")
    share, z = F.col("n") / F.col("n_t"), 1.96
    low = (share + z * z / (2 * F.col("n_t")) - z * F.sqrt(share * (1 - share) / F.col("n_t") + z * z / (4 * F.col("n_t") * F.col("n_t")))) / (1 + z * z / F.col("n_t"))
    rate = F.col("n_c") / F.lit(float(n_docs))
    ratio = F.log2(F.when(F.col("cls").isNull(), share).otherwise(low) / rate) / -F.log2(rate)
    out = both.withColumn("ratio", ratio).groupBy("cls", "term").agg(F.max("ratio").alias("ratio"))
    return store.put(out.where(F.col("ratio") >= p.generalise_at), "disclosing")


def disclosing_terms(docs: DataFrame, p: Params) -> DataFrame:
    """term, ratio (PMI / IC, the highest over entities): the terms over a threshold that disclose values."""
    return disclosing(docs, p).where("cls is null").select("term", "ratio")


def near_entities(text: str, spans: list[tuple[int, int, str]], near: dict[str, dict[str, float]], window: int) -> dict[tuple[int, int], float]:
    """Places of the terms that disclose the class of an entity within ``window`` words (an entity is one word), with their ratios."""
    words, out = [], {}
    at = 0
    for start, end, name in spans:
        words += [(m.start() + at, m.end() + at, m[0].lower(), None) for m in WORDS.finditer(text[at:start])]
        words.append((start, end, "", name))
        at = end
    words += [(m.start() + at, m.end() + at, m[0].lower(), None) for m in WORDS.finditer(text[at:])]
    for i, (_, _, _, name) in enumerate(words):
        terms = near.get(name) if name else None
        if terms:
            for a, b, w, other in words[max(0, i - window) : i + window + 1]:
                if other is None and w in terms:
                    out[a, b] = max(terms[w], out.get((a, b), 0.0))
    return out


def rewrite(text: str, terms: dict[str, float], remove_at: float, near: dict[str, dict[str, float]] | None = None, window: int = 10) -> tuple[str, int, int, int]:
    """(text, entities generalised, terms generalised, terms removed).  terms: those that go everywhere; near: class -> those beside its entities."""
    found = entities(text)
    spans = [(a, b, f"[{name}]") for a, b, name in found]
    soft = hard = 0
    places = near_entities(text, found, near, window) if near and found else {}
    if places or (terms and not terms.keys().isdisjoint(map(str.lower, WORDS.findall(text)))):
        ends = [b for _, b, _ in spans]
        k, extra = 0, []
        for m in WORDS.finditer(text):
            ratio = max(terms.get(m[0].lower(), 0.0), places.get(m.span(), 0.0))
            if not ratio:
                continue
            while k < len(spans) and ends[k] <= m.start():
                k += 1
            if k < len(spans) and spans[k][0] < m.end():
                continue  # inside an entity
            if ratio >= remove_at:
                extra.append((*m.span(), ""))
                hard += 1
            else:
                extra.append((*m.span(), "[NUMBER]" if any(map(str.isdigit, m[0])) else "[WORD]"))
                soft += 1
        spans = sorted(spans + extra)
    if not spans:
        return text, 0, 0, 0
    parts, at = [], 0
    for a, b, mark in spans:
        parts += (text[at:a], mark)
        at = b
    return "".join(parts) + text[at:], len(found), soft, hard


def rewritten_column(docs: DataFrame, p: Params):
    """struct<text, n_entities, n_generalised, n_removed>."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    slices, part = [], []
    for r in disclosing(docs, p).orderBy("cls", "term").toLocalIterator():
        part.append((r.cls, r.term, r.ratio))
        if len(part) == p.slice_terms:
            slices.append(context.broadcast(part))
            part = []
    slices.append(context.broadcast(part))
    kind = pa.struct([("text", pa.string()), ("n_entities", pa.int32()), ("n_generalised", pa.int32()), ("n_removed", pa.int32())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        terms: dict[str, float] = {}
        near: dict[str, dict[str, float]] = {}
        for shared in slices:
            for cls, term, ratio in shared.value:
                (terms if cls is None else near.setdefault(cls, {}))[term] = ratio
        for texts in batches:
            rows = [(None, 0, 0, 0) if t is None else rewrite(t, terms, p.remove_at, near, p.window) for t in texts.to_pylist()]
            cols = [[r[i] for r in rows] for i in range(4)]
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], fields=list(kind))

    return F.arrow_udf(run, "text string, n_entities int, n_generalised int, n_removed int")(col("text"))


def sanitise(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, text, n_entities, n_generalised, n_removed: one row for each input row."""
    return docs.select(col("doc_id"), rewritten_column(docs, p or Params()).alias("r")).select("doc_id", "r.*")


def sanitise_text(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """The documents with sanitised ``text``; all other columns as they were."""
    return docs.withColumn("text", rewritten_column(docs, p or Params()).getField("text"))
