"""Secret scan by dictionary-primed zstandard novelty.

Candidates are strings in a sensitive context: assigned to a name such as ``password`` or ``token``, or
to an identifier with such a part (``SECRET_KEY_BASE``), bearing a provider's prefix (``AKIA``, ``ghp_``), standing shortly behind a sensitive word or behind
another such string of its line, or a PEM block.  The compressor is primed with a dictionary of code identifiers, sensitive names and usual
placeholders, and of the corpus' own identifiers: the names without digits that values are assigned to, of which the
``corpus_names`` that stand in most documents are taken (counted over all of them, from ``min_documents`` on).  A candidate's novelty is the number of bytes by which the compressed surroundings
grow when it is put back in its place, over its length: words, placeholders and repetitions of what
stands around cost next to nothing, keys cost all their entropy.  Other occurrences of the candidate
in a sensitive context are cut from its surroundings: they would vouch for each other.  From
``min_novelty`` on it is reported.

Edge cases: null and empty texts report nothing.  Whole texts are searched, however long; a candidate is measured
against ``around`` characters on either side, so that the work is linear.  Sensitive words are told by ASCII letters of either case.  Of overlapping candidates that are novel the first is
reported, then the longest.
Each occurrence is reported at its offset (characters from 0); repeated rows repeat.  The secret itself
is never returned, only its first four characters, its length and its SHA-256.  An empty table gives
no rows; only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, small_batches

NAMES = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|auth(?:orization)?|bearer|credentials?|private[ _-]?key|client[ _-]?secret"
HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk-", "sk_live", "AIza", "eyJ", "-----BEGIN")
RULES = [
    ("pem", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(.*?)(?:-----END|\Z)", re.S)),
    ("prefix", re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk(?:-|_live_)[A-Za-z0-9_-]{16,}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]*)(?![A-Za-z0-9])")),
    # the name may go on as an identifier: _PROD, .key, Key, a plural s
    ("assigned", re.compile(rf"(?ai:{NAMES})(?:s?(?:[_.-][\w.-]{{0,100}}+|[A-Z0-9]\w{{0,100}}+)?)[\"']?\s*(?:=>|[:=])\s*[\"']?([^\s\"',;]{{8,}})")),
]
# a sensitive word, alone or as a part of an identifier: SECRET_KEY, authToken
WORD = re.compile(rf"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?ai:{NAMES})(?:s?(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
REACH = 40  # characters of a line behind a sensitive word, or behind a run in its reach, in which a run may begin
DICTIONARY = " ".join(
    """import from return class public static void const let var function def self this null none true false string int float bool
    username user name email host hostname port database db url uri path config settings environment env os.environ getenv process.env
    request response header headers Authorization Bearer Basic Content-Type application/json client server session cookie
    password passwd passphrase pwd secret token api_key apikey api-key access_key access_token refresh_token auth_token client_id client_secret
    private_key public_key aws_access_key_id aws_secret_access_key credentials credential login logout encrypt decrypt signature
    changeme change_me changeit example example_key your_api_key your-api-key your_password_here yourpassword mypassword my_password password123 passw0rd
    ${API_KEY} ${PASSWORD} ${SECRET} $TOKEN <your-token> <your-api-key> <password> <secret> {{ secrets.TOKEN }} settings.SECRET_KEY request.headers
    placeholder dummy test testing test_token sample xxxxxxxxxxxxxxxx XXXXXXXXXXXX ******** 0000000000000000 1234567890 123456789012 12345678 abcdefghijklmnopqrstuvwxyz
    ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef deadbeefdeadbeef undefined redacted REDACTED hidden insert_here todo TODO lorem ipsum
    the and of to in that this with from for are was have been which there their would about other into than them these some could""".split()
).encode()


@dataclass
class Params:
    around: int = 128  # characters of surroundings on each side
    min_novelty: float = 0.45  # marginal bytes for each byte of the candidate
    min_bytes: int = 6
    corpus_names: int = 1024
    min_documents: int = 5


def near(text: str) -> Iterator[tuple[int, int]]:
    """Every run in reach of a sensitive word."""
    words, at = [m.end() for m in WORD.finditer(text)], 0
    if not words:
        return
    end = -1  # of the word or run whose reach counts
    for m in RUN.finditer(text):
        a, b = m.span()
        while at < len(words) and words[at] <= a:
            end = max(end, words[at])
            at += 1
        if end >= 0 and a - end <= REACH and "\n" not in text[end:a]:
            yield a, b
            end = b


def candidates(text: str) -> list[tuple[int, int, str]]:
    """All of them, overlapping ones too; a span that several rules find goes by the first."""
    found = [(*m.span(1), name) for name, rule in RULES for m in rule.finditer(text) if m[1]]
    found += [(a, b, "near") for a, b in near(text)]
    rule = {}
    for a, b, name in found:
        rule.setdefault((a, b), name)
    return [(a, b, rule[a, b]) for a, b in sorted(rule, key=lambda x: (x[0], -x[1]))]


def dictionary(names: list[str]) -> bytes:
    return " ".join([*reversed(names), ""]).encode("utf-8", "surrogatepass") + DICTIONARY


#: A name to which a value is assigned; without digits, so that no key can pass for one.
ASSIGNED = r"(?<![\w.-])([A-Za-z_][A-Za-z_.-]{2,31})[\"']?[ \t]*[:=]"


def corpus_names(docs: DataFrame, p: Params) -> list[str]:
    """The names that values are assigned to in most documents, most frequent first; a top-k over counts of all documents."""
    text = col("text")
    found = docs.where(text.contains("=") | text.contains(":")).select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(1)))).alias("name"))
    counted = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.min_documents)
    return [r.name for r in counted.orderBy(F.desc("n"), "name").limit(p.corpus_names).collect()]


class Novelty:
    def __init__(self, names: list[str] | None = None) -> None:
        """names: the corpus' identifiers, most frequent first; those lie at the end of the dictionary, nearest to the text."""
        primed = zstandard.ZstdCompressionDict(dictionary(names or []), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # even a lone candidate is measured inside a block that zstd compresses, not stores
        self.frame = DICTIONARY[:160]
        self.pack = zstandard.ZstdCompressor(level=12, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def marginal(self, before: str, candidate: str, after: str) -> int:
        enc = lambda s: s.encode("utf-8", "surrogatepass")
        return max(0, len(self.pack(self.frame + enc(before + candidate + after))) - len(self.pack(self.frame + enc(before + after))))


def without(text: str, start: int, end: int, spans: list[tuple[int, int]]) -> str:
    """text[start:end] less the spans."""
    parts = []
    for a, b in spans:
        if b > start and a < end:
            parts.append(text[start : max(start, a)])
            start = min(end, b)
    return "".join(parts) + text[start:end]


def scan(text: str | None, novelty: Novelty, p: Params) -> list[dict]:
    out: list[dict] = []
    found_at: dict[str, list[tuple[int, int]]] = {}
    all_of = candidates(text) if text else []
    for a, b, _ in all_of:
        found_at.setdefault(text[a:b], []).append((a, b))
    for a, b, rule in all_of:
        if out and a < out[-1]["offset"] + out[-1]["length"]:
            continue
        found = text[a:b]
        same = found_at[found]
        if len(same) > 1:  # a secret given twice must not vouch for itself
            near = [x for x in same[max(0, bisect.bisect_left(same, (a, b)) - p.around) :][: 2 * p.around + 1] if x[1] > a - p.around and x[0] < b + p.around]
            before, after = without(text, max(0, a - p.around), a, near), without(text, b, b + p.around, near)
        else:
            before, after = text[max(0, a - p.around) : a], text[b : b + p.around]
        n = novelty.marginal(before, found, after)
        size = len(found.encode("utf-8", "surrogatepass"))
        if n >= p.min_bytes and n / size >= p.min_novelty:
            out.append({"offset": a, "length": b - a, "rule": rule, "marginal_bytes": n, "novelty": n / size, "preview": found[:4] + "...", "sha256": hashlib.sha256(found.encode("utf-8", "surrogatepass")).hexdigest()})
    return out


FIELDS = "offset:bigint,length:bigint,rule:string,marginal_bytes:bigint,novelty:double,preview:string,sha256:string"


def secrets(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """doc_id, offset, length, rule, marginal_bytes, novelty, preview, sha256: one row for each secret."""
    p = p or Params()
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(corpus_names(docs, p))  # at most corpus_names of 32 bytes
    kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("rule", pa.string()), ("marginal_bytes", pa.int64()), ("novelty", pa.float64()), ("preview", pa.string()), ("sha256", pa.string())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(shared.value)
        for texts in batches:
            yield pa.array([scan(t, novelty, p) for t in texts.to_pylist()], kind)

    # a text with no sensitive word or prefix has no candidate and never leaves the JVM
    text, low = col("text"), F.lower(col("text"))
    may = F.lit(False)
    for h in HINTS:
        may = may | low.contains(h)
    for h in PREFIXES:
        may = may | text.contains(h)
    return docs.where(may).select(col("doc_id").alias("doc_id"), F.inline(F.arrow_udf(run, f"array<struct<{FIELDS}>>")(text)))
