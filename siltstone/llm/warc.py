"""WARC records and their Merkle fixity audit.

A page is one WARC response record.  Records lie in archives of 4096 ids each, in order of page_id, then of digest;
equal records lie side by side.  The tree follows the ids, not the positions, so that a record that is missing or was
inserted anywhere moves no other node.  Levels and their nodes: 0 record (page_id), 1 the records of one id (page_id),
2 and 3 ranges of 16 and 256 ids (page_id >> 4, >> 8), 4 archive (page_id >> 12), 5 range of 4096 archives (>> 24), 6 root (0).

A record's hash is the SHA-256 of its bytes, with ``x`` and their number where it has several copies.  The records of an id
are hashed in groups by the first three digits of their digests, and these in order with their bytes.  Above that, a node's
hash is that of ``start:end:hash`` of its children in order, where start and end are offsets from the node's own
start, so that ordered offset ranges are part of the tree.  Offsets reported are those in the archive, for
levels 5 and 6 the bytes of all archives.

The audit compares the roots of two replicas and descends only into nodes that differ.  A replica's tree is built in one
pass: records are combined by id and digest, those of an id by digest groups (so that one id may have any number), and the
levels within an archive are one nested row, of which the audit reads the hash alone unless it differs.

Edge cases: null url or html count as empty; records with a null page_id are written ``null`` and lie in an
archive and range of their own, whose numbers are null.  Repeated pages are copies of one record; a different number of copies is a difference.  If an id has one
differing record in each replica they share a row; else each differing record has a row with a null hash for the replica
that lacks it.  If the roots agree the result is the root's row alone; two empty replicas give no rows.  Very long bodies are
hashed where they lie.  Only page_id, which is read as a long, url and html are read; other columns never.
"""

from __future__ import annotations

import gzip
import io
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, col

EOL = "\r\n"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """The whole record as it lies in the archive."""
    html = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}WARC-Type: response{EOL}WARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("null")),
        F.lit(f">{EOL}WARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit(f"{EOL}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(EOL + EOL),
    )
    return F.concat(head, html, F.lit(EOL + EOL))


def leaves(pages: DataFrame) -> DataFrame:
    """page_id, digest, size (of one copy), copies, hash: one row for each distinct record."""
    page_id = col("page_id").cast("long")
    record = record_text(page_id, col("url"), col("html"))
    # bodies stay where they are: only digests and lengths are shuffled, and copies combined before
    rows = pages.select(page_id.alias("page_id"), F.octet_length(record).cast("long").alias("size"), F.sha2(record, 256).alias("digest"))
    found = rows.groupBy("page_id", "digest").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))
    return found.withColumn("hash", F.when(F.col("copies") > 1, F.concat("digest", F.lit("x"), F.col("copies").cast("string"))).otherwise(F.col("digest")))


def joined(items: Column, separator: str) -> Column:
    return F.sha2(F.array_join(items, separator), 256)


def placed(children: Column) -> Column:
    """Children in order, each with its start from that of the first."""
    ordered = F.array_sort(children)
    before = lambda i: F.aggregate(F.slice(ordered, F.lit(1), i), F.lit(0).cast("long"), lambda n, c: n + c.getField("bytes"))
    rest = lambda x: [x.getField(c).alias(c) for c in ("bytes", "hash", "kids")]
    return F.transform(ordered, lambda x, i: F.struct(x.getField("node").alias("node"), F.when(i > 0, before(i)).otherwise(F.lit(0).cast("long")).alias("start"), *rest(x)))


def ranged(child: Column) -> Column:
    start, bytes_ = child.getField("start"), child.getField("bytes")
    return F.concat(start.cast("string"), F.lit(":"), (start + bytes_).cast("string"), F.lit(":"), child.getField("hash"))


def archives(records: DataFrame) -> DataFrame:
    """archive_id, node, bytes, hash, kids: a nested tree for each archive, down to ids."""
    groups = records.groupBy(F.shiftright("page_id", 12).alias("archive_id"), "page_id", F.substring("digest", 1, 3).alias("prefix"))
    groups = groups.agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), joined(F.array_sort(F.collect_list("hash")), ",").alias("hash"))
    # from here on all levels of an archive are made in one task
    ids = groups.repartition("archive_id").groupBy("archive_id", "page_id").agg(F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("prefix", "bytes", "hash"))).alias("g"))
    text = F.transform("g", lambda g: F.concat(g.getField("bytes").cast("string"), F.lit(":"), g.getField("hash")))
    level = ids.select("archive_id", F.col("page_id").alias("node"), "bytes", joined(text, ";").alias("hash"), F.lit(0).alias("kids"))
    for _ in range(3):
        up = level.groupBy("archive_id", F.shiftright("node", 4).alias("up")).agg(F.sum("bytes").alias("bytes"), F.collect_list(F.struct("node", "bytes", "hash", "kids")).alias("c"))
        up = up.select("archive_id", F.col("up").alias("node"), "bytes", placed(F.col("c")).alias("kids"))
        level = up.select("archive_id", "node", "bytes", joined(F.transform("kids", ranged), ";").alias("hash"), "kids")
    return level


def above(children: DataFrame, key: str) -> DataFrame:
    """key, bytes, hash from (key, child, bytes, hash): at most 4096 children a node, but for the root, which has one for 16 million ids."""
    end = F.sum("bytes").over(Window.partitionBy(key).orderBy("child").rowsBetween(Window.unboundedPreceding, 0))
    item = F.concat((F.col("end") - F.col("bytes")).cast("string"), F.lit(":"), F.col("end").cast("string"), F.lit(":"), F.col("hash"))
    rows = children.withColumn("end", end).select(key, "child", "bytes", item.alias("item"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("child", "item"))), lambda x: x.getField("item"))
    return rows.groupBy(key).agg(F.sum("bytes").alias("bytes"), joined(items, ";").alias("hash"))


class Tree:
    """A replica: its records and archives, which are written, and the small levels over them."""

    def __init__(self, pages: DataFrame, store: Written, name: str):
        self.records = store.put(leaves(pages), f"{name}-records")
        self.archives = store.put(archives(self.records), f"{name}-archives")
        self.segments = above(self.archives.select(F.shiftright("archive_id", 12).alias("segment"), F.col("archive_id").alias("child"), "bytes", "hash"), "segment")
        self.root = above(self.segments.select(F.lit(0).cast("long").alias("root"), F.col("segment").alias("child"), "bytes", "hash"), "root")


RESULT = ("level", "segment", "archive_id", "node", "page_id", "start_offset", "end_offset", "primary_hash", "replica_hash")


def differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def compared(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, bytes, primary, replica of the nodes in either."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}")), "full")
    known = F.when(F.col("x.hash").isNotNull(), F.col(f"x.{key}")).otherwise(F.col(f"y.{key}"))
    return both.select(known.alias(key), F.coalesce("x.bytes", "y.bytes").alias("bytes"), F.col("x.hash").alias("primary"), F.col("y.hash").alias("replica"))


def row(level: int, node: Column, start: Column, end: Column, primary: Column, replica: Column, archive: Column | None = None, segment: Column | None = None, page: Column | None = None) -> list[Column]:
    none = F.lit(None).cast("long")
    return [F.lit(level).alias("level"), *[(none if c is None else c).cast("long").alias(n) for c, n in ((segment, "segment"), (archive, "archive_id"), (node, "node"), (page, "page_id"), (start, "start_offset"), (end, "end_offset"))], primary.alias("primary_hash"), replica.alias("replica_hash")]


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The root, and below it every node that differs, down to the records."""
    store = Written(primary.sparkSession)
    a, b = Tree(primary, store, "primary"), Tree(replica, store, "replica")
    zero, old, new = F.lit(0), F.col("primary"), F.col("replica")
    roots = store.put(compared(a.root, b.root, "root"), "roots")
    out = roots.select(*row(6, zero, zero, F.col("bytes"), old, new))
    if roots.where(differs(old, new)).isEmpty():
        return out.select(*RESULT)
    segments = compared(a.segments, b.segments, "segment").where(differs(old, new))
    out = out.unionByName(segments.select(*row(5, F.col("segment"), zero, F.col("bytes"), old, new, segment=F.col("segment"))))
    bad = store.put(compared(*(x.archives.select("archive_id", "bytes", "hash") for x in (a, b)), "archive_id").where(differs(old, new)), "bad")
    archive, segment = F.col("archive_id"), F.shiftright("archive_id", 12)
    out = out.unionByName(bad.select(*row(4, archive, zero, F.col("bytes"), old, new, archive, segment)))
    # the nested trees of differing archives alone, one level after the other
    trees = []
    for x, own in ((a, True), (b, False)):
        some = x.archives.alias("t").join(bad.select(F.col("archive_id").alias("want")), F.col("archive_id").eqNullSafe(F.col("want")), "left_semi")
        trees.append(some.select("archive_id", F.lit(0).cast("long").alias("base"), F.lit(own).alias("own"), F.explode("kids").alias("c")))
    rows = trees[0].unionByName(trees[1])
    for level, shift in ((3, 8), (2, 4), (1, 0)):
        have = F.struct((F.col("base") + F.col("c.start")).alias("start"), F.col("c.bytes").alias("bytes"), F.col("c.hash").alias("hash"), F.col("c.kids").alias("kids"))
        both = rows.groupBy("archive_id", F.col("c.node").alias("node")).agg(F.first(F.when(F.col("own"), have), True).alias("a"), F.first(F.when(~F.col("own"), have), True).alias("b"))
        now = store.put(both.where(differs(F.col("a.hash"), F.col("b.hash"))), f"level-{level}")
        start = F.coalesce("a.start", "b.start")
        out = out.unionByName(now.select(*row(level, F.col("node"), start, start + F.coalesce("a.bytes", "b.bytes"), F.col("a.hash"), F.col("b.hash"), archive, segment, F.col("node") if level == 1 else None)))
        if level > 1:
            side = lambda s, own: F.transform(F.col(f"{s}.kids"), lambda c: F.struct(F.col(f"{s}.start").alias("base"), F.lit(own).alias("own"), c.alias("c")))
            nothing = F.array().cast(now.select(side("a", True).alias("k")).schema["k"].dataType)
            kids = F.concat(F.coalesce(side("a", True), nothing), F.coalesce(side("b", False), nothing))
            rows = now.select("archive_id", F.explode(kids).alias("k")).select("archive_id", "k.base", "k.own", "k.c")
    ids = now.select("archive_id", F.col("node").alias("page_id"), F.col("a.start").alias("a_start"), F.col("b.start").alias("b_start"))
    return out.unionByName(store.put(record_rows(a, b, ids), "records")).select(*RESULT)


def record_rows(a: Tree, b: Tree, ids: DataFrame) -> DataFrame:
    """The differing records of the ids (archive_id, page_id, a_start, b_start)."""
    sides = []
    for tree, start in ((a, "a_start"), (b, "b_start")):
        r = tree.records.alias("r").join(ids.select(F.col("page_id").alias("want"), F.col(start).alias("base")), F.col("page_id").eqNullSafe(F.col("want"))).drop("want")
        r = r.withColumns({"prefix": F.substring("digest", 1, 3), "bytes": F.col("size") * F.col("copies")})
        # offsets by groups of digests, so that no window holds all records of an id
        groups = r.groupBy("page_id", "prefix").agg(F.sum("bytes").alias("group"))
        earlier = F.sum("group").over(Window.partitionBy("page_id").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1))
        groups = groups.select(F.col("page_id").alias("want"), F.col("prefix").alias("of"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
        r = r.join(groups, F.col("page_id").eqNullSafe(F.col("want")) & (F.col("prefix") == F.col("of")))
        within = F.sum("bytes").over(Window.partitionBy("page_id", "prefix").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0))
        end = F.col("base") + F.col("earlier") + within
        sides.append(r.select("page_id", "digest", F.struct((end - F.col("bytes")).alias("start"), end.alias("end"), F.col("hash").alias("hash")).alias("at")))
    x, y = sides[0].alias("x"), sides[1].alias("y")
    both = x.join(y, F.col("x.page_id").eqNullSafe(F.col("y.page_id")) & (F.col("x.digest") == F.col("y.digest")), "full")
    both = both.select(F.when(F.col("x.at").isNotNull(), F.col("x.page_id")).otherwise(F.col("y.page_id")).alias("page_id"), F.col("x.at").alias("a"), F.col("y.at").alias("b"))
    both = both.where(differs(F.col("a.hash"), F.col("b.hash")))
    lost, come = F.col("b").isNull(), F.col("a").isNull()
    by = both.groupBy("page_id").agg(F.count(F.when(lost, 1)).alias("lost"), F.count(F.when(come, 1)).alias("come"), F.max(F.when(lost, F.col("a"))).alias("a"), F.max(F.when(come, F.col("b"))).alias("b"))
    pairs = by.where("lost = 1 AND come = 1")
    rest = both.join(pairs.select(F.col("page_id").alias("want")), F.col("page_id").eqNullSafe(F.col("want")) & (lost | come), "left_anti")
    rows = rest.unionByName(pairs.select("page_id", "a", "b"))
    archive = F.shiftright("page_id", 12)
    return rows.select(*row(0, F.col("page_id"), F.coalesce("a.start", "b.start"), F.coalesce("a.end", "b.end"), F.col("a.hash"), F.col("b.hash"), archive, F.shiftright("page_id", 24), F.col("page_id")))


def to_warc(rows: list[tuple]) -> bytes:
    """One gzip member for each (page_id, url, html)."""
    out = io.BytesIO()
    for page_id, url, html in rows:
        body = (html or "").encode("utf-8", "surrogatepass")
        head = EOL.join(["WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {url or ''}", f"Content-Length: {len(body)}", "", ""])
        out.write(gzip.compress(head.encode("utf-8", "surrogatepass") + body + (EOL + EOL).encode(), mtime=0))
    return out.getvalue()


def from_warc(data: bytes) -> Iterator[tuple]:
    """(page_id, url, html) of the response records; lengths, not separators, delimit bodies."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[at:stop].decode("utf-8", "surrogatepass").split(EOL)[1:])
        size = int(head["Content-Length"])
        body = raw[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4
        if head.get("WARC-Type") == "response":
            name = head["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
            yield (int(name) if name != "null" else None, head["WARC-Target-URI"], body.decode("utf-8", "surrogatepass"))


def write_warc(pages: DataFrame, folder: str) -> None:
    """One ``.warc.gz`` for each partition, in a folder that all executors share; a retried task replaces its own."""
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = os.path.join(folder, f"part-{TaskContext.get().partitionId():06d}.warc.gz")
        part = f"{name}.{uuid.uuid4().hex}"
        n = 0
        with open(part, "wb") as f:
            for b in batches:
                f.write(to_warc(list(zip(*(b[c].to_pylist() for c in range(3)), strict=True))))
                n += b.num_rows
        os.replace(part, name)
        yield pa.RecordBatch.from_pydict({"n": [n]}, schema=pa.schema([("n", pa.int64())]))

    pages.select(col("page_id").cast("long"), col("url"), col("html")).mapInArrow(run, "n long").collect()


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b["content"].to_pylist():
                rows = list(from_warc(data))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content").mapInArrow(run, "page_id long, url string, html string")
