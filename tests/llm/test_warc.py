import hashlib

import pytest

from siltstone.llm import queries, warc

SCHEMA = "page_id long, url string, html string, hash string, level int"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def brute_tree(pages):
    """level -> {node: (start, end, hash, children)} by plain loops, records: {(page_id, digest): (start, end, hash)}."""
    found = {}
    for page_id, url, html in pages:
        body = (html or "").encode()
        head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Length: {len(body)}\r\n\r\n"
        data = head.encode() + body + b"\r\n\r\n"
        n = found.get((page_id, sha(data)), (0, 0))[1]
        found[page_id, sha(data)] = (len(data), n + 1)
    order = sorted(found, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    nodes = {}  # id -> [bytes, hash]
    for page_id in dict.fromkeys(k[0] for k in order):
        groups = {}
        for k in order:
            if k[0] == page_id:
                size, n = found[k]
                g = groups.setdefault(k[1][:3], [0, []])
                g[0] += size * n
                g[1].append(k[1] + (f"x{n}" if n > 1 else ""))
        nodes[page_id] = (sum(g[0] for g in groups.values()), sha(";".join(f"{n}:{sha(','.join(hs))}" for n, hs in groups.values())))
    levels, inside = {1: nodes}, {}
    for level, up in ((2, 4), (3, 4), (4, 4), (5, 12), (6, None)):
        parents = {}
        for k, v in levels[level - 1].items():
            parents.setdefault(0 if up is None else None if k is None else k >> up, []).append((k, *v))
        levels[level] = {}
        for k, children in parents.items():
            at, items = 0, []
            for child, n, h in children:
                items.append(f"{at}:{at + n}:{h}")
                inside[level - 1, child] = (level, k, at)
                at += n
            levels[level][k] = (at, sha(";".join(items)))

    def start(level, k):
        if level >= 4:
            return 0
        up, parent, at = inside[level, k]
        return at + start(up, parent)

    tree = {level: {k: (start(level, k), start(level, k) + n, h) for k, (n, h) in some.items()} for level, some in levels.items()}
    tree[0], done = {}, {}
    for k in order:
        size, n = found[k]
        at = done.get(k[0], tree[1][k[0]][0])
        done[k[0]] = at + size * n
        tree[0][k] = (at, at + size * n, k[1] + (f"x{n}" if n > 1 else ""))
    return tree


def shifted(k, n):
    return None if k is None else k >> n


def brute_audit(a, b):
    a, b = brute_tree(a), brute_tree(b)
    rows = set()
    for level in range(1, 7):
        for k in set(a[level]) | set(b[level]):
            x, y = a[level].get(k), b[level].get(k)
            if level == 6 or x is None or y is None or x[2] != y[2]:
                s = x or y
                archive = shifted(k, {1: 12, 2: 8, 3: 4, 4: 0}[level]) if level <= 4 else None
                segment = shifted(archive, 12) if level <= 4 else k if level == 5 else None
                rows.add((level, segment, archive, k, s[0], s[1], x and x[2], y and y[2]))
    odd = [(k[0], a[0].get(k), b[0].get(k)) for k in set(a[0]) | set(b[0]) if a[0].get(k, "   ")[2] != b[0].get(k, "   ")[2]]
    for page_id in {o[0] for o in odd}:
        lost = [x for p, x, y in odd if p == page_id and y is None]
        come = [y for p, x, y in odd if p == page_id and x is None]
        pairs = [(x, y) for p, x, y in odd if p == page_id and x and y]
        pairs += [(lost[0], come[0])] if len(lost) == len(come) == 1 else [(x, None) for x in lost] + [(None, y) for y in come]
        for x, y in pairs:
            s = x or y
            rows.add((0, shifted(page_id, 24), shifted(page_id, 12), page_id, s[0], s[1], x and x[2], y and y[2]))
    return rows


def audited(spark, a, b):
    frame = lambda rows: spark.createDataFrame([(*r, "h", 1) for r in rows], SCHEMA)
    return {(r.level, r.segment, r.archive_id, r.node, r.start_offset, r.end_offset, r.primary_hash, r.replica_hash) for r in warc.audit(frame(a), frame(b)).collect()}


PAGES = [(i * 37, f"http://x/{i}", f"<p>page {i} é</p>") for i in range(400)]


@pytest.mark.parametrize("change", ["none", "html", "url", "missing", "middle", "inserted", "extra", "empty", "null", "copies", "several"])
def test_against_brute_force(spark, change):
    other = list(PAGES)
    if change == "html":
        other[200] = (*other[200][:2], "broken")
    elif change == "url":
        other[3] = (other[3][0], "http://y", other[3][2])
    elif change == "missing":
        other = other[:399]
    elif change == "middle":
        del other[100]
    elif change == "inserted":
        other.insert(100, (PAGES[100][0] + 1, "u", "new"))
    elif change == "copies":
        other += [other[5]] * 3
    elif change == "several":
        other += [(PAGES[7][0], "u", "a"), (PAGES[7][0], "u", "b"), (-5, "u", "below zero")]
        other[7] = (PAGES[7][0], "u", "c")
    elif change == "extra":
        other.append((20_000_000, "u", "far away"))
    elif change == "empty":
        other = []
    elif change == "null":
        other += [(None, None, None), (7, None, ""), (7, None, ""), (None, "u", "x")]
    assert audited(spark, PAGES, other) == brute_audit(PAGES, other)


@pytest.mark.parametrize("inserted", [False, True])
def test_a_record_in_the_middle_moves_no_other_node(spark, inserted):
    pages = [(i, f"http://x/{i}", f"page {i}") for i in range(4000)]
    other = [p for p in pages if p[0] != 100]
    rows = audited(spark, other, pages) if inserted else audited(spark, pages, other)
    assert sorted((r[0], r[3]) for r in rows) == [(0, 100), (1, 100), (2, 6), (3, 0), (4, 0), (5, 0), (6, 0)]
    assert all((r[6] is None, r[7] is None) == (inserted, not inserted) for r in rows if r[0] < 2)


def test_an_id_of_many_records_is_hashed_in_groups(spark):
    pages = [(5, "u", f"text {i}") for i in range(3000)] + [(None, "u", f"text {i % 50}") for i in range(3000)]
    other = [(p[0], p[1], "broken" if p == (5, "u", "text 1234") else p[2]) for p in pages] + [(None, "u", "text 7")]
    assert audited(spark, pages, other) == brute_audit(pages, other)


def test_both_empty(spark):
    assert audited(spark, [], []) == set()


def test_very_long_body(spark):
    a = [(1, "u", "x" * 3_000_000), (2, "u", "y")]
    b = [(1, "u", "x" * 2_999_999 + "z"), (2, "u", "y")]
    assert audited(spark, a, b) == brute_audit(a, b)


def test_query_finds_what_was_damaged(spark, medium):
    pages = spark.read.parquet(f"{medium}/pages.parquet").collect()
    rows = queries.op8_merkle_audit(spark, medium).collect()
    hit = {r.page_id for r in pages if sha(r.url) < "04" and not r.html.startswith("#")}
    assert {r.page_id for r in rows if r.level == 0} == hit and hit


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://x", "<p>é\r\n\r\nWARC/1.1</p>"), (2, None, None), (None, "u", "x"), (1, "http://x", "<p>é\r\n\r\nWARC/1.1</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_warc(pages, str(tmp_path / "w"))
    back = [tuple(r) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()]
    assert sorted(back, key=str) == sorted(((i, u or "", h or "") for i, u, h in rows), key=str)
    assert list(warc.from_warc(warc.to_warc(rows))) == [(i, u or "", h or "") for i, u, h in rows]
