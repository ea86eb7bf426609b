"""One read-only statement, proven on the parsed plan before anything runs."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from . import inspect
from .inspect import Node

#: Plan nodes that only read.  Whatever is not listed is refused.
READS = frozenset(
    """Project Filter Join LateralJoin Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except SubqueryAlias Window Generate Expand Sample
    Pivot Unpivot UnresolvedRelation UnresolvedWith UnresolvedSubqueryColumnAliases UnresolvedHaving UnresolvedInlineTable WithWindowDefinition LocalRelation OneRowRelation
    UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedHint ResolvedHint RepartitionByExpression Repartition LimitAll UnresolvedOrdinal""".split()
)
FORBIDDEN_FUNCTIONS = frozenset({"reflect", "java_method", "try_reflect"})


class Refused(ValueError):
    """The statement is not allowed; the message says why and what to do."""


def _plans(n: Node) -> list[Node]:
    """All plan nodes: those under the root, in CTEs and in subquery expressions."""
    out = [n, *[x for c in n.children for x in _plans(c)]]
    for _, e in n.exprs():
        for x in e.walk():
            if x.kind == "SubqueryAlias" and e is x:  # a CTE body
                out += _plans(x)
                break
            for name, p in x.exprs():
                if name == "plan":
                    out += _plans(p)
    return out


def assert_select_only(spark: SparkSession, sql: str) -> Node:
    root = inspect.parsed(spark, sql)
    for n in _plans(root):
        if n.kind not in READS:
            raise Refused(f"only a single read-only SELECT is allowed; the statement holds {n.kind}")
    for n in root.walk():
        if n.kind == "UnresolvedFunction":
            name = inspect.name_parts(n.fields.get("nameParts"))[-1:]
            if name and name[0].lower() in FORBIDDEN_FUNCTIONS:
                raise Refused(f"{name[0]} calls into the JVM and is not allowed")
    return root


def split_statements(text: str) -> list[tuple[str, int]]:
    """(statement, line) of a file: by semicolons outside quotes and comments; without any, one a line."""
    out: list[tuple[str, int]] = []
    start, i, n = 0, 0, len(text)
    cuts = []
    while i < n:
        c = text[i]
        if text.startswith("--", i):
            i = text.find("\n", i)
            i = n if i < 0 else i
            continue
        if text.startswith("/*", i):
            end = text.find("*/", i + 2)
            i = n if end < 0 else end + 2
            continue
        if c in "'\"`":
            i += 1
            while i < n and text[i] != c:
                i += 2 if text[i] == "\\" and c != "`" else 1
        elif c == ";":
            cuts.append(i)
        i += 1
    if cuts:
        for cut in [*cuts, n]:
            out.append((text[start:cut], text.count("\n", 0, start) + 1))
            start = cut + 1
    else:
        for line, s in enumerate(text.splitlines(), 1):
            out.append((s, line))
    done = []
    for s, line in out:
        code = re.sub(r"--[^\n]*|/\*.*?\*/", "", s, flags=re.S).strip()
        if code:
            lead = len(s) - len(s.lstrip())
            done.append((s.strip(), line + s[:lead].count("\n")))
    return done
