"""Table names in a statement, found by Spark's own parser, and their replacement by text offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession


def _seq(it):
    return [it.apply(k) for k in range(it.size())]


def relations(spark: SparkSession, sql: str) -> list[tuple[list[str], int, int]]:
    """(name parts, first offset, end offset) of each table name that no common table expression defines."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    out: list[tuple[list[str], int, int]] = []

    def walk(node, hidden: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = _seq(node.multipartIdentifier())
            if not (len(parts) == 1 and parts[0].lower() in hidden):
                o = node.origin()
                out.append((parts, int(o.startIndex().get()), int(o.stopIndex().get()) + 1))
            return
        if kind == "UnresolvedWith":
            inner = set(hidden)
            own = _seq(node.cteRelations())
            names = {r._1().lower() for r in own}
            for r in own:
                walk(r._2(), frozenset(inner | (names if node.allowRecursion() else set())))
                inner.add(r._1().lower())
            walk(node.child(), frozenset(inner))
            return
        for child in _seq(node.children()):
            walk(child, hidden)
        for sub in _seq(node.subqueries()):
            walk(sub, hidden)

    walk(plan, frozenset())
    return out


def replace_tables(spark: SparkSession, sql: str, view_of: Callable[[list[str]], str]) -> str:
    """The statement with each table name replaced by the name of the view that ``view_of`` makes for it."""
    for parts, a, b in sorted(relations(spark, sql), key=lambda r: -r[1]):
        view = view_of(parts)
        named = sql[b:].lstrip()[:3].lower() if sql[b:].strip() else ""
        alias = "" if named.startswith("as ") or (named[:1].isalpha() and sql[b:].lstrip().split()[0].lower() not in STOP) or named[:1] == "`" else f" as `{parts[-1].replace('`', '``')}`"
        sql = sql[:a] + f"`{view}`{alias}" + sql[b:]
    return sql


#: Words that can follow a table name and aren't its alias.
STOP = frozenset("where group order having limit join inner left right full cross on using union except intersect lateral window offset qualify natural semi anti tablesample pivot unpivot sort cluster distribute for version timestamp minus set values select".split())
