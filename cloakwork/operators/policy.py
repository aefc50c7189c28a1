"""Policies on tables and columns: guards, their predicates, and the views a session gets to see."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPS = {"gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le, "eq": operator.eq, "ne": operator.ne}


@dataclass(frozen=True)
class Policy:
    """Clauses (guard, predicate): the predicates whose guard holds are ORed, none gives no rows."""

    name: str
    clauses: tuple[tuple[tuple, str], ...]
    aggregate: bool = False


TRUE = Policy("true", (((), "true"),))
FALSE = Policy("false", ())


def holds(guard: tuple, session: dict) -> bool:
    """A guard: () always, ("or", g...), ("and", g...), ("session_is", name, value), ("time_is", value), or (op, a, b).

    Arguments that start with $ are session variables.
    """
    if not guard:
        return True
    name, *args = guard
    if name == "or":
        return any(holds(g, session) for g in args)
    if name == "and":
        return all(holds(g, session) for g in args)
    if name == "session_is":
        return session.get(args[0]) == args[1]
    value = lambda x: session.get(x[1:]) if isinstance(x, str) and x.startswith("$") else x
    if name == "time_is":
        return session.get("time") == value(args[0])
    a, b = map(value, args)
    return a is not None and b is not None and _OPS[name](a, b)


def clause(policy: Policy, session: dict) -> str:
    parts = [f"({p})" for g, p in policy.clauses if holds(g, session)]
    return " OR ".join(parts) or "1 = 0"


def resolve(columns: list[str], either: dict[str, set[str]], linked: list[tuple[set[str], set[str]]]) -> set[str]:
    """Policies that all the columns' clusters leave: those of single columns united, linked columns' intersected."""
    out: set[str] = set()
    for c in columns:
        out |= either.get(c, set())
    for together, names in linked:
        if together <= set(columns):
            out = out & names if out else set(names)
    return out


def least_restrictive(names: set[str], weaker: dict[str, set[str]]) -> set[str]:
    """Of the policies those that no other of them is weaker than; weaker[a] lists what a is weaker than."""
    return {n for n in names if not any(n in weaker.get(m, set()) for m in names if m != n)}


def chosen(policies: list[Policy], query_aggregates: bool) -> list[Policy]:
    """Aggregate policies apply first to queries that only aggregate; else the plain ones."""
    own = [p for p in policies if p.aggregate] if query_aggregates else []
    return own or [p for p in policies if not p.aggregate]


def row_suppression(base: DataFrame, policies: list[Policy], session: dict, unexpected: tuple[str, ...] = ()) -> DataFrame:
    """Rows that every policy lets through; unexpected columns are null."""
    for p in policies:
        base = base.where(F.expr(clause(p, session)))
    return base.select(*[F.lit(None).cast(t).alias(c) if c in unexpected else F.col(c) for c, t in base.dtypes])


def cell_blinding(base: DataFrame, by_column: dict[str, list[Policy]], session: dict) -> DataFrame:
    """Each cell only where all policies of its column hold, else null."""
    cond = lambda ps: " AND ".join(f"({clause(p, session)})" for p in ps) or "true"
    return base.select(*[F.when(F.expr(cond(by_column[c])), F.col(c)).alias(c) if c in by_column else F.col(c) for c in base.columns])


def non_null(base: DataFrame, columns: list[str]) -> DataFrame:
    return base.dropna(subset=columns)


def relations(spark: SparkSession, sql: str) -> set[str]:
    """Names of all relations that a query reads, those of its own common table expressions left out; other sources as they stand."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    text = plan.toString()
    names = set(re.findall(r"'UnresolvedRelation \[([^\]]*)\]", text))
    own = {n.strip().lower() for found in re.findall(r"CTE \[([^\]]*)\]", text) for n in found.split(",")}
    return {n.replace(", ", ".") for n in names if n.lower() not in own}


def run(spark: SparkSession, sql: str, views: dict[str, DataFrame], session: dict) -> DataFrame:
    """A query under the session's views; :name parameters are bound to it. Any other table, view, file or table function is refused.

    Temporary views that stood under the same names are put back once the query is analysed.
    """
    if not sql.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only queries run under policies")
    other = relations(spark, sql) - set(views)
    if other:
        raise PermissionError(f"no policy opens {', '.join(sorted(other))}")
    if re.search(r"UnresolvedTableValuedFunction", spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString()):
        raise PermissionError("table functions aren't open to policies")
    return _bound(spark, sql, views, session)


def _bound(spark: SparkSession, sql: str, views: dict[str, DataFrame], session: dict) -> DataFrame:
    """The query with the views as the only relations: they stand in session-local names while it is analysed, and go again."""
    before = {n: spark.table(n) for n in views if spark.catalog.tableExists(n)}
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql, args={k: v for k, v in session.items() if f":{k}" in sql})
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)
