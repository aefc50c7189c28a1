"""Undoing a transformation: collapse of diffs, three-way merge, referential checks and pseudoprincipal modes."""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.operators.speaksfor import nearest_ancestor
from cloakwork.sources.catalog import TableInfo


class PartialRevealError(RuntimeError):
    """A revealed row would mix restored and current values, which was not allowed."""


def order_of_tables(info: dict[str, TableInfo]) -> list[str]:
    """Tables after all the tables that their other_fks refer to."""
    graph = {t: {k.to_table for k in x.other_fks if k.to_table in info and k.to_table != t} for t, x in sorted(info.items())}
    return list(TopologicalSorter(graph).static_order())


def collapse(diffs: DataFrame) -> DataFrame:
    """One (key, old, new) for each row of a table from all its diffs(ids, seq, old, new).

    Of each column the earliest old value and the latest value that a diff changed; one aggregation, no ordering of rows.
    """
    cells = diffs.select(F.to_json("ids").alias("key"), "seq", "new", F.explode("old").alias("col", "was"))
    cells = cells.withColumn("now", F.element_at("new", F.col("col"))).withColumn("changed", ~F.col("was").eqNullSafe(F.col("now")))
    one = cells.groupBy("key", "col").agg(
        F.min_by("was", "seq").alias("old"), F.max_by("now", F.when(F.col("changed") & F.col("new").isNotNull(), F.col("seq"))).alias("new"),
        F.max(F.col("changed") & F.col("new").isNotNull()).alias("changed"), F.max(F.col("new").isNull()).alias("removed"),
    )
    one = one.withColumn("new", F.when(F.col("changed"), F.col("new")).otherwise(F.col("old")))
    entry = lambda c: F.map_from_entries(F.collect_list(F.struct("col", c))).alias(c)
    return one.groupBy("key").agg(entry("old"), entry("new"), F.max("removed").alias("removed"))


def merged(current: str, old: str, new: str) -> str:
    """SQL: a value changed since by others stays, anything else becomes the old one; null equals null."""
    return f"CASE WHEN {current} IS DISTINCT FROM {new} AND {current} IS DISTINCT FROM {old} THEN {current} ELSE {old} END"


def reveal_rows(base: DataFrame, collapsed: DataFrame, info: TableInfo, allow_partial: bool = True) -> DataFrame:
    """base with the collapsed diffs undone: changed rows are merged, removed ones come back, rows in place stay."""
    types = dict(base.dtypes)
    old = collapsed.select(*[F.element_at("old", c).cast(types[c]).alias(f"__o_{c}") for c in base.columns], *[F.element_at("new", c).cast(types[c]).alias(f"__n_{c}") for c in base.columns], F.lit(True).alias("__hit"))
    on = [base[c] == old[f"__o_{c}"] for c in info.id_cols]
    both = base.select("*", F.lit(True).alias("__here")).join(old, on, "full")
    if not allow_partial:
        mixed = " OR ".join(f"({c} IS DISTINCT FROM __n_{c} AND {c} IS DISTINCT FROM __o_{c})" for c in base.columns)
        if both.where(f"__hit AND __here AND ({mixed})").limit(1).count():
            raise PartialRevealError(info.table)
    return both.select(*[F.expr(f"CASE WHEN __hit IS NULL THEN {c} WHEN __here IS NULL THEN __o_{c} ELSE {merged(c, f'__o_{c}', f'__n_{c}')} END").alias(c) for c in base.columns])


def orphans(rows: DataFrame, info: TableInfo, tables: dict[str, DataFrame], owners: bool = True) -> DataFrame:
    """(col, value) of references from rows to rows that aren't there; null refers to nothing."""
    out = None
    for k in (*info.other_fks, *(info.owner_fks if owners else ())):
        to = tables[k.to_table].select(F.col(k.to_col).cast("string").alias("value"))
        missing = rows.select(F.lit(k.from_col).alias("col"), F.col(k.from_col).cast("string").alias("value")).where("value IS NOT NULL").join(to, "value", "left_anti").distinct()
        out = missing if out is None else out.unionByName(missing)
    return out if out is not None else rows.sparkSession.createDataFrame([], "col string, value string")


def children(tables: dict[str, DataFrame], info: dict[str, TableInfo], to_table: str) -> DataFrame:
    """(uid, n): how many rows of any table refer to each id of a table; one union of partial counts."""
    out = None
    for t, x in info.items():
        for k in (*x.owner_fks, *x.other_fks):
            if k.to_table == to_table:
                one = tables[t].groupBy(F.col(k.from_col).cast("string").alias("uid")).agg(F.count("*").alias("n"))
                out = one if out is None else out.unionByName(one)
    return out.where("uid IS NOT NULL").groupBy("uid").agg(F.sum("n").alias("n"))


def reveal_pseudoprincipals(tables: dict[str, DataFrame], info: dict[str, TableInfo], principal: str, id_col: str, edges: DataFrame, pps: DataFrame, mode: str = "restore") -> dict[str, DataFrame]:
    """What becomes of the rows of ``pps(uid)``: restore gives them to the nearest surviving ancestor (nothing changes if
    one has none), delete removes them with their pseudoprincipals, retain leaves all."""
    if mode == "retain":
        return tables
    out = dict(tables)
    if mode == "restore":
        of = nearest_ancestor(edges, pps)
        there = tables[principal].select(F.col(id_col).cast("string").alias("ancestor"))
        if pps.join(of.join(there, "ancestor", "left_semi"), "uid", "left_anti").limit(1).count():
            return tables
    for t, x in info.items():
        for k in x.owner_fks:
            if t == principal and k.from_col == id_col:
                continue
            df = out[t]
            if mode == "restore":
                m = of.select(F.col("uid").alias("__u"), F.col("ancestor").alias("__a"))
                out[t] = df.join(m, F.col(k.from_col).cast("string") == F.col("__u"), "left").withColumn(k.from_col, F.coalesce(F.col("__a").cast(df.schema[k.from_col].dataType), F.col(k.from_col))).select(df.columns)
            else:
                out[t] = df.join(pps.select(F.col("uid").alias("__u")), F.col(k.from_col).cast("string") == F.col("__u"), "left_anti")
    out[principal] = out[principal].join(pps.select(F.col("uid").alias("__u")), F.col(id_col).cast("string") == F.col("__u"), "left_anti")
    return out

