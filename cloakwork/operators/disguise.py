"""Remove, modify and decorrelate: each maps a table to (table, diffs, edges, pseudoprincipals) without side effects.

A pseudoprincipal's id is a digest of what it stands for, so it is a plain projection: rows of one group get the
same id wherever they are, and no mapping has to be joined back. diffs(uid, typ, tbl, ids, old, new, old_uid, new_uid).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakwork.functions.expressions import PP_BASE, digest, digits, generated, image, owner_filter, predicate
from cloakwork.sources.catalog import Decor, Generator, Modify, Remove, TableInfo

DIFF = "uid string, typ string, tbl string, ids map<string,string>, old map<string,string>, new map<string,string>, old_uid string, new_uid string"
EDGE = "old_uid string, new_uid string"


@dataclass
class Result:
    table: DataFrame
    diffs: DataFrame
    edges: DataFrame | None = None
    principals: DataFrame | None = None


def owned(df: DataFrame, info: TableInfo, valid: DataFrame) -> DataFrame:
    """Rows of which some owner column has one of ``valid(uid)``: the user or, over any number of hops, a pseudoprincipal."""
    if not info.owner_fks:
        raise ValueError("a user was given, but the table has no owner columns")
    ids = functools.reduce(DataFrame.union, [df.join(valid.select(F.col("uid").alias("__v")).distinct(), F.col(k.from_col).cast("string") == F.col("__v"), "left_semi").select(*info.id_cols) for k in info.owner_fks])
    return df.join(ids.distinct(), list(info.id_cols), "left_semi")


def matches(tables: dict[str, DataFrame], info: TableInfo, t, user=None, valid: DataFrame | None = None) -> DataFrame:
    """The rows of info.table that a transformation takes, each once; with ``frm`` by a semi join on its ids.

    ``valid(uid)`` are the user and its pseudoprincipals, whose rows are the user's too.
    """
    base = tables[info.table]
    own = owner_filter([f"{info.table}.{k.from_col}" if t.frm else k.from_col for k in info.owner_fks], user if valid is None else None)
    pred = own & predicate(t.pred)
    if valid is not None:
        base = owned(base, info, valid)
    if t.frm is None:
        return base.where(pred.sql)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    ids = ", ".join(f"{info.table}.{c}" for c in info.id_cols)
    hit = base.sparkSession.sql(f"SELECT DISTINCT {ids} FROM {t.frm} WHERE {pred.sql}")
    return base.join(hit, list(info.id_cols), "left_semi")


def ids_of(info: TableInfo):
    return F.create_map(*[x for c in info.id_cols for x in (F.lit(c), F.col(c).cast("string"))])


def _diff(df: DataFrame, uid, typ: str, info: TableInfo, old, new, old_uid=None, new_uid=None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(uid.cast("string").alias("uid"), F.lit(typ).alias("typ"), F.lit(info.table).alias("tbl"), ids_of(info).alias("ids"), old.alias("old"), new.alias("new"), (none if old_uid is None else old_uid.cast("string")).alias("old_uid"), (none if new_uid is None else new_uid.cast("string")).alias("new_uid"))


def _with(image: str, col: str, value):
    """An image with another value in one column."""
    return F.map_concat(F.map_filter(image, lambda k, v: k != F.lit(col)), F.create_map(F.lit(col), value))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def remove(tables: dict, info: TableInfo, t: Remove, user=None, principal: str | None = None, valid: DataFrame | None = None) -> Result:
    """Rows that match go; each owner (or, for the principal table, the principal) gets a REMOVE diff."""
    hit = matches(tables, info, t, user, valid)
    owners = [F.col(k.from_col) for k in info.owner_fks] or [F.lit(None)]
    typ = "REMOVE_PRINCIPAL" if info.table == principal else "REMOVE"
    owner = owners[0] if len(owners) == 1 else F.explode(F.array_distinct(F.array(*owners)))
    diffs = _diff(hit.select("*", owner.alias("__owner")), F.col("__owner"), typ, info, image(tables[info.table]), F.lit(None).cast("map<string,string>"))
    return Result(tables[info.table].join(hit.select(*info.id_cols), list(info.id_cols), "left_anti").select(tables[info.table].columns), diffs)


def modify(tables: dict, info: TableInfo, t: Modify, did: str, user=None, valid: DataFrame | None = None) -> Result:
    """One value for the whole transformation; a MODIFY diff for every owner column of a row."""
    base, hit = tables[info.table], matches(tables, info, t, user, valid)
    value = F.expr(generated(t.generator[0], digest(did, repr(info.table), repr(t.col)), *t.generator[1:])).cast(base.schema[t.col].dataType)
    marked = hit.select(*info.id_cols).withColumn("__hit", F.lit(True))
    out = base.join(marked, list(info.id_cols), "left").withColumn(t.col, F.when(F.col("__hit"), value).otherwise(F.col(t.col))).select(base.columns) if t.frm or valid is not None else base.withColumn(t.col, F.when(F.coalesce(F.expr((owner_filter([k.from_col for k in info.owner_fks], user) & predicate(t.pred)).sql), F.lit(False)), value).otherwise(F.col(t.col)))
    old, new = image(base), image(hit.withColumn(t.col, value))
    rows = hit.withColumn("__old", old).withColumn(t.col, value).withColumn("__new", new)
    diffs = _union([_diff(rows, F.col(k.from_col), "MODIFY", info, F.col("__old"), F.col("__new")) for k in info.owner_fks] or [_diff(rows, F.lit(None), "MODIFY", info, F.col("__old"), F.col("__new"))])
    return Result(out, diffs)


def pseudo_id(did: str, info: TableInfo, fk: str, group: tuple[str, ...]) -> str:
    """SQL for the id of the pseudoprincipal that takes over ``fk`` in a row's group."""
    owners = [k.from_col for k in info.owner_fks]
    return f"({PP_BASE}L + {digits(digest(f'{did}|{info.table}|{fk}', *owners, *(group or info.id_cols)))})"


def principal_rows(generator: Generator, uids: DataFrame, schema, did: str) -> DataFrame:
    """A row of the principal table for each ``uids(uid)``, by the generators."""
    cols = []
    for f in schema.fields:
        if f.name == generator.id_col:
            cols.append(F.col("uid").cast(f.dataType).alias(f.name))
        else:
            g = generator.columns.get(f.name, ("Null",))
            cols.append(F.expr(generated(g[0], digest(f"{did}|{f.name}", "uid"), *g[1:])).cast(f.dataType).alias(f.name))
    return uids.select(*cols)


def decorrelate(tables: dict, info: TableInfo, t: Decor, generator: Generator, did: str, user=None, valid: DataFrame | None = None) -> Result:
    """Each owner column in t.user_fk_cols gets a fresh pseudoprincipal for each group of rows.

    A group has equal owners and equal group columns (the row's ids if none are given). With a user only columns
    change whose value is the user or one of ``valid(uid)``, its pseudoprincipals. Matching nothing changes nothing.
    """
    base = tables[info.table]
    hit = matches(tables, info, t, None if valid is not None else user)
    if user is not None:
        valid = valid if valid is not None else base.sparkSession.createDataFrame([(str(user),)], "uid string")
    rows = hit.select(*info.id_cols, image(base).alias("__old"), *[F.expr(pseudo_id(did, info, fk, t.group_by_cols)).alias(f"__pp_{fk}") for fk in t.user_fk_cols], *[F.col(fk).alias(f"__was_{fk}") for fk in t.user_fk_cols])
    for fk in t.user_fk_cols:
        ok = F.col(f"__was_{fk}").isNotNull()
        if valid is not None:
            rows = rows.join(valid.select(F.col("uid").alias(f"__v_{fk}")), F.col(f"__was_{fk}").cast("string") == F.col(f"__v_{fk}"), "left")
            ok = F.col(f"__v_{fk}").isNotNull()
        rows = rows.withColumn(f"__pp_{fk}", F.when(ok, F.col(f"__pp_{fk}")))
    out = base.join(rows.select(*info.id_cols, *[f"__pp_{fk}" for fk in t.user_fk_cols]), list(info.id_cols), "left")
    for fk in t.user_fk_cols:
        out = out.withColumn(fk, F.coalesce(F.col(f"__pp_{fk}").cast(base.schema[fk].dataType), F.col(fk)))
    out = out.select(base.columns)
    parts, edges = [], []
    for fk in t.user_fk_cols:
        own = rows.where(F.col(f"__pp_{fk}").isNotNull())
        was, pp = F.col(f"__was_{fk}").cast("string"), F.col(f"__pp_{fk}").cast("string")
        parts.append(_diff(own, was, "DECOR", info, F.col("__old"), _with("__old", fk, pp), was, pp))
        edges.append(own.select(was.alias("old_uid"), pp.alias("new_uid")))
    edges = _union(edges).distinct()
    none = F.lit(None).cast("map<string,string>")
    new = edges.select(F.col("old_uid").alias("uid"), F.lit("NEW_PP").alias("typ"), F.lit(generator.table).alias("tbl"), F.create_map(F.lit(generator.id_col), "new_uid").alias("ids"), none.alias("old"), none.alias("new"), "old_uid", "new_uid")
    principals = principal_rows(generator, edges.select(F.col("new_uid").alias("uid")).distinct(), tables[generator.table].schema, did)
    return Result(out, _union([*parts, new]), edges, principals)


def remove_shared(tables: dict, info: TableInfo, t: Remove, generator: Generator, did: str, gone: DataFrame) -> Result:
    """Rows with several owners: an owner in ``gone(uid)`` is replaced by a pseudoprincipal; with all gone the row goes.

    Which owners of a row have gone is read off the row: a pseudoprincipal's id lies above PP_BASE. So a later removal
    by the last owner finds the row whole without any state beside the table.
    """
    base = tables[info.table]
    owners = [k.from_col for k in info.owner_fks]
    rows = matches(tables, info, t).withColumn("__old", image(base))
    for fk in owners:
        rows = rows.join(gone.select(F.col("uid").alias(f"__g_{fk}")).distinct(), F.col(fk).cast("string") == F.col(f"__g_{fk}"), "left")
    touched = " OR ".join(f"__g_{fk} IS NOT NULL" for fk in owners)
    rows = rows.where(touched)
    away = " AND ".join(f"(__g_{fk} IS NOT NULL OR {fk} >= {PP_BASE}L)" for fk in owners)
    for fk in owners:
        rows = rows.withColumn(f"__pp_{fk}", F.expr(f"CASE WHEN __g_{fk} IS NOT NULL THEN {pseudo_id(did, info, fk, ())} END"))
    rows = rows.withColumn("__away", F.expr(away))
    out = base.join(rows.select(*info.id_cols, "__away", *[f"__pp_{fk}" for fk in owners]), list(info.id_cols), "left").where("NOT coalesce(__away, false)")
    for fk in owners:
        out = out.withColumn(fk, F.coalesce(F.col(f"__pp_{fk}").cast(base.schema[fk].dataType), F.col(fk)))
    parts, edges = [], []
    for fk in owners:
        own = rows.where(F.col(f"__pp_{fk}").isNotNull())
        pp = F.col(f"__pp_{fk}").cast("string")
        parts.append(_diff(own.where("__away"), F.col(fk), "REMOVE", info, F.col("__old"), F.lit(None).cast("map<string,string>")))
        own = own.where("NOT __away")
        parts.append(_diff(own, F.col(fk), "DECOR", info, F.col("__old"), _with("__old", fk, pp), F.col(fk), pp))
        edges.append(own.select(F.col(fk).cast("string").alias("old_uid"), pp.alias("new_uid")))
    edges = _union(edges).distinct()
    principals = principal_rows(generator, edges.select(F.col("new_uid").alias("uid")).distinct(), tables[generator.table].schema, did)
    none = F.lit(None).cast("map<string,string>")
    new = edges.select(F.col("old_uid").alias("uid"), F.lit("NEW_PP").alias("typ"), F.lit(generator.table).alias("tbl"), F.create_map(F.lit(generator.id_col), "new_uid").alias("ids"), none.alias("old"), none.alias("new"), "old_uid", "new_uid")
    return Result(out.select(base.columns), _union([*parts, new]), edges, principals)
