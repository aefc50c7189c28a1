"""Tables, their keys, and specifications; all sources and sinks work on immutable snapshots."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ForeignKey:
    from_col: str
    to_table: str
    to_col: str


@dataclass(frozen=True)
class TableInfo:
    table: str
    id_cols: tuple[str, ...]
    owner_fks: tuple[ForeignKey, ...] = ()
    other_fks: tuple[ForeignKey, ...] = ()


@dataclass(frozen=True)
class Remove:
    pred: str = "true"
    frm: str | None = None


@dataclass(frozen=True)
class Modify:
    col: str
    generator: tuple
    pred: str = "true"
    frm: str | None = None


@dataclass(frozen=True)
class Decor:
    user_fk_cols: tuple[str, ...]
    group_by_cols: tuple[str, ...] = ()
    pred: str = "true"
    frm: str | None = None


@dataclass(frozen=True)
class Generator:
    """How a pseudoprincipal's row is made: its table, id column, and a generator for each other column."""

    table: str
    id_col: str
    columns: dict = field(default_factory=dict)


_NAME = re.compile(r"[A-Za-z_]\w*$")


def load_spec(text: str) -> dict[str, list]:
    """A specification from JSON: table -> list of {type: remove|modify|decor, ...}. Wrong shapes are named in the error."""
    out: dict[str, list] = {}
    for table, items in json.loads(text).items():
        for x in items:
            kind = str(x.get("type", "")).lower()
            if not isinstance(x.get("pred", "true"), str):
                raise ValueError(f"{table}: a predicate is text, not {type(x['pred']).__name__}")
            for c in (*x.get("user_fk_cols", ()), *x.get("group_by_cols", ()), *([x["col"]] if "col" in x else [])):
                if not _NAME.match(c):
                    raise ValueError(f"{table}: {c!r} is not one column name")
            more = {"pred": x.get("pred", "true"), "frm": x.get("from")}
            if kind == "remove":
                t = Remove(**more)
            elif kind == "modify":
                t = Modify(x["col"], tuple(x["generator"]), **more)
            elif kind == "decor":
                t = Decor(tuple(x["user_fk_cols"]), tuple(x.get("group_by_cols", ())), **more)
            else:
                raise ValueError(f"{table}: no transformation {x.get('type')!r}")
            out.setdefault(table, []).append(t)
    return out


def load_info(text: str) -> dict[str, TableInfo]:
    keys = lambda xs: tuple(ForeignKey(x["from_col"], x["to_table"], x["to_col"]) for x in xs)
    return {t: TableInfo(t, tuple(x["id_cols"]), keys(x.get("owner_fks", ())), keys(x.get("other_fks", ()))) for t, x in json.loads(text).items()}


def read_tables(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names}


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def insert(base: DataFrame, rows: DataFrame) -> DataFrame:
    return base.unionByName(rows)


def upsert(base: DataFrame, rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows replace those with equal ids."""
    return base.join(rows.select(*ids), ids, "left_anti").select(base.columns).unionByName(rows)


def update(base: DataFrame, where: str, **sets: str) -> DataFrame:
    hit = F.coalesce(F.expr(where), F.lit(False))
    return base.select(*[F.when(hit, F.expr(sets[c]).cast(t)).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c, t in base.dtypes])


def delete(base: DataFrame, where: str) -> DataFrame:
    """A predicate that is null keeps the row."""
    return base.where(~F.coalesce(F.expr(where), F.lit(False)))


def delete_matching(base: DataFrame, rows: DataFrame, ids: list[str]) -> DataFrame:
    return base.join(rows.select(*ids), ids, "left_anti").select(base.columns)


def space(df: DataFrame, payload: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.octet_length(payload)), F.lit(0)).alias("n_bytes"))
