"""Predicates, value comparison and deterministic value generators."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Generated ids start here, above any natural one; 60 bits of a digest follow.
PP_BASE = 1 << 60


@dataclass(frozen=True)
class Pred:
    """A predicate as SQL text; ``&``, ``|`` and ``~`` parenthesise, so that mixing them keeps its meaning."""

    sql: str

    def __and__(self, other: Pred) -> Pred:
        return Pred(f"({self.sql}) AND ({other.sql})")

    def __or__(self, other: Pred) -> Pred:
        return Pred(f"({self.sql}) OR ({other.sql})")

    def __invert__(self) -> Pred:
        return Pred(f"NOT ({self.sql})")


TRUE, FALSE = Pred("true"), Pred("false")
#: col & mask as the whole of a predicate or of an operand of AND or OR: an integer where Spark wants a boolean.
_MASK = re.compile(r"(?i)(^|\(|\bAND\b|\bOR\b|\bNOT\b)(\s*)([\w.`]+\s*&\s*\w+)(?=\s*($|\)|\bAND\b|\bOR\b))")


def predicate(text: str) -> Pred:
    """A user's predicate; bitmask integers become comparisons with 0."""
    if not isinstance(text, str):
        raise TypeError(f"a predicate is SQL text, not {type(text).__name__}")
    return Pred(_MASK.sub(r"\1\2(\3) <> 0", text))


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, int | float) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def compare(col: str, op: str, value) -> Pred:
    return Pred(f"{col} {op} {literal(value)}")


def in_list(col: str, values: list, negated: bool = False) -> Pred:
    if not values:
        return TRUE if negated else FALSE
    return Pred(f"{col} {'NOT ' * negated}IN ({', '.join(map(literal, values))})")


def owner_filter(owner_fks: list[str], user) -> Pred:
    """True without a user; else any owner column equals the user."""
    if user is None:
        return TRUE
    if not owner_fks:
        raise ValueError("a user was given, but the table has no owner columns")
    return functools.reduce(operator.or_, (compare(f, "=", user) for f in owner_fks))


def owned_by(df: DataFrame, fk: str, user, edges: DataFrame, negated: bool = False) -> DataFrame:
    """Rows whose owner is the user or, one hop on, a pseudoprincipal of the user (or, negated, neither); nulls never match."""
    ids = edges.where(F.col("old_uid") == F.lit(str(user))).select(F.col("new_uid").alias("__u")).union(edges.sparkSession.createDataFrame([(str(user),)], "__u string")).distinct()
    return df.where(F.col(fk).isNotNull()).join(ids, F.col(fk).cast("string") == F.col("__u"), "left_anti" if negated else "left_semi")


def compare_text(a: Column, b: Column) -> Column:
    """-1, 0 or 1: by number if both are numbers, else by text; null equals null and comes first."""
    x, y = a.try_cast("double"), b.try_cast("double")
    less = F.when(x.isNotNull() & y.isNotNull(), x < y).otherwise(a < b)
    same = F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(same, 0).when(less, -1).otherwise(1)


def digest(seed: str, *keys) -> str:
    """SQL for the md5 of a seed and keys, equal in any engine."""
    return f"md5(concat_ws('|', {literal(seed)}, {', '.join(f'coalesce(cast({k} as string), chr(0))' for k in keys)}))"


def digits(md5: str, n: int = 15) -> str:
    return f"cast(conv(substr({md5}, 1, {n}), 16, 10) as bigint)"


def generated(kind: str, md5: str, *args) -> str:
    """SQL for one value of a generator, all randomness from an md5: the same value wherever the plan is evaluated."""
    if kind in ("ConstNum", "ConstStr", "Bool"):
        return literal(args[0])
    if kind == "Null":
        return "NULL"
    if kind == "Timestamp":
        return f"timestamp_seconds({int(args[0])})" if args else "current_timestamp()"
    if kind == "RandNum":
        lo, hi = args
        return f"({lo} + {digits(md5, 12)} % {hi - lo})"
    if kind == "RandStr":
        return f"substr(repeat({md5}, {args[0] // 32 + 1}), 1, {args[0]})"
    if kind == "RandEmail":
        return f"concat(substr({md5}, 1, 20), '@anon.com')"
    if kind == "RandPhone":
        return f"lpad(cast({digits(md5, 12)} % 1000000000 as string), 9, '0')"
    raise ValueError(f"no generator {kind!r}")


def image(df: DataFrame) -> Column:
    """A row as a map from column to text, null staying null."""
    return F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])


def restored(images: DataFrame, column: str, schema) -> list[Column]:
    """A map's columns, cast back to the types of a table."""
    return [F.element_at(column, f.name).cast(f.dataType).alias(f.name) for f in schema.fields]


#: Two text functions that policies use: the fourth tab-separated field up to a line feed, and the first word before a space.
AFFILIATION = "nullif(regexp_extract({0}, '^[^\\\\t\\\\n]*\\\\t[^\\\\t\\\\n]*\\\\t[^\\\\t\\\\n]*\\\\t([^\\\\t\\\\n]*)', 1), '')"
TOPIC = "CASE WHEN instr({0}, ' ') > 1 THEN substring_index({0}, ' ', 1) END"
