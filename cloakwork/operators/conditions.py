"""Conditions on rows that ask other tables: SQL over the row's columns and over marks, each a key set that the row may be in."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = itertools.count()


@dataclass(frozen=True)
class Cond:
    """``&``, ``|`` and ``~`` combine conditions; a null is false at the end, a mark never null (as EXISTS)."""

    sql: str
    marks: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)

    def __and__(self, other: Cond) -> Cond:
        return Cond(f"({self.sql}) AND ({other.sql})", self.marks | other.marks)

    def __or__(self, other: Cond) -> Cond:
        return Cond(f"({self.sql}) OR ({other.sql})", self.marks | other.marks)

    def __invert__(self) -> Cond:
        return Cond(f"NOT ({self.sql})", self.marks)


ALWAYS, NEVER = Cond("true"), Cond("false")


def member(column: str, keys: DataFrame) -> Cond:
    """The row's column is among the keys (a frame of one column); a null is in no set."""
    name = f"__mark{next(_NUMBER)}"
    return Cond(name, {name: (column, keys)})


def keep(df: DataFrame, cond: Cond) -> DataFrame:
    """Rows that the condition holds for: a semi or anti join for one mark, else a left join on distinct keys for each.

    Keys are distinct before the join, so no row is doubled; all joins are on equal keys, whose skew AQE splits.
    """
    if list(cond.marks) in ([cond.sql], [cond.sql.removeprefix("NOT (").removesuffix(")")]):
        ((column, keys),) = cond.marks.values()
        return df.join(keys.toDF("__key"), F.col(column) == F.col("__key"), "left_anti" if cond.sql.startswith("NOT") else "left_semi")
    out = df
    for name, (column, keys) in cond.marks.items():
        flags = keys.toDF(f"{name}_key").where(F.col(f"{name}_key").isNotNull()).distinct().withColumn(f"{name}_in", F.lit(True))
        out = out.join(flags, F.col(column) == F.col(f"{name}_key"), "left").withColumn(name, F.coalesce(f"{name}_in", F.lit(False)))
    return out.where(F.expr(cond.sql)).select(*[F.col(f"`{c}`") for c in df.columns])


def containing(texts: DataFrame, text: str, needles: DataFrame, key: str, needle: str, width: int = 8) -> DataFrame:
    """Keys of the needles that occur somewhere in a text: equal beginnings first, the whole confirmed after.

    Every text gives its distinct stretches as long as a needle's beginning (its first ``width`` characters; shorter ones whole), a
    join on equal stretches finds the texts to look into. An empty needle is in any text, null in none.
    """
    size = F.least(F.char_length(needle), F.lit(width))
    known = needles.where(F.col(needle).isNotNull()).select(F.col(key).alias("__id"), F.col(needle).alias("__needle"), size.alias("__size"), F.substring(needle, 1, width).alias("__start"))
    sizes = sorted(r[0] for r in known.select("__size").distinct().collect())  # width + 1 numbers at most
    lines = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("__text")).distinct()
    found = needles.select(F.col(key).alias("__id")).limit(0)
    for n in sizes:
        at = known.where(F.col("__size") == n)
        if n == 0:
            found = found.union(at.select("__id")) if not lines.isEmpty() else found
            continue
        spots = F.transform(F.sequence(F.lit(1), F.char_length("__text") - n + 1), lambda i: F.substring("__text", i, F.lit(n)))
        starts = lines.where(F.char_length("__text") >= n).select("__text", F.explode(F.array_distinct(spots)).alias("__start"))
        found = found.union(starts.join(at, "__start").where(F.contains("__text", "__needle")).select("__id"))
    return found.distinct()
