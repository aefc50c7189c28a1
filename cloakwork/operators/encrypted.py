"""Tables whose cells are encrypted under a key of their own for each row; keys are a table joined on the row's id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_keys(rows: DataFrame, ids: list[str], secret: str) -> DataFrame:
    """(ids..., key): a 128-bit key for each row, derived from a secret."""
    return rows.select(*ids).distinct().withColumn("key", F.unhex(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), *[F.col(c).cast("string") for c in ids]), 256), 1, 32)))


def insert(rows: DataFrame, keys: DataFrame, ids: list[str]) -> DataFrame:
    """Every column but the ids encrypted; null stays null."""
    both = rows.join(keys, ids)
    return both.select(*[F.col(c) if c in ids else F.expr(f"aes_encrypt(cast(cast({c} as string) as binary), key, 'GCM')").alias(c) for c in rows.columns])


def select(cipher: DataFrame, keys: DataFrame, ids: list[str], types: dict[str, str], where: str = "true") -> DataFrame:
    """Rows that the keys open, decrypted before the predicate; rows without a key are left out."""
    both = cipher.join(keys, ids)
    plain = both.select(*[F.col(c) if c in ids else F.expr(f"cast(cast(try_aes_decrypt({c}, key, 'GCM') as string) as {types[c]})").alias(c) for c in cipher.columns])
    return plain.where(where)


def delete(cipher: DataFrame, keys: DataFrame, ids: list[str], types: dict[str, str], where: str) -> tuple[DataFrame, DataFrame]:
    """Table and keys without the rows that match."""
    gone = select(cipher, keys, ids, types, where).select(*ids)
    return cipher.join(gone, ids, "left_anti"), keys.join(gone, ids, "left_anti")


def update(cipher: DataFrame, keys: DataFrame, ids: list[str], types: dict[str, str], where: str, **sets: str) -> DataFrame:
    """Matching rows with new values, encrypted again under their own key."""
    hit = select(cipher, keys, ids, types, where)
    new = insert(hit.select(*[F.expr(sets[c]).cast(types[c]).alias(c) if c in sets else F.col(c) for c in hit.columns]), keys, ids)
    return cipher.join(hit.select(*ids), ids, "left_anti").unionByName(new)
