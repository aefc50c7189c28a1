"""Keys and sealed bags. Keys are derived on the driver, bags are encrypted by Spark.

Sealing is symmetric (AES-GCM): unlike with a public key, who can seal a principal's bag can also open it.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A prime of 521 bits (2**521 - 1): the field of the shares.
PRIME = (1 << 521) - 1


def password_key(uid: str, password: str, salt: bytes = b"") -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt + uid.encode(), 20_000)


def split(secret: int, points: list[int], threshold: int = 2) -> list[tuple[int, int]]:
    """Shamir shares of a secret at the given x; any ``threshold`` of them give it back."""
    line = [secret, *(secrets.randbelow(PRIME) for _ in range(threshold - 1))]
    return [(x, sum(c * pow(x, i, PRIME) for i, c in enumerate(line)) % PRIME) for x in points]


def join(shares: list[tuple[int, int]]) -> int:
    """The secret: the polynomial's value at 0."""
    total = 0
    for i, (x, y) in enumerate(shares):
        top = bottom = 1
        for j, (z, _) in enumerate(shares):
            if i != j:
                top, bottom = top * -z % PRIME, bottom * (x - z) % PRIME
        total = (total + y * top * pow(bottom, -1, PRIME)) % PRIME
    return total


class Vault:
    """Principals' keys: by uid and password, or by one stored share and the share that the user holds."""

    def __init__(self):
        self.stored: dict[str, tuple[int, int]] = {}
        self.index: dict[str, str] = {}
        self._check: dict[str, str] = {}

    def register(self, uid: str, password: str) -> tuple[int, int]:
        """Keeps one share, gives one away; the third lies at the password's point."""
        key = int.from_bytes(secrets.token_bytes(32), "big")
        x = int.from_bytes(password_key(uid, password), "big") % PRIME
        slope = secrets.randbelow(PRIME)
        at = lambda p: (p, (key + slope * p) % PRIME)
        self.stored[uid] = at(1)
        self._third = getattr(self, "_third", {}) | {uid: at(x)[1]}
        self._check[uid] = hashlib.sha256(key.to_bytes(32, "big")).hexdigest()
        return at(2)

    def key(self, uid: str, password: str | None = None, share: tuple[int, int] | None = None) -> bytes | None:
        """The principal's key, or None with too few shares or wrong ones."""
        if uid not in self.stored:
            return None
        shares = [self.stored[uid]]
        if share:
            shares.append(tuple(share))
        elif password is not None:
            shares.append((int.from_bytes(password_key(uid, password), "big") % PRIME, self._third[uid]))
        if len(shares) < 2:
            return None
        got = join(shares)
        raw = got.to_bytes(66, "big")[-32:]
        return raw if hashlib.sha256(raw).hexdigest() == self._check[uid] else None


def seal(diffs: DataFrame, keys: DataFrame) -> DataFrame:
    """(uid, did, loc, bag): one encrypted bag for each user and disguise from diffs and ``keys(uid, key)``."""
    cols = [c for c in diffs.columns if c not in ("uid", "did")]
    bags = diffs.groupBy("uid", "did").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in diffs.select(cols).dtypes])))).alias("bag"))
    bags = bags.join(keys, "uid").withColumn("bag", F.expr("aes_encrypt(cast(bag as binary), key, 'GCM')"))
    return bags.select("uid", "did", F.sha2(F.concat_ws("|", "uid", "did"), 256).alias("loc"), "bag")


def unseal(bags: DataFrame, uid: str, key: bytes) -> DataFrame:
    """The user's bags as text; with a wrong key null."""
    return bags.where(F.col("uid") == uid).select("uid", "did", F.expr(f"cast(try_aes_decrypt(bag, unhex('{key.hex()}'), 'GCM') as string)").alias("bag"))
