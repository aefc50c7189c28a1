"""Sealed records of disguises: bags that only a principal's private key opens, followed from principal to pseudoprincipal.

Sealing needs public keys only (Diffie-Hellman with a one-time exponent for each bag, then AES-GCM in Spark). A bag holds at most
about ``CHUNK`` records, so a principal with many records has many bags and no task gathers them all. One-time exponents and the
keys of pseudoprincipals are digests under a random seed of each disguise: a lost task computes the same again, and the seed goes
with the disguise.
"""

from __future__ import annotations

import _hashlib
import ctypes
import functools
import hashlib
import secrets
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType

from cloakwork.operators import vault
from cloakwork.operators.engine import Engine
from cloakwork.operators.speaksfor import durable
from cloakwork.sources.catalog import space

CHUNK = 1000
BASE = 2
RECORD = "uid string, kind string, payload string, new_uid string, secret string"
_PRINCIPAL = "uid string, public string, spot string"
_BAG = "loc string, did string, eph string, bag binary"
_LOCATOR = "spot string, eph string, at binary"


@functools.cache
def prime() -> int:
    """The 2048-bit safe prime of RFC 3526, by its rule: 2^2048 - 2^1984 - 1 + 2^64 * (floor(2^1918 * pi) + 124476)."""
    one = 1 << 1990

    def arctan(n: int) -> int:  # arctan(1/n) * one, by its series
        term, total, i = one // n, 0, 0
        while term:
            total += (term if i % 2 == 0 else -term) // (2 * i + 1)
            term //= n * n
            i += 1
        return total

    pi = 4 * (4 * arctan(5) - arctan(239)) >> 72
    return (1 << 2048) - (1 << 1984) - 1 + (1 << 64) * (pi + 124476)


@functools.cache
def _openssl():
    """A function (base, exponent) -> base ** exponent mod prime of the OpenSSL that hashlib is linked to, in constant time; None without one."""
    try:
        lib = ctypes.CDLL(_hashlib.__file__)
        pointer = ctypes.c_void_p
        for name, result, *args in (
            ("BN_new", pointer), ("BN_CTX_new", pointer), ("BN_MONT_CTX_new", pointer), ("BN_clear_free", None, pointer), ("BN_CTX_free", None, pointer),
            ("BN_bin2bn", pointer, ctypes.c_char_p, ctypes.c_int, pointer), ("BN_bn2binpad", ctypes.c_int, pointer, ctypes.c_char_p, ctypes.c_int),
            ("BN_MONT_CTX_set", ctypes.c_int, pointer, pointer, pointer), ("BN_mod_exp_mont_consttime", ctypes.c_int, *[pointer] * 6),
        ):
            f = getattr(lib, name)
            f.restype, f.argtypes = result, args
    except (OSError, AttributeError):
        return None
    size = prime().bit_length() // 8
    number = lambda x: lib.BN_bin2bn(x.to_bytes(size, "big"), size, None)
    modulus, shared, ctx = number(prime()), lib.BN_MONT_CTX_new(), lib.BN_CTX_new()
    ready = lib.BN_MONT_CTX_set(shared, modulus, ctx)
    lib.BN_CTX_free(ctx)

    def power(base: int, exponent: int) -> int:  # numbers of its own for each call: threads may meet here
        a, e, out, ctx, raw = number(base), number(exponent), lib.BN_new(), lib.BN_CTX_new(), ctypes.create_string_buffer(size)
        try:
            if lib.BN_mod_exp_mont_consttime(out, a, e, modulus, ctx, shared) != 1 or lib.BN_bn2binpad(out, raw, size) != size:
                raise ArithmeticError("OpenSSL could not compute a modular power")
            return int.from_bytes(raw.raw, "big")
        finally:
            lib.BN_clear_free(a), lib.BN_clear_free(e), lib.BN_clear_free(out), lib.BN_CTX_free(ctx)

    return power if ready == 1 else None


def power(base: int, exponent: int) -> int:
    """base ** exponent mod prime; by Python where there is no OpenSSL, and for numbers that are not of the group."""
    fast = _openssl()
    if fast is None or not (0 < base < prime() and 0 < exponent < prime()):
        return pow(base, exponent, prime())
    return fast(base, exponent)


def new_key() -> str:
    return secrets.token_hex(32)


def public_key(secret: str) -> str:
    return f"{power(BASE, int(secret, 16)):x}"


def spot_of(secret: str) -> str:
    """Where a principal's locators lie: a digest of its private key."""
    return hashlib.sha256(f"spot|{secret}".encode()).hexdigest()


def _agreed(public: str, secret: str) -> bytes:
    return hashlib.sha256(f"{power(int(public, 16), int(secret, 16)):x}".encode()).digest()


@pandas_udf(BinaryType())
def _opening(eph: pd.Series, secret: pd.Series) -> pd.Series:
    return pd.Series([None if e is None else _agreed(e, s) for e, s in zip(eph, secret, strict=True)])


def _sealing(seed: str, public: Column, label: Column) -> Column:
    """(eph, key): a one-time public value and the key agreed with the holder of ``public``."""

    @pandas_udf("eph string, key binary")
    def agree(public: pd.Series, label: pd.Series) -> pd.DataFrame:
        once = [hashlib.sha256(f"{seed}|once|{x}".encode()).hexdigest() for x in label]
        return pd.DataFrame({"eph": [public_key(x) for x in once], "key": [_agreed(p, x) for p, x in zip(public, once, strict=True)]})

    return agree(public, label)


def _keys(seed: str, uids: DataFrame) -> DataFrame:
    """(uid, secret, public, spot) for each uid."""

    @pandas_udf("secret string, public string, spot string")
    def derive(uid: pd.Series) -> pd.DataFrame:
        got = [hashlib.sha256(f"{seed}|key|{u}".encode()).hexdigest() for u in uid]
        return pd.DataFrame({"secret": got, "public": [public_key(x) for x in got], "spot": [spot_of(x) for x in got]})

    return _spread(uids).select("uid", derive("uid").alias("k")).select("uid", "k.*")


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores before costly work on few bytes, which adaptive execution would gather in one task."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there; a checkpoint would compute it twice, modular powers and all."""
    to = f"{df.sparkSession.sparkContext.getCheckpointDir()}/sealed-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


class Records:
    """Principals, bags and locators. Between ``start_disguise`` and ``end_disguise`` records gather, unsealed, for one disguise.

    Records for unknown principals are dropped. With ``dry_run`` nothing is encrypted.
    """

    def __init__(self, spark: SparkSession, dry_run: bool = False):
        durable(spark)
        self.spark, self.dry_run, self.vault = spark, dry_run, vault.Vault()
        self.principals = spark.createDataFrame([], _PRINCIPAL)
        self.bags = spark.createDataFrame([], _BAG)
        self.locators = spark.createDataFrame([], _LOCATOR)
        self.did: str | None = None

    # --- principals ---

    def register(self, uid) -> str:
        """A principal without sharing: its private key, which is kept nowhere."""
        key = new_key()
        self._add(self.spark.createDataFrame([(str(uid), public_key(key), spot_of(key))], _PRINCIPAL))
        return key

    def register_all(self, uids: DataFrame, seed: str) -> None:
        """Principals for ``uids(uid)`` with keys derived from a secret seed; ``derived_key`` gives one of them."""
        self._add(_keys(seed, uids.select(F.col("uid").cast("string")).distinct()).select("uid", "public", "spot"))

    def register_with_password(self, uid, password: str) -> tuple[int, int]:
        """A principal whose key comes back from its password, or from the share that is returned."""
        share = self.vault.register(str(uid), password)
        key = self.vault.key(str(uid), password).hex()
        self._add(self.spark.createDataFrame([(str(uid), public_key(key), spot_of(key))], _PRINCIPAL))
        return share

    def private_key(self, uid, password: str | None = None, share: tuple[int, int] | None = None) -> str | None:
        got = self.vault.key(str(uid), password, share)
        return got.hex() if got else None

    def _add(self, rows: DataFrame) -> None:
        self.principals = kept(self.principals.join(rows.select("uid"), "uid", "left_anti").unionByName(rows))

    # --- one disguise ---

    def start_disguise(self) -> str:
        if self.did:
            raise RuntimeError("a disguise is open already")
        self.did, self._seed, self._gone, self._open = str(secrets.randbits(64)), new_key(), [], []
        return self.did

    def save_diffs(self, rows: DataFrame) -> None:
        """``rows(uid, payload)``: any text, one record each."""
        none = F.lit(None).cast("string")
        self._open.append(rows.select(F.col("uid").cast("string"), F.lit("DIFF").alias("kind"), "payload", none.alias("new_uid"), none.alias("secret")))

    def save_diff(self, uid, payload: str) -> None:
        self.save_diffs(self.spark.createDataFrame([(str(uid), payload)], "uid string, payload string"))

    def register_pseudoprincipals(self, edges: DataFrame) -> None:
        """``edges(old_uid, new_uid)``: keys for the new ones, each put into the bag of the old one (if that is known)."""
        keys = kept(_keys(self._seed, edges.select(F.col("new_uid").alias("uid")).distinct()))
        self._add(keys.select("uid", "public", "spot"))
        chain = edges.select("old_uid", "new_uid").distinct().join(keys.select(F.col("uid").alias("new_uid"), "secret"), "new_uid")
        self._open.append(chain.select(F.col("old_uid").alias("uid"), F.lit("CHAIN").alias("kind"), F.lit(None).cast("string").alias("payload"), "new_uid", "secret"))

    def forget(self, uid) -> None:
        """The principal's public part goes into its own bag; the principal goes when the disguise ends."""
        me = self.principals.where(F.col("uid") == str(uid))
        none = F.lit(None).cast("string")
        self._open.append(me.select("uid", F.lit("PRINCIPAL").alias("kind"), F.to_json(F.struct("uid", "public", "spot")).alias("payload"), none.alias("new_uid"), none.alias("secret")))
        self._gone.append(str(uid))

    def end_disguise(self) -> None:
        """Seals what has gathered and forgets the disguise's seed."""
        if not self.did:
            raise RuntimeError("no disguise is open")
        if self._open:
            rows = functools.reduce(DataFrame.unionByName, self._open)
            bags, locators = self._seal(rows, self.did, self._seed)
            self.bags, self.locators = kept(self.bags.unionByName(bags)), kept(self.locators.unionByName(locators))
        if self._gone:
            self.principals = kept(self.principals.where(~F.col("uid").isin(self._gone)))
        self.did = self._seed = None
        self._open, self._gone = [], []

    def _seal(self, rows: DataFrame, did: str, seed: str) -> tuple[DataFrame, DataFrame]:
        rows = kept(rows.select(*[F.col(c.split()[0]) for c in RECORD.split(", ")], F.monotonically_increasing_id().alias("n")))
        many = rows.groupBy("uid").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")).join(self.principals, "uid")
        dealt = rows.join(many, "uid").withColumn("chunk", F.pmod(F.xxhash64("n"), "chunks"))
        record = F.struct("n", "uid", "kind", "payload", "new_uid", "secret")
        bags = dealt.groupBy("uid", "public", "spot", "chunk").agg(F.to_json(F.sort_array(F.collect_list(record))).alias("text"))
        bags = bags.withColumn("loc", F.sha2(F.concat_ws("|", F.lit(seed), "uid", "chunk"), 256))
        if self.dry_run:
            bags = bags.withColumn("s", F.struct(F.lit(None).cast("string").alias("eph"), F.lit(None).cast("binary").alias("key"))).withColumn("bag", F.col("text").cast("binary")).withColumn("at", F.col("loc").cast("binary"))
        else:
            bags = _spread(bags).withColumn("s", _sealing(seed, F.col("public"), F.col("loc"))).withColumn("bag", F.aes_encrypt(F.col("text").cast("binary"), "s.key")).withColumn("at", F.aes_encrypt(F.col("loc").cast("binary"), "s.key"))
        bags = kept(bags.select("loc", "spot", "s.eph", "bag", "at"))
        return bags.select("loc", F.lit(did).alias("did"), "eph", "bag"), bags.select("spot", "eph", "at")

    # --- with a key ---

    def open(self, uid, secret: str) -> DataFrame:
        """(loc, spot, did, uid, kind, payload, new_uid, secret): all records that the key opens, those of pseudoprincipals included.

        A frontier of principals, one written round a hop; a key that isn't the principal's opens nothing.
        """
        front = self.spark.createDataFrame([(str(uid), secret, spot_of(secret))], "uid string, secret string, spot string")
        seen, found = front.select("spot"), None
        part = "array<struct<n: bigint, uid: string, kind: string, payload: string, new_uid: string, secret: string>>"
        spot_udf = pandas_udf(lambda s: s.map(spot_of, na_action="ignore"), "string")
        while True:
            mine = self.locators.join(front, "spot")
            if self.dry_run:
                mine = mine.select("uid", "spot", F.lit(None).cast("binary").alias("key"), F.col("at").cast("string").alias("loc")).join(self.bags, "loc").withColumn("text", F.col("bag").cast("string"))
            else:
                mine = _spread(mine).withColumn("key", _opening("eph", "secret")).withColumn("loc", F.try_aes_decrypt("at", "key").cast("string"))
                mine = mine.select("uid", "spot", "key", "loc").join(self.bags, "loc").withColumn("text", F.try_aes_decrypt("bag", "key").cast("string"))
            step = mine.select("loc", "spot", "did", "uid", F.explode(F.from_json("text", part)).alias("r")).where("uid = r.uid")
            step = kept(step.select("loc", "spot", "did", "uid", "r.kind", "r.payload", "r.new_uid", "r.secret"))
            found = step if found is None else found.unionByName(step)
            front = kept(step.where("kind = 'CHAIN'").select(F.col("new_uid").alias("uid"), "secret").distinct().withColumn("spot", spot_udf("secret")).join(seen, "spot", "left_anti"))
            if front.isEmpty():
                return found
            seen = seen.union(front.select("spot"))

    def get_records(self, did: str, uid, secret: str) -> tuple[DataFrame, DataFrame]:
        """(uid, payload) of one disguise, and (old_uid, new_uid, secret) of all chains that the key opens."""
        got = self.open(uid, secret)
        chains = got.where("kind = 'CHAIN'").select(F.col("uid").alias("old_uid"), "new_uid", "secret").distinct()
        return got.where((F.col("did") == did) & (F.col("kind") == "DIFF")).select("uid", "payload"), chains

    def pseudoprincipals(self, uid, secret: str) -> DataFrame:
        """uid: the principal and all its pseudoprincipals."""
        return self.open(uid, secret).where("kind = 'CHAIN'").select(F.col("new_uid").alias("uid")).union(self.spark.createDataFrame([(str(uid),)], "uid string")).distinct()

    def restore_principal(self, did: str, uid, secret: str) -> None:
        """A principal that a disguise forgot is registered again under its old key."""
        back = self.open(uid, secret).where((F.col("did") == did) & (F.col("kind") == "PRINCIPAL")).select(F.from_json("payload", _PRINCIPAL).alias("p")).select("p.*")
        self._add(back.distinct())

    def cleanup(self, did: str, uid, secret: str) -> None:
        """The disguise's records that the key opens go; chains stay that still lead to records of other disguises."""
        got = self.open(uid, secret)
        chains = got.where("kind = 'CHAIN'").select(F.col("uid").alias("old"), F.col("new_uid").alias("new")).distinct()
        needed = got.where((F.col("did") != did) & (F.col("kind") != "CHAIN")).select("uid").distinct().checkpoint()
        front = needed
        while True:  # up from who holds other records to whose chains lead there
            front = chains.join(front, F.col("new") == F.col("uid"), "left_semi").select(F.col("old").alias("uid")).distinct().join(needed, "uid", "left_anti").checkpoint()
            if front.isEmpty():
                break
            needed = needed.union(front).checkpoint()
        stay = got.where((F.col("did") == did) & (F.col("kind") == "CHAIN")).join(needed.select(F.col("uid").alias("new_uid")), "new_uid", "left_semi")
        stay = stay.select(*[F.col(c.split()[0]) for c in RECORD.split(", ")]).checkpoint()
        kept_spots = got.where(F.col("did") != did).select("spot").distinct()
        gone = got.where(F.col("did") == did).select("loc", "spot").distinct().checkpoint()
        # locators can't be told apart without their keys: those of principals without other bags go, the rest point to nothing
        idle = gone.select("spot").distinct().join(kept_spots, "spot", "left_anti")
        bags, locators = self.bags.join(gone.select("loc"), "loc", "left_anti"), self.locators.join(idle, "spot", "left_anti")
        if not stay.isEmpty():
            again = self._seal(stay, did, new_key())
            bags, locators = bags.unionByName(again[0]), locators.unionByName(again[1])
        self.bags, self.locators = kept(bags.select(*[c.split()[0] for c in _BAG.split(", ")])), kept(locators.select("spot", "eph", "at"))

    # --- keeping ---

    def space(self) -> DataFrame:
        """(part, n_rows, n_bytes) of the bags and of the locators."""
        return space(self.bags, "bag").withColumn("part", F.lit("bags")).unionByName(space(self.locators, "at").withColumn("part", F.lit("locators")))

    def save(self, path: str) -> None:
        for name in ("principals", "bags", "locators"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, dry_run: bool = False) -> Records:
        out = cls(spark, dry_run)
        for name in ("principals", "bags", "locators"):
            setattr(out, name, spark.read.parquet(f"{path}/{name}"))
        return out


def derived_key(seed: str, uid) -> str:
    return hashlib.sha256(f"{seed}|key|{uid}".encode()).hexdigest()


class SealedEngine(Engine):
    """An engine that keeps no diffs and no edges in the clear: each goes into its owner's bag, and a reveal needs the owner's key."""

    def __init__(self, spark, tables, info, generator, records: Records):
        super().__init__(spark, tables, info, generator)
        self.records, self.names = records, {}

    def apply(self, spec: dict[str, list], user=None, secret: str | None = None) -> str:
        """As the engine's; with a user's key the rows of the user's pseudoprincipals are the user's, too."""
        self._recall(None, user, secret)
        before = self.edges
        did = super().apply(spec, user)
        name = self.records.start_disguise()
        try:
            new = self.edges.join(before, ["did", "old_uid", "new_uid"], "left_anti")
            self.records.register_pseudoprincipals(new.select("old_uid", "new_uid"))
            self.records.save_diffs(self.diffs.where(F.col("did") == did).select("uid", F.to_json(F.struct("*")).alias("payload")))
        finally:
            self.records.end_disguise()
        self.names[did] = name
        self._forget()
        return did

    def reveal(self, did: str, user=None, mode: str = "restore", allow_partial: bool = True, secret: str | None = None) -> None:
        """Undo a disguise as far as the user's key opens its records; without a key nothing changes."""
        if user is None or secret is None:
            return
        self._recall(self.names[did], user, secret)
        held = self.diffs.count()
        super().reveal(did, None, mode, allow_partial)
        if held and self.diffs.where(F.col("did") == did).isEmpty():
            self.records.cleanup(self.names[did], user, secret)
        self._forget()

    def _recall(self, name: str | None, user, secret: str | None) -> None:
        self._forget()
        if user is None or secret is None:
            return
        got = self.records.open(user, secret)
        edges = got.where("kind = 'CHAIN'").select(F.col("did"), F.col("uid").alias("old_uid"), "new_uid")
        self.edges = self.edges.unionByName(edges).checkpoint()
        if name is not None:
            rows = got.where((F.col("did") == name) & (F.col("kind") == "DIFF")).select(F.from_json("payload", self.diffs.schema).alias("d")).select("d.*")
            self.diffs = self.diffs.unionByName(rows).checkpoint()

    def _forget(self) -> None:
        self.diffs, self.edges = self.diffs.limit(0).checkpoint(), self.edges.limit(0).checkpoint()
