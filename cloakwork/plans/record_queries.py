"""Registered queries of sealed records: whole tables go into bags, one principal's key opens what is its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.operators.records import Records, SealedEngine, derived_key, new_key
from cloakwork.sources.catalog import Decor, ForeignKey, Generator, TableInfo

USERS = TableInfo("customer", ("c_custkey",), (ForeignKey("c_custkey", "customer", "c_custkey"),))
STORIES = TableInfo("orders", ("o_orderkey",), (ForeignKey("o_custkey", "customer", "c_custkey"),))
_PP = "concat('p', o_custkey, o_orderstatus)"
PPS = Generator("customer", "c_custkey", {"c_name": ("RandStr", 30)})


def _two_disguises(spark: SparkSession, sf_dir: str) -> tuple[Records, str, str, str]:
    """Every order is a record of its customer, with a pseudoprincipal for the orders of one status; every order's total is a record of
    that one, of a second disguise."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    orders, seed = read("orders"), new_key()
    r = Records(spark)
    r.register_all(read("customer").select(F.col("c_custkey").alias("uid")), seed)
    first = r.start_disguise()
    r.register_pseudoprincipals(orders.select(F.col("o_custkey").cast("string").alias("old_uid"), F.expr(_PP).alias("new_uid")))
    r.save_diffs(orders.select(F.col("o_custkey").alias("uid"), F.expr("'order ' || o_orderkey").alias("payload")))
    r.end_disguise()
    second = r.start_disguise()
    r.save_diffs(orders.select(F.expr(_PP).alias("uid"), F.expr("'total of ' || o_orderkey").alias("payload")))
    r.end_disguise()
    return r, first, second, derived_key(seed, 7)


def opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, _, _, key = _two_disguises(spark, sf_dir)
    return r.open(7, key).select("uid", "kind", "payload")


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first disguise's records go; the chains to those of the second stay."""
    r, first, _, key = _two_disguises(spark, sf_dir)
    r.cleanup(first, 7, key)
    return r.open(7, key).select("uid", "kind", "payload")


def sealed_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders go under pseudonyms, then one customer reveals its own with its key."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    r, seed = Records(spark), new_key()
    customer = read("customer").select("c_custkey", "c_name")
    r.register_all(customer.select(F.col("c_custkey").alias("uid")), seed)
    e = SealedEngine(spark, {"customer": customer, "orders": read("orders").select("o_orderkey", "o_custkey", "o_orderstatus")}, {"customer": USERS, "orders": STORIES}, PPS, r)
    did = e.apply({"orders": [Decor(("o_custkey",), ("o_orderstatus",))]})
    e.reveal(did, user=7, secret=derived_key(seed, 7))
    return e.tables["orders"].selectExpr("o_orderkey", "CASE WHEN o_custkey < 1152921504606846976 THEN o_custkey END AS seen")


_LINES = f"SELECT {_PP} AS uid, 'DIFF' AS kind, concat('total of ', o_orderkey) AS payload FROM orders WHERE o_custkey = 7"
_CHAINS = "SELECT '7' AS uid, 'CHAIN' AS kind, CAST(NULL AS VARCHAR) AS payload FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_custkey = 7) t"
QUERIES = {"k7_open_chain": opened, "k9_cleanup": cleaned, "z25_sealed_reveal": sealed_reveal}
ORACLES = {
    "k7_open_chain": f"{_LINES} UNION ALL {_CHAINS} UNION ALL SELECT '7', 'DIFF', concat('order ', o_orderkey) FROM orders WHERE o_custkey = 7",
    "k9_cleanup": f"{_LINES} UNION ALL {_CHAINS}",
    "z25_sealed_reveal": "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN o_custkey END AS seen FROM orders",
}
