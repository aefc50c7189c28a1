"""Sealed records: what a key opens, what it doesn't, chains over hops, cleanup, forgotten principals."""

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import records
from cloakwork.operators.records import Records, SealedEngine
from cloakwork.sources.catalog import Decor, ForeignKey, Generator, Remove, TableInfo

EDGE = "old_uid string, new_uid string"


def _probably_prime(n):
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7, 11):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def test_prime():
    p = records.prime()
    assert p.bit_length() == 2048 and _probably_prime(p) and _probably_prime((p - 1) // 2)


def test_dry_run(spark):
    r = Records(spark, dry_run=True)
    key = r.register(7)
    did = r.start_disguise()
    r.save_diff(7, "in the clear")
    r.end_disguise()
    assert b"in the clear" in bytes(r.bags.first().bag)
    assert [tuple(x) for x in r.get_records(did, 7, key)[0].collect()] == [("7", "in the clear")]


def test_chains_and_cleanup(spark):
    r = Records(spark)
    key = r.register(7)
    other = r.register(8)
    first = r.start_disguise()
    r.register_pseudoprincipals(spark.createDataFrame([("7", "p1"), ("8", "q1"), ("99", "lost")], EDGE))
    r.save_diff(7, "a")
    r.save_diff(7, "a")
    r.save_diff(99, "nobody's")
    r.end_disguise()
    second = r.start_disguise()
    r.register_pseudoprincipals(spark.createDataFrame([("p1", "p2")], EDGE))
    r.save_diff("p2", "b")
    r.save_diff("p1", None)
    r.end_disguise()
    diffs, chains = r.get_records(first, 7, key)
    assert [tuple(x) for x in diffs.collect()] == [("7", "a")] * 2
    assert {(x.old_uid, x.new_uid) for x in chains.collect()} == {("7", "p1"), ("p1", "p2")}
    assert sorted(map(tuple, r.get_records(second, 7, key)[0].collect()), key=str) == [("p1", None), ("p2", "b")]
    assert {x.uid for x in r.pseudoprincipals(8, other).collect()} == {"8", "q1"}
    assert r.open(7, other).isEmpty()
    r.cleanup(first, 7, key)
    assert r.get_records(first, 7, key)[0].isEmpty()
    assert {(x.uid, x.payload) for x in r.get_records(second, 7, key)[0].collect()} == {("p1", None), ("p2", "b")}
    r.cleanup(second, 7, key)
    r.cleanup(first, 7, key)
    assert r.open(7, key).isEmpty()
    assert {x.uid for x in r.pseudoprincipals(8, other).collect()} == {"8", "q1"}


def test_nothing_in_the_clear(spark):
    r = Records(spark)
    r.register(7)
    r.start_disguise()
    r.save_diff(7, "a secret text")
    r.end_disguise()
    row = r.bags.first()
    assert b"secret" not in bytes(row.bag) and row.loc.encode() not in bytes(r.locators.first()["at"])
    assert r.open(7, records.new_key()).isEmpty()


def test_many_records_many_bags(spark, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 50)
    r = Records(spark)
    key = r.register(7)
    did = r.start_disguise()
    r.save_diffs(spark.range(1000).select(F.lit("7").alias("uid"), F.lit("same").alias("payload")))
    r.end_disguise()
    assert r.bags.count() == 20
    assert r.get_records(did, 7, key)[0].count() == 1000


def test_forget_restore_save_load(spark, tmp_path):
    r = Records(spark)
    share = r.register_with_password(7, "pw")
    key = r.private_key(7, "pw")
    assert key == r.private_key(7, share=share) and r.private_key(7, "no") is None and r.private_key(7) is None
    did = r.start_disguise()
    with pytest.raises(RuntimeError):
        r.start_disguise()
    r.forget(7)
    r.end_disguise()
    with pytest.raises(RuntimeError):
        r.end_disguise()
    assert r.principals.isEmpty()
    r.save(str(tmp_path))
    r = Records.load(spark, str(tmp_path))
    r.restore_principal(did, 7, key)
    assert r.principals.first().public == records.public_key(key)
    assert {x.part: x.n_rows for x in r.space().collect()} == {"bags": 1, "locators": 1}


def test_sealed_engine(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    stories = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "sid long, author long")
    info = {"users": TableInfo("users", ("id",), (ForeignKey("id", "users", "id"),)), "stories": TableInfo("stories", ("sid",), (ForeignKey("author", "users", "id"),))}
    r = Records(spark)
    keys = {u: r.register(u) for u in (1, 2)}
    e = SealedEngine(spark, {"users": users, "stories": stories}, info, Generator("users", "id", {"name": ("RandStr", 8)}), r)
    did = e.apply({"stories": [Decor(("author",))]})
    assert e.diffs.isEmpty() and e.edges.isEmpty()
    assert e.tables["stories"].where("author IN (1, 2)").isEmpty()
    e.reveal(did)
    e.reveal(did, user=1, secret=keys[2])
    assert e.tables["stories"].where("author = 1").isEmpty()
    e.reveal(did, user=1, secret=keys[1])
    assert {x.sid for x in e.tables["stories"].where("author = 1").collect()} == {10, 11}
    assert e.tables["stories"].where("author = 2").isEmpty()
    e.apply({"stories": [Remove()]}, user=2, secret=keys[2])
    assert {x.sid for x in e.tables["stories"].collect()} == {10, 11}
