"""Invariants: a reveal undoes a disguise, without a key nothing comes back, references hold after every step."""

import pytest
from pyspark.sql import functions as F

from cloakwork.functions.expressions import AFFILIATION, PP_BASE, TOPIC, Pred, compare_text, in_list, literal, owner_filter, predicate
from cloakwork.operators import policy, vault
from cloakwork.operators.engine import Engine
from cloakwork.operators.reveal import PartialRevealError, order_of_tables, orphans
from cloakwork.sources.catalog import Decor, ForeignKey, Generator, Modify, Remove, TableInfo, delete, load_spec

USERS = TableInfo("users", ("id",), (ForeignKey("id", "users", "id"),))
STORIES = TableInfo("stories", ("id",), (ForeignKey("user_id", "users", "id"),))
MODS = TableInfo("moderations", ("id",), (ForeignKey("moderator", "users", "id"), ForeignKey("user_id", "users", "id")), (ForeignKey("story_id", "stories", "id"),))
INFO = {x.table: x for x in (USERS, STORIES, MODS)}
GEN = Generator("users", "id", {"username": ("RandStr", 30), "karma": ("ConstNum", 0)})


@pytest.fixture
def engine(spark):
    u, n, admin = 4, 3, 100
    users = [(k, f"hello{k}", k) for k in range(1, u + 1)] + [(admin, "admin", 0)]
    stories = [(k * n + i, k, f"u{i}") for k in range(1, u + 1) for i in range(n)]
    tables = {
        "users": spark.createDataFrame(users, "id long, username string, karma int"),
        "stories": spark.createDataFrame(stories, "id long, user_id long, url string"),
        "moderations": spark.createDataFrame([(s[0], admin, s[0], s[1], "bad story!") for s in stories], "id long, moderator long, story_id long, user_id long, action string"),
    }
    return Engine(spark, tables, INFO, GEN)


def state(e):
    return {t: sorted(map(tuple, df.collect()), key=str) for t, df in e.tables.items()}


def sound(e):
    return all(orphans(e.tables[t], INFO[t], e.tables).isEmpty() for t in INFO)


def test_decor_and_back(engine):
    before = state(engine)
    did = engine.apply({"stories": [Decor(("user_id",))]})
    after = state(engine)
    owners = [r[1] for r in after["stories"]]
    assert all(o >= PP_BASE for o in owners) and len(set(owners)) == len(owners)
    assert all(len(r[1]) == 30 for r in after["users"] if r[0] >= PP_BASE) and sound(engine)
    engine.reveal(did)
    assert state(engine) == before


def test_grouped_decor(engine):
    engine.apply({"stories": [Decor(("user_id",), ("url",))]})
    assert engine.tables["stories"].select("user_id").distinct().count() == 12  # owner and url: each row its own group
    engine2 = Engine(engine.spark, engine.tables, INFO, GEN)
    engine2.apply({"stories": [Decor(("user_id",), ("url",), "url = 'none'")]})
    assert state(engine2)["stories"] == state(engine)["stories"]


def test_user_removal_and_back(engine):
    before = state(engine)
    did = engine.apply({"users": [Remove()], "stories": [Remove()], "moderations": [Decor(("moderator", "user_id"))]}, user=2)
    after = state(engine)
    assert 2 not in [r[0] for r in after["users"]] and 2 not in [r[1] for r in after["stories"]]
    assert all(r[3] != 2 for r in after["moderations"]) and len(after["moderations"]) == 12
    engine.reveal("nothing")
    assert state(engine) == after
    engine.reveal(did, user=3)
    assert state(engine) == after
    engine.reveal(did, user=2)
    assert state(engine) == before


def test_composition_both_orders(engine):
    before = state(engine)
    a = engine.apply({"stories": [Decor(("user_id",))]})
    b = engine.apply({"stories": [Modify("url", ("ConstStr", "gone"))]})
    engine.reveal(b)
    engine.reveal(a)
    assert state(engine) == before
    a = engine.apply({"stories": [Decor(("user_id",))]})
    b = engine.apply({"stories": [Modify("url", ("ConstStr", "gone"))]})
    engine.reveal(a)
    engine.reveal(b)
    assert state(engine) == before


def test_shared_rows_go_with_their_last_owner(engine):
    n = engine.tables["moderations"].count()
    engine.apply({"moderations": [Remove()]}, user=1)
    rows = engine.tables["moderations"]
    assert rows.count() == n and rows.where("user_id = 1").count() == 0 and sound(engine)
    engine.apply({"moderations": [Remove()]}, user=100)
    assert engine.tables["moderations"].count() == n - 3 and sound(engine)


def test_partial_reveal_is_refused(engine):
    did = engine.apply({"stories": [Modify("url", ("ConstStr", "gone"))]})
    engine.tables["stories"] = engine.tables["stories"].withColumn("url", F.when(F.col("id") == 3, "later").otherwise(F.col("url")))
    with pytest.raises(PartialRevealError):
        engine.reveal(did, allow_partial=False)
    engine.reveal(did)
    assert engine.tables["stories"].where("id = 3").first().url == "later"


def test_updates_are_replayed(engine):
    did = engine.apply({"stories": [Remove("user_id = 2")]})
    engine.record_update("stories", lambda df: df.withColumn("url", F.expr("replace(url, 'u', 'v')")))
    engine.reveal(did)
    assert {r.url for r in engine.tables["stories"].collect()} == {"v0", "v1", "v2"} and engine.tables["stories"].count() == 12


def test_retain_and_delete_modes(engine):
    did = engine.apply({"stories": [Decor(("user_id",), pred="id = 3")]})
    held = state(engine)
    engine.reveal(did, mode="retain")
    assert state(engine) == held


def test_missing_reference_voids_the_table(engine):
    did = engine.apply({"stories": [Remove("user_id = 2")]})
    engine.tables["users"] = delete(engine.tables["users"], "id = 2")
    engine.reveal(did)
    assert engine.tables["stories"].where("user_id = 2").count() == 0


def test_predicates(spark):
    assert predicate("roles & 1").sql == "(roles & 1) <> 0"
    assert predicate("a = 1 AND roles & 4").sql == "a = 1 AND (roles & 4) <> 0"
    assert (Pred("a") & (Pred("b") | Pred("c"))).sql == "(a) AND ((b) OR (c))"
    assert owner_filter(["x", "y"], 3).sql == "(x = 3) OR (y = 3)" and owner_filter([], None).sql == "true"
    with pytest.raises(ValueError):
        owner_filter([], 3)
    assert literal("o'x") == "'o\\'x'" and in_list("a", []).sql == "false"
    got = spark.sql("SELECT * FROM VALUES ('2', '10'), ('a', 'b'), (NULL, 'x'), (NULL, NULL), ('b', '1') AS t(a, b)").select(compare_text(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in got.collect()] == [-1, -1, -1, 0, 1]
    t = spark.createDataFrame([("a\tb\tc\tmit\nrest", "Systems and more"), ("a", "word")], "p string, q string").select(F.expr(AFFILIATION.format("p")), F.expr(TOPIC.format("q"))).collect()
    assert [tuple(r) for r in t] == [("mit", "Systems"), (None, None)]


def test_spec_errors():
    with pytest.raises(ValueError, match="one column"):
        load_spec('{"t": [{"type": "decor", "user_fk_cols": ["refusedBy, requestedBy"]}]}')
    with pytest.raises(ValueError, match="predicate"):
        load_spec('{"t": [{"type": "remove", "pred": {"a": 1}}]}')
    assert order_of_tables(INFO).index("stories") < order_of_tables(INFO).index("moderations")


def test_guards():
    s = {"role": "pc", "time": 5}
    assert policy.holds(("le", "$time", 5), s) and not policy.holds(("le", "$time", 4), s) and policy.holds(("or", ("session_is", "role", "x"), ("gt", "$time", 4)), s)
    assert policy.clause(policy.FALSE, s) == "1 = 0"
    assert policy.resolve(["a", "b"], {"a": {"p"}, "b": {"q"}}, [({"a", "b"}, {"q"})]) == {"q"}
    assert policy.least_restrictive({"p", "q"}, {"p": {"q"}}) == {"p"}


def test_vault(spark):
    v = vault.Vault()
    share = v.register("7", "secret")
    key = v.key("7", password="secret")
    assert key and v.key("7", share=share) == key and v.key("7") is None and v.key("7", password="wrong") is None
    diffs = spark.createDataFrame([("7", "d1", 1, "x"), ("8", "d1", 2, "y")], "uid string, did string, seq int, v string")
    bags = vault.seal(diffs, spark.createDataFrame([("7", bytearray(key)), ("8", bytearray(32))], "uid string, key binary"))
    assert '"v":"x"' in vault.unseal(bags, "7", key).first().bag
    assert vault.unseal(bags, "7", bytes(32)).first().bag is None


def test_tail(spark, tmp_path):
    from cloakwork.streaming.tail import tail

    spark.range(5).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    q = tail(spark, str(tmp_path / "t")).writeStream.format("memory").queryName("tailed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tailed").count() == 5


def test_removal_reaches_pseudoprincipals(engine):
    """Anonymise all, then a user's removal finds its rows under their pseudonymous owners; so does a modification."""
    engine.apply({"stories": [Decor(("user_id",))]})
    engine.apply({"stories": [Modify("url", ("ConstStr", "gone"))]}, user=3)
    assert engine.tables["stories"].where("url = 'gone'").count() == 3
    did = engine.apply({"stories": [Remove()]}, user=2)
    assert sorted(r.id for r in engine.tables["stories"].collect()) == [3, 4, 5, 9, 10, 11, 12, 13, 14]
    engine.reveal(did, user=2)
    assert engine.tables["stories"].count() == 12
    for user in (1, 2, 3, 4):
        engine.apply({"stories": [Remove()]}, user=user)
    assert engine.tables["stories"].count() == 0


def test_shared_removal_and_back(engine):
    before = state(engine)
    did = engine.apply({"moderations": [Remove()]}, user=2)
    assert state(engine) != before and engine.edges.count() == 3
    engine.reveal(did)
    assert state(engine) == before and engine.edges.count() == 0


def test_void_reveal_can_be_repeated(engine):
    did = engine.apply({"stories": [Remove("user_id = 2")]})
    users = engine.tables["users"]
    engine.tables["users"] = delete(users, "id = 2")
    engine.reveal(did)
    assert engine.tables["stories"].count() == 9
    engine.tables["users"] = users
    engine.reveal(did)
    assert engine.tables["stories"].count() == 12


def test_policies_open_only_their_views(spark):
    base = spark.createDataFrame([(k, k % 3) for k in range(12)], "id long, owner long")
    base.createOrReplaceTempView("stories")
    seen = {"seen": base.where("owner = 1")}
    assert policy.run(spark, "select count(*) as n from seen", seen, {}).first().n == 4
    assert policy.run(spark, "with s as (select * from seen) select count(*) as n from s join seen using (id)", seen, {}).first().n == 4
    for sql in ("select * from stories", "select * from seen where id in (select id from stories)", "with s as (select * from stories) select * from s", "select * from parquet.`/tmp/x`", "select * from range(3)"):
        with pytest.raises(PermissionError):
            policy.run(spark, sql, seen, {})
    assert not spark.catalog.tableExists("seen") and spark.table("stories").count() == 12
    own = {"stories": base.where("owner = 1")}
    assert policy.run(spark, "select * from stories", own, {}).count() == 4 and spark.table("stories").count() == 12


def test_pseudonyms_cannot_be_recomputed(engine):
    """Whoever knows the disguise's id, the owners and the row ids finds no owner; two runs share no pseudonym."""
    import hashlib

    rows = state(engine)["stories"]
    tables = dict(engine.tables)
    did = engine.apply({"stories": [Decor(("user_id",))]})
    trace = {PP_BASE + int(hashlib.md5(f"{did}|stories|user_id|{u}|{i}".encode()).hexdigest()[:15], 16) for i, _, _ in rows for u in range(1, 6)}
    ids = {r[1] for r in state(engine)["stories"]}
    again = Engine(engine.spark, tables, INFO, GEN)
    again.apply({"stories": [Decor(("user_id",))]})
    assert not ids & trace and len(ids) == len(rows) and not ids & {r[1] for r in state(again)["stories"]}
