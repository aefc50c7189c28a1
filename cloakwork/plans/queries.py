"""Registered queries of the engine on the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.functions.expressions import AFFILIATION, PP_BASE, digest, digits, generated, image  # noqa: F401
from cloakwork.operators import disguise as D
from cloakwork.operators import encrypted, policy
from cloakwork.operators import reveal as R
from cloakwork.operators.engine import Engine
from cloakwork.operators.speaksfor import closure, nearest_ancestor
from cloakwork.plans import record_queries, review_queries
from cloakwork.plans.workload import BOTH, MODERATIONS, PAIRS, TABLES
from cloakwork.sources.catalog import Decor, ForeignKey, Generator, Modify, Remove, TableInfo, delete_matching, insert, read_tables, update, upsert, values

USERS = TableInfo("customer", ("c_custkey",), (ForeignKey("c_custkey", "customer", "c_custkey"),))
STORIES = TableInfo("orders", ("o_orderkey",), (ForeignKey("o_custkey", "customer", "c_custkey"),))
MODS = TableInfo("moderations", ("m_id",), (ForeignKey("m_moderator", "customer", "c_custkey"), ForeignKey("m_user", "customer", "c_custkey")), (ForeignKey("m_story", "orders", "o_orderkey"),))
INFO = {x.table: x for x in (USERS, STORIES, MODS)}
PPS = Generator("customer", "c_custkey", {"c_name": ("RandStr", 30), "c_nationkey": ("ConstNum", 0), "c_acctbal": ("ConstNum", 0), "c_mktsegment": ("RandEmail",)})


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    out = read_tables(spark, sf_dir, ["customer", "orders", "lineitem", "part", "events", "nation", "region"])
    out["customer"].createOrReplaceTempView("customer")
    out["orders"].createOrReplaceTempView("orders")
    return out | {"moderations": spark.sql(f"SELECT * FROM {MODERATIONS}")}


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for n in TABLES:
            spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)
        return spark.sql(text)

    return run


# --- the same digests in DuckDB ---


def _md5(seed: str, *keys: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)}))"


def _id(did: str, table: str, fk: str, *keys: str) -> str:
    return f"({PP_BASE} + CAST('0x' || substr({_md5(f'{did}|{table}|{fk}', *keys)}, 1, 15) AS BIGINT))"


_M = f"WITH moderations AS {MODERATIONS} "
_ID1 = _id("d", "orders", "o_custkey", "o_custkey", "o_orderkey")
_IDG = _id("d", "orders", "o_custkey", "o_custkey", "o_orderstatus")
_MM, _MU = _id("d", "moderations", "m_moderator", "m_moderator", "m_user", "m_id"), _id("d", "moderations", "m_user", "m_moderator", "m_user", "m_id")
_ORDER = "o_orderkey, {} AS o_custkey, o_orderstatus, o_orderpriority"
_SHORT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
_FROM = "orders JOIN lineitem ON lineitem.l_orderkey = orders.o_orderkey JOIN part ON part.p_partkey = lineitem.l_partkey"

Q: dict = {}
SQL: dict = {}


def _q(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@_q("t3_decor", f"SELECT o.*, c_name FROM (SELECT {_ORDER.format(_ID1)} FROM orders) o JOIN (SELECT {_ID1} AS id, substr(repeat({_md5('d|c_name', _ID1)}, 1), 1, 30) AS c_name FROM orders) p ON p.id = o.o_custkey")
def decor(spark, sf_dir):
    got = D.decorrelate(tables(spark, sf_dir), STORIES, Decor(("o_custkey",)), PPS, "d")
    return got.table.select(*_SHORT).join(got.principals.select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey").select(*_SHORT, "c_name")


@_q("t3_decor_grouped", f"SELECT {_ORDER.format(_IDG)} FROM orders")
def decor_grouped(spark, sf_dir):
    return D.decorrelate(tables(spark, sf_dir), STORIES, Decor(("o_custkey",), ("o_orderstatus",)), PPS, "d").table.select(*_SHORT)


@_q("t3_decor_two_owners", f"{_M} SELECT m_id, {_MM} AS m_moderator, {_MU} AS m_user, m_story FROM moderations")
def decor_two(spark, sf_dir):
    return D.decorrelate(tables(spark, sf_dir), MODS, Decor(("m_moderator", "m_user")), PPS, "d").table


@_q("t3a_decor_user", f"{_M} SELECT m_id, CASE WHEN m_moderator = 12 THEN {_MM} ELSE m_moderator END AS m_moderator, CASE WHEN m_user = 12 THEN {_MU} ELSE m_user END AS m_user, m_story FROM moderations")
def decor_user(spark, sf_dir):
    valid = spark.createDataFrame([("12",)], "uid string")
    return D.decorrelate(tables(spark, sf_dir), MODS, Decor(("m_moderator", "m_user")), PPS, "d", 12, valid).table


@_q("t3b_decor_edges", f"{_M} SELECT CAST(m_moderator AS VARCHAR) AS old_uid, CAST({_MM} AS VARCHAR) AS new_uid FROM moderations UNION SELECT CAST(m_user AS VARCHAR), CAST({_MU} AS VARCHAR) FROM moderations")
def decor_edges(spark, sf_dir):
    return D.decorrelate(tables(spark, sf_dir), MODS, Decor(("m_moderator", "m_user")), PPS, "d").edges


@_q("t3_decor_joined", f"SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#13' OR p_size > 40) THEN {_ID1} ELSE o_custkey END AS o_custkey, o_orderstatus, o_orderpriority FROM orders")
def decor_joined(spark, sf_dir):
    t = Decor(("o_custkey",), pred="part.p_brand = 'Brand#13' OR part.p_size > 40", frm=_FROM)
    return D.decorrelate(tables(spark, sf_dir), STORIES, t, PPS, "d").table.select(*_SHORT)


@_q("t1a_remove", "SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_custkey = 12)")
def remove(spark, sf_dir):
    return D.remove(tables(spark, sf_dir), STORIES, Remove(), 12).table.select("o_orderkey", "o_custkey")


@_q("t1a_remove_diffs", "SELECT CAST(o_custkey AS VARCHAR) AS uid, 'REMOVE' AS typ, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS was FROM orders WHERE o_totalprice > 200000")
def remove_diffs(spark, sf_dir):
    d = D.remove(tables(spark, sf_dir), STORIES, Remove("o_totalprice > 200000")).diffs
    return d.select("uid", "typ", F.col("ids")["o_orderkey"].alias("id"), F.col("old")["o_orderstatus"].alias("was"))


@_q("t1_remove_joined", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 48)")
def remove_joined(spark, sf_dir):
    return D.remove(tables(spark, sf_dir), STORIES, Remove("part.p_size > 48", _FROM)).table.select("o_orderkey")


@_q("t1b_remove_shared", f"{_M} SELECT m_id, CASE WHEN m_moderator % 10 = 0 THEN {_MM} ELSE m_moderator END AS m_moderator, CASE WHEN m_user % 10 = 0 THEN {_MU} ELSE m_user END AS m_user, m_story FROM moderations WHERE NOT (m_moderator % 10 = 0 AND m_user % 10 = 0)")
def remove_shared(spark, sf_dir):
    t = tables(spark, sf_dir)
    gone = t["customer"].where("c_custkey % 10 = 0").select(F.col("c_custkey").cast("string").alias("uid"))
    return D.remove_shared(t, MODS, Remove(), PPS, "d", gone).table


@_q("t1c_remove_shared_later", f"{_M}, a AS (SELECT m_id, CASE WHEN m_moderator % 10 = 0 THEN {_MM} ELSE m_moderator END AS m1, CASE WHEN m_user % 10 = 0 THEN {_MU} ELSE m_user END AS m2 FROM moderations WHERE NOT (m_moderator % 10 = 0 AND m_user % 10 = 0)) SELECT m_id FROM a WHERE NOT ((m1 % 10 = 1 AND m1 < {PP_BASE} AND (m2 >= {PP_BASE} OR m2 % 10 = 1)) OR (m2 % 10 = 1 AND m2 < {PP_BASE} AND (m1 >= {PP_BASE} OR m1 % 10 = 1)))")
def remove_shared_later(spark, sf_dir):
    t = tables(spark, sf_dir)
    gone = lambda k: t["customer"].where(f"c_custkey % 10 = {k}").select(F.col("c_custkey").cast("string").alias("uid"))
    first = D.remove_shared(t, MODS, Remove(), PPS, "d", gone(0)).table
    return D.remove_shared(t | {"moderations": first}, MODS, Remove(), PPS, "e", gone(1)).table.select("m_id")


@_q("t2_modify", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'gone' ELSE c_name END AS c_name FROM customer")
def modify(spark, sf_dir):
    return D.modify(tables(spark, sf_dir), USERS, Modify("c_name", ("ConstStr", "gone"), "c_acctbal < 0"), "d").table.select("c_custkey", "c_name")


@_q("t2_modify_diffs", "SELECT CAST(c_custkey AS VARCHAR) AS uid, 'MODIFY' AS typ, c_mktsegment AS was, 'none' AS now FROM customer WHERE c_nationkey = 3")
def modify_diffs(spark, sf_dir):
    d = D.modify(tables(spark, sf_dir), USERS, Modify("c_mktsegment", ("ConstStr", "none"), "c_nationkey = 3"), "d").diffs
    return d.select("uid", "typ", F.col("old")["c_mktsegment"].alias("was"), F.col("new")["c_mktsegment"].alias("now"))


@_q("t6_generators", f"SELECT c_custkey, 5 + CAST('0x' || substr({_md5('s', 'c_custkey')}, 1, 12) AS BIGINT) % 95 AS num, substr(repeat({_md5('s', 'c_custkey')}, 2), 1, 40) AS str, substr({_md5('s', 'c_custkey')}, 1, 20) || '@anon.com' AS email, lpad(CAST(CAST('0x' || substr({_md5('s', 'c_custkey')}, 1, 12) AS BIGINT) % 1000000000 AS VARCHAR), 9, '0') AS phone FROM customer")
def generators(spark, sf_dir):
    m = digest("s", "c_custkey")
    return tables(spark, sf_dir)["customer"].select("c_custkey", F.expr(generated("RandNum", m, 5, 100)).alias("num"), F.expr(generated("RandStr", m, 40)).alias("str"), F.expr(generated("RandEmail", m)).alias("email"), F.expr(generated("RandPhone", m)).alias("phone"))


def _edges(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey > 0").select(F.expr("cast(o_orderkey div 3 as string)").alias("old_uid"), F.col("o_orderkey").cast("string").alias("new_uid"))


_EA = "WITH RECURSIVE e AS (SELECT CAST(o_orderkey // 3 AS VARCHAR) AS old_uid, CAST(o_orderkey AS VARCHAR) AS new_uid FROM orders WHERE o_orderkey > 0), c(root, uid, depth) AS (SELECT DISTINCT old_uid, old_uid, 0 FROM e UNION ALL SELECT c.root, e.new_uid, c.depth + 1 FROM c JOIN e ON c.uid = e.old_uid)"


@_q("k8_closure", f"{_EA} SELECT root, uid, min(depth) AS depth FROM c GROUP BY root, uid")
def speaks_for_all(spark, sf_dir):
    return closure(_edges(spark, sf_dir))


@_q("r6_nearest_ancestor", f"{_EA}, g AS (SELECT new_uid AS uid FROM e WHERE CAST(new_uid AS BIGINT) % 2 = 0) SELECT uid, arg_min(root, depth) AS ancestor FROM c WHERE depth > 0 AND uid IN (SELECT uid FROM g) AND root NOT IN (SELECT uid FROM g) GROUP BY uid")
def ancestors_all(spark, sf_dir):
    return _ancestors(_edges(spark, sf_dir))


def _ancestors(e):
    return nearest_ancestor(e, e.where("cast(new_uid as bigint) % 2 = 0").select(F.col("new_uid").alias("uid")))


def _collapsed(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    row = lambda t: F.create_map(F.lit("id"), F.col("user_id").cast("string"), F.lit("kind"), t)
    return R.collapse(ev.select(F.create_map(F.lit("id"), F.col("user_id").cast("string")).alias("ids"), F.col("event_id").alias("seq"), row(F.col("event_type")).alias("old"), row(F.concat("event_type", F.lit("+"))).alias("new")))


@_q("r4_collapse", "SELECT CAST(user_id AS VARCHAR) AS id, arg_min(event_type, event_id) AS old, arg_max(event_type || '+', event_id) AS new FROM events GROUP BY user_id")
def collapsed(spark, sf_dir):
    return _collapsed(spark, sf_dir).select(F.col("old")["id"].alias("id"), F.col("old")["kind"].alias("old"), F.col("new")["kind"].alias("new"))


@_q("r8_merge", "SELECT o_orderkey, CASE WHEN cur IS DISTINCT FROM n AND cur IS DISTINCT FROM o THEN cur ELSE o END AS v FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN o_orderstatus ELSE 'other' END AS cur, o_orderstatus AS o, 'new' AS n FROM orders)")
def merge(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", "CASE o_orderkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN o_orderstatus ELSE 'other' END AS cur", "o_orderstatus AS o", "'new' AS n")
    return o.select("o_orderkey", F.expr(R.merged("cur", "o", "n")).alias("v"))


@_q("r8_reveal_modify", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def reveal_modify(spark, sf_dir):
    t = tables(spark, sf_dir)
    got = D.modify(t, USERS, Modify("c_name", ("ConstStr", "gone"), "c_acctbal < 0"), "d")
    back = R.reveal_rows(got.table, R.collapse(got.diffs.withColumn("seq", F.lit(1))), USERS)
    return back.select("c_custkey", "c_name", "c_nationkey")


@_q("r14_reveal_remove", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def reveal_remove(spark, sf_dir):
    got = D.remove(tables(spark, sf_dir), STORIES, Remove("o_totalprice > 200000"))
    back = R.reveal_rows(got.table, R.collapse(got.diffs.withColumn("seq", F.lit(1))), STORIES)
    return back.select("o_orderkey", "o_custkey", "o_orderstatus")


@_q("r15_restore_pps", "SELECT o_orderkey, o_custkey FROM orders")
def restore_pps(spark, sf_dir):
    t = tables(spark, sf_dir)
    got = D.decorrelate(t, STORIES, Decor(("o_custkey",)), PPS, "d")
    t = t | {"orders": got.table, "customer": t["customer"].unionByName(got.principals)}
    info = {"customer": USERS, "orders": STORIES}
    return R.reveal_pseudoprincipals(t, info, "customer", "c_custkey", got.edges, got.edges.select(F.col("new_uid").alias("uid")).distinct())["orders"].select("o_orderkey", "o_custkey")


@_q("r10_children", f"{_M} SELECT uid, count(*) AS n FROM (SELECT CAST(c_custkey AS VARCHAR) AS uid FROM customer UNION ALL SELECT CAST(o_custkey AS VARCHAR) FROM orders UNION ALL SELECT CAST(m_moderator AS VARCHAR) FROM moderations UNION ALL SELECT CAST(m_user AS VARCHAR) FROM moderations) GROUP BY uid")
def child_counts(spark, sf_dir):
    return R.children(tables(spark, sf_dir), INFO, "customer")


@_q("r12_orphans", f"{_M} SELECT 'm_story' AS col, CAST(m_story AS VARCHAR) AS value FROM moderations WHERE m_story % 7 = 0")
def orphan_rows(spark, sf_dir):
    t = tables(spark, sf_dir)
    return R.orphans(t["moderations"], MODS, t | {"orders": t["orders"].where("o_orderkey % 7 <> 0")}, owners=False)


@_q("u4_replay_values", "SELECT c_custkey, replace(c_name, 'o', 'i') AS c_name FROM customer")
def replay(spark, sf_dir):
    e = Engine(spark, {"customer": tables(spark, sf_dir)["customer"]}, {"customer": USERS}, PPS)
    did = e.apply({"customer": [Remove("c_acctbal < 0")]})
    e.record_update("customer", lambda df: df.withColumn("c_name", F.expr("replace(c_name, 'o', 'i')")))
    e.reveal(did)
    return e.tables["customer"].select("c_custkey", "c_name")


@_q("p5_owner_hop", "SELECT o_orderkey FROM orders WHERE o_custkey IN (4, 12, 13, 14)")
def owner_hop(spark, sf_dir):
    from cloakwork.functions.expressions import owned_by

    return owned_by(tables(spark, sf_dir)["orders"], "o_custkey", 4, _edges(spark, sf_dir)).select("o_orderkey")


@_q("d2_insert", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99 AS r_regionkey, 'NOWHERE' AS r_name")
def inserted(spark, sf_dir):
    r = tables(spark, sf_dir)["region"].select("r_regionkey", "r_name")
    return insert(r, values(spark, [(99, "NOWHERE")], "r_regionkey int, r_name string"))


@_q("snk2_upsert", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey NOT IN (1, 2) UNION ALL SELECT 1, 'x' UNION ALL SELECT 2, 'y'")
def upserted_values(spark, sf_dir):
    n = tables(spark, sf_dir)["nation"].select("n_nationkey", "n_name")
    return upsert(n, values(spark, [(1, "x"), (2, "y")], "n_nationkey int, n_name string"), ["n_nationkey"])


@_q("f18_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = 33")
def parameters(spark, sf_dir):
    return spark.sql("SELECT o_orderkey FROM {orders} WHERE o_custkey = :who", args={"who": 33}, orders=tables(spark, sf_dir)["orders"])


@_q("z3_remove_reaches_pseudonyms", "SELECT o_orderkey FROM orders WHERE o_custkey <> 12")
def remove_after_decor(spark, sf_dir):
    """All orders go under pseudonyms, then a customer's removal still finds its own."""
    t = tables(spark, sf_dir)
    e = Engine(spark, {"customer": t["customer"], "orders": t["orders"]}, {"customer": USERS, "orders": STORIES}, PPS)
    e.apply({"orders": [Decor(("o_custkey",))]})
    e.apply({"orders": [Remove()]}, user=12)
    return e.tables["orders"].select("o_orderkey")


@_q("z3_shared_removal_revealed", f"{_M} SELECT m_id, m_moderator, m_user, (SELECT count(*) FROM customer) AS principals FROM moderations")
def shared_removal_revealed(spark, sf_dir):
    """A customer's shared rows are removed and revealed: rows and principals are as before."""
    t = tables(spark, sf_dir)
    e = Engine(spark, {n: t[n] for n in INFO}, INFO, PPS)
    did = e.apply({"moderations": [Remove()]}, user=12)
    e.reveal(did)
    return e.tables["moderations"].select("m_id", "m_moderator", "m_user").withColumn("principals", F.lit(e.tables["customer"].count()))


@_q("r1_void_reveal_again", "SELECT o_orderkey, o_custkey FROM orders")
def void_reveal_again(spark, sf_dir):
    """Orders are removed and their customer goes: the reveal is void. With the customer back a second one restores them."""
    t = tables(spark, sf_dir)
    e = Engine(spark, {"customer": t["customer"], "orders": t["orders"]}, {"customer": USERS, "orders": STORIES}, PPS)
    did = e.apply({"orders": [Remove("o_custkey = 12")]})
    e.tables["customer"] = t["customer"].where("c_custkey <> 12")
    e.reveal(did)
    e.tables["customer"] = t["customer"]
    e.reveal(did)
    return e.tables["orders"].select("o_orderkey", "o_custkey")


@_q("snk3_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' ELSE n_name END AS n_name FROM nation")
def updated(spark, sf_dir):
    return update(tables(spark, sf_dir)["nation"], "n_regionkey = 1", n_name="'X'").select("n_nationkey", "n_name")


@_q("snk2_upsert_frame", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation")
def upserted(spark, sf_dir):
    n = tables(spark, sf_dir)["nation"].select("n_nationkey", "n_name")
    return upsert(n, n.where("n_nationkey < 5").withColumn("n_name", F.lit("new")), ["n_nationkey"])


@_q("snk6_delete_frame", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def deleted(spark, sf_dir):
    t = tables(spark, sf_dir)
    return delete_matching(t["orders"], t["lineitem"].where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]).select("o_orderkey")


_OWN = policy.Policy("own", (((), "o_custkey = 7"), (("session_is", "role", "admin"), "o_orderstatus = 'F'")))
_PRICE = policy.Policy("open", (((), "o_orderstatus <> 'P'"),))


@_q("q1_row_suppression", "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey = 7 OR o_orderstatus = 'F') AND o_orderstatus <> 'P'")
def suppressed(spark, sf_dir):
    return policy.row_suppression(tables(spark, sf_dir)["orders"], [_OWN, _PRICE], {"role": "admin"}).select("o_orderkey", "o_custkey")


@_q("q2_cell_blinding", "SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN o_custkey END AS o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority FROM orders")
def blinded(spark, sf_dir):
    got = policy.cell_blinding(tables(spark, sf_dir)["orders"], {"o_custkey": [_OWN], "o_orderpriority": [_PRICE]}, {"role": "user"})
    return got.select("o_orderkey", "o_custkey", "o_orderpriority")


@_q("q3_non_null_view", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def view_rows(spark, sf_dir):
    got = policy.cell_blinding(tables(spark, sf_dir)["orders"], {"o_custkey": [_OWN]}, {})
    return policy.non_null(got, ["o_custkey"]).select("o_orderkey", "o_custkey")


@_q("q9_aggregate_policy", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def aggregate_policy(spark, sf_dir):
    own = policy.chosen([_OWN, policy.Policy("counts", (((), "true"),), True)], query_aggregates=True)
    view = policy.row_suppression(tables(spark, sf_dir)["orders"], own, {})
    return policy.run(spark, "select o_orderstatus, count(*) as n from orders_seen group by o_orderstatus", {"orders_seen": view}, {})


@_q("q6_bound_parameter", "SELECT o_orderkey FROM orders WHERE o_custkey = 21")
def bound(spark, sf_dir):
    return policy.run(spark, "select o_orderkey from orders_seen where o_custkey = :me", {"orders_seen": tables(spark, sf_dir)["orders"]}, {"me": 21})


@_q("q10_unexpected_null", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer")
def unexpected(spark, sf_dir):
    return policy.row_suppression(tables(spark, sf_dir)["customer"], [policy.TRUE], {}, ("c_name",)).select("c_custkey", "c_name")


_TYPES = {"c_name": "string", "c_nationkey": "int", "c_mktsegment": "string"}


@_q("x2_encrypted_select", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_custkey % 2 = 0")
def encrypted_select(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select("c_custkey", *_TYPES)
    keys = encrypted.row_keys(c.where("c_custkey % 2 = 0"), ["c_custkey"], "s")
    cipher = encrypted.insert(c, encrypted.row_keys(c, ["c_custkey"], "s"), ["c_custkey"])
    return encrypted.select(cipher, keys, ["c_custkey"], _TYPES, "c_nationkey IN (1, 2, 3)")


@_q("x6_encrypted_update", "SELECT c_custkey, CASE WHEN c_nationkey = 1 THEN 'changed' ELSE c_name END AS c_name FROM customer")
def encrypted_update(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select("c_custkey", *_TYPES)
    keys = encrypted.row_keys(c, ["c_custkey"], "s")
    new = encrypted.update(encrypted.insert(c, keys, ["c_custkey"]), keys, ["c_custkey"], _TYPES, "c_nationkey = 1", c_name="'changed'")
    return encrypted.select(new, keys, ["c_custkey"], _TYPES).select("c_custkey", "c_name")


@_q("x5_encrypted_delete", "SELECT c_custkey FROM customer WHERE c_nationkey <> 1")
def encrypted_delete(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select("c_custkey", *_TYPES)
    keys = encrypted.row_keys(c, ["c_custkey"], "s")
    return encrypted.delete(encrypted.insert(c, keys, ["c_custkey"]), keys, ["c_custkey"], _TYPES, "c_nationkey = 1")[0].select("c_custkey")


QUERIES = {n: _sql(t) for n, t in BOTH.items()} | {n: _sql(a) for n, (a, _) in PAIRS.items()} | Q | review_queries.QUERIES | record_queries.QUERIES
ORACLES = BOTH | {n: b for n, (_, b) in PAIRS.items()} | SQL | review_queries.ORACLES | record_queries.ORACLES
