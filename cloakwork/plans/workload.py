"""Application and grammar queries: Spark SQL beside DuckDB SQL (where one text serves both engines it stands once)."""

from __future__ import annotations

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations", "embeddings"]

#: The two-owner table: every order is looked after by its customer and one other.
MODERATIONS = "(SELECT o_orderkey AS m_id, o_custkey AS m_moderator, (o_orderkey * 7 + 3) % (SELECT count(*) FROM customer) AS m_user, o_orderkey AS m_story FROM orders)"

BOTH = {
    # reads of a link-sharing site
    "l1_read_story": "SELECT o.o_orderkey, c.c_name, l.l_linenumber, l.l_partkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderkey IN (7, 42, 99) AND l.l_quantity - 5 >= 0",
    "l3_frontpage": "SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE o_orderstatus IS NOT NULL AND o_totalprice - 1000 >= 0 ORDER BY cents DESC, o_orderkey LIMIT 51",
    "l4_recent": "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderkey AS BIGINT) - o_custkey >= 0 ORDER BY o_orderkey DESC LIMIT 51",
    "l5_comments": "SELECT event_id, user_id, event_type FROM events WHERE event_type IS NOT NULL AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ORDER BY event_id DESC LIMIT 40",
    "l6_vote_update": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN o_custkey + 1 ELSE o_custkey END AS karma FROM orders",
    "l7_profile_top_tag": "SELECT c_custkey, p_brand, n FROM (SELECT c.c_custkey, p.p_brand, count(*) AS n, row_number() OVER (PARTITION BY c.c_custkey ORDER BY count(*) DESC, p.p_brand) AS k FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey GROUP BY c.c_custkey, p.p_brand) t WHERE k = 1",
    "l8_messages": "SELECT conv_id, count(*) AS n, max(turn) AS last_turn FROM conversations GROUP BY conv_id",
    "l9_baseline_decay": "SELECT o.o_orderkey, CASE WHEN c.c_acctbal < 0 THEN NULL ELSE o.o_custkey END AS owner FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey",
    "h1_reviews": f"SELECT m_id, m_moderator, m_user FROM {MODERATIONS} m WHERE m_moderator = 12 OR m_user = 12",
    "b1_leclist": "SELECT r.r_regionkey, r.r_name, coalesce(q.qcount, 0) AS qcount FROM region r LEFT JOIN (SELECT n_regionkey, count(*) AS qcount FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey) q ON q.n_regionkey = r.r_regionkey",
    "p16_in_list": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)",
    "p17_point_lookup": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 17",
    "p18_exists_probe": "SELECT 1 AS one FROM events WHERE user_id = 3 LIMIT 1",
    "p11_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    # joins
    "j2_theta_residual": f"SELECT m.m_id, o.o_custkey, m.m_user FROM {MODERATIONS} m JOIN orders o ON o.o_orderkey = m.m_story AND o.o_custkey <> m.m_user",
    "j3_left_aggregate": "SELECT c.c_custkey, coalesce(o.n, 0) AS n FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
    "j5_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "j8_natural_full": "SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation WHERE n_nationkey < 10) a NATURAL FULL JOIN (SELECT r_regionkey + 2 AS k, r_name FROM region) b",
    "j8_using_left": "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a LEFT JOIN (SELECT r_regionkey AS k, r_name FROM region WHERE r_regionkey > 1) b USING (k)",
    # aggregation, windows, sets
    "a2_objects_per_user": "SELECT uid, sum(n) AS n FROM (SELECT o_custkey AS uid, count(*) AS n FROM orders GROUP BY o_custkey UNION ALL SELECT user_id, count(*) FROM events GROUP BY user_id) t GROUP BY uid",
    "a6_aggregates": "SELECT o_orderstatus, count(*) AS n, min(o_custkey) AS lo, max(o_custkey) AS hi, sum(o_custkey) AS s, round(avg(o_custkey), 6) AS a, round(stddev_pop(o_custkey), 6) AS sd FROM orders GROUP BY o_orderstatus",
    "a8_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "a9_distinct_filter": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS d, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_orderpriority",
    "w1_row_number": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders",
    "w2_running_sum": "SELECT o_orderkey, sum(o_custkey) OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM orders",
    "w3_range_avg": "SELECT n_nationkey, round(avg(n_regionkey) OVER (ORDER BY n_nationkey RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS a FROM nation",
    "w4_running_max": "SELECT event_id, max(event_id) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS m FROM events",
    "so1_union": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey + 3 FROM region",
    "so1_except_all": "SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region",
    "so1_intersect_all": "SELECT n_regionkey AS k FROM nation INTERSECT ALL SELECT n_nationkey FROM nation",
    "so3_set_difference": "SELECT c_custkey FROM customer EXCEPT SELECT user_id FROM events",
    "c1_ctes": "WITH a(k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey), b AS (SELECT max(n) AS m FROM a) SELECT a.k, a.n FROM a JOIN b ON a.n = b.m",
    "c2_scalar_subquery": "SELECT o_orderkey, (SELECT count(*) FROM region) AS r, EXISTS (SELECT 1 FROM nation WHERE n_nationkey = o_custkey) AS e FROM orders",
    "o1_mixed_order": "SELECT n_nationkey, n_regionkey, row_number() OVER (ORDER BY n_regionkey DESC, n_name) AS at FROM nation",
    "o4_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20",
    "o4_with_ties": "SELECT n_name, n_regionkey FROM (SELECT n_name, n_regionkey, rank() OVER (ORDER BY n_regionkey) AS r FROM nation) t WHERE r <= 3",
    # scalars
    "f2_bitmask": "SELECT c_custkey FROM customer WHERE (c_custkey & 5) <> 0 AND (c_custkey & 8) = 0",
    "f4_case": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'rich' END AS c, CASE c_nationkey WHEN 1 THEN 'one' ELSE 'other' END AS n FROM customer",
    "f6_text": "SELECT c_custkey, concat(lower(c_name), '/', upper(c_mktsegment)) AS t, instr(c_name, '#') AS at, replace(c_name, '0', 'o') AS r, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer",
    "f10_functions": "SELECT c_custkey, round(sqrt(c_custkey), 6) AS root, greatest(c_custkey, c_nationkey) AS g, round(power(c_nationkey, 2), 6) AS p, abs(c_nationkey - 12) AS a FROM customer",
    "f11_extract": "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(quarter FROM o_orderdate) AS INT) AS q, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(ceil(extract(year FROM o_orderdate) / 100.0) AS INT) AS century FROM orders",
    "f21_ratio": "SELECT o_custkey, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 6) AS r FROM orders GROUP BY o_custkey",
    "snk5_delete_null_safe": "SELECT c_custkey FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) = 5, false)",
    "snk6_delete_join": "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_orderkey = o.o_orderkey AND p.p_size > 45)",
    "snk8_migration": "SELECT o_orderkey AS id, o_custkey AS owner, CAST(NULL AS VARCHAR(10)) AS note FROM orders",
    "q13_exists_or": "SELECT o_orderkey FROM orders o WHERE o.o_custkey = 5 OR EXISTS (SELECT 1 FROM events e WHERE e.user_id = o.o_custkey AND e.event_type = 'purchase')",
    "x7_in_and_null": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT (c_nationkey IS NULL)",
}

#: name: (Spark, DuckDB) where the engines' texts differ.
PAIRS = {
    "a7_group_concat": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "p19_regex": ("SELECT c_custkey FROM customer WHERE c_name RLIKE '[13579]$' AND c_mktsegment RLIKE '(?i)^b'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[13579]$') AND regexp_matches(c_mktsegment, '^b', 'i')"),
    "p19_in_values": ("SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT * FROM VALUES (1), (4), (9))", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (VALUES (1), (4), (9))"),
    "p19_any": ("SELECT n_nationkey FROM nation WHERE n_nationkey < (SELECT max(r_regionkey) FROM region)", "SELECT n_nationkey FROM nation WHERE n_nationkey < ANY (SELECT r_regionkey FROM region)"),
    "j8_lateral_series": ("SELECT r_regionkey, g FROM region, LATERAL (SELECT explode(sequence(0, r_regionkey)) AS g)", "SELECT r_regionkey, CAST(unnest(range(0, r_regionkey + 1)) AS INT) AS g FROM region"),
    "f9_url": ("SELECT page_id, parse_url(url, 'HOST') AS host FROM pages WHERE url LIKE 'http%'", "SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages WHERE url LIKE 'http%'"),
    "f14_list": ("SELECT vec_id, size(embedding) AS n, CAST(element_at(embedding, 1) * 1000 AS INT) AS x, size(slice(embedding, 2, 3)) AS s FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, CAST(trunc(embedding[1] * 1000) AS INT) AS x, CAST(len(embedding[2:4]) AS INT) AS s FROM embeddings"),
    "f13_literals": (
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH AS DATE) AS later, CAST(o_orderdate AS DATE) < DATE '1996-01-01' AS old, upper(hex(X'1f')) AS h FROM orders",
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, CAST(o_orderdate AS DATE) < DATE '1996-01-01' AS old, upper(hex('\\x1f'::BLOB)) AS h FROM orders",
    ),
    "f15_json": (
        "SELECT c_custkey, get_json_object(j, '$.a.n') AS n, get_json_object(j, '$.b[1]') AS b FROM (SELECT c_custkey, concat('{\"a\":{\"n\":', c_nationkey, '},\"b\":[1,', c_custkey, ']}') AS j FROM customer)",
        "SELECT c_custkey, json_extract_string(j, '$.a.n') AS n, json_extract_string(j, '$.b[1]') AS b FROM (SELECT c_custkey, concat('{\"a\":{\"n\":', c_nationkey, '},\"b\":[1,', c_custkey, ']}') AS j FROM customer)",
    ),
    "f16_struct": (
        "SELECT c_custkey, x.a.n AS n, x.name AS name FROM (SELECT c_custkey, named_struct('a', named_struct('n', c_nationkey), 'name', c_name) AS x FROM customer)",
        "SELECT c_custkey, x.a.n AS n, x.name AS name FROM (SELECT c_custkey, struct_pack(a := struct_pack(n := c_nationkey), name := c_name) AS x FROM customer)",
    ),
    "f17_collate": ("SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE UTF8_LCASE = 'building'", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE NOCASE = 'building'"),
    "f19_hash": ("SELECT c_custkey, sha2(c_name, 256) AS h, md5(c_name) AS m FROM customer", "SELECT c_custkey, sha256(c_name) AS h, md5(c_name) AS m FROM customer"),
    "ud2_affil": ("SELECT c_custkey, nullif(regexp_extract(concat(c_name, '\\t', c_mktsegment, '\\tx\\t', c_nationkey, '\\nrest'), '^[^\\\\t\\\\n]*\\\\t[^\\\\t\\\\n]*\\\\t[^\\\\t\\\\n]*\\\\t([^\\\\t\\\\n]*)', 1), '') AS affil FROM customer", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS affil FROM customer"),
    "ud3_topic": ("SELECT doc_id, CASE WHEN instr(text, ' ') > 1 THEN substring_index(text, ' ', 1) END AS topic FROM documents", "SELECT doc_id, CASE WHEN instr(text, ' ') > 1 THEN split_part(text, ' ', 1) END AS topic FROM documents"),
    "j10_closure": (
        "WITH RECURSIVE c(root, uid, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT c.root, n.n_nationkey, c.d + 1 FROM c JOIN nation n ON n.n_nationkey = c.uid * 2 + 1 WHERE c.d < 10) SELECT root, uid, d FROM c",
        "WITH RECURSIVE c(root, uid, d) AS (SELECT n_nationkey, n_nationkey, 0 FROM nation UNION ALL SELECT c.root, n.n_nationkey, c.d + 1 FROM c JOIN nation n ON n.n_nationkey = c.uid * 2 + 1 WHERE c.d < 10) SELECT root, uid, d FROM c",
    ),
}
