"""URL filters: host-suffix and path-prefix expressions, equi-joined on short hash prefixes (op2, native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import columns_of

#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Rules are broadcast up to this many; more are joined by a shuffle on the hash prefix.
BROADCAST_RULES = 100_000
#: A verdict for urls that no rule fits.
DEFAULT = "allow"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(urls: DataFrame) -> DataFrame:
    """Adds host and path to ``urls(url)``: null or no ``://`` gives two empty strings."""
    rest = F.regexp_extract(F.expr("substring(url, instr(url, '://') + 3)"), "^([^?#]*)", 1)
    urls = urls.withColumn("whole", F.when(F.instr("url", "://") > 0, rest).otherwise(""))
    host = F.translate(F.substring_index("whole", "/", 1), UPPER, LOWER)
    path = F.expr("substring(whole, length(substring_index(whole, '/', 1)) + 1)")
    return urls.withColumn("host", host).withColumn("path", path).drop("whole")


def judge(pages: DataFrame, rules: DataFrame, n_rules: int, path_lengths: list[int], default: str = DEFAULT) -> DataFrame:
    """A verdict for every row of ``pages(page_id, url)`` under ``rules(host, path, verdict)``.

    Each url becomes one expression for every host suffix at a dot and every path prefix that is as long as some
    rule's path; its 32-bit SHA-256 prefix meets the rules' in an equi-join, and the full digests confirm. The
    longest rule (host and path together) wins; between equally long ones the longer host, then block.
    Null or malformed urls have empty host and path and the default verdict. Repeated rows are judged each.
    Rules that repeat count once. A url makes at most labels x path_lengths expressions, and as many rows at most.
    """
    # a row's place tells repeated rows apart; the rows of a url meet again after one shuffle of one row a url
    urls = parts(columns_of(pages, "page_id", "url")).select(F.monotonically_increasing_id().alias("row"), "page_id", "host", "path")
    lengths = "array(" + ", ".join(str(int(n)) for n in sorted(set(path_lengths))) + ")" if path_lengths else "cast(array() as array<int>)"
    hosts = "transform(sequence(1, size(split(host, '[.]', -1))), i -> substring_index(host, '.', -i))"
    paths = f"transform(filter({lengths}, n -> n <= length(path)), n -> substring(path, 1, n))"
    exprs = urls.withColumn("expression", F.explode_outer(F.expr(f"flatten(transform({hosts}, h -> transform({paths}, p -> concat(h, chr(0), p))))")))
    exprs = exprs.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, 8))
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).distinct()
    rules = rules.withColumn("r_digest", F.sha2(F.concat("r_host", F.expr("chr(0)"), "r_path"), 256)).withColumn("r_short", F.substring("r_digest", 1, 8))
    rules = F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules
    hits = exprs.join(rules, (F.col("short") == F.col("r_short")) & (F.col("digest") == F.col("r_digest")), "left")
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("size"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").cast("int").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("r_digest").isNotNull(), rank)).alias("best"))
    return best.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `pages` under RULES; see judge."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules, len(RULES), [len(p) for _, p, _ in RULES])


#: The same in SQL, by direct comparison with every rule.
OP2_SQL = f"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS whole FROM pages
), p AS (
  SELECT page_id, translate(split_part(whole, '/', 1), '{UPPER}', '{LOWER}') AS host, substr(whole, length(split_part(whole, '/', 1)) + 1) AS path, row_number() OVER () AS r FROM u
), rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(map(str, RULES))}), hits AS (
  SELECT r, r_host || r_path AS rule, r_verdict, row_number() OVER (PARTITION BY r ORDER BY length(r_host) + length(r_path) DESC, length(r_host) DESC) AS k
  FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
)
SELECT page_id, host, path, rule, coalesce(r_verdict, '{DEFAULT}') AS verdict
FROM p LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (r)
"""
