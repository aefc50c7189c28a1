"""Document fingerprints from closed syncmers (op1, native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.llm.common import columns_of

#: Words of a k-mer and of the substrings inside it.
K, S = 5, 2


def anchors(text: str, k: int = K, s: int = S) -> str:
    """SQL for the hashes (32 bits) of the closed syncmers of a text column, in their order.

    A k-mer of words is chosen if the least hash of the s-words in it is that of the first or the last of them.
    That depends on nothing outside the k-mer, so equal passages give equal anchors wherever they stand. A text of
    fewer than k words is one anchor, one without a chosen k-mer has its least k-mer's hash, one without words has none.
    """
    inner = k - s + 1
    middle = ", ".join(f"g[i + {j}]" for j in range(1, inner - 1))
    words = f"filter(split(lower({text}), '[\\\\s]+'), w -> w <> '')"
    # each transform over a one-element array names a value, so that it is computed once
    grams = "transform(sequence(0, size(h) - {s}), i -> xxhash64({gram}))".format(s=s, gram=", ".join(f"h[i + {j}]" for j in range(s)))
    chosen = f"filter(sequence(0, size(h) - {k}), i -> least(g[i], g[i + {inner - 1}]) <= least({middle}))"
    hashed = f"i -> xxhash64(slice(h, i + 1, {k})) & 4294967295"
    least = f"array(array_min(transform(sequence(0, size(h) - {k}), {hashed})))"
    many = f"flatten(transform(array({grams}), g -> transform({chosen}, {hashed})))"
    many = f"flatten(transform(array({many}), c -> if(size(c) > 0, c, {least})))"
    return f"flatten(transform(array(transform({words}, w -> xxhash64(w))), h -> if(size(h) = 0, cast(array() as array<bigint>), if(size(h) < {k}, array(xxhash64(h) & 4294967295), {many}))))"


def likeness(a: str, b: str):
    """Jaccard of two arrays of anchors; of two empty ones 1."""
    both, all_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(both / F.greatest(all_, F.lit(1)))


def written(a: str):
    """The fingerprint as text: eight hex digits an anchor."""
    return F.expr(f"array_join(transform({a}, x -> lpad(lower(hex(x)), 8, '0')), '')")


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Each row of ``docs(doc_id, ...)`` with the columns of the next doc_id's row as ``next_...``; after the last comes the first.

    doc_ids are dealt to ``buckets`` ranges, which move once; the first document of each range also goes to the range
    before, whose last document precedes it. Equal doc_ids are in the order of ``columns``, null comes first.
    """
    spark = docs.sparkSession
    cuts = docs.select(F.expr(f"percentile_approx(doc_id, array({', '.join(str((i + 1) / buckets) for i in range(buckets - 1))}), 10000)").alias("q")).first()[0] if buckets > 1 else []
    cuts = sorted({int(x) for x in cuts or []})
    ranges = F.expr(f"coalesce(size(filter(array({', '.join(f'{x}L' for x in cuts)}), x -> x < doc_id)), 0)") if cuts else F.lit(0)
    docs = docs.withColumn("range", ranges)
    firsts = sorted((r["range"], r["first"]) for r in docs.groupBy("range").agg(F.min(F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(None).cast("long")).alias("d"))).alias("first")).select("range", "first.d").withColumnRenamed("d", "first").collect())
    if not firsts:
        return docs.drop("range").select("*", *[F.col(c).alias(f"next_{c}") for c in columns])
    before = [(firsts[i - 1][0], own, first) for i, (own, first) in enumerate(firsts)]
    moved = F.broadcast(spark.createDataFrame(before, "to int, own int, first long"))  # a row for each range
    extra = docs.join(moved, (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("first")))
    extra = extra.withColumn("range", F.col("to")).drop("to", "own", "first").withColumn("extra", F.lit(1))
    both = docs.withColumn("extra", F.lit(0)).unionByName(extra)
    w = Window.partitionBy("range").orderBy("extra", F.col("doc_id").asc_nulls_first(), *columns)
    out = both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.where("extra = 0").drop("extra", "range")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """The contract's columns and the number of anchors for every row of ``docs(doc_id, text)``.

    Null text is empty. Texts without words have empty fingerprints, alike (1) to each other and unlike (0) to all
    others. One document alone is its own next. Repeated rows follow each other. Empty table: empty result.
    """
    buckets = buckets or min(2048, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    docs = columns_of(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    pairs = with_next(docs.withColumn("a", F.expr(anchors("text"))), ["text", "a"], buckets)
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"))
    pairs = pairs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", "next_a", F.expr(anchors("edited")).alias("e"))
    return pairs.select(
        "doc_id", "n_chars", "edited_sha256", written("a").alias("fingerprint"), written("e").alias("edited_fingerprint"),
        likeness("a", "e").alias("near_edited"), likeness("a", "next_a").alias("near_next"), F.size("a").cast("long").alias("n_anchors"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`; see fingerprints."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
