"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped edges (op4)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.anchors import _mix
from cloakwork.llm.common import Scratch, columns_of, connected_components
from cloakwork.llm.shingles import WORDS, ordered, shingle_set
from cloakwork.llm.tokens import batches, forget

#: 24 bands of 4 bins: a pair at 0.8 shares no bucket once in 300,000 times, one at 0.85 once in 50 million.
BANDS, ROWS = 24, 4
#: Draws of the densification for each empty bin before it takes the next full bin.
DRAWS = 256


def _draws(bins: int) -> np.ndarray:
    """[draw, bin]: the bin that an empty bin asks in that draw; the same for all sets."""
    n = np.arange(DRAWS * bins, dtype=np.uint64)
    return (_mix(n * np.uint64(0x9E3779B97F4A7C15) + np.uint64(77)) % np.uint64(bins)).astype(np.int64).reshape(DRAWS, bins)


def signature(values: np.ndarray, bins: int, draws: np.ndarray) -> np.ndarray:
    """One permutation cut into bins, the least value of each; every empty bin takes that of a bin drawn at random."""
    edges = np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins)
    at = np.searchsorted(values, edges)
    ends = np.append(at[1:], len(values))
    full = at < ends
    sig = np.zeros(bins, np.uint64)
    sig[full] = values[at[full]]
    empty = np.flatnonzero(~full)
    for d in draws:
        if not len(empty):
            return sig
        asked = d[empty]
        hit = full[asked]
        sig[empty[hit]] = sig[asked[hit]]
        empty = empty[~hit]
    where = np.flatnonzero(full)
    if len(empty):
        sig[empty] = sig[where[np.searchsorted(where, empty) % len(where)]]
    return sig


def _signed(k: int, bands: int, rows: int):
    def sign(it):
        forget()
        draws = _draws(bands * rows)
        number = np.arange(bands, dtype=np.uint64)
        for b in batches(it, "text"):
            out = [[], [], []]
            for text in b.column("text"):
                values = shingle_set(text.as_buffer().to_pybytes() if text.is_valid else None, k)
                out[0].append(len(values))
                if len(values):
                    sig = signature(values, bands * rows, draws).reshape(bands, rows)
                    out[1].append(xxhash.xxh3_128_digest(values.tobytes()))
                    out[2].append(ordered([number, *sig.T]).view(np.int64))
                else:
                    out[1].append(None)
                    out[2].append(None)
            yield pa.record_batch([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "buckets"])
        WORDS.clear()

    return sign


def _sets(k: int):
    def sets(it):
        for b in batches(it, "text"):
            got = [shingle_set(t.as_buffer().to_pybytes() if t.is_valid else None, k).view(np.int64) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(got, pa.list_(pa.int64()))], names=["id", "grams"])
        WORDS.clear()

    return sets


def prefix_pairs(scratch: Scratch, rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of ``rest(id, component, n)`` in different components; no pair at ``percent`` is missing.

    Two such sets share one of the n - ceil(percent * n) + 1 rarest grams of each, in one order of all grams.
    By rarity, that leaves what only a few have; grams that occur once are counted but not joined. A shared gram's
    places in the two sets also bound what they can share from there on.
    """
    grams = scratch.save(rest.join(sets.select("id", "grams"), "id").select("id", "n", "component", F.explode("grams").alias("g")), "rest-grams")
    count = scratch.save(grams.groupBy("g").agg(F.count("*").alias("f")).where("f > 1"), "gram-counts")
    known = grams.join(count, "g").groupBy("id", "n", "component").agg(F.sort_array(F.collect_list(F.struct("f", "g"))).alias("known"))
    short = F.expr(f"n - cast(ceil({percent} * n / 100) as int) + 1")
    known = known.withColumn("skip", F.expr("n - size(known)")).withColumn("take", F.greatest(F.lit(0), short - F.col("skip")))
    rows = known.select("id", "n", "component", "skip", F.posexplode(F.expr("slice(known, 1, cast(take as int))")).alias("k", "x"))
    rows = scratch.save(rows.select("id", "n", "component", (F.col("skip") + F.col("k")).alias("at"), F.col("x.g").alias("g")), "prefixes")
    a, b = rows.select(*[F.col(c).alias(f"a_{c}") for c in rows.columns]), rows.select(*[F.col(c).alias(f"b_{c}") for c in rows.columns])
    need = f"{percent} * (a_n + b_n) <= {100 + percent} * least(a_n - a_at, b_n - b_at)"
    pairs = a.join(b, F.expr(f"a_g = b_g and a_id < b_id and a_component <> b_component and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n) and {need}"))
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()


def near_duplicates(scratch: Scratch, docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``.

    Two documents are linked if their sets of k-word shingles have 100 * intersection >= percent * union, confirmed on
    the full sets (of 64-bit hashes). Documents with equal sets are one class, whose least doc_id stands for it
    in buckets and links. Empty or null texts have no shingles and link with nothing. Rows that share a doc_id
    count as one document with the links of all of them. component_id is the least doc_id reachable; kept marks it.
    Null doc_ids link with nothing. Empty table: empty result. The members of a bucket
    meet its least id only (a star). Where a bucket then still spans components, links between these are found by an
    exact prefix join instead (see prefix_pairs), so a large bucket never takes all its pairs and no link is lost.
    """
    docs = columns_of(docs, "doc_id", "text")
    sig = scratch.save(docs.mapInArrow(_signed(k, bands, rows), "doc_id long, n_shingles long, set_key binary, buckets array<long>"), "signatures")
    known = sig.where("set_key is not null and doc_id is not null")
    classes = scratch.save(known.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("buckets").alias("buckets")), "classes")
    members = classes.select(F.explode("buckets").alias("bucket"), "id").distinct()
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = scratch.save(members.join(scratch.save(shared, "shared"), "bucket"), "members")
    ids = scratch.save(members.select("id").distinct(), "ids")
    texts = docs.join(ids, docs.doc_id == ids.id, "left_semi")
    sets = scratch.save(texts.mapInArrow(_sets(k), "id long, grams array<long>").withColumn("n", F.size("grams")).where("n > 0"), "sets")
    size = sets.select("id", "n")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        # sizes first: they rule out most chance pairs before any set moves
        near = pairs.join(size.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
        near = scratch.save(near.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b").distinct(), f"near-{name}")
        both = near.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), "b")
        both = both.withColumn("i", F.size(F.array_intersect("ga", "gb")))
        both = both.where(f"100 * i >= {percent} * (size(ga) + size(gb) - i)").select("a", "b").distinct()
        return scratch.save(both, f"links-{name}")

    # a star in each bucket: its least id and every other member
    centres = scratch.save(members.groupBy("bucket").agg(F.min("id").alias("c")), "centres")
    stars = members.join(centres, "bucket").where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    links = confirm(scratch.save(stars, "stars"), "stars")
    components = connected_components(scratch, links, "stars-cc")
    # the members of buckets that still span components, without the centres, which have met theirs
    rest = members.join(centres, "bucket").where("id <> c").select("bucket", "id").join(components, "id", "left")
    rest = scratch.save(rest.select("bucket", "id", F.coalesce("component", "id").alias("component")), "rest")
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("bucket")
    rest = rest.join(scratch.save(mixed, "mixed"), "bucket").select("id", "component").distinct().join(size, "id")
    rest = scratch.save(rest, "rest-ids")
    if not rest.isEmpty():
        found = confirm(scratch.save(prefix_pairs(scratch, rest, sets, percent), "prefix-pairs"), "prefix")
        components = connected_components(scratch, links.union(found), "all-cc")
    # rows that share a doc_id link its classes
    of = scratch.save(classes.select("set_key", "id"), "of")
    odd = known.groupBy("doc_id").agg(F.count_distinct("set_key").alias("n")).where("n > 1").select("doc_id")
    if odd.limit(1).count():
        same = known.join(odd, "doc_id").join(of, "set_key").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
        links = components.select(F.col("id").alias("a"), F.col("component").alias("b")).union(same)
        components = connected_components(scratch, links, "shared-ids")
    least = sig.join(of, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("id"))
    out = least.join(components, "id", "left").select("doc_id", "n_shingles", F.coalesce("component", "id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, three words and 85 per cent; see near_duplicates."""
    return near_duplicates(Scratch(spark, "op4"), spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85)
