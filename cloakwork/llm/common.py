"""Shared pieces: the shared folder, stage tables and connected components.

Every table that cuts lineage is written to the folder that ``spark.checkpoint.dir`` names, which all
executors and the driver share, so a lost executor never loses a stage's result.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``; where that is unset, one of our own if the master is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "cloakwork-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """A folder for one call's stage tables under the shared folder."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_base(spark)}/{what}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return it as read back: its lineage is then a scan of shared files."""
        to = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(to)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(to)

    def release(self) -> None:
        """Let Spark remove the shuffle files of plans that nothing refers to any more; it does so after a collection."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Remove a stage table that nothing still to be computed reads."""
        self.names.discard(name)
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, *names: str) -> None:
        """Remove all stage tables but those named, which the result still reads, and old shuffle files."""
        for n in self.names - set(names):
            self.drop(n)
        self.release()


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that any extra column of the input, whatever its name, stays out of the way."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def small(df: DataFrame, rows: int, limit: int = 10_000) -> DataFrame:
    """Mark df for broadcast only when the counted rows stay under limit."""
    return F.broadcast(df) if rows <= limit else df


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """Components of undirected ``edges(a, b)`` as ``(id, component)`` with the least id of each component.

    Contraction: each node points to the least of its neighbours and itself, pointers are followed once more, and the
    edges then run between the nodes pointed to; those inside one node go. So each round works on what is left,
    and the rounds grow with the logarithm of a chain's length. A hub's rows only pass through joins that adaptive
    execution may split and aggregations that combine before the shuffle. Ids in no edge are not returned.
    """
    two = lambda df: df.where("a <> b").select("a", "b").union(df.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    left, labels, k = scratch.save(two(edges), f"{name}-0-left"), None, 0
    while labels is None or not left.isEmpty():
        k += 1
        to = left.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("p"))
        to = scratch.save(to, f"{name}-{k}-to")
        far = to.select(F.col("id").alias("p"), F.col("p").alias("q"))
        to = scratch.save(to.join(far, "p").select("id", F.col("q").alias("p")), f"{name}-{k}-far")
        ends = left.join(to.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(to.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        left = scratch.save(ends.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), f"{name}-{k}-left")
        if labels is None:
            labels = to.select("id", F.col("p").alias("component"))
        else:
            labels = labels.join(to.select(F.col("id").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        labels = scratch.save(labels, f"{name}-{k}")
        for old in (f"{name}-{k - 1}", f"{name}-{k}-to", f"{name}-{k}-far", f"{name}-{k - 1}-left"):
            scratch.drop(old)
    scratch.drop(f"{name}-{k}-left")
    return labels
