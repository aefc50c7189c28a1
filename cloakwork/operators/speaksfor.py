"""Edges old_uid -> new_uid between principals and their pseudoprincipals."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def durable(spark: SparkSession) -> None:
    """A checkpoint folder: the session's spark.checkpoint.dir, or one of our own if it is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(base or os.path.join(tempfile.gettempdir(), "cloakwork-checkpoints"))


def closure(edges: DataFrame) -> DataFrame:
    """(root, uid, depth): everything reachable from each old_uid, itself at depth 0, over any number of hops.

    Each round doubles the depth and is written: pairs less than 2^k apart are joined with those exactly 2^k apart,
    so the rounds grow with the logarithm of the longest chain. Cycles end, as only shortest ways are kept.
    """
    durable(edges.sparkSession)
    step = edges.where("old_uid <> new_uid").select("old_uid", "new_uid").distinct().checkpoint()
    pairs = edges.select(F.col("old_uid").alias("root"), F.col("old_uid").alias("uid"), F.lit(0).alias("depth")).distinct().checkpoint()
    hops = 1
    while not step.isEmpty():
        far = pairs.join(step, pairs.uid == step.old_uid).select("root", F.col("new_uid").alias("uid"), (F.col("depth") + hops).alias("depth"))
        pairs = pairs.union(far).groupBy("root", "uid").agg(F.min("depth").alias("depth")).checkpoint()
        more = step.select(F.col("old_uid").alias("root"), F.col("new_uid").alias("mid")).join(step, F.col("mid") == F.col("old_uid")).select("root", F.col("new_uid").alias("uid"))
        step = more.distinct().join(pairs, ["root", "uid"], "left_anti").select(F.col("root").alias("old_uid"), F.col("uid").alias("new_uid")).checkpoint()
        hops *= 2
    return pairs


def pseudoprincipals(edges: DataFrame, user) -> DataFrame:
    """uid: the user and all its pseudoprincipals, over any number of hops.

    A frontier runs from the user alone, one written round a hop; principals of others are never joined.
    """
    spark = edges.sparkSession
    durable(spark)
    step = edges.select("old_uid", "new_uid").distinct()
    found = front = spark.createDataFrame([(str(user),)], "uid string")
    while True:
        front = step.join(front, F.col("old_uid") == F.col("uid"), "left_semi").select(F.col("new_uid").alias("uid")).distinct().join(found, "uid", "left_anti").checkpoint()
        if front.isEmpty():
            return found
        found = found.union(front).checkpoint()


def nearest_ancestor(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(uid, ancestor): for each pseudoprincipal in ``gone(uid)`` the nearest ancestor that isn't itself gone, of equally near ones the least.

    Each round climbs one hop from those still without an ancestor, so only paths through gone principals are followed.
    """
    spark = edges.sparkSession
    durable(spark)
    up = edges.where("old_uid <> new_uid").select(F.col("new_uid").alias("at"), F.col("old_uid").alias("next")).distinct()
    lost = gone.select(F.col("uid").alias("lost")).distinct()
    front = lost.select(F.col("lost").alias("uid"), F.col("lost").alias("at"))
    seen, found = front, None
    while True:
        step = front.join(up, "at").select("uid", F.col("next").alias("at")).distinct().join(lost.withColumn("gone", F.lit(True)), F.col("at") == F.col("lost"), "left")
        step = step.select("uid", "at", F.coalesce("gone", F.lit(False)).alias("gone")).checkpoint()
        hit = step.where("not gone").groupBy("uid").agg(F.min("at").alias("ancestor")).checkpoint()
        found = hit if found is None else found.union(hit).checkpoint()
        front = step.where("gone").select("uid", "at").join(hit, "uid", "left_anti").join(seen, ["uid", "at"], "left_anti").checkpoint()
        if front.isEmpty():
            return found
        seen = seen.union(front).checkpoint()
