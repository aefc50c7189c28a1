"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (op8)."""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakwork.llm.anchors import _mix
from cloakwork.llm.common import Scratch, columns_of
from cloakwork.llm.tokens import batches, forget

#: Labelled rows that the model is fitted on, at most; the rows with the least hash of doc_id are taken.
SAMPLE = 8000
#: A document is rejected from this score on.
THRESHOLD = 0.7
#: Features are hashed to this many bits.
BITS = 30

WORD = re.compile(r"\w+")


#: Lengths of the word beginnings that count as features too: they carry over to words that the sample lacks.
BEGINNINGS = (3, 4, 5, 6)


class _Hashes(dict):
    """Of each word its hash and those of its beginnings (0: the word is no longer than that); at most ``limit`` words."""

    limit = 200_000

    def __missing__(self, word: str) -> bytes:
        digest = xxhash.xxh3_64_intdigest
        v = struct.pack("<5Q", digest(word), *(digest(word[:n] + "\0") if len(word) > n else 0 for n in BEGINNINGS))
        if len(self) < self.limit:
            self[word] = v
        return v


_HASHES = _Hashes()


def features(text: str | None) -> np.ndarray:
    """Hashed words, their beginnings, pairs of neighbours, and pairs with one and two words between; as often as they occur."""
    words = WORD.findall((text or "").lower())
    rows = np.frombuffer(b"".join(map(_HASHES.__getitem__, words)), np.uint64).reshape(-1, 1 + len(BEGINNINGS))
    h, begin = rows[:, 0].copy(), rows[:, 1:]
    parts = [_mix(h + np.uint64(1)), _mix(begin[begin != 0] + np.uint64(2))]
    for gap in (1, 2, 3):
        if len(h) > gap:
            parts.append(_mix(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] + np.uint64(gap)))
    return (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(examples: list[np.ndarray], labels: np.ndarray, epochs: int = 10, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, least: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) by FTRL-proximal: each coordinate has its own rate, and L1 keeps most weights zero.

    Features count once a document; those of fewer than ``least`` documents are left out.
    """
    if not len(labels):
        return np.zeros(0, np.int64), np.zeros(0), -30.0
    every = np.concatenate(examples)
    names, count = np.unique(every, return_counts=True)
    del every
    names = names[count >= least]
    rows = []
    for x in examples:
        at = np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))
        rows.append((at[names[at] == x] if len(names) else at[:0]).astype(np.int32))
    z, n = np.zeros(len(names)), np.zeros(len(names))
    rate = min(max(labels.mean(), 1e-4), 1 - 1e-4)
    bias, seen = float(np.log(rate / (1 - rate))), 1.0
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    for _ in range(epochs):
        for x, y in zip(rows, labels, strict=True):
            zx, nx = z[x], n[x]
            w = weights(zx, nx)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha * w
            n[x] = nx + g * g
            seen += g * g
            bias -= 0.02 * g / np.sqrt(seen)
    w = weights(z, n)
    return names[w != 0].astype(np.int64), w[w != 0], bias


def _featured(it):
    forget()
    for b in batches(it, "text"):
        rows = [np.unique(features(t)).astype(np.int32) for t in b.column("text").to_pylist()]
        yield pa.record_batch([b.column("doc_id"), b.column("toxic"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "toxic", "features"])
    _HASHES.clear()


def _fitted(it):
    forget()
    rows = []
    for b in it:
        own = [x.values.to_numpy().copy() for x in b.column("features")]
        rows += zip(b.column("doc_id").to_pylist(), b.column("toxic").to_pylist(), own, strict=True)
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r[0])), r[0], len(r[2]), r[2].tobytes()))
    names, w, bias = fit([r[2] for r in rows], np.array([r[1] for r in rows], float))
    yield pa.record_batch([pa.array([-1, *names.tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], names=["feature", "weight"])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(scratch: Scratch, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most ``sample`` labelled rows that aren't held out; one task holds their features.

    Only the sample's texts leave their scan, as features. Without labelled rows every score is near 0.
    """
    known = columns_of(labels, "doc_id", "toxic").where("toxic in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = columns_of(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    rows = rows.select("doc_id", "text", "toxic").mapInArrow(_featured, "doc_id long, toxic long, features array<int>")
    rows = scratch.save(rows, "features")
    table = scratch.save(rows.repartition(1).mapInArrow(_fitted, "feature long, weight double"), "weights")
    # features of at least three of at most `sample` documents whose weight L1 leaves: bounded by the sample, not by the corpus
    got = table.collect()
    bias = next((r.weight for r in got if r.feature == -1), -30.0)
    got = sorted((r.feature, r.weight) for r in got if r.feature != -1)
    return np.array([f for f, _ in got], np.int64), np.array([w for _, w in got]), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], to: str = "score") -> DataFrame:
    """docs with a score (0 to 1) of its ``text``; every other column stays. Null text: as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(it):
        forget()
        names, w, bias = sent.value
        # a small table by the low bits rules out nearly all features before they are looked up
        maybe = np.zeros(1 << 22, bool)
        maybe[names & (1 << 22) - 1] = True
        for b in batches(it, "text"):
            out = []
            for t in b.column("text").to_pylist():
                x = features(t)
                x = np.unique(x[maybe[x & (1 << 22) - 1]])
                at = np.minimum(np.searchsorted(names, x), max(0, len(names) - 1))
                total = bias + (w[at[names[at] == x]].sum() if len(names) else 0.0)
                out.append(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))))
            yield pa.record_batch([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, to])
        _HASHES.clear()

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(to, T.DoubleType())]))


def toxicity(scratch: Scratch, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, toxic)`` teach only where crc32(doc_id) mod 3 isn't 1, and are no input of a score. Null and empty
    texts have the score of no features. Repeated rows score alike; of several labels of a doc_id the greater counts.
    """
    model = train(scratch, docs, labels, sample)
    out = score(columns_of(docs, "doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`, taught by `labels`; see toxicity."""
    return toxicity(Scratch(spark, "op8"), spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
