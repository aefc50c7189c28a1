"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded (op6)."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import Scratch, columns_of
from cloakwork.llm.tokens import batches, encoder, trim

_OUT = pa.schema([("shard", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("rank", pa.int64())])


def pieces(n: int, most: int = 2048) -> list[int]:
    """Binary lengths whose sum is n: as often as it goes the largest, then the bits of what is left."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def _decompose(tokenizer: str, most: int, end_id: int):
    def cut(rows):
        shard, enc, seen = TaskContext.get().partitionId(), None, {}
        trim()  # the worker may have served other stages
        for b in batches(rows, "text"):
            enc = enc or encoder(tokenizer)
            out = [[] for _ in range(6)]
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist()), strict=True):
                ids, at = np.append(ids.astype("<u4"), np.uint32(end_id)), 0
                for n in pieces(len(ids), most):
                    rank = seen.get(n, 0)
                    seen[n] = rank + 1
                    for col, v in zip(out, (doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), rank), strict=True):
                        col.append(v)
                    at += n
            yield pa.record_batch([pa.array([shard] * len(out[0]), pa.int64()), *(pa.array(c, pa.int64()) for c in out)], schema=_OUT)

    return cut


def pack(scratch: Scratch, docs: DataFrame, tokenizer: str, most: int = 2048, end_id: int = 1) -> DataFrame:
    """One row a piece of ``docs(doc_id, text)``, each piece a sequence of its own in the bucket of its length.

    A document's ids and ``end_id`` are cut into pieces of binary length, at most ``most`` (a power of two). Sequences
    are numbered bucket by bucket, longest first, so each run of numbers has one length and needs no padding: offset
    is 0. Null or empty text: the end id alone, one piece of length 1. Repeated doc_ids are packed each on its own.
    No rows: no pieces. Texts aren't shuffled; only a count for each task and length (12 numbers a task) is collected.
    """
    cut = columns_of(docs, "doc_id", "text").mapInArrow(_decompose(tokenizer, most, end_id), "shard long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long")
    cut = scratch.save(cut, "pieces")
    counts = sorted(map(tuple, cut.groupBy("length", "shard").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], x[1]))
    base, at = [], 0
    for length, shard, n in counts:
        base.append((length, shard, at))
        at += n
    bases = scratch.spark.createDataFrame(base, "length long, shard long, base long")
    out = cut.join(F.broadcast(bases), ["length", "shard"])  # at most 12 rows a task of the scan
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`; see pack."""
    from cloakwork.llm.vocab import BYTE_BPE

    return pack(Scratch(spark, "op6"), spark.read.parquet(f"{sf_dir}/documents.parquet"), BYTE_BPE())
