"""Token ids in Arrow stream files: fixed-size-list batches of equal-length sequences and masks (op5)."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.llm.common import Scratch, columns_of
from cloakwork.llm.tokens import batches, encoder

#: Sequences of each record batch but a file's last.
ROWS = 256


def _opened(uri: str):
    """File system and path of a URI that executors share."""
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pa.fs.LocalFileSystem(), uri)


class SequenceWriter:
    """Cuts one shard's ids into sequences of ``length``; only the last is padded, with mask false there."""

    def __init__(self, sink, length: int, dtype):
        self.length, self.dtype = length, np.dtype(dtype)
        self.kinds = pa.list_(pa.from_numpy_dtype(self.dtype), length), pa.list_(pa.bool_(), length)
        self.file = pa.ipc.new_file(sink, pa.schema([("ids", self.kinds[0]), ("mask", self.kinds[1])]))
        self.parts, self.held, self.total = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        full = self.length * ROWS
        if self.held >= full:
            got = np.concatenate(self.parts)
            cut = len(got) // full * full
            for at in range(0, cut, full):
                self._write(got[at : at + full], full)
            self.parts, self.held = [got[cut:]], len(got) - cut

    def _write(self, ids: np.ndarray, size: int) -> None:
        mask = np.zeros(size, dtype=bool)
        mask[: len(ids)] = True
        ids = np.concatenate([ids, np.zeros(size - len(ids), dtype=self.dtype)]) if len(ids) < size else ids
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in zip((ids, mask), self.kinds, strict=True)]
        self.file.write_batch(pa.record_batch(arrays, names=["ids", "mask"]))

    def close(self) -> None:
        rest = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=self.dtype)
        if len(rest):
            self._write(rest, -(-len(rest) // self.length) * self.length)
        self.file.close()


class SequenceFile:
    """Random access to a shard's sequences; local files are memory-mapped, so reads copy nothing."""

    def __init__(self, uri: str):
        fs, path = _opened(uri)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _batch(self, k: int):
        if k != self.at:
            b = self.file.get_batch(k)
            self.at, self.batch = k, (b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten())
        return self.batch

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        k, j = divmod(i, ROWS)
        ids, mask = self._batch(k)
        cut = slice(j * self.length, (j + 1) * self.length)
        return ids[cut], mask.slice(j * self.length, self.length).to_numpy(zero_copy_only=False)

    def span(self, start: int, n: int) -> np.ndarray:
        """n ids from place start of the shard on; a view wherever they lie in one batch."""
        full, out = self.length * ROWS, []
        while n:
            k, j = divmod(start, full)
            part = self._batch(k)[0][j : j + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, dtype=np.uint16)


_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _writer(base: str, tokenizer: str, length: int, end_id: int):
    def write(rows):
        shard = TaskContext.get().partitionId()
        fs, root = _opened(base)
        fs.create_dir(root, recursive=True)
        own = f"{root}/.{shard:06d}-{TaskContext.get().taskAttemptId()}"
        docs, total, out = None, 0, None
        for b in batches(rows, "text"):
            if out is None:  # empty shards have no file
                enc = encoder(tokenizer)
                sink, index = fs.open_output_stream(f"{own}-ids"), fs.open_output_stream(f"{own}-docs")
                out, docs = SequenceWriter(sink, length, enc.dtype), pa.ipc.new_file(index, _DOCS)
                end = np.array([end_id], dtype=enc.dtype)
            ids = enc.encode(b.column("text").to_pylist())
            sizes = np.array([len(x) + 1 for x in ids], dtype=np.int64)
            for x in ids:
                out.add(x)
                out.add(end)
            starts = total + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            total += int(sizes.sum())
            docs.write_batch(pa.record_batch([b.column("doc_id"), pa.array(starts, pa.int64()), pa.array(sizes)], schema=_DOCS))
        if out is None:
            return
        out.close(), docs.close(), sink.close(), index.close()
        # a rename makes each file whole or absent; a repeated task writes the same bytes
        fs.move(f"{own}-ids", f"{root}/{shard:06d}.ids.arrow")
        fs.move(f"{own}-docs", f"{root}/{shard:06d}.docs.arrow")
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([total], pa.int64())], names=["shard", "tokens"])

    return write


def write_sequences(docs: DataFrame, base: str, tokenizer: str, length: int = 2048, end_id: int = 0) -> dict[int, int]:
    """Write all ids of ``docs(doc_id, text)`` in ascending doc_id order, ``end_id`` after each document.

    One range of doc_ids goes to each shard: ``<shard>.ids.arrow`` with its sequences and masks, and
    ``<shard>.docs.arrow`` with each document's place. Null or empty text: the end id alone. Equal doc_ids follow
    by text. No rows: no files. Returns, for each shard, the ids of all shards before it (one number a shard).
    """
    rows = columns_of(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    told = rows.mapInArrow(_writer(base, tokenizer, length, end_id), "shard long, tokens long").collect()
    starts, at = {}, 0
    for shard, tokens in sorted(map(tuple, told)):
        starts[shard] = at
        at += tokens
    return starts


def read_documents(spark: SparkSession, base: str, starts: dict[int, int]) -> DataFrame:
    """From the files: doc_id, start among all ids, n_tokens, and ids_crc32 over the ids as little-endian u32."""
    shards = sorted(starts)

    def read(rows):
        for b in rows:
            for k in b.column(0).to_pylist():
                shard = shards[k]
                fs, root = _opened(base)
                ids = SequenceFile(f"{base}/{shard:06d}.ids.arrow")
                with fs.open_input_file(f"{root}/{shard:06d}.docs.arrow") as f:
                    docs = pa.ipc.open_file(f)
                    for i in range(docs.num_record_batches):
                        d = docs.get_batch(i)
                        crc = [zlib.crc32(ids.span(s, n).astype("<u4").tobytes()) for s, n in zip(d.column(1).to_pylist(), d.column(2).to_pylist(), strict=True)]
                        start = pa.array(d.column(1).to_numpy() + starts[shard], pa.int64())
                        yield pa.record_batch([d.column(0), start, d.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, len(shards))
    return spark.range(0, len(shards), 1, n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents` to shared files and back; see write_sequences for nulls, ties and empty tables."""
    from cloakwork.llm.vocab import BYTE_BPE

    scratch = Scratch(spark, "op5")
    starts = write_sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch.path}/files", os.fspath(BYTE_BPE()))
    return read_documents(spark, f"{scratch.path}/files", starts)
