"""Sampled segmentations over the lattice of SentencePiece pieces, by forward filtering and backward sampling (op7)."""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm.anchors import _mix
from cloakwork.llm.common import columns_of
from cloakwork.llm.tokens import batches

#: Stretches with a lattice of their own: a word with the space before it, a space, a line feed. Pieces never span two.
STRETCH = re.compile(r" ?[^ \n]+| |\n")
SPACE = "▁"
#: Added to the code point of a literal U+2581, which only its bytes may encode.
_LITERAL = 0x200000
_P = np.uint64(0x9E3779B97F4A7C15)
#: Words of a lattice table at once.
TABLE = 2048


class Lattice:
    """Encoder and decoder for a SentencePiece model with byte pieces.

    Piece i has the weight (1 + rank)**-alpha, rank by the model's scores; a character that is no piece is spelt in
    bytes. A segmentation's probability is in proportion to the product of its pieces' weights. Forward filtering
    sums the weights of all ways to each place of a stretch, backward sampling then draws pieces from its end. The
    draws depend on the seed, the row key and the stretch's number only, not on batches, caches or tasks.
    """

    def __init__(self, path: str, alpha: float = 1.0, seed: int = 1):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids, self.bytes_of, texts, scores, ids = [0] * 256, [b""] * n, [], [], []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_ids[b], self.bytes_of[i] = i, bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
                texts.append(piece), scores.append(sp.get_score(i)), ids.append(i)
        self.longest = max(len(t) for t in texts if SPACE not in t[1:])
        rank = np.empty(len(texts))
        rank[np.argsort(-np.array(scores), kind="stable")] = np.arange(len(texts))
        weight = -alpha * np.log(2.0 + rank)
        keys = np.array([self._key(t) for t in texts], np.uint64)
        order = np.argsort(keys)
        self.keys, self.weights, self.ids = keys[order], weight[order], np.array(ids)[order]
        if len(np.unique(self.keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.spelt = float(weight.min()) - 2.0
        self.seed = np.uint64(seed)

    @staticmethod
    def _key(text: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in text:
            h = (h + np.uint64(ord(c) + 1)) * _P
        return _mix(h)[0]

    def _tables(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cumulative chance, id) of the piece of length l + 1 that ends at place j of word w; id -1: spelt in bytes."""
        n, size = len(start), int(length.max())
        most = min(self.longest, size)
        code = codes[np.minimum(start[:, None] + np.arange(size), len(codes) - 1)]
        weight = np.full((n, size + 1, most), -np.inf)
        ids = np.full((n, size + 1, most), -1, np.int32)
        h = np.zeros((n, size), np.uint64)
        for k in range(most):
            h = (h[:, : size - k] + code[:, k:] + np.uint64(1)) * _P
            key = _mix(h)
            row, at = np.nonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)] & (np.arange(size - k) + k < length[:, None]))
            own = key[row, at]
            where = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            hit = self.keys[where] == own
            row, at, where = row[hit], at[hit], where[hit]
            weight[row, at + k + 1, k] = self.weights[where]
            ids[row, at + k + 1, k] = self.ids[where]
        alone = weight[:, 1:, 0]
        alone[np.isneginf(alone)] = self.spelt
        forward = np.full((n, size + 1), -np.inf)
        forward[:, 0] = 0.0
        chance = np.zeros((n, size + 1, most), np.float32)
        for j in range(1, size + 1):
            k = min(j, most)
            ways = weight[:, j, :k] + forward[:, j - 1 :: -1][:, :k]
            top = ways.max(axis=1)
            p = np.exp(ways - top[:, None])
            total = p.sum(axis=1)
            forward[:, j] = top + np.log(total)
            chance[:, j, :k] = np.cumsum(p, axis=1) / total[:, None]
            chance[:, j, k - 1 :] = 1.0
        return chance, ids

    def encode(self, texts: list[str | None], keys: list) -> list[np.ndarray]:
        """Sampled ids of each text; texts with equal row keys get equal draws."""
        split = [STRETCH.findall(t) if t else [] for t in texts]
        flat = list(chain.from_iterable(split))
        number = {w: i for i, w in enumerate(dict.fromkeys(flat))}
        word = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        counts = np.array([len(s) for s in split], np.int64)
        ends = np.cumsum(counts)
        first = np.repeat(ends - counts, counts)
        base = np.array([xxhash.xxh3_64_intdigest(str(k)) for k in keys], np.uint64)
        draw = _mix(np.repeat(base, counts) + self.seed * _P + np.arange(len(word)).astype(np.uint64) - first.astype(np.uint64))
        codes = np.frombuffer("".join(number).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[codes == 0x2581] += np.uint64(_LITERAL)
        codes[codes == 32] = 0x2581
        length = np.fromiter(map(len, number), np.int64, len(number))
        start = np.cumsum(length) - length
        by = np.argsort(length, kind="stable")  # words of like length share a table
        groups, at = [], 0
        while at < len(by):
            size = int(length[by[at]])
            up = size + max(1, size // 6)
            end = min(int(np.searchsorted(length[by], up, side="right")), at + max(1, TABLE * 16 // up))
            groups.append(by[at:end])
            at = end
        place = np.empty(len(number), np.int64)
        group_of = np.empty(len(number), np.int64)
        for g, own in enumerate(groups):
            place[own], group_of[own] = np.arange(len(own)), g
        occurrence = np.argsort(group_of[word], kind="stable")
        cuts = np.searchsorted(group_of[word][occurrence], np.arange(len(groups) + 1))
        out = [[], [], [], []]  # occurrence, number of the piece from the end, id, code point where spelt
        pieces_of = np.zeros(len(word), np.int64)
        for g, own in enumerate(groups):
            mine = occurrence[cuts[g] : cuts[g + 1]]
            chance, ids = self._tables(codes, start[own], length[own])
            width, most = chance.shape[1:]
            chance, ids = chance.reshape(-1, most), ids.reshape(-1)
            row, j = place[word[mine]] * width, length[word[mine]]
            step = 0
            while len(mine):
                step += 1
                u = (_mix(draw[mine] + np.uint64(step * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
                k = (chance.take(row + j, axis=0) <= u[:, None]).sum(axis=1)
                got = ids.take((row + j) * most + k)
                pieces_of[mine] = step
                out[0].append(mine), out[1].append(np.full(len(mine), step)), out[2].append(got)
                out[3].append(np.where(got < 0, codes[start[word[mine]] + j - 1], 0))
                j = j - k - 1
                left = j > 0
                mine, row, j = mine[left], row[left], j[left]
        if not len(word):
            return [np.zeros(0, np.int32) for _ in texts]
        who, back, got, code = (np.concatenate(x) for x in out)
        order = np.empty(len(who), np.int64)  # each piece's place in the text's order
        order[np.cumsum(pieces_of)[who] - back] = np.arange(len(who))
        who, got, code = who[order], got[order], code[order]
        spelt = np.flatnonzero(got < 0)
        if len(spelt):
            raw = [chr(c - _LITERAL if c > 0x1FFFFF else 32 if c == 0x2581 else c).encode("utf-8", "surrogatepass") for c in code[spelt].tolist()]
            widths = np.ones(len(got), np.int64)
            widths[spelt] = [len(b) for b in raw]
            starts = np.cumsum(widths) - widths
            who, wide = np.repeat(who, widths), np.repeat(got, widths)
            at = np.concatenate([np.arange(s, s + len(b)) for s, b in zip(starts[spelt].tolist(), raw, strict=True)])
            wide[at] = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
            got = wide
        cut = np.searchsorted(who, np.concatenate([[0], ends]))
        return [got[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The UTF-8 bytes that ids encode."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def sampled(docs: DataFrame, model: str, alpha: float = 1.0, seed: int = 1, ids: bool = False) -> DataFrame:
    """For every row of ``docs(doc_id, text)``: doc_id, n_tokens, ids_crc32 (little-endian u32), decoded_sha256, lossless.

    With ``ids`` the ids themselves too. Null text: no ids. The row key is doc_id, so equal rows get equal ids. Every
    text, whatever it holds, decodes to itself; lossless says whether it did. No shuffle; empty table: empty result.
    """

    def encoded(it):
        lattice = None
        for b in batches(it, "text", 6 << 20):
            lattice = lattice or Lattice(model, alpha, seed)
            texts, keys = b.column("text").to_pylist(), b.column("doc_id").to_pylist()
            got = lattice.encode(texts, keys)
            back = [lattice.decode(x) for x in got]
            cols = {
                "doc_id": b.column("doc_id"),
                "n_tokens": pa.array([len(x) for x in got], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in got], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                "lossless": pa.array([x == (t or "").encode() for x, t in zip(back, texts, strict=True)]),
            }
            if ids:
                cols["ids"] = pa.array(got, pa.list_(pa.int32()))
            yield pa.record_batch(list(cols.values()), names=list(cols))

    kind = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean" + ", ids array<int>" * ids
    return columns_of(docs, "doc_id", "text").mapInArrow(encoded, kind)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole `documents`; see sampled."""
    from cloakwork.llm.vocab import PIECES

    return sampled(spark.read.parquet(f"{sf_dir}/documents.parquet"), PIECES())
