"""Byte-level BPE ids of whole texts, encoded by the tokenizers library."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import os
import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa

#: White space that may join a run with the spaces and line feeds beside it; texts that hold some are encoded whole.
OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
#: Visible ASCII without apostrophes and Latin letters, with single line feeds inside: the pre-tokenizer cuts these as PARTS does.
SAFE = re.compile(r"[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+(?:\n[!-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)*").fullmatch
PARTS = re.compile(r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+|\n| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+").findall
#: Byte-level spelling of a line feed.
FEED = "\u010a"
#: Longer pieces are not kept.
LONGEST = 64
#: What each byte of a plain text is: 0 no plain text, 1 space, 2 line feed, 3 letter (of U+00C0 to U+023F, too), 4 digit, 5 other visible ASCII.
KIND = np.zeros(256, np.uint8)
KIND[32], KIND[10], KIND[33:127] = 1, 2, 5
KIND[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), *range(0xC3, 0xC9)]], KIND[48:58], KIND[39] = 3, 4, 0


def _spelling() -> dict[int, str]:
    """How a byte-level model spells each character that SAFE pieces hold: printable Latin-1 bytes as themselves, others from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in shown]
    byte = [chr(b if b in shown else 256 + rest.index(b)) for b in range(256)]
    return {c: "".join(byte[b] for b in chr(c).encode()) for c in (10, *range(32, 127), *range(0xC0, 0x250))}


class Encoder:
    """Ids of texts, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, little-endian.

    Texts that hold the string of an added token are left to the library whole. A byte-level pre-tokenizer always cuts before a
    single space, so texts are cut there and each piece is looked up with its space. Unknown pieces are put together
    from the ids of their words, and the unknown words of a batch are encoded by the library in one call. Plain texts (KIND)
    are cut into words at once, by their bytes, and each distinct word of a batch is looked up. At most ``cache`` words and
    a third as many pieces are kept, so memory is bounded; results don't depend on what is kept.
    """

    def __init__(self, path: str, cache: int = 300_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.tokenizer.to_str())
        pre, feed = spec.get("pre_tokenizer") or {}, self._ids("\n")
        self.cut = (
            spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space", False) and feed.tolist() == [self.tokenizer.token_to_id(FEED)]
        )
        if self.cut:
            self.feed = feed[0]
            self.added = [t["content"] for t in spec.get("added_tokens") or []]
            self.spelling = _spelling()
            self.words = {"\n": feed.tobytes()}
            self.spelt = Tokenizer.from_file(path)  # the same model on words that are spelt and cut already
            self.spelt.pre_tokenizer = pre_tokenizers.Split(FEED, "isolated")
        self.pieces, self.limit = {}, cache

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _between_feeds(self, tokenizer, text: str, words: list[str]) -> list[bytes] | None:
        """Ids of each word from the text that joins them; None if the line feeds between them don't show where each ends."""
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends, raw, w = [*np.flatnonzero(ids == self.feed).tolist(), len(ids)], ids.tobytes(), self.dtype.itemsize
        starts = [0, *(e + 1 for e in ends[:-1])]
        return [raw[a * w : b * w] for a, b in zip(starts, ends, strict=True)] if len(ends) == len(words) else None

    def _learn_words(self, words: list[str]) -> None:
        if words:
            ids = self._between_feeds(self.spelt, "\n".join(words).translate(self.spelling), words)
            self.words.update(zip(words, ids or [self._ids(x).tobytes() for x in words], strict=True))

    def _plain(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Ids of texts by their words; None for those that aren't plain. No text begins or ends with a space."""
        ends = np.cumsum([0, *map(len, texts)])
        data = np.frombuffer(b"".join(texts), np.uint8)
        kind = KIND[data]
        bad = kind == 0
        pair = kind[1:]
        bad[1:] |= (pair <= 2) & (kind[:-1] <= 2)  # white space beside white space
        bad[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # the signs of multiplication and division
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, np.flatnonzero(bad), "right") - 1] = True
        if odd.any():
            known = iter(self._plain([t for t, o in zip(texts, odd, strict=True) if not o]) if not odd.all() else ())
            return [None if o else next(known) for o in odd]
        # a word begins where the kind changes, but a space belongs to what follows it
        first = np.ones(len(data), bool)
        first[1:] = (pair != kind[:-1]) & (kind[:-1] != 1)
        first[ends[:-1][ends[:-1] < len(data)]] = True
        starts = np.flatnonzero(first)
        at = np.searchsorted(starts, ends).tolist()
        words = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        own, codes = words.dictionary.to_pylist(), words.indices.to_numpy()
        new = list(filterfalse(self.words.__contains__, own))
        self._learn_words(new)
        get = list(map(self.words.__getitem__, own)).__getitem__
        self._forget(self.words, new, self.limit)
        return [np.frombuffer(b"".join(map(get, codes[a:b].tolist())), dtype=self.dtype) for a, b in zip(at, at[1:], strict=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces, each with a space before it; None for those with other white space."""
        known, words, plain, rest = self.words, set(), [], []
        for p in new:
            (plain if SAFE(p) else rest).append(p)
        parts = [PARTS(" " + p) for p in plain]
        for x in parts:
            words.update(filterfalse(known.__contains__, x))
        words = list(words)
        self._learn_words(words)
        get = known.__getitem__
        self.pieces.update((p, b"".join(map(get, x))) for p, x in zip(plain, parts, strict=True))
        self.pieces.update((p, None) for p in rest if OTHER_SPACE.search(p))
        one = [p for p in rest if "\n" not in p and p not in self.pieces]
        if one:
            text = "\n".join([" " + p for p in one])
            self.pieces.update(zip(one, self._between_feeds(self.tokenizer, text, one) or (), strict=False))
        for p in rest:
            if p not in self.pieces:
                self.pieces[p] = self._ids(" " + p).tobytes()
        self._forget(known, words, self.limit)

    def _forget(self, held: dict, new: list[str], most: int) -> None:
        for x in [x for x in new if len(x) > LONGEST]:
            del held[x]
        over = len(held) - most
        for x in [x for x in new if x in held][-over:] if over > 0 else ():
            del held[x]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Null is an empty text."""
        texts = [t or "" for t in texts]
        if not self.cut:
            got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(e.ids, dtype=self.dtype) for e in got]
        # runs of spaces and line feeds with a space in them aren't cut where spaces are
        odd = [any(a in t for a in self.added) or t[:1] == " " or t[-1:] == " " or "  " in t or "\n " in t or " \n" in t for t in texts]
        plain = iter(self._plain([t.encode() for o, t in zip(odd, texts, strict=True) if not o]))
        plain = [None if o else next(plain) for o in odd]
        split = [None if o or x is not None else t.split(" ") for o, x, t in zip(odd, plain, texts, strict=True)]
        new, known = set(), self.pieces.__contains__
        for s in split:
            if s:
                head = s.pop(0)
                new.update(filterfalse(known, s))
                s.append(head)
        new = list(new)
        self._learn(new)
        out, get = [], self.pieces.__getitem__
        for t, s, ids in zip(texts, split, plain, strict=True):
            if s and not OTHER_SPACE.search(head := s.pop()):
                found = list(map(get, s))
                ids = None if None in found else np.frombuffer(self._ids(head).tobytes() + b"".join(found), dtype=self.dtype)
            out.append(self._ids(t) if ids is None else ids)
        self._forget(self.pieces, new, self.limit // 3)
        return out


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The process's encoder: what it keeps serves all tasks of a worker."""
    return Encoder(path)


def trim() -> None:
    """Give back to the system what the process has freed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other platforms have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def forget() -> None:
    """Give back the memory of what a worker keeps of ids: workers outlive their stage and serve others next."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
    trim()


def batches(rows, texts: str, most: int = 4 << 20):
    """Cut Arrow record batches into pieces of at most about ``most`` bytes of text (one row at least)."""
    for b in rows:
        col = b.column(b.schema.get_field_index(texts))
        start, held = 0, 0
        for i, v in enumerate(col):
            held += len(v.as_buffer()) if v.is_valid else 0
            if held >= most:
                yield b.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)
