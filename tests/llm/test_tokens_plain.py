"""The encoder's way of plain texts: the library's ids, and less kept than by pieces."""

import random

from cloakwork.llm.tokens import Encoder
from cloakwork.llm.vocab import BYTE_BPE


def test_ids_as_the_library():
    rng, enc = random.Random(1), Encoder(BYTE_BPE(), cache=50)
    some = ["a", "The", "é", "Öß", "ȿ", "ɏ", "Ɂ", "×", "÷", "'s", "’", "7", "42", "!", "$$", "~", " ", " ", " ", " ", "\n", "\t", "\r", "\x00", "\x7f", "\x85", "\xa0", " ", "ª", "漢", "🙂", "<|endoftext|>", "ǅ", "é"]
    for alphabet in (some, some[:7] + some[11:20] + ["\n"]):
        texts = [None, "", "\n", " ", "a\n", "\na", "\n\n", *("".join(rng.choices(alphabet, k=rng.randrange(1, 20))) for _ in range(4000))]
        want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        for at in range(0, len(texts), 97):
            for t, x, y in zip(texts[at : at + 97], enc.encode(texts[at : at + 97]), want[at : at + 97], strict=True):
                assert x.tolist() == y, repr(t)
    assert len(enc.words) <= 51 and len(enc.pieces) <= 50


def test_plain_texts_keep_words_only():
    enc = Encoder(BYTE_BPE())
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)]
    texts = [" ".join(a + b for a, b in zip(words, [",", ".", "\nSo", "!"] * 1250, strict=True)), " ".join(words)]
    assert [x.tolist() for x in enc.encode(texts)] == [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert not enc.pieces and len(enc.words) < 11_000
