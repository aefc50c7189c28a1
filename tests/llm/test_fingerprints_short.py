"""Fingerprints of short texts."""

import random

from cloakwork.llm import fingerprints


def test_short_texts_have_anchors(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(8 * n + i, " ".join(word() for _ in range(n))) for n in range(1, 18) for i in range(8)]
    got = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.fingerprint and r.n_anchors > 0 for r in got)
    assert len({r.fingerprint for r in got}) == len(rows) and all(r.near_next == 0 for r in got)
    # one word changed in the middle of 16 leaves an anchor in most texts
    both = [(2 * i + j, " ".join(w if j == 0 or k != 8 else "x" for k, w in enumerate(t.split()))) for i, t in enumerate(t for _, t in rows[-16:-8]) for j in (0, 1)]
    got = fingerprints.fingerprints(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert sum(r.near_next > 0 for r in got if r.doc_id % 2 == 0) >= 6
