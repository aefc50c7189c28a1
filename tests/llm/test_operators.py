"""The text operators on small fixtures: brute force, round trips, and nulls, ties, repeats, empty tables, extra columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cloakwork.llm import bm25, fingerprints, lines, minhash, packing, pieces, queries, sequences, suffixes, toxicity, urls
from cloakwork.llm.anchors import anchors, gram_hashes
from cloakwork.llm.common import Scratch, connected_components
from cloakwork.llm.lcp import merge, pack_run, unpack_run
from cloakwork.llm.vocab import BYTE_BPE, PIECES

SF = "/root/testdata/sf0.001"
P = "The quick brown fox jumps over the lazy dog while the patient cat watches from a warm window sill above. "
ODD = [(0, P * 3), (1, None), (2, ""), (3, P * 3), (4, "x"), (5, "a b"), (6, "日本語 \n\n ▁ é\t" + P * 2), (7, "word " * 400), (9, "A B"), (12, P * 2 + "tail"), (12, P * 2 + "other"), (13, "same"), (13, "same"), (None, P)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(d, t, "zz", 1, "q", "k") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n int, score string, bucket string")


@pytest.fixture(scope="module")
def real():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def removal(rows, width=100):
    seen, out = set(), {}
    for d, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                cover[s : s + width] = b"\1" * width
            seen.add(b[s : s + width])
        n = sum(cover[i] and (i == 0 or not cover[i - 1]) for i in range(len(b)))
        out[d] = (len(b), sum(cover), n, hashlib.sha256(bytes(x for x, c in zip(b, cover) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [500, 1])
def test_suffixes_against_brute_force(spark, real, hot):
    rows = real[:60] + [(1000 + i, ("ab" * 90) + str(i) * 3 + P * 2) for i in range(12)]
    got = suffixes.remove_repeats(Scratch(spark, "t10"), docs_of(spark, rows), hot=hot, per_target=50)
    assert {r.doc_id: tuple(r)[1:5] for r in got.collect()} == removal(rows)


def test_suffixes_odd(spark, odd):
    got = suffixes.remove_repeats(Scratch(spark, "t10"), odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.n_bytes, r.n_removed))
    assert by[13] == {(4, 0)} and by[1] == {(0, 0)} and by[None] == {(len(P), 0)} and all(n == m for n, m in by[3])


def test_suffix_stage_keeps_rows(spark):
    """Two texts of one doc_id and length, rows without a doc_id, repeated rows, clashing columns: each row keeps its own text."""
    import corpus_pipeline

    a, b = ("".join(hashlib.sha256(f"{s}{i}".encode()).hexdigest() for i in range(3))[:130] for s in "ab")
    rows = [(1, a, 130, "p", 0), (1, b, 130, "q", 1), (None, b, 130, "r", 2), (None, a + "x", 131, "s", 3), (2, None, 0, "t", 4), (3, a, 130, "u", 5), (3, a, 130, "u", 5), (4, "", 0, "v", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, `rest` string, sub int")
    got = corpus_pipeline.suffix_stage(spark, docs, SF)
    assert got.columns == docs.columns
    # rows without a doc_id come first and stay whole; everything else repeats them
    assert sorted(map(tuple, got.collect()), key=lambda r: r[4]) == [(1, "", 0, "p", 0), (1, "", 0, "q", 1), (None, b, 130, "r", 2), (None, a + "x", 131, "s", 3), (2, None, 0, "t", 4), (3, "", 0, "u", 5), (3, "", 0, "u", 5), (4, "", 0, "v", 6)]


def test_anchor_windows():
    rng = np.random.default_rng(3)
    for _ in range(60):
        d = rng.integers(0, 3, rng.integers(1, 200)).astype(np.uint8)
        _, p, lo, hi = anchors(d, 20, 6)
        own = {s: a for a, x, y in zip(p, lo, hi) for s in range(x, y + 1)}
        assert len(own) == max(0, len(d) - 19)
        if len(d) >= 20:
            h = gram_hashes(d, 6)
            assert all(own[s] == s + int(np.argmin(h[s : s + 15])) for s in own)


def test_loser_tree():
    rng = np.random.default_rng(5)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 12))) for _ in range(5)]
    packed = [unpack_run(pack_run(r, np.zeros((len(r), 2)), r)) for r in runs]
    assert [p[0] for p in packed] == runs == [p[3] for p in packed]
    out, last = [], b""
    for r, i, same in merge([p[:2] for p in packed]):
        s = packed[r][0][i]
        if out:
            n = 0
            while n < min(len(s), len(last)) and s[n] == last[n]:
                n += 1
            assert same == n
        out.append(s)
        last = s
    assert out == sorted(sum(runs, []))


def linked(rows, k, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    of = {d: d for d in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                of[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_minhash_against_brute_force(spark, real):
    words = [f"w{i}" for i in range(120)]
    family = []
    for i in range(60):  # one large group of near copies with edits in different places
        own = list(words)
        for j in range(1 + i % 5):
            own[(7 * i + 23 * j) % 120] = f"e{i}x{j}"
        family.append((5000 + i, " ".join(own)))
    rows = real[:80] + [(5000 - 1, " ".join(words))] + family
    got = minhash.near_duplicates(Scratch(spark, "t4"), docs_of(spark, rows), 3, 85)
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == linked(rows, 3, 85)


def test_minhash_odd(spark, odd):
    got = minhash.near_duplicates(Scratch(spark, "t4"), odd, 3, 85).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.component_id, r.kept))
    assert len(got) == len(ODD) and by[3] == {(0, False)} and by[1] == {(1, True)} and by[9] == {(5, False)} and by[13] == {(13, True)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 120)] + [(7, 7)]
    got = connected_components(Scratch(spark, "cc"), spark.createDataFrame(edges, "a long, b long"), "x")
    assert {r.id: r.component for r in got.collect()} == {i: 0 for i in range(31)} | {k: 100 for k in range(100, 120)}


def test_lines(spark):
    base = " ".join(f"word{i} thing{i}" for i in range(40))
    near = base.replace("word7 ", "wordx ")
    rows = [(1, f"{base}\nshort\nshort\n{base.upper()}"), (2, f"intro line of some words here\n{near}"), (3, None), (4, ""), (5, "short"), (6, "\n\n"), (2**40, f"{base}.\nnew text that stays as it is")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(Scratch(spark, "t9"), docs_of(spark, rows)).collect()}
    assert got[1] == (4, 1, f"{base}\nshort\nshort") and got[3] == (0, 0, None) and got[4] == (1, 0, "") and got[6] == (3, 0, "\n\n")
    assert got[2**40] == (2, 1, "new text that stays as it is")
    assert got[2] == (2, 1, "intro line of some words here")
    short = {r.doc_id: (r.n_removed, r.text) for r in lines.dedup_lines(Scratch(spark, "t9"), docs_of(spark, rows), least=1).collect()}
    assert short[1] == (2, f"{base}\nshort") and short[5] == (1, "") and short[6] == (0, "\n\n") and short[4] == (0, "")


def test_lines_odd(spark, odd):
    got = lines.dedup_lines(Scratch(spark, "t9"), odd)
    assert got.columns == [*odd.columns, "n_lines", "n_removed"] and got.count() == len(ODD)
    assert [r.n_removed for r in got.where("doc_id = 13").collect()] == [0, 0]


def test_line_columns_may_clash(spark):
    rows = [(1, "one two three four", "a", 5), (1, "one two three four", "b", 6), (2, "one two three four", "c", 7), (None, None, "d", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `row` string, gone int")
    got = lines.dedup_lines(Scratch(spark, "t9"), docs)
    assert got.columns == ["doc_id", "text", "row", "gone", "n_lines", "n_removed"]
    assert sorted((r["row"], r.gone, r.n_removed) for r in got.collect()) == [("a", 5, 0), ("b", 6, 0), ("c", 7, 1), ("d", 8, 0)]


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BYTE_BPE())
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_sequences(spark, odd, real):
    for rows in (real, sorted(((d, t) for d, t in ODD if d is not None), key=lambda r: (r[0], r[1] or ""))):
        scratch = Scratch(spark, "t5")
        starts = sequences.write_sequences(docs_of(spark, rows), f"{scratch.path}/f", BYTE_BPE(), length=64)
        got = sorted(tuple(r) for r in sequences.read_documents(spark, f"{scratch.path}/f", starts).collect())
        at, want = 0, []
        for (d, _), ids in zip(rows, ids_of([t for _, t in rows]), strict=True):
            x = np.array([*ids, 0], "<u4")
            want.append((d, at, len(x), zlib.crc32(x.tobytes())))
            at += len(x)
        assert got == sorted(want)
        shard = min(starts)
        f = sequences.SequenceFile(f"{scratch.path}/f/{shard:06d}.ids.arrow")
        ids, mask = f.sequence(0)
        assert len(ids) == len(mask) == 64 and mask[0]


def test_packing(spark, odd):
    got = packing.pack(Scratch(spark, "t6"), odd, BYTE_BPE(), most=64).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 64 for r in got)
    seven = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 7)
    x, at = np.array([*ids_of(["word " * 400])[0], 1], "<u4"), 0
    for start, n, crc in seven:
        assert start == at and crc == zlib.crc32(x[at : at + n].tobytes())
        at += n
    assert at == len(x) and packing.pieces(2048 * 2 + 5) == [2048, 2048, 4, 1]
    by = defaultdict(set)
    for r in got:
        by[r.length].add(r.sequence_id)
    assert all(max(v) - min(v) + 1 == len(v) for v in by.values())


def test_urls(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert sorted(map(tuple, urls.op2_urls(spark, SF).collect()), key=str) == sorted(con.sql(urls.OP2_SQL).fetchall(), key=str)
    cases = [(1, "http://A.Example.COM/en/7x?y#z"), (2, None), (3, "no host"), (4, "x://example.net/de/8"), (5, "http://notexample.com"), (6, "http://b.org/es/"), (6, "http://b.org/es/"), (7, "a://b?c://d/en/")]
    pages = spark.createDataFrame([(a, b, "h", "r") for a, b in cases], "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*urls.RULES, urls.RULES[0]], "host string, path string, verdict string")
    got = sorted((tuple(r) for r in urls.judge(pages, rules, 6, [len(x[1]) for x in urls.RULES]).collect()), key=str)
    assert got == sorted([(1, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "example.net", "/de/8", "example.net/de/8", "block"), (5, "notexample.com", "", None, "allow"), (6, "b.org", "/es/", "org/es/", "block"), (6, "b.org", "/es/", "org/es/", "block"), (7, "b", "", None, "allow")], key=str)


def test_fingerprints(spark, real):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs_of(spark, real), buckets=7).collect()}
    for i, (d, t) in enumerate(real):
        n, after = len(t or ""), real[(i + 1) % len(real)][1] or ""
        edited = (t or "")[: n - n // 2] + after[: n // 2]
        assert got[d].n_chars == n and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    same = defaultdict(set)
    for d, t in real:
        same[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert np.mean([r.near_edited for r in got.values()]) > 0.25 > np.mean([r.near_next for r in got.values()])


def test_fingerprints_odd(spark, odd):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    alone = fingerprints.fingerprints(docs_of(spark, [(5, P * 4)])).first()
    assert alone.near_next == 1.0


def test_pieces(spark, odd):
    rows = pieces.sampled(odd, PIECES(), ids=True).collect()
    assert len(rows) == len(ODD) and all(r.lossless for r in rows)
    assert len({tuple(r.ids) for r in rows if r.doc_id == 13}) == 1
    assert rows == pieces.sampled(odd.repartition(3), PIECES(), ids=True).orderBy("doc_id").collect() or sorted(map(str, rows)) == sorted(map(str, pieces.sampled(odd.repartition(3), PIECES(), ids=True).collect()))
    lattice = pieces.Lattice(PIECES(), alpha=0.3)
    weight = dict(zip(lattice.ids.tolist(), lattice.weights.tolist()))
    text = {lattice.bytes_of[i].decode(): i for i in weight}

    def ways(s):
        if not s:
            yield (), 0.0
        for k in range(1, len(s) + 1):
            if s[:k] in text:
                for rest, x in ways(s[k:]):
                    yield (text[s[:k]], *rest), x + weight[text[s[:k]]]

    p = {a: math.exp(x) for a, x in ways("that")}
    drawn = Counter(tuple(lattice.encode(["that"], [k])[0].tolist()) for k in range(2000))
    assert set(drawn) <= set(p) and all(abs(p[a] / sum(p.values()) - drawn[a] / 2000) < 0.06 for a in p)


def test_toxicity(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in toxicity.op8_toxicity(spark, sf).collect()}
    known = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d in got)
    held = [(got[d].score, y) for d, y in known if got[d].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8
    assert np.mean([s >= 0.7 for s in bad]) < 0.05


def test_toxicity_odd(spark, odd):
    labels = spark.createDataFrame([(0, 1, 5), (3, 0, 5), (3, None, 5), (5, 1, 5)], "doc_id long, toxic int, text int")
    got = toxicity.toxicity(Scratch(spark, "t8"), odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.toxicity(Scratch(spark, "t8"), odd, labels.where("false")).collect()
    assert all(r.predicted == 0 for r in none)


def test_search(spark, real):
    rows = real[:120]
    count = {d: Counter((t or "").encode().lower().split()) for d, t in rows}
    size = {d: sum(c.values()) for d, c in count.items()}
    avg = sum(size.values()) / len(rows)
    df = Counter(w for c in count.values() for w in c)
    idf = {w: math.log(1 + (len(rows) - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    old, bm25.SHARD, bm25.BLOCK = (bm25.SHARD, bm25.BLOCK), 50, 4
    try:
        found = defaultdict(list)
        docs = docs_of(spark, rows)
        for r in bm25.search(Scratch(spark, "t3"), docs, docs.where("doc_id % 20 = 0"), 5).orderBy("rank").collect():
            found[r.query_id].append((r.doc_id, r.score))
    finally:
        bm25.SHARD, bm25.BLOCK = old
    for q in found:
        want = sorted(((-sum(n * idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[d] / avg)) for w, n in count[q].items() if w in c), d) for d, c in count.items()))[:5]
        assert [round(-x, 6) for x, _ in want] == [round(s, 6) for _, s in found[q]]


def test_search_odd(spark, odd):
    got = bm25.search(Scratch(spark, "t3"), odd, odd, 3).collect()
    assert {r.query_id for r in got} == {0, 3, 4, 5, 6, 7, 9, 12, 13} and all(1 <= r.rank <= 3 and r.score > 0 for r in got)


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for df in (
        suffixes.remove_repeats(Scratch(spark, "e"), none), minhash.near_duplicates(Scratch(spark, "e"), none), lines.dedup_lines(Scratch(spark, "e"), none),
        packing.pack(Scratch(spark, "e"), none, BYTE_BPE()), fingerprints.fingerprints(none), pieces.sampled(none, PIECES()), toxicity.toxicity(Scratch(spark, "e"), none, labels), bm25.search(Scratch(spark, "e"), none, none),
        urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "host string, path string, verdict string"), 0, []),
    ):
        assert df.count() == 0
    assert sequences.write_sequences(none, f"{Scratch(spark, 'e').path}/f", BYTE_BPE()) == {}


def test_pipeline(spark):
    import corpus_pipeline

    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, Scratch(spark, "p").save(stage(spark, docs, SF), "x")
        assert docs.columns == before.columns and 0 < docs.count() <= before.count(), name
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == docs.count()
    assert sorted(queries.QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate("fingerprints urls search minhash sequences packing pieces toxicity lines suffixes".split(), 1))
