"""Decontamination, compression bands and token counts against direct computations."""

import random

import pytest
import zstandard

from tokenlake.llm import op03_decontaminate as D
from tokenlake.llm import op06_compression as C
from tokenlake.llm import op09_token_counts as K


def normal(t):
    import regex

    return regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).strip()


def brute_hits(docs, items, n):
    out = {}
    for d, t in docs:
        text = f" {normal(t)} "
        for i, b in set(items):
            for p in D.test_strings(normal(b), n):
                k = sum(text.startswith(f" {p} ", at) for at in range(len(text)))
                if k:
                    out[d, i] = out.get((d, i), 0) + k
    return out


@pytest.mark.parametrize("n", [2, 4, 8])
def test_hits_equal_brute_force(spark, n):
    rnd = random.Random(n)
    vocab = ["a", "Bé", "cc", "über", "x1", "größer", "verylongword"]
    make = lambda k: " ".join(rnd.choice(vocab) + rnd.choice(["", "", ",", "!\n"]) for _ in range(k))
    items = [(i, make(rnd.randrange(1, 14))) for i in range(12)] + [(3, "cc"), (50, None), (51, "..."), (52, "a a a a a a a a a")]
    docs = [(i, make(rnd.randrange(200))) for i in range(30)] + [(40, items[0][1].upper()), (41, None), (42, ""), (43, "a " * 50), (40, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["item_id"]): r["n_hits"] for r in D.contaminated(rows, bench, n).collect()}
    want = brute_hits(docs, [(i, t) for i, t in items if t], n)
    assert got == want
    clean = sorted(r["doc_id"] for r in D.decontaminate(rows, bench, n).collect())
    assert clean == sorted(d for d, t in docs if not brute_hits([(d, t)], [(i, b) for i, b in items if b], n))


def test_decontamination_cases(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x {item} y", "k"), (None, item.upper(), "k"), (2, None, None), (3, "", "z"), (4, "w " * 100_000 + item, "l")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(9, item), (9, item), (8, item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_hits"] for r in D.contaminated(docs, bench).collect()}
    assert got == {(d, i): 2 for d in (1, None, 4) for i in (8, 9)}
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]
    assert D.contaminated(docs, bench.limit(0)).collect() == [] and D.decontaminate(docs, bench.limit(0)).count() == 5
    assert D.contaminated(docs.limit(0), bench).collect() == [] and D.decontaminate(docs.limit(0), bench).collect() == []


def test_a_benchmark_too_large_is_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    bench = docs.withColumnRenamed("doc_id", "item_id")
    monkeypatch.setattr(D._normal_items, "__defaults__", (5,))
    with pytest.raises(ValueError, match="bytes"):
        D.decontaminate(docs, bench)


def test_small_matchers_find_the_same(spark, monkeypatch):
    rnd = random.Random(6)
    items = [(i, " ".join(rnd.choices("abcdefgh", k=12))) for i in range(20)]
    docs = [(i, " ".join(rnd.choices("abcdefgh", k=90)) + " " + items[i % 20][1]) for i in range(20)]
    monkeypatch.setattr(D, "MATCHER_BYTES", 60)
    assert len(D._matchers(items, 4)[0]) > 10
    got = {(r["doc_id"], r["item_id"]): r["n_hits"] for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4).collect()}
    assert got == brute_hits(docs, items, 4)


def test_items_without_id_are_searched(spark):
    item = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "own words")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, item), (7, item), (None, None)], "item_id long, text string")
    assert sorted(map(tuple, D.contaminated(docs, bench).collect()), key=str) == [(1, 7, 2), (1, None, 2)]
    assert [r["doc_id"] for r in D.decontaminate(docs, bench.filter("item_id is null")).collect()] == [2]


def test_compression_equals_direct_computation(spark):
    rnd = random.Random(1)
    prose = " ".join("".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(2, 9))) for _ in range(9000))
    texts = [None, "", "short", prose[:600], prose, "spam " * 400, prose[:3000] + "x" * 6000 + prose[:3000], "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(1500)), "é" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(4, prose)], "doc_id long, text string")
    out = {}
    for r in C.measured(rows).collect():
        out.setdefault(r["doc_id"], []).append(r)
    size = zstandard.ZstdCompressor(level=C.LEVEL)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        ratio = lambda x: len(x) / len(size.compress(x)) if x else 1.0
        parts = [ratio(raw[a:b]) for a, b in C.chunk_bounds(len(raw))]
        want = (len(raw), ratio(raw), min(parts), max(parts))
        for r in out[i]:
            assert (r["n_bytes"], r["ratio"], r["min_chunk_ratio"], r["max_chunk_ratio"]) == pytest.approx(want)
    verdicts = [out[i][0]["verdict"] for i in range(len(texts))]
    assert verdicts[:6] == ["ok", "ok", "ok", "ok", "ok", "repetitive"]
    assert verdicts[6] == "repetitive" and verdicts[8] == "repetitive"
    assert len(out[4]) == 2
    assert all(r["keep"] == (r["verdict"] == "ok") for rs in out.values() for r in rs)
    assert C.measured(rows.limit(0)).collect() == []
    clash = spark.createDataFrame([(1, "a" * 99, "x"), (2, "plain words here", "y")], "doc_id long, text string, verdict string")
    assert {r["doc_id"]: r["verdict"] for r in C.measured(clash).collect()} == {1: "repetitive", 2: "ok"}


@pytest.mark.parametrize("n", [0, 50, 100, 499, 500, 2000, 8000, 50_000, 10**9])
def test_every_length_has_a_band(n):
    band = [b for b in C.BANDS if b.least <= n][-1]
    assert C.verdict(n, band.low, band.chunk_low, band.chunk_high) == C.verdict(n, band.high, band.chunk_low, band.chunk_high) == "ok"
    assert C.verdict(n, band.high + 0.1, 2, 2) == C.verdict(n, 2, 2, band.chunk_high + 0.1) == "repetitive"
    assert C.verdict(n, band.low - 0.01, 1.5, 1.5) == C.verdict(n, (band.low + band.high) / 2, band.chunk_low - 0.01, 1.5) == "incompressible"


def test_chunks_cover_the_text():
    for n in (0, 1, 4095, 4096, 6143, 6144, 8192, 100_000):
        b = C.chunk_bounds(n)
        assert b[0][0] == 0 and b[-1][1] == n and all(x[1] == y[0] for x, y in zip(b, b[1:]))


TEXTS = ["Hello world, it's 2024!", "  spaces \n\n\tand tabs  ", "Größe über naïve cœur ½ x²", "日本語のテキスト", "😀😀 emoji", "", None, "don't we've I'LL", "a" * 500, "word " * 3000, "<|endoftext|>", "____ __a_", "\u0085 x\xa0y"]


def test_token_counts_equal_the_tokenizer(spark):
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 2)], "doc_id long, text string, n_tokens int").repartition(3)
    enc = K.encoding(K.read_ranks())
    want = {i: (len(enc.encode_ordinary(t or "")), len((t or "").encode())) for i, t in enumerate(TEXTS)}
    for top in (1 << 15, 3):
        got = K.token_counts(rows, top=top).collect()
        assert len(got) == len(TEXTS) + 1
        assert all((r["n_tokens"], r["n_bytes"]) == want[r["doc_id"]] for r in got)
        assert all(r["n_pretokens"] == len(K.splitter()(TEXTS[r["doc_id"]] or "")) for r in got)
    assert K.token_counts(rows.limit(0)).collect() == []


def test_quick_splitter_agrees():
    import regex

    find, full = K.splitter(), regex.compile(K.PATTERN).findall
    rnd = random.Random(2)
    for _ in range(500):
        t = "".join(rnd.choice("ab1 '\n\tst.,_²é½\xa0\x85ßÀ-") for _ in range(rnd.randrange(40)))
        assert find(t) == full(t)
        assert "".join(find(t)) == t


def test_pieces_split_alike():
    find = K.splitter()
    rnd = random.Random(4)
    for _ in range(3000):
        t = "".join(rnd.choice(["a", "bc", "1", " ", " ", "\n", "  ", "'s", ".", "é", "日", "\t", "\u00a0", "\x1c", "x y", "\n\n"]) for _ in range(rnd.randrange(30)))
        parts = list(K.pieces(t, size=5))
        assert "".join(parts) == t and [p for x in parts for p in find(x)] == find(t)


def test_the_worker_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(K, "CACHE", 3)
    enc = K.encoding(K.read_ranks())
    lengths = K.Lengths({" the": 1}, K.read_ranks(), K.PATTERN)
    for i in range(200):
        piece = f" w{i % 9}x"
        assert lengths[piece] == len(enc.encode_ordinary(piece)) and len(lengths) <= 6


def test_frequent_keeps_every_heavy_piece(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) + " heavy" * 20 for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = K.frequent(rows, keep=64, fan_in=2)
    assert " heavy" in found[:8] and len(found) <= 64 * 4
