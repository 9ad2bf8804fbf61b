"""Substring dedup and suffix index against brute force."""

import random
import re

import numpy as np
import pytest

from tokenlake.llm import op01_substring, op08_suffix, spans

WIDTH, GRAM = 6, 3


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, width, order):
    """Maximal spans of each document, and the words in them that later windows cover."""
    seen = {}
    docs = sorted(set(rows), key=order)
    copies = {r: rows.count(r) for r in docs}
    for r in docs:
        w = words(r[1])
        for s in range(len(w) - width + 1):
            seen.setdefault(tuple(w[s : s + width]), []).append((r, s))
    out = []
    for r in docs:
        w = words(r[1])
        cover, late = set(), set()
        for s in range(len(w) - width + 1):
            at = seen[tuple(w[s : s + width])]
            if len(at) > 1 or copies[r] > 1:
                cover.update(range(s, s + width))
                if at[0] != (r, s) or copies[r] > 1:
                    late.update(range(s, s + width))
        while cover:
            a = b = min(cover)
            while b in cover:
                cover.discard(b)
                b += 1
            out.append((r[0], a, b - a, sum(a <= x < b for x in late)))
    return sorted(out, key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = ["The", "été", "b", "c", "dd", "e1", "f", "größe"]
    passages = [" ".join(rnd.choice(vocab) for _ in range(12)) for _ in range(3)]
    rows = []
    for i in range(25):
        text = " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(30)))
        if rnd.random() < 0.5:
            text += ",  " + rnd.choice(passages).upper().replace("É", "é").replace("Ö", "ö").replace("SS", "ß") + "!\n" + rnd.choice(vocab)
        rows.append((i, text))
    rows += [(30, "a " * 40), (31, "a b " * 20), (32, ""), (33, "x"), (34, rows[3][1]), (35, rows[3][1])]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, op01_substring.repeated(docs, WIDTH, GRAM).collect()), key=repr)
    assert got == brute(rows, WIDTH, lambda r: r[0])
    got = sorted(map(tuple, op08_suffix.matches(docs, WIDTH, GRAM).collect()), key=repr)
    assert got == brute(rows, WIDTH, lambda r: (r[0] % 8, r[0]))


def test_defined_cases(spark):
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, None, "x"), (1, "", "x"), (None, long, "y"), (7, long + " tail", "z"), (9, long[:10], "z"), (5, "q r s t u v", "k"), (5, "q r s t u v", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start_word string")
    for f in (op01_substring.repeated, op08_suffix.matches):
        got = sorted(map(tuple, f(docs, WIDTH, GRAM).collect()), key=repr)
        assert got == [(5, 0, 6, 6), (7, 0, 300, 300), (None, 0, 300, 0)]
        assert f(docs.limit(0), WIDTH, GRAM).collect() == []
        assert f(docs.limit(0), WIDTH, GRAM).columns == ["doc_id", "start_word", "n_words", "removable_words"]


def test_very_long_text(spark):
    rnd = random.Random(5)
    text = " ".join(str(rnd.randrange(10**6)) for _ in range(200_000))
    passage = " ".join(text.split(" ")[150_000:150_080])
    docs = spark.createDataFrame([(1, text), (2, passage)], "doc_id long, text string")
    for f in (op01_substring.repeated, op08_suffix.matches):
        assert {(r["doc_id"], r["n_words"]) for r in f(docs).collect()} == {(1, 80), (2, 80)}


def test_sketch_never_underestimates(spark):
    rows = [(i, " ".join(random.Random(i % 40).choices("abcdefgh", k=60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tokenlake.llm import packed

    bitmap, bits = op01_substring.sketch(packed.identity(docs), WIDTH, GRAM)
    seen = np.unpackbits(np.frombuffer(bitmap, np.uint8), bitorder="little")
    import pyarrow as pa

    anchor = np.concatenate([spans.runs(pa.array([t]), WIDTH, GRAM)[0] for _, t in rows])
    h, n = np.unique(anchor, return_counts=True)
    for r, c in enumerate(op01_substring.cells(h[n > 1], bits)):
        assert seen[(c + np.uint64(r << bits)).astype(np.int64)].all()
    assert op01_substring.row_bits(0) == 16 and op01_substring.row_bits(10**15) == 29


def test_long_words_do_not_collide():
    from tokenlake.llm.words import text_buffer, word_hashes
    import pyarrow as pa

    a = "a"
    while len(a) < 4096:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    h = word_hashes(*text_buffer(pa.array([f"{a} {b} {a.upper()}"])))[0].tolist()
    assert h[0] == h[2] != h[1]
    for piece in (1 << 22, 100, 5000):
        assert word_hashes(*text_buffer(pa.array([f"x {a} {b} {a}"])), piece)[0].tolist()[1:] == [h[0], h[1], h[0]]


def family_spans(frames):
    """Maximal spans of the window spans of several batches."""
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return sorted(map(tuple, spans.report(out).collect()), key=repr)


def test_family_meets_an_index_of_an_earlier_run(spark, tmp_path):
    rows = corpus(7)
    path = f"{tmp_path}/index"
    order = {}
    found = []
    for b in range(5):
        part = [r for r in rows if r[0] % 5 == b]
        order.update({r: b for r in part})
        # each call opens the index anew, as another program would
        family = op08_suffix.Family(spark, path, 3, WIDTH, GRAM)
        found.append(family.add(spark.createDataFrame(part, "doc_id long, text string")))
        assert family.step == b + 1 and len(family.levels) <= 3
        sizes = [n.bit_length() for n, _ in family.levels]
        assert sizes == sorted(set(sizes), reverse=True)
        want = brute([r for r in rows if r[0] % 5 <= b], WIDTH, lambda r: (r[0] % 5, r[0]))
        assert family_spans(found) == want
    again = op08_suffix.Family(spark, path)
    assert (again.shards, again.width, again.gram, again.step) == (3, WIDTH, GRAM, 5)
    # an empty batch changes nothing; a batch of copies finds all and adds no entries
    before = list(again.levels)
    assert again.add(spark.createDataFrame([], "doc_id long, text string")).collect() == [] and again.levels == before
    copies = again.add(spark.createDataFrame([(100 + i, t) for i, t in rows if len(words(t)) >= WIDTH], "doc_id long, text string"))
    assert all(n == len(words(dict(rows)[d - 100])) == r for d, s, n, r in family_spans([copies]) if d >= 100)
    assert again.levels == before


def check_order(e, rows):
    """Entries in order of anchor and suffix, with the words of their texts; their number."""
    keys = [(int(r["anchor"]), e.words(i)[r["byte"] :]) for i, r in enumerate(e.rows)]
    assert keys == sorted(keys)
    for i, r in enumerate(e.rows):
        w = e.words(i).decode().split(" ")
        text = words(dict(rows)[int(r["doc"])])
        assert w[-1] == "" and w[:-1] == text[r["start"] : r["start"] + r["n"] + WIDTH - 1]
    return len(e.rows)


def test_entries_are_in_suffix_order(spark, tmp_path):
    rows = corpus(3)
    family = op08_suffix.Family(spark, f"{tmp_path}/index", 2, WIDTH, GRAM)
    for b in range(4):
        family.add(spark.createDataFrame([r for r in rows if r[0] % 4 == b], "doc_id long, text string"))
    paths = [p for _, p in family.levels]
    n = 0
    for path in paths:
        for shard in range(2):
            parts = op08_suffix.Shard([path], shard)
            assert all((parts.part(p).rows["anchor"] % 16 == p).all() for p in parts.packed)
            for e in map(parts.part, parts.packed):
                n += check_order(e, rows)
    assert n == sum(size for size, _ in family.levels)


@pytest.mark.parametrize("seed", range(5))
def test_pairs_and_sorted_windows_agree(seed):
    """Two entries by common words left and right, and by suffix order, against all windows."""
    import pyarrow as pa

    rnd = random.Random(seed)
    vocab = ["a", "b", "ab", "ba", "aa"]
    for _ in range(200):
        shared = [rnd.choice(vocab) for _ in range(rnd.randrange(4, 14))]
        texts = [" ".join([rnd.choice(vocab) for _ in range(rnd.randrange(5))] + shared + [rnd.choice(vocab) for _ in range(rnd.randrange(5))]) for _ in range(2)]
        e = op08_suffix.entries(pa.array(texts), np.arange(2), np.zeros(2, np.int64), 0, WIDTH, GRAM)
        for i in range(len(e.rows)):
            for j in range(i):
                if e.rows["anchor"][i] == e.rows["anchor"][j]:
                    w = [e.words(x).decode().split(" ")[:-1] for x in (i, j)]
                    want = {(a, b) for a in range(e.rows["n"][i]) for b in range(e.rows["n"][j]) if w[0][a : a + WIDTH] == w[1][b : b + WIDTH] and e.rows["at"][i] - a == e.rows["at"][j] - b}
                    found = op08_suffix.pair(e, i, j, WIDTH)
                    got = {(int(e.rows["at"][i]) - d, int(e.rows["at"][j]) - d) for d in range(found[1], found[0] + 1)} if found else set()
                    assert got == want
                    for g in op08_suffix.equal_windows(e, [i, j], WIDTH):
                        assert len({" ".join(e.words(x).decode().split(" ")[k : k + WIDTH]) for x, k in g}) == 1
