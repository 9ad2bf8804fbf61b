"""Line dedup against brute force."""

import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenlake.llm import op04_lines as L


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, least):
    spots = sorted({(d, i, line) for d, t in rows for i, line in enumerate((t or "").split("\n")) if len(line) >= least or line.strip()}, key=lambda x: x[:2])
    out = []
    for k, (d, i, line) in enumerate(spots):
        at = next((s for s in spots[:k] if s[2] == line or (min(len(s[2]), len(line)) >= least and within_one(s[2], line))), None)
        if at:
            out.append((d, i, at[0], at[1], int(at[2] != line)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abé ü€😀") for _ in range(rnd.randrange(3, 70))) for _ in range(12)]

    def edit(s):
        i, c = rnd.randrange(len(s) + 1), rnd.choice("abx😀")
        return rnd.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s, edit(s) if rnd.random() < 0.3 else s])

    rows = [(i, "\n".join(edit(rnd.choice(base)) for _ in range(rnd.randrange(6)))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, L.report(docs, 3).collect())) == brute(rows, 3)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=1, max_size=90), st.data())
def test_neighbours_share_a_block_deletion(a, data):
    i = data.draw(st.integers(0, len(a)))
    b = data.draw(st.sampled_from([a[:i] + "c" + a[i:], a[:i] + a[i + 1 :], a[:i] + "c" + a[i + 1 :]]))
    lines = L.Lines(["\n".join([a, b])], 0)
    keys = [set(L.block_variants(lines, np.array([k]))[1].tolist()) for k in range(2)]
    assert keys[0] & keys[1]
    assert max(map(len, keys)) <= 40


def test_defined_cases(spark):
    line = "a line of more than twenty characters"
    rows = [(1, line + "\nshort\n" + line, 5, "x"), (2, None, None, "y"), (2, "", 0, None), (None, line.replace("more", "mora"), 1, "n"), (3, line + "\n" + line[:-1] + "\nown words that nobody else has", 9, "z"), (3, line + "\n" + line[:-1] + "\nown words that nobody else has", 9, "z"), (4, "short\nshort", 11, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, line_no string")
    got = sorted(map(tuple, L.report(docs).collect()))
    assert got == [(1, 0, None, 0, 1), (1, 2, None, 0, 1), (3, 0, None, 0, 1), (3, 1, 1, 0, 1), (4, 0, 1, 1, 0), (4, 1, 1, 1, 0)]
    out = L.deduplicated(docs)
    assert out.columns == docs.columns
    assert out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    kept = sorted(map(tuple, out.collect()), key=repr)
    own = "own words that nobody else has"
    assert kept == sorted([(1, "short", 5, "x"), (2, None, None, "y"), (2, "", 0, None), (None, rows[3][1], 1, "n"), (3, own, len(own), "z"), (3, own, len(own), "z"), (4, "", 0, "s")], key=repr)
    assert sorted(r["doc_id"] or 0 for r in L.deduplicated(docs, emptied=False).collect()) == [0, 1, 2, 2, 3, 3]
    assert L.report(docs.limit(0)).collect() == [] and L.deduplicated(docs.limit(0)).collect() == []


def test_very_long_line(spark):
    rnd = random.Random(2)
    text = "".join(rnd.choices("abcdefgh ", k=300_000))
    docs = spark.createDataFrame([(1, text), (2, text[:1000] + "Z" + text[1000:]), (3, text[:5] + "ZZ" + text[5:])], "doc_id long, text string")
    assert [tuple(r) for r in L.report(docs).collect()] == [(2, 0, 1, 0, 1)]


def test_many_candidates_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_BROADCAST", 0)
    rows = [(i, "the same line with number %d here\nunique %s" % (i, "xyz" * i)) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, L.report(docs).collect())) == brute(rows, L.MIN_CHARS)


def test_equal_lines_of_every_length(spark):
    short, blank = "Read more", " \t\u00a0\r"
    rows = [(1, f"{short}\n\n{blank}\nx"), (2, f"{short}\n\n{blank}\nRead mora\nx"), (3, f"{' ' * 25}\n{' ' * 25}\nRead mor")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, L.report(docs).collect())) == [(2, 0, 1, 0, 0), (2, 4, 1, 3, 0), (3, 1, 3, 0, 0)]
    left = {r["doc_id"]: r["text"] for r in L.deduplicated(docs).collect()}
    assert left == {1: rows[0][1], 2: f"\n{blank}\nRead mora", 3: f"{' ' * 25}\nRead mor"}


def test_pipeline_drops_short_repeats(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "Share this\nfirst"), (2, "second\nShare this")], "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "")
    assert sorted(map(tuple, got.collect())) == [(1, "Share this\nfirst"), (2, "second")]


def test_lines_with_equal_polynomial_hashes_stay(spark):
    """Thue-Morse strings and their complements collide modulo 2**64, whatever the base."""
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    assert len(set(L.Lines([a, b], 0).hash.tolist())) == 1
    docs = spark.createDataFrame([(1, a), (2, b), (3, b)], "doc_id long, text string")
    assert [tuple(r) for r in L.report(docs).collect()] == [(3, 0, 2, 0, 0)]
    assert sorted(map(tuple, L.deduplicated(docs).collect())) == [(1, a), (2, b), (3, "")]


def test_many_dropped_lines_are_linear(spark):
    docs = spark.createDataFrame([(1, "the same line over and over again\n" * 80_000)], "doc_id long, text string")
    t = time.time()
    assert [r["text"] for r in L.deduplicated(docs).collect()] == ["the same line over and over again\n"]
    assert time.time() - t < 40


def test_smallest_doc_id_is_not_null(spark):
    docs = spark.createDataFrame([(-(1 << 63), "x y"), (None, "x y"), (5, "x y")], "doc_id long, text string")
    got = sorted(map(tuple, L.report(docs).collect()), key=str)
    assert got == sorted([(None, 0, -(1 << 63), 0, 0), (5, 0, -(1 << 63), 0, 0)], key=str)


def test_choosing_lines_does_not_sort_the_candidates_again():
    """Each piece of 256 KB looks its lines up among all candidates, which grow with the corpus."""
    rnd = np.random.default_rng(1)
    known = np.sort(rnd.integers(0, 1 << 64, 1 << 21, dtype=np.uint64))
    h = np.concatenate([known[::4096], rnd.integers(0, 1 << 64, 500, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)])
    assert (L.among(h, known) == np.isin(h, known)).all()
    assert not L.among(h, known[:0]).any()
    t = time.process_time()
    for _ in range(200):
        L.among(h, known)
    fast = time.process_time() - t
    t = time.process_time()
    for _ in range(2):
        np.isin(h, known)
    assert fast < 20 * (time.process_time() - t)


def test_shuffle_files_of_the_first_round_go_before_the_second(spark, monkeypatch):
    from pathlib import Path

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    stored = lambda: {p for d in dirs for p in Path(d).rglob("shuffle_*.data")}
    candidates, exchange, new, left = L.candidates, L.packed.exchange, set(), []

    def first_round(*a):
        before = stored()
        out = candidates(*a)
        new.update(stored() - before)
        return out

    def any_round(*a):
        end = time.time() + 10
        while new & stored() and time.time() < end:
            time.sleep(0.2)
        left.append(len(new & stored()))
        return exchange(*a)

    monkeypatch.setattr(L, "candidates", first_round)
    monkeypatch.setattr(L.packed, "exchange", any_round)
    docs = spark.createDataFrame([(i, f"a line of many characters, number {i}") for i in range(50)], "doc_id long, text string")
    assert L.report(docs).count() > 0
    assert new and left == [0, 0]
