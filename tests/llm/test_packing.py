"""Packing against a sequential deficit round-robin."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tokenlake.llm import op07_packing as P
from tokenlake.llm import op09_token_counts as K
from tokenlake.llm.packed import NULL_ID

ENC = K.encoding(K.read_ranks())


def n_tokens(text):
    return len(ENC.encode_ordinary(text or ""))


def queue_order(docs):
    """Rows (doc_id, source, n) of each source in the order of its queue."""
    return [(r["doc_id"], r["source"], r["n"]) for r in P.queues(docs).orderBy("source", F.xxhash64("doc_id", "key"), "doc_id", "key").collect()]


def simulate(rows, weights, window):
    """Documents in the order in which the round-robin serves them, and the rounds."""
    out = []
    for tier in (0, 1):
        queue, weight = {}, {}
        for d, s, n in rows:
            if (weights.get(s, 0) > 0) == (tier == 0):
                queue.setdefault(s, []).append((d, s, n))
                weight[s] = weights[s] if tier == 0 else 1
        total, deficit = sum(weight.values()), dict.fromkeys(queue, 0)
        while queue:
            for s in sorted(queue, key=lambda s: (s is not None, s or "")):
                deficit[s] += window * weight[s]  # in parts of 1 / total
                while queue[s] and queue[s][0][2] * total <= deficit[s]:
                    doc = queue[s].pop(0)
                    deficit[s] -= doc[2] * total
                    out.append(doc)
                if not queue[s]:
                    del queue[s]
    return out


def cut(served, window):
    out, at = [], 0
    for d, s, n in served:
        k = 0
        while k < n:
            size = min(n - k, window - (at + k) % window)
            out.append(((at + k) // window, s, None if d == NULL_ID else d, k, size))
            k += size
        at += n
    return sorted(out, key=repr)


def made(rnd, n, sources):
    return [(i, " ".join(rnd.choice(["word", "Größe", "x", "don't", "12"]) for _ in range(rnd.choice([1, 5, 30, rnd.randrange(1, 400)]))), rnd.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_pieces_equal_simulation(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "a", "a", "a", "b", "c", "d"]
    rows = made(rnd, 120, sources)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    window = rnd.choice([16, 64, 200])
    weights = {s: rnd.choice([0, 1, 2, 5, 100]) for s in (None, "a", "b", "c")}
    got = sorted(map(tuple, P.packed(docs, window, weights).collect()), key=repr)
    assert got == cut(simulate(queue_order(docs), weights, window), window)


def test_default_weights_equal_simulation(spark):
    rnd = random.Random(9)
    rows = made(rnd, 150, ["a", "a", "a", "b", "c"])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + n_tokens(t)
    weights = {s: max(1, round(P.SCALE * (n / max(total.values())) ** P.ALPHA)) for s, n in total.items()}
    assert sorted(map(tuple, P.packed(docs, 128).collect()), key=repr) == cut(simulate(queue_order(docs), weights, 128), 128)


def test_windows_hold_the_target(spark):
    rnd = random.Random(1)
    rows = [(i, "w " * rnd.randrange(1, 60), f"s{rnd.choice([0, 0, 0, 1, 2])}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    weights, window = {"s0": 1, "s1": 2, "s2": 5}, 256
    out = P.packed(docs, window, weights).toPandas()
    fill = out.groupby("window_id")["n_tokens"].sum()
    assert (fill.iloc[:-1] == window).all() and fill.iloc[-1] <= window and list(fill.index) == list(range(len(fill)))
    last = out.groupby("source")["window_id"].max().min()
    mix = out[out["window_id"] < last].pivot_table(index="window_id", columns="source", values="n_tokens", aggfunc="sum", fill_value=0)
    assert len(mix) > 5
    for s, w in weights.items():
        # what a window owes is paid in the next ones: never off by more than a round and a document
        assert (mix[s].cumsum() - window * w / 8 * (mix.index + 1)).abs().max() <= window * w / 8 + 130
    # documents are whole but for the ends of windows
    assert len(out) <= len(rows) + len(fill)


def test_windows_have_their_tokens(spark):
    rnd = random.Random(2)
    rows = made(rnd, 60, ["a", "b", None]) + [(7, "twice the same", "a"), (7, "twice the same", "a"), (None, "no id", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    text = {}
    for d, t, _ in rows:
        text.setdefault(d, []).append(t)
    want = {}
    for w, s, d, start, n in sorted(map(tuple, P.packed(docs, 50).collect()), key=repr):
        want.setdefault(w, []).append((s, d, start, n))
    got = {r["window_id"]: r["ids"] for r in P.filled(docs, 50).collect()}
    assert set(got) == set(want) and all(len(got[w]) == sum(p[3] for p in want[w]) for w in want)
    whole = [i for w in sorted(got) for i in got[w]]
    served = simulate(queue_order(docs), {s: max(1, round(P.SCALE * (x / max(sizes(rows).values())) ** P.ALPHA)) for s, x in sizes(rows).items()}, 50)
    at = 0
    for d, _, n in served:
        assert ENC.decode(whole[at : at + n]) in text[None if d == NULL_ID else d]
        at += n
    assert at == len(whole)


def sizes(rows):
    out = {}
    for _, t, s in rows:
        out[s] = out.get(s, 0) + n_tokens(t)
    return out


def test_defined_cases(spark):
    long = "w " * 10_000
    rows = [(1, None, "a", 1), (2, "", "a", 2), (None, "x y", None, 3), (4, "one two three", "b", 4), (4, "one two three", "b", 4), (5, long, "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int").withColumn("window_id", F.lit("clash")).withColumn("h", F.lit(0)).withColumn("at", F.lit(0))
    out = P.packed(docs, 100).toPandas()
    assert out.columns.tolist() == ["window_id", "source", "doc_id", "doc_start", "n_tokens"]
    assert out["n_tokens"].sum() == sum(n_tokens(t) for _, t, _, _ in rows)
    assert out[out["doc_id"] == 4]["n_tokens"].sum() == 2 * n_tokens("one two three")
    assert out[out["source"].isna()]["n_tokens"].sum() == n_tokens("x y") == out[out["doc_id"].isna()]["n_tokens"].sum()
    assert not set(out["doc_id"].dropna()) & {1, 2}
    assert P.packed(docs.limit(0)).collect() == [] and P.filled(docs.limit(0)).collect() == []
    zero = P.packed(docs, 100, {"b": 0, "c": 1}).toPandas()
    assert zero[zero["source"] == "b"]["window_id"].min() >= n_tokens(long) // 100


def test_long_texts_are_tokenized_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    monkeypatch.setattr(K, "PIECE", 1000)
    docs = spark.createDataFrame([(1, text, "a")], "doc_id long, text string, source string")
    assert P.packed(docs, 1 << 30).first()["n_tokens"] == n_tokens(text)


def test_many_sources(spark):
    docs = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("three words here").alias("text"), F.concat(F.lit("host"), "id").alias("source"))
    t = time.time()
    out = P.packed(docs).agg(F.sum("n_tokens"), F.count("*")).first()
    assert out[0] == 100_000 * n_tokens("three words here") and time.time() - t < 60


def test_large_source_tables_take_the_join(spark, monkeypatch):
    rows = made(random.Random(4), 60, ["a", "b", None])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(tuple, P.packed(docs, 64).collect()), key=repr)
    monkeypatch.setattr(P, "MAX_BROADCAST", 0)
    monkeypatch.setattr(P, "RANGE_ROWS", 7)
    assert sorted(map(tuple, P.packed(docs, 64).collect()), key=repr) == want
