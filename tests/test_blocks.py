"""The distributed trainer's blocks, and dictionaries that the driver does not hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlake.operators import train


def learnt(words, size):
    return train.learn([(w.encode(), n) for w, n in words.items()], size).merges


@pytest.mark.parametrize(("seed", "table", "block"), [(0, 1 << 22, 1 << 19), (1, 1 << 22, 8), (2, 1, 8)])
def test_blocks_learn_the_same(spark, monkeypatch, seed, table, block):
    monkeypatch.setattr(train, "TABLE", table)
    monkeypatch.setattr(train, "BLOCK", block)
    monkeypatch.setattr(train, "WRITE_EVERY", 5)
    monkeypatch.setattr(train, "PAIRS_A_JOB", 6)
    rnd = random.Random(seed)
    words = {"".join(rnd.choices("abcdefé", k=rnd.randrange(1, 9))): rnd.randrange(1, 1 << 30) for _ in range(200)} | {"aaaaaaa": 1 << 40}
    rows = spark.createDataFrame(list(words.items()), "chunk string, n long")
    assert train.learn_distributed(rows, 256 + 40).merges == learnt(words, 256 + 40)


def test_certain_pairs_are_merged_in_this_order():
    assert train.certain([(1, 2, 9), (1, 3, 8), (4, 2, 7), (5, 1, 6)], 9, True) == [(1, 2, 9), (1, 3, 8), (4, 2, 7)]
    assert train.certain([(1, 2, 9), (3, 4, 8), (5, 1, 8)], 9, True) == [(1, 2, 9)]
    assert train.certain([(1, 2, 9), (3, 4, 8), (3, 5, 7)], 9, False) == [(1, 2, 9), (3, 4, 8)]
    assert train.certain([(1, 1, 9), (3, 4, 8)], 9, True) == [(1, 1, 9)]
    assert train.certain([(1, 2, 9), (3, 4, 8)], 1, True) == [(1, 2, 9)]
    rnd = random.Random(5)
    for _ in range(300):
        words = {tuple(rnd.choices(range(6), k=rnd.randrange(2, 6))): rnd.randrange(1, 6) for _ in range(8)}
        count = {}
        for w, n in words.items():
            for p in zip(w, w[1:]):
                count[p] = count.get(p, 0) + n
        ranked = sorted(((*p, n) for p, n in count.items()), key=lambda x: (-x[2], x[:2]))
        sure = train.certain(ranked, 9, True)
        assert [m[:2] for m in train.learn([(bytes(w), n) for w, n in words.items()], 256 + len(sure)).merges] == [s[:2] for s in sure if s[2] > 1]


def test_runs_merge_every_second_place():
    end = int(train.END)
    ids = np.array([1, 1, 1, end, 1, 1, 1, 1, end, 2, 1, 1, end], np.uint32)
    assert train.joined(ids, 1, 1, 9).tolist() == [9, 1, end, 9, 9, end, 2, 9, end]


def test_the_driver_does_not_take_a_large_dictionary(spark, monkeypatch):
    docs = spark.range(50).select(F.concat_ws(" ", F.lit("abcab"), F.hex("id"), F.lit("cab")).alias("text"))
    want = train.train(docs, 262, distributed=False).merges
    monkeypatch.setattr(train, "MAX_LOCAL", 3)
    monkeypatch.setattr(train, "learn", lambda *_: pytest.fail("the driver learns"))
    assert train.train(docs, 262, distributed=False).merges == train.train(docs, 262).merges == want
