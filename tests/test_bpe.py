"""Training, models, encoding and decoding."""

import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenlake.functions import binary as B
from tokenlake.functions.text import PRETOKEN, Norm
from tokenlake.model import Config, Model, ModelError
from tokenlake.operators import codec, pairs, train
from tokenlake.tokenizer import Tokenizer

CORPORA = {
    "toy": ("aaabdaaabac " * 4, 270),
    "testdata": ("test test test data data data " * 3, 270),
    "merhaba": ("merhaba merhaba merhaba dünya dünya " * 5, 280),
    "stop": (("a" * 400 + " ") * 2, 400),
}


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def learnt(text, size):
    words = {}
    for c in B.split(text.encode()):
        words[c] = words.get(c, 0) + 1
    return train.learn(words.items(), size)


def by_recount(text, size):
    """The trainer's rules, naively: recount all pairs after each merge."""
    model, seqs = Model(), [list(c) for c in B.split(text.encode())]
    while len(model) < size:
        count = {}
        for s in seqs:
            for p in zip(s, s[1:]):
                count[p] = count.get(p, 0) + 1
        if not count:
            break
        (a, b), n = min(count.items(), key=lambda x: (-x[1], x[0]))
        if n < 2 or len(model.tokens[a] + model.tokens[b]) > 128:
            break
        new = model.add_merge(a, b)
        for k, s in enumerate(seqs):
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    out.append(new)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            seqs[k] = out
    return model


@pytest.mark.parametrize("name", CORPORA)
def test_trainers_agree(spark, name):
    text, size = CORPORA[name]
    want = by_recount(text, size).merges
    assert learnt(text, size).merges == want
    if name != "stop":
        assert train.train(docs(spark, text), size, distributed=True).merges == want
        assert train.train(docs(spark, text), size, distributed=False).merges == want


def test_known_merges():
    assert learnt(*CORPORA["toy"]).merges[:4] == [(97, 97, 256), (97, 98, 257), (256, 257, 258), (97, 99, 259)]
    m = learnt(*CORPORA["testdata"])
    assert len(m) == 262
    assert [i for c in B.split(b"test data") for i in m.encode_chunk(c)] == [261, 32, 260]
    m = learnt(*CORPORA["merhaba"])
    assert len(m) == 267
    assert m.encode_chunk(b"merhaba") == [261]
    assert [len(t) for t in learnt(*CORPORA["stop"]).tokens[256:]] == [2, 4, 8, 16, 32, 64, 128]


def test_ties_and_small_targets(spark):
    assert learnt("ba ba dc dc", 300).merges[0][:2] == (98, 97)
    assert train.train(docs(spark, "aa aa"), 100).merges == []
    assert len(train.train(docs(spark), 300)) == 256
    assert len(train.train(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), 300)) == 256


@settings(max_examples=60, deadline=None)
@given(st.text("ab c", max_size=60), st.integers(256, 275))
def test_fresh_models(text, size):
    m = learnt(text, size)
    assert m.merges == by_recount(text, size).merges
    assert len(m.merges) == len(m) - 256
    assert all(r == 256 + k for k, (_, _, r) in enumerate(m.merges))


@settings(max_examples=150, deadline=None)
@given(st.text("abc é", max_size=80), st.text("abc é1!", max_size=60), st.integers(256, 290))
def test_compiled_encoder_is_one_pass_by_rank(lesson, text, size):
    tiktoken = pytest.importorskip("tiktoken")
    m = learnt(lesson, size)
    assert m.learnt and m.is_fresh()
    encoder = tiktoken.Encoding("m", pat_str=PRETOKEN, mergeable_ranks={t: i for i, t in enumerate(m.tokens)}, special_tokens={})
    want = [i for c in B.split(text.encode()) for i in fold(m, c)]
    assert encoder.encode_ordinary(text) == want == [i for c in B.split(text.encode()) for i in m.encode_chunk(c)]


def fold(model, data):
    ids = list(data)
    for a, b, r in model.merges:
        out, i = [], 0
        while i < len(ids):
            if ids[i : i + 2] == [a, b]:
                out.append(r)
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
    return ids


def test_rank_order_of_foreign_models():
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"abd"]
    m = Model(tokens, [(256, 100, 257), (97, 98, 256)])
    assert m.encode_chunk(b"abd") == [256, 100] and not m.is_fresh()
    rnd = random.Random(3)
    for _ in range(200):
        rules = [(rnd.choice([97, 98, 256, 257]), rnd.choice([97, 98, 256, 257]), rnd.choice([256, 257])) for _ in range(6)]
        m = Model(tokens, rules)
        data = bytes(rnd.choice(b"ab") for _ in range(12))
        assert m.encode_chunk(data) == fold(m, data)


def test_pair_counts_overlap_and_merges_do_not(spark):
    state = spark.createDataFrame([("aaa", 2), ("x", 9), ("", 1)], "s string, n long")
    assert [tuple(r) for r in pairs.pair_counts(state).collect()] == [("aa", 4)]
    assert state.select(pairs.merge_pair(F.col("s"), "aa", "Z")).first()[0] == "Za"
    assert Model(merges=[(97, 98, 256)]).encode_chunk(b"ababcab") == [256, 256, 99, 256]
    table = spark.createDataFrame([(97, 98, 7), (99, 100, 3), (99, 99, 7)], "left_id int, right_id int, n long")
    assert tuple(pairs.best_pairs(table).first()) == (97, 98, 7)
    assert pairs.best_pairs(table.limit(0)).count() == 0


ROUND_TRIPS = ["", " ", "a", "  padded  ", "line\nbreak\r\n", "İstanbul'da ılık", "üöç €€", "😀🇹🇷", "evlerinizdekilerden", "mixed 123 ABC çok güzel!", "tekrar " * 300]


def test_round_trips(spark):
    model = learnt("güzel bir gün ve güzel bir ev " * 3, 300)
    model.config = Config(norm=Norm.NONE)
    rows = docs(spark, *ROUND_TRIPS)
    for encoded in (codec.encode(rows, model), codec.encode_native(rows, model)):
        got = {r["doc_id"]: bytes(r["bytes"]).decode() for r in codec.decode(encoded, model).collect()}
        assert got == dict(enumerate(ROUND_TRIPS))
    a = {r["doc_id"]: r["ids"] for r in codec.encode(rows, model).collect()}
    assert a == {r["doc_id"]: r["ids"] for r in codec.encode_native(rows, model).collect()}


def test_binary_round_trips(spark):
    model = learnt("abcabc abc " * 3, 280)
    data = [bytes(range(256)), bytes(i % 4 for i in range(128)), *(bytes([i]) for i in range(0, 256, 37))]
    rows = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "doc_id long, text binary")
    back = codec.decode(codec.encode(rows, model, raw=True), model)
    assert {r["doc_id"]: bytes(r["bytes"]) for r in back.collect()} == dict(enumerate(data))


def test_nulls_and_unknown_ids(spark):
    m = Model()
    assert codec.encode(spark.createDataFrame([(1, None)], "doc_id long, text string"), m).first()["ids"] is None
    rows = spark.createDataFrame([(1, [97, 999]), (2, [98]), (3, [-1]), (4, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["bytes"] for r in codec.decode(rows, m).collect()}
    assert got[1] is None and got[3] is None and bytes(got[2]) == b"b" and bytes(got[4]) == b""
    with pytest.raises(ModelError):
        m.decode([300])


def test_without_pretokenizing(spark):
    model = Model(config=Config(norm=Norm.NONE, pretokenize=False))
    model.add_merge(97, 32)
    assert codec.encode(docs(spark, "a a"), model).first()["ids"] == [256, 97]
    model.config = Config(norm=Norm.NONE)
    assert codec.encode(docs(spark, "a a"), model).first()["ids"] == [97, 32, 97]


def test_model_files(spark, tmp_path):
    m = learnt(*CORPORA["merhaba"])
    m.config = Config(300, Norm.LOWERCASE, False)
    back = Model.from_bytes(m.to_bytes())
    assert (back.tokens, back.merges, back.config) == (m.tokens, m.merges, Config())
    assert m.to_bytes()[:8] == b"PBKT" + struct.pack("<I", 1)
    m.save(spark, str(tmp_path / "m"))
    back = Model.load(spark, str(tmp_path / "m"))
    assert (back.tokens, back.merges, back.config) == (m.tokens, m.merges, m.config)
    data = m.to_bytes()
    for bad in (b"", b"XXXX" + data[4:], data[:4] + b"\2" + data[5:], data[:100], data[:-5], data[:16] + b"\1" + data[17:]):
        with pytest.raises(ModelError):
            Model.from_bytes(bad)
    with pytest.raises(ModelError):
        m.add_token(b"x" * 129)


def test_tokenizer_handle(spark, tmp_path):
    t = Tokenizer(spark, Config(290, Norm.NONE))
    for call in (lambda: t.encode_text("x"), lambda: t.decode_ids([1]), lambda: t.save("x"), t.vocab_size):
        with pytest.raises(ModelError):
            call()
    (tmp_path / "in.txt").write_text("bir ev iki ev güzel ev\nbir gün güzel gün\n" * 5)
    t.train_files(str(tmp_path / "in.txt"))
    with pytest.raises(ModelError):
        t.train(docs(spark, "x"))
    assert t.decode_ids(t.encode_text("güzel ev")) == "güzel ev".encode()
    assert t.encode_text("İ") != t.encode_text("I")
    assert len(t.encode_text("güzel")) < len("güzel".encode())
    t.save(str(tmp_path / "m.bpe"))
    u = Tokenizer(spark).load(str(tmp_path / "m.bpe"))
    assert u.config == Config()
    assert u.encode_text("güzel\n\nev") == u.encode_text("güzel ev")
    assert u.stats() == {"vocab_size": u.vocab_size(), "num_merges": u.vocab_size() - 256, "base_tokens": 256, "merged_tokens": u.vocab_size() - 256}
    assert u.token_to_id(u.token_bytes(256)) == 256 and u.token_bytes(10**6) is None and u.token_to_id(b"nope") is None
    r = u.coverage(docs(spark, "güzel ev", "")).first()
    assert r["bytes"] == 9 and r["bytes_per_token"] == 9 / r["tokens"]
