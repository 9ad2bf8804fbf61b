"""Work on whole tables in pieces of bounded size: encoding, malformed bytes."""

import random

import pyarrow as pa
import pytest

from tokenlake.functions import arrays as A
from tokenlake.functions import binary as B
from tokenlake.model import Model
from tokenlake.operators import codec
from tokenlake.plans import registry


@pytest.mark.parametrize("raw", [False, True])
def test_ids_leave_in_pieces(spark, raw):
    text = "the then é 1 " * 50_000
    own = text.encode() if raw else text
    rows = pa.array([own, None, "" if not raw else b"", own, own])
    model = registry.fixed_model()
    out = list(codec.encode_udf(model, spark.range(1), raw=raw).func(iter([rows])))
    assert [len(x) for x in out] == [3, 1, 1]
    ids = pa.chunked_array(out).to_pylist()
    want = [i for c in B.split(text.encode()) for i in model.encode_chunk(c)]
    assert ids[0] == ids[3] == ids[4] == want and ids[1] is None and ids[2] == []


@pytest.mark.parametrize("raw", [False, True])
def test_every_way_to_encode(spark, raw):
    texts = ["the then the", "é ü", "", None, "x" * 200 + " the " + "then " * 9]
    rows = pa.array([t.encode() if raw and t is not None else t for t in texts])
    fixed = registry.fixed_model()
    for model in (fixed, Model(fixed.tokens, fixed.merges), Model(), Model(fixed.tokens)):
        out = pa.chunked_array(list(codec.encode_udf(model, spark.range(1), raw=raw).func(iter([rows])))).to_pylist()
        assert out == [None if t is None else [i for c in B.split(t.encode()) for i in model.encode_chunk(c)] for t in texts]


def test_damage_in_raw_bytes(spark):
    model, data = registry.fixed_model(), b"the \xff then \xc0\xaf the"
    out = list(codec.encode_udf(model, spark.range(1), raw=True).func(iter([pa.array([data])])))[0].to_pylist()[0]
    assert out == [i for c in B.split(data) for i in model.encode_chunk(c)] and model.decode(out) == data


def test_long_texts_are_cut_between_chunks(monkeypatch):
    model, text = registry.fixed_model(), "the then  and that " * 30
    whole = [i for part in codec._compiled(model)(text) for i in part]
    monkeypatch.setattr(codec, "PIECE", 10)
    parts = list(codec._compiled(model)(text))
    assert len(parts) > 20 and [i for part in parts for i in part] == whole


def test_malformed_bytes_by_arrays():
    rnd = random.Random(1)
    parts = [b"a", b"1", b" ", b"\xc3\xa9", b"\xe2\x82\xac", b"\xf0\x9f\x98\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\x80", b"\xff", b"\xe2\x82", b"\xf0\x9f", b"\xc4", b".", b"\xef\xbf\xbd", b"\xf8\x88\x80", b"\xe2\x80\x80", b"\xe4\xb8\x80"]
    for _ in range(200):
        data = [None if rnd.random() < 0.1 else b"".join(rnd.choices(parts, k=rnd.randrange(9))) for _ in range(rnd.randrange(9))]
        column = pa.array([b"\xe2\x82", *data], pa.binary()).slice(1)
        assert B.chunks(column).to_pylist() == [None if x is None else B.split(x) for x in data]
        assert B._lengths(column).to_pylist() == [None if x is None else B.length(x) for x in data]
    assert [len(p) for p in A.pieces(pa.array(["abc", None, "d" * 9, "e"]), 4)] == [2, 1, 1]


def test_native_rules_run_once_a_text(spark):
    rows = spark.createDataFrame([(1, "the then  the,the\n1the é"), (2, ""), (3, None), (4, "t h the")], "doc_id long, text string")
    native = codec.encode_native(rows, registry.fixed_model())
    assert {tuple(r) if r[1] is None else (r[0], tuple(r[1])) for r in native.collect()} == {tuple(r) if r[1] is None else (r[0], tuple(r[1])) for r in codec.encode(rows, registry.fixed_model()).collect()}
    plan = native._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten" not in plan  # each chunk by itself
