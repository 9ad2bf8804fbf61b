"""Command line, ingest of damaged text, line loader, encyclopedia minimum, code points, several merges a job."""

import random

import pytest
from pyspark.sql import functions as F

from tokenlake import cli
from tokenlake.functions import binary as B
from tokenlake.functions import text as T
from tokenlake.model import Model
from tokenlake.operators import clean, codec, train
from tokenlake.operators import pairs as P
from tokenlake.sources import files


@pytest.fixture
def one_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)


def test_command_line(spark, one_session, tmp_path, capfd):
    text, model, ids, back = (str(tmp_path / n) for n in ("t.txt", "m.bpe", "i.txt", "b.txt"))
    raw = 'merhaba "dünya"\tmerhaba\\ merhaba\n'.encode() * 4
    open(text, "wb").write(raw)
    assert cli.main(["train", "-i", text, "-o", model, "-v", "270", "-n", "wq"]) == 0
    capfd.readouterr()
    assert cli.main(["encode", "-m", model, "-i", text, "-o", ids]) == 0
    assert "tokens" in capfd.readouterr().err
    assert cli.main(["decode", "-m", model, "-i", ids, "-o", back]) == 0
    assert open(back, "rb").read() == raw.replace(b"\t", b" ").replace(b"\n", b" ")
    assert cli.main(["encode", "-m", model, "-i", text, "-s", "-o", ids]) == 0
    shown = open(ids).read().split("\n")
    assert '34\t"\\""' in shown and '92\t"\\\\"' in shown
    capfd.readouterr()
    open(ids, "w").write("no ids")
    assert cli.main(["decode", "-m", model, "-i", ids]) == 0
    assert "warning" in capfd.readouterr().err
    open(ids, "w").write("999999")
    assert cli.main(["decode", "-m", model, "-i", ids]) == 1
    assert cli.main(["train", "-i", text, "-o", model, "-v", "262", "-p"]) == 0


def test_unknown_tokens_show():
    show = codec.shown_tokens(Model())
    assert [show(i) for i in (65, 0xC4, 10, 300)] == ["A", "\\xC4", "\\n", "<UNK>"]


def test_large_files_are_rows(spark, tmp_path):
    raw = b"one two\r\n\n caf\xc3\xa9 \xff\xfe end\n  last"
    (tmp_path / "x.txt").write_bytes(raw)
    rows = files.text_rows(spark, str(tmp_path))
    assert "".join(r["text"] for r in rows.collect()) == raw.decode("utf-8", "replace") + "\n"
    whole = spark.createDataFrame([(raw.decode("utf-8", "replace") + "\n",)], "text string")
    chars = lambda d: {r["chunk"]: r["n"] for r in P.dictionary(d).collect() if r["chunk"].strip()}
    assert chars(rows) == chars(whole)


def test_damage_is_replaced(spark):
    data = [b"plain", b"\xc3\xa9", b"\xff\xfe", b"a\xe2\x82", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b""]
    rows = spark.createDataFrame([(bytearray(x),) for x in data], "b binary")
    assert [r[0] for r in rows.select(clean.repair(F.col("b"))).collect()] == [clean.repaired(x) for x in data]


def test_line_loader(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([" a ", "", "b", " \t", "c"])], "doc_id long, line_no int, line string")
    assert [r["line"] for r in files.loader_lines(rows, 4).orderBy("line_no").collect()] == ["a", "b"]


def test_encyclopedia_minimum(spark):
    rows = spark.createDataFrame([(1, "<doc id=1>"), (1, "short"), (2, "x" * 30), (2, "y" * 20), (2, ""), (None, "z" * 50)], "doc_id long, line string")
    assert sorted(r["line"] for r in files.wiki_documents(rows).collect()) == ["x" * 30, "y" * 20, "z" * 50]


def test_code_points(spark):
    codes = [0, 65, 0x7F, 0x80, 0x130, 0x7FF, 0x800, 0x20AC, 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF, 0x110000, -1]
    rows = spark.createDataFrame([(c,) for c in codes], "c int")
    assert [bytes(r[0]) for r in rows.select(T.encode_codepoint(F.col("c"))).collect()] == [B.encode_codepoint(c) for c in codes]


@pytest.mark.parametrize("seed", range(3))
def test_several_merges_a_job(spark, seed):
    rnd = random.Random(seed)
    words = [("".join(rnd.choices("abcdefghijkl", weights=range(12, 0, -1), k=rnd.randrange(1, 7))), rnd.randrange(1, 9)) for _ in range(60)]
    rows = spark.createDataFrame([(w, n) for w, n in dict(words).items()], "chunk string, n long")
    one = train.learn([(w.encode(), n) for w, n in dict(words).items()], 256 + 14)
    assert train.learn_distributed(rows, 256 + 14).merges == one.merges


def test_independent_pairs():
    assert train.independent([("ab", 9), ("cd", 8), ("ef", 7), ("ax", 6)], 9) == [("ab", 9), ("cd", 8), ("ef", 7)]
    assert train.independent([("ab", 9), ("cd", 8), ("be", 8)], 9) == [("ab", 9)]
    assert train.independent([("aa", 9), ("cd", 8)], 9) == [("aa", 9)]
    assert train.independent([("ab", 9), ("cd", 8)], 1) == [("ab", 9)]
