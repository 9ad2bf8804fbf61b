"""Cleaning, inspection, metrics, sources, streaming, command line and the entry module."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tokenlake import cli
from tokenlake.model import Model
from tokenlake.operators import clean, codec, inspect, metrics
from tokenlake.plans import registry
from tokenlake.sources import files
from tokenlake.streaming import clean_stream, encode_stream, write_parquet

LONG = "güzel bir gün ve yeni bir ev "


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, line_no int, line string")


@pytest.mark.parametrize(("line", "out"), [("a​﻿b", "ab"), ("a\x07­b", "ab"), ("a \t  b", "a b"), (" 　a ", "a"), ("é", "é"), ("", ""), (None, None)])
def test_clean(spark, line, out):
    assert lines(spark, line).select(clean.clean(F.col("line"))).first()[0] == out


@pytest.mark.parametrize(("line", "score", "ok"), [("Hello there", 0.3, True), ("query", 0.24, False), ("güzel", 0.7, True), ("12345", 0.0, False), ("  ", 0.0, False), ("bir ve bu", 0.6, True)])
def test_language_score(spark, line, score, ok):
    r = lines(spark, line).select(clean.language_score(F.col("line")), clean.is_turkish(F.col("line"))).first()
    assert r[0] == pytest.approx(score) and r[1] is ok


def test_status_is_the_first_failed_rule(spark):
    rows = lines(spark, "x" * 19, "y" * 20, "z" * 10000, "z" * 10001, LONG, LONG.replace(" ", "  "), "9" * 30, "w" * 30, "x" * 19)
    got = {r["line_no"]: r["status"] for r in clean.judged(rows).collect()}
    assert got == {0: "too_short", 1: "kept", 2: "kept", 3: "too_long", 4: "kept", 5: "duplicate", 6: "not_turkish", 7: "not_turkish", 8: "too_short"}
    s = clean.summary(clean.judged(rows)).first().asDict()
    assert s == {"total": 9, "kept": 3, "too_short": 2, "too_long": 1, "not_turkish": 2, "duplicate": 1, "kept_percent": pytest.approx(100 / 3, abs=1e-5)}
    assert clean.judged(rows, sample=2).count() == 2
    assert clean.summary(clean.judged(rows.limit(0))).first()["total"] == 0


def test_inspection(spark):
    m = registry.fixed_model()
    vocab, rules = m.vocab_frame(spark), m.merges_frame(spark)
    assert inspect.length_histogram(vocab).orderBy("len").first()["bar"] == "#" * 40
    assert [r["rank"] for r in inspect.merge_listing(vocab, rules, 3).orderBy("rank").collect()] == [0, 1, 2]
    gap = Model(m.tokens[:260], m.merges[:10])
    assert "<265>" in {r["result"] for r in inspect.merge_listing(gap.vocab_frame(spark), gap.merges_frame(spark)).collect()}
    assert inspect.search(vocab, b"").count() == len(m) == inspect.dump(vocab).count()
    shown = {r["id"]: r["token"] for r in inspect.dump(vocab).collect()}
    assert [shown[b] for b in b'" \\\n\t\r'] == ['\\"', "·", "\\\\", "\\n", "\\t", "\\r"] and shown[255] == "\\xFF"
    found = inspect.lookup(spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"??"),)], "bytes binary"), vocab)
    assert {bytes(r["bytes"]): r["id"] for r in found.collect()} == {b"a": 97, b"??": None}


def test_metrics(spark):
    rows = spark.createDataFrame([("ab cd", [1, 2]), ("", [])], "text string, ids array<int>")
    r = metrics.fertility(rows).first()
    assert (r["total_tokens"], r["total_chars"], r["total_bytes"], r["total_words"], r["tokens_per_word"], r["bytes_per_token"]) == (2, 5, 5, 2, 1.0, 2.5)
    empty = metrics.unknown_rate(metrics.fertility(rows.limit(0))).first()
    assert (empty["total_tokens"], empty["tokens_per_word"], empty["unknown_rate"]) == (0, 0.0, 0.0)
    bands = spark.createDataFrame([(1.49,), (1.99,), (2.99,), (3.0,)], "x double").select(metrics.verdict(F.col("x"))).collect()
    assert [r[0] for r in bands] == ["excellent", "good", "moderate", "poor"]
    assert {r["winner"] for r in metrics.compare(metrics.fertility(rows), metrics.fertility(rows)).collect()} == {"ours"}
    words = metrics.word_analysis(rows)
    assert {r["winner"] for r in metrics.compare_words(words, words).collect()} == {"tie"}


def test_files(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_bytes(b"a\rb\n\nlast")
    assert [r["line"] for r in files.text_lines(spark, str(p)).collect()] == ["a\rb", "", "last"]
    assert [r["line"] for r in files.text_lines(spark, str(p), newline_only=False).collect()] == ["a", "b", "", "last"]
    assert files.whole_texts(spark, str(p)).first()["text"] == "a\rb\n\nlast"
    assert bytes(files.whole_bytes(spark, str(p)).first()["bytes"]) == p.read_bytes()
    assert files.file_sizes(spark, str(p)).first()["size"] == 9
    rows = lines(spark, '<doc id="1">', "</doc>", " ", "text")
    assert [r["line"] for r in files.wiki_lines(rows).collect()] == ["text"]
    docs = spark.createDataFrame([(1, "　 x "), (2, " \n"), (3, None)], "doc_id long, text string")
    assert [r["text"] for r in files.web_documents(docs).collect()] == ["x"]
    ids = spark.createDataFrame([("1,2 3x4 +5 -6",), ("",), (None,)], "t string").select(files.parse_ids(F.col("t")).alias("i")).collect()
    assert [r["i"] for r in ids] == [[1, 2, 3, 4, 5, -6], [], None]


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, "the hand\nthe hand"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
    m = registry.fixed_model()
    for name, df in (("enc", encode_stream(source(), m)), ("clean", clean_stream(source()))):
        write_parquet(df, str(tmp_path / name), str(tmp_path / f"{name}-cp")).awaitTermination(120)
    static = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "enc")).collect())) == sorted(map(str, codec.encode(static, m).collect()))
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 2


def test_command_line(spark, tmp_path, capsysbinary):
    text, model, ids = (str(tmp_path / x) for x in ("in.txt", "m.bpe", "ids.txt"))
    (tmp_path / "in.txt").write_text("bir ev bir ev bir ev\n")
    assert cli.main(["train", "-i", text, "-o", model, "-v", "256"]) == 1
    assert cli.main(["train", "-i", text, "-o", model, "-v", "300"]) == 0
    capsysbinary.readouterr()
    assert cli.main(["encode", "-m", model, "-i", text, "-c"]) == 0
    (tmp_path / "ids.txt").write_bytes(capsysbinary.readouterr().out)
    assert cli.main(["decode", "-m", model, "-i", ids]) == 0
    assert capsysbinary.readouterr().out == b"bir ev bir ev bir ev \n"
    assert cli.main(["inspect", "-m", model, "-s", "ev"]) == 0
    assert b"ev" in capsysbinary.readouterr().out


def test_entry_without_the_operators_package():
    code = """
import sys, importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda n, *a: None if n.startswith("tokenlake.llm") or n == "corpus_pipeline" else real(n, *a)
import __spark_entry__ as e
assert "best_pair_topk" in e.queries() and not any(k.startswith("op") for k in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
