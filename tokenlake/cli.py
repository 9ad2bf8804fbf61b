"""Command line: ``python -m tokenlake.cli train|encode|decode|inspect``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .functions.text import parse_flags
from .model import Config, ModelError
from .operators import codec, inspect
from .operators.clean import repaired
from .session import local_session
from .sources import files
from .tokenizer import Tokenizer


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tokenlake")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="learn a model from text files")
    t.add_argument("-i", "--input", required=True)
    t.add_argument("-o", "--output", required=True)
    t.add_argument("-v", "--vocab", type=int, default=32_000)
    t.add_argument("-n", "--norm", default="w", help="flags w, l, a; without -N they have no effect on training")
    t.add_argument("-N", "--normalize", action="store_true", help="apply the flags to the training texts")
    t.add_argument("-p", "--no-pretokenize", action="store_true", help="take each line as one chunk")
    e = sub.add_parser("encode", help="text to ids")
    e.add_argument("-m", "--model", required=True)
    e.add_argument("-i", "--input")
    e.add_argument("-o", "--output")
    e.add_argument("-s", "--show", action="store_true", help="show the tokens")
    e.add_argument("-c", "--comma", action="store_true", help="one line, separated by commas")
    d = sub.add_parser("decode", help="ids to text")
    d.add_argument("-m", "--model", required=True)
    d.add_argument("-i", "--input")
    d.add_argument("-o", "--output")
    s = sub.add_parser("inspect", help="look into a model")
    s.add_argument("-m", "--model", required=True)
    s.add_argument("-t", "--tokens", type=int, default=50)
    s.add_argument("-r", "--rules", type=int, default=20)
    s.add_argument("-s", "--search")
    s.add_argument("-a", "--all", action="store_true")
    return p


def _read(path: str | None) -> bytes:
    if path is None:
        return sys.stdin.buffer.read()
    with open(path, "rb") as f:
        return f.read()


def _write(path: str | None, data: bytes) -> None:
    if path is None:
        sys.stdout.buffer.write(data)
        sys.stdout.buffer.flush()
    else:
        with open(path, "wb") as f:
            f.write(data)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = local_session()
    if a.command == "train":
        if a.vocab < 257:
            print("the vocabulary needs at least 257 tokens", file=sys.stderr)
            return 1
        t = Tokenizer(spark, Config(a.vocab, parse_flags(a.norm, strict=False), not a.no_pretokenize))
        t.train(files.text_rows(spark, a.input), normalize=a.normalize)
        t.save(a.output)
        print(t.stats())
        return 0
    t = Tokenizer(spark).load(a.model)
    if a.command == "encode":
        raw = _read(a.input)
        ids = t.encode_text(repaired(raw))
        shown = codec.shown_tokens(t.model)
        lines = [f'{i}\t"{shown(i)}"' if a.show else str(i) for i in ids]
        _write(a.output, ((",".join if a.comma else "\n".join)(lines) + "\n").encode())
        print(codec.encode_stats(len(raw), len(ids)), file=sys.stderr)
    elif a.command == "decode":
        row = spark.createDataFrame([(_read(a.input).decode("utf-8", "replace"),)], "text string")
        ids = row.select(files.parse_ids(F.col("text")).alias("ids")).first()["ids"]
        if not ids:
            print("warning: no token ids in the input", file=sys.stderr)
        try:
            out = t.decode_ids(ids)
        except ModelError as e:
            print(e, file=sys.stderr)
            return 1
        _write(a.output, out + (b"" if a.output or not out or out.endswith(b"\n") else b"\n"))
        print(codec.decode_stats(len(ids), len(out)), file=sys.stderr)
    else:
        vocab, rules = t.model.vocab_frame(spark), t.model.merges_frame(spark)
        if a.search is not None:
            found = inspect.search(vocab, a.search.encode())
        elif a.all:
            found = inspect.dump(vocab)
        else:
            print(t.stats())
            inspect.length_histogram(vocab).orderBy("len").show(20, False)
            inspect.merge_listing(vocab, rules, a.rules).orderBy("rank").show(a.rules, False)
            found = inspect.merged_tokens(vocab, a.tokens)
        for r in found.orderBy("id").toLocalIterator():
            print(r["id"], r["len"], r["token"], sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main())
