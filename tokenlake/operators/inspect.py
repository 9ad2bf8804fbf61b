"""Looking into a model: summary, lengths, rules, tokens and search, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import BASE
from .codec import escaped

BAR, SHOWN = 40, 20


def summary(vocab: DataFrame, merges: DataFrame) -> DataFrame:
    """``(vocab_size, num_merges, base_tokens, merged_tokens)``."""
    n = vocab.agg(F.count("*").alias("vocab_size")).crossJoin(merges.agg(F.count("*").alias("num_merges")))
    return n.select("vocab_size", "num_merges", F.lit(BASE).alias("base_tokens"), F.greatest(F.col("vocab_size") - BASE, F.lit(0)).alias("merged_tokens"))


def length_histogram(vocab: DataFrame) -> DataFrame:
    """``(len, n, bar)`` of lengths up to 20; the bars' scale is the largest count of any length."""
    counts = vocab.groupBy("len").agg(F.count("*").alias("n"))
    scaled = counts.withColumn("top", F.max("n").over(Window.partitionBy()))
    return scaled.filter((F.col("len") >= 1) & (F.col("len") <= SHOWN)).select("len", "n", F.expr(f"repeat('#', cast(n * {BAR} div top as int))").alias("bar"))


def merge_listing(vocab: DataFrame, merges: DataFrame, n: int = 20) -> DataFrame:
    """The first n rules with printable tokens; an id without token shows as ``<id>``."""
    out = merges.filter(F.col("rank") < n)
    for side in ("left", "right", "result"):
        look = F.broadcast(vocab.select(F.col("id").alias(f"{side}_id"), escaped(F.col("bytes"), True).alias(side)))
        out = out.join(look, f"{side}_id", "left").withColumn(side, F.coalesce(side, F.concat(F.lit("<"), F.col(f"{side}_id"), F.lit(">"))))
    return out.select("rank", "left_id", "right_id", "result_id", "left", "right", "result")


def merged_tokens(vocab: DataFrame, n: int = 50) -> DataFrame:
    """The first n tokens beyond the bytes, in order of creation."""
    return vocab.filter((F.col("id") >= BASE) & (F.col("id") < BASE + n)).select("id", "len", escaped(F.col("bytes"), True).alias("token"))


def search(vocab: DataFrame, needle: bytes) -> DataFrame:
    """Tokens that contain ``needle``; an empty one is in all."""
    return vocab.filter(F.contains(F.col("bytes"), F.lit(bytearray(needle)))).select("id", "len", escaped(F.col("bytes"), True).alias("token"))


def dump(vocab: DataFrame) -> DataFrame:
    """All tokens in printable form."""
    return vocab.select("id", "len", escaped(F.col("bytes"), True).alias("token"))


def lookup(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """``tokens(bytes)`` with their ids, null where there is none."""
    return tokens.join(F.broadcast(vocab.select("id", "bytes")), "bytes", "left")
