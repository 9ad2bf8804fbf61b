"""Chunk dictionary and pair statistics.

Texts are exploded into chunks and reduced to distinct chunks with their counts,
which is the only shuffle that grows with the corpus, and which partial
aggregation shrinks to distinct chunks by task.  All that follows works on the
dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def chunks(docs: DataFrame, key: str = "doc_id", text: Column | None = None) -> DataFrame:
    """``(key, pos, chunk)`` in order."""
    return docs.select(key, F.posexplode(T.pretokens(F.col("text") if text is None else text)).alias("pos", "chunk"))


def dictionary(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """``(chunk, n)``: distinct chunks and their counts."""
    return docs.select(F.explode(T.pretokens(F.col("text") if text is None else text)).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))


def token_strings(words: DataFrame) -> DataFrame:
    """``(s, n)``: each chunk as a string of one character per token, at first per byte."""
    return words.select(T.byte_string(F.col("chunk")).alias("s"), "n")


def pair_counts(state: DataFrame) -> DataFrame:
    """``(pair, n)``: adjacent pairs, which may overlap, weighted by the chunks' counts."""
    long = state.filter(F.length("s") > 1)
    pair = F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring(F.col("s"), i, F.lit(2)))
    return long.select(F.explode(pair).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))


def with_ids(pairs: DataFrame) -> DataFrame:
    """``(left_id, right_id, n)`` of pairs of base tokens."""
    return pairs.select(F.ascii(F.substring("pair", 1, 1)).alias("left_id"), F.ascii(F.substring("pair", 2, 1)).alias("right_id"), "n")


def best_pairs(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The k most frequent pairs; of equals, the smallest ids first."""
    return pairs.orderBy(F.desc("n"), "left_id", "right_id").limit(k)


def merge_pair(s: Column, pair: str, result: str) -> Column:
    """Replace a pair from left to right, without overlap."""
    return F.replace(s, F.lit(pair), F.lit(result))
