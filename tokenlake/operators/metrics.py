"""Fertility and compression of encoded corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import WHITE

#: Words of the word analysis: common ones, agglutinated ones, and all four i.
WORDS = ("Ankara", "Türkiye", "anlayamayacaklarımızdandır", "büyük", "evlerinizdekilerden", "gelebilecekmiydiler", "güzel", "ilk", "küçük", "merhaba", "yapabileceklerimizdendi", "çocuk", "İstanbul", "İzmir", "İğdır", "ışık")


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, f"{WHITE}+"), lambda w: w != ""))


def fertility(encoded: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals and ratios of rows ``(text, ids)``, overall or by group; one pass, partial sums only."""
    rows = encoded.groupBy(*by) if by else encoded
    totals = rows.agg(
        F.coalesce(F.sum(F.size("ids").cast("long")), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("total_chars"),
        F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(word_count(F.col("text")).cast("long")), F.lit(0)).alias("total_words"),
    )

    def ratio(a: str, b: str) -> Column:
        return F.col(f"total_{a}").cast("double") / F.greatest(F.col(f"total_{b}"), F.lit(1))

    return totals.withColumns({"tokens_per_char": ratio("tokens", "chars"), "tokens_per_word": ratio("tokens", "words"), "bytes_per_token": ratio("bytes", "tokens"), "chars_per_token": ratio("chars", "tokens")})


def unknown_rate(totals: DataFrame) -> DataFrame:
    """Tokens over bytes, the share of bytes that found no merge in the limit; 0 without tokens."""
    return totals.withColumn("unknown_rate", F.when(F.col("total_tokens") > 0, F.col("total_tokens").cast("double") / F.greatest("total_bytes", F.lit(1))).otherwise(0.0))


def verdict(tokens_per_word: Column) -> Column:
    return F.when(tokens_per_word < 1.5, "excellent").when(tokens_per_word < 2.0, "good").when(tokens_per_word < 3.0, "moderate").otherwise("poor")


def compare(ours: DataFrame, other: DataFrame) -> DataFrame:
    """``(metric, ours, other, winner)`` of two one-row fertility tables; equal values go to ours."""
    rows = ours.select(F.struct("tokens_per_word", "bytes_per_token").alias("a")).crossJoin(other.select(F.struct("tokens_per_word", "bytes_per_token").alias("b")))
    metric = F.explode(F.array(F.struct(F.lit("tokens_per_word").alias("metric"), F.col("a.tokens_per_word").alias("ours"), F.col("b.tokens_per_word").alias("other"), F.lit(-1).alias("sign")), F.struct(F.lit("bytes_per_token").alias("metric"), F.col("a.bytes_per_token").alias("ours"), F.col("b.bytes_per_token").alias("other"), F.lit(1).alias("sign"))))
    return rows.select(metric.alias("m")).select("m.metric", "m.ours", "m.other", F.when((F.col("m.ours") - F.col("m.other")) * F.col("m.sign") >= 0, "ours").otherwise("other").alias("winner"))


def word_analysis(encoded: DataFrame) -> DataFrame:
    """``(text, n_tokens, n_bytes, bytes_per_token)`` of each word."""
    return encoded.select("text", F.size("ids").alias("n_tokens"), F.octet_length("text").alias("n_bytes"), (F.octet_length("text").cast("double") / F.greatest(F.size("ids"), F.lit(1))).alias("bytes_per_token"))


def compare_words(ours: DataFrame, other: DataFrame) -> DataFrame:
    """Winner by word of two word analyses; equal counts are a tie."""
    a, b = ours.select("text", F.col("n_tokens").alias("ours")), other.select("text", F.col("n_tokens").alias("other"))
    return a.join(b, "text").withColumn("winner", F.when(F.col("ours") < F.col("other"), "ours").when(F.col("ours") > F.col("other"), "other").otherwise("tie"))
