"""Corpus cleaning: lines are cleaned, filtered by length and language, and deduplicated.

A line is judged by the first rule that it fails, kept as its ``status``.  Cleaning and
the language score are Arrow functions, as characters by class and distinct words of a
line cost less by table and by set than by expressions over each line.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A

MIN_CHARS, MAX_CHARS = 20, 10_000
THRESHOLD = 0.3
SPECIFIC = "çÇğĞıİöÖşŞüÜ"
ALPHABET = "abcçdefgğhıijklmnoöprsştuüvyzABCÇDEFGĞHIİJKLMNOÖPRSŞTUÜVYZ"
STOPWORDS = tuple("ama ancak arasında ben bir biz bu da daha dan de den dir dır en gibi hem ile ise için kadar ki ne olan olarak oldu sen sonra var ve veya ya çok üzerinde".split())
#: What Python's ``str.strip`` and ``str.split`` take for white space.
WHITE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def repaired(data: bytes) -> str:
    """Text of bytes at ingest: damage becomes U+FFFD, as Python replaces it."""
    return data.decode("utf-8", "replace")


def repair(data: Column) -> Column:
    """Text of a binary column, with U+FFFD for damage; stays in the JVM."""
    return F.make_valid_utf8(data.cast("string"))


def strip(text: Column) -> Column:
    """Without white space at either end, as Python strips."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


_BLANKS = re.compile("[ \t]+")


def cleaned(line: str) -> str:
    """A cleaned line: no invisible characters, single blanks, stripped, composed."""
    if not line.isprintable():
        line = _BLANKS.sub(" ", "".join([c for c in line if c in "\t\n" or unicodedata.category(c)[0] != "C"]))
    elif "  " in line:
        line = _BLANKS.sub(" ", line)
    line = line.strip()
    return line if line.isascii() else unicodedata.normalize("NFC", line)


@lru_cache
def _classes() -> np.ndarray:
    """Of each code point: 1 for a letter, 2 for one of the alphabet, 4 for a Turkish one, added up."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)
    out[[ord(c) for c in ALPHABET]] |= 2
    out[[ord(c) for c in SPECIFIC]] |= 4
    return out


_STOP = frozenset(STOPWORDS)


def scores(texts: list[str]) -> np.ndarray:
    """How much each line looks Turkish: own letters 0.4, share of alphabet 0.3, stop words up to 0.3."""
    kinds = _classes()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([0, *map(len, texts)])
    letters, known, own = (np.diff(np.r_[0, np.cumsum(kinds & bit > 0)][ends]) for bit in (1, 2, 4))
    words = [set(t.lower().split()) for t in texts]
    size, hits = (np.fromiter(x, np.int64, len(texts)) for x in (map(len, words), (len(w & _STOP) for w in words)))
    score = np.where(own > 0, 0.4, 0.0) + np.where(letters > 0, known / np.maximum(letters, 1), 0.0) * 0.3 + np.minimum(hits / np.maximum(size, 1) * 2.0, 0.3)
    return np.where(size == 0, 0.0, score)


def _clean(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else cleaned(x) for x in column.to_pylist()], pa.string())


def _score(column: pa.Array) -> pa.Array:
    texts = column.to_pylist()
    out = scores([t or "" for t in texts])
    return pa.array([0.3 if t is None else s for t, s in zip(texts, out.tolist())] if column.null_count else out, pa.float64())


def _clean_and_score(column: pa.Array) -> pa.Array:
    texts = _clean(column)
    return pa.StructArray.from_arrays([texts, _score(texts)], ["clean", "score"])


def clean(line: Column) -> Column:
    """A cleaned line."""
    return A.function(lambda: _clean, "string")(line)


def _once(work, kind: str, line: Column) -> Column:  # noqa: ANN001
    """The function of a line, which a filter on its result doesn't call a second time: Spark moves no filter past what may vary."""
    return A.function(lambda: work, kind).asNondeterministic()(line)


def scored(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, line_no, clean, score)`` of ``(key, line_no, line)``, in one pass."""
    both = _once(_clean_and_score, "clean string, score double", F.col("line"))
    return rows.select(key, "line_no", both.alias("both")).select(key, "line_no", "both.clean", "both.score")


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, line_no, line)``: lines from 0, cut at newlines, carriage returns or both."""
    return docs.select(key, F.posexplode(F.split("text", r"\r\n|\r|\n", -1)).alias("line_no", "line"))


def language_score(line: Column) -> Column:
    """How much a line looks Turkish; see ``scores``."""
    return A.function(lambda: _score, "double")(line)


def is_turkish(line: Column, threshold: float = THRESHOLD) -> Column:
    return language_score(line) >= F.lit(threshold)


def judged(rows: DataFrame, key: str = "doc_id", sample: int | None = None, least: int = MIN_CHARS, most: int = MAX_CHARS, turkish: bool = True, dedup: bool = True) -> DataFrame:
    """``(key, line_no, clean, status)`` of every line; ``sample`` takes the first lines only, before all else."""
    if sample is not None:
        rows = rows.orderBy(key, "line_no").limit(sample)
    rows = scored(rows, key) if turkish else rows.select(key, "line_no", _once(_clean, "string", F.col("line")).alias("clean"))
    status = F.when(F.length("clean") < least, "too_short").when(F.length("clean") > most, "too_long")
    if turkish:
        status = status.when(~(F.col("score") >= F.lit(THRESHOLD)), "not_turkish")
    rows = rows.select(key, "line_no", "clean", status.otherwise("kept").alias("status"))
    if not dedup:
        return rows
    # lines that are out already do not meet in one partition for their hash
    first = Window.partitionBy("alive").orderBy(key, "line_no")
    alive = F.when(F.col("status") == "kept", F.md5(F.col("clean"))).otherwise(F.concat_ws(":", F.col(key), F.col("line_no")))
    rows = rows.withColumn("alive", alive).withColumn("k", F.row_number().over(first))
    return rows.withColumn("status", F.when((F.col("status") == "kept") & (F.col("k") > 1), "duplicate").otherwise(F.col("status"))).drop("alive", "k")


def kept(rows: DataFrame, key: str = "doc_id", dedup: bool = True, **options: object) -> DataFrame:
    """The lines that pass: ``(key, line_no, clean)``; only those that pass the other rules are shuffled for duplicates."""
    rows = judged(rows, key, dedup=False, **options).filter("status = 'kept'").drop("status")
    if not dedup:
        return rows
    first = Window.partitionBy("alive").orderBy(key, "line_no")
    return rows.withColumn("alive", F.md5("clean")).withColumn("k", F.row_number().over(first)).filter("k = 1").drop("alive", "k")


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts by status, and the share kept in per cent."""
    count = {s: F.count_if(F.col("status") == s).alias(s) for s in ("kept", "too_short", "too_long", "not_turkish", "duplicate")}
    out = rows.agg(F.count("*").alias("total"), *count.values())
    return out.withColumn("kept_percent", F.round(F.col("kept") * 100.0 / F.greatest("total", F.lit(1)), 6))


def first_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys of the first document of each distinct text; partial aggregation absorbs hot texts."""
    return docs.groupBy(F.md5("text").alias("h"), F.length("text").alias("size")).agg(F.min(key).alias(key), F.count("*").alias("copies")).select(key, "copies")
