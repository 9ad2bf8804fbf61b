"""The registered queries of the operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op01_substring, op02_quality, op03_decontaminate, op04_lines, op05_simhash, op06_compression, op07_packing, op08_suffix, op09_token_counts, op10_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_substring.repeated(_table(spark, sf_dir, "documents"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_lines.report(_table(spark, sf_dir, "documents"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_simhash.groups(_table(spark, sf_dir, "documents"))


def compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_compression.measured(_table(spark, sf_dir, "documents"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_packing.packed(_table(spark, sf_dir, "documents"))


def suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_suffix.matches(_table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_token_counts.token_counts(_table(spark, sf_dir, "documents"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring": substring,
    "op2_quality": quality,
    "op3_decontaminate": decontaminate,
    "op4_lines": lines,
    "op5_simhash": simhash,
    "op6_compression": compression,
    "op7_packing": packing,
    "op8_suffix": suffix,
    "op9_token_counts": token_counts,
    "op10_toxicity": toxicity,
}

_NORMAL = r"trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g'))"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+')"

#: Maximal spans of words in repeated windows of 50.
_SPANS = """
WITH docs AS (SELECT doc_id, _WORDS AS w FROM documents),
wins AS (SELECT doc_id, s, hash(array_to_string(w[s + 1 : s + 50], ' ')) AS h FROM docs, unnest(range(0, len(w) - 49)) AS t(s)),
marked AS (
  SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY _ORDER, s) AS k FROM wins),
rep AS (SELECT doc_id, s, k > 1 AS later FROM marked WHERE n > 1),
cover AS (SELECT doc_id, p, bool_or(later) AS later FROM rep, unnest(range(s, s + 50)) AS t(p) GROUP BY doc_id, p),
isles AS (SELECT doc_id, p, later, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS isle FROM cover)
SELECT doc_id, min(p) AS start_word, count(*) AS n_words, count(*) FILTER (later) AS removable_words
FROM isles GROUP BY doc_id, isle
""".replace("_WORDS", _WORDS)

ORACLE: dict[str, str] = {
    "op1_substring": _SPANS.replace("_ORDER", "doc_id"),
    "op8_suffix": _SPANS.replace("_ORDER", "doc_id % 8, doc_id"),
    "op3_decontaminate": f"""
WITH items AS (SELECT DISTINCT item_id, string_split({_NORMAL}, ' ') AS w FROM benchmark WHERE item_id IS NOT NULL AND {_NORMAL} <> ''),
tests AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
  FROM items, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(i)),
docs AS (SELECT doc_id, string_split({_NORMAL}, ' ') AS w FROM documents),
grams AS (
  SELECT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT k FROM tests) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i))
SELECT doc_id, item_id, count(*) AS n_hits FROM grams JOIN tests USING (k, g) GROUP BY doc_id, item_id
""",
}

# Lines within one edit agree in their first or last half, which the join uses before it measures the distance.
ORACLE["op4_lines"] = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i - 1 AS line_no, ls[i] AS line FROM docs, unnest(range(1, len(ls) + 1)) AS t(i) WHERE length(ls[i]) >= 20 OR regexp_matches(ls[i], '[^\s\x0B\x{85}\p{Z}]')),
firsts AS (SELECT line, min(row(doc_id, line_no)) AS spot FROM lines GROUP BY line),
halves AS (
  SELECT line, spot, m, side, CASE side WHEN 0 THEN left(line, m // 2) ELSE right(line, (m - 1) // 2) END AS half
  FROM firsts, (SELECT unnest([0, 1]) AS side), unnest([length(line), length(line) + 1]) AS t(m) WHERE length(line) >= 20),
pairs AS (
  SELECT DISTINCT a.line, b.line AS other, b.spot FROM halves AS a JOIN halves AS b USING (m, side, half)
  WHERE b.spot < a.spot AND a.line <> b.line AND abs(length(a.line) - length(b.line)) <= 1),
near AS (SELECT line, min(spot) AS near FROM pairs WHERE levenshtein(line, other) = 1 GROUP BY line),
judged AS (
  SELECT doc_id, line_no, spot, CASE WHEN spot < row(doc_id, line_no) AND (near IS NULL OR spot < near) THEN spot ELSE near END AS dest
  FROM lines JOIN firsts USING (line) LEFT JOIN near USING (line))
SELECT doc_id, line_no::INTEGER AS line_no, dest[1] AS first_doc_id, dest[2]::INTEGER AS first_line_no, CASE WHEN dest = spot THEN 0 ELSE 1 END AS distance
FROM judged WHERE dest < row(doc_id, line_no)
"""
