"""Text and model files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Model
from ..operators.clean import strip


#: Characters of an encyclopedia document at least.
WIKI_MIN = 50


def text_lines(spark: SparkSession, path: str, newline_only: bool = True) -> DataFrame:
    """``(path, line)``: lines cut at newlines only (a carriage return stays), or at any line end."""
    reader = spark.read
    if newline_only:
        reader = reader.option("lineSep", "\n")
    return reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: a file in rows that end in newlines, which no chunk but white space goes across; any number of tasks share a large file.

    Malformed bytes become U+FFFD.
    """
    rows = spark.read.format("text").option("lineSep", "\n").load(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.concat(F.make_valid_utf8("value"), F.lit("\n")).alias("text"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)``: one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def whole_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size, bytes)``: one row a file, untouched."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("content").alias("bytes"))


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, size)`` without reading the contents."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))


def web_documents(docs: DataFrame) -> DataFrame:
    """Stripped texts without empty ones, as a crawl dump yields them."""
    return docs.withColumn("text", strip(F.col("text"))).filter("text <> ''")


def wiki_lines(rows: DataFrame) -> DataFrame:
    """``(…, line)`` without document tags and blank lines, of an extracted encyclopedia; every length, as what it extracts is filtered by document."""
    return rows.filter(~F.contains("line", F.lit("<doc ")) & ~F.contains("line", F.lit("</doc>")) & (strip(F.col("line")) != ""))


def wiki_documents(rows: DataFrame, key: str = "doc_id", least: int = WIKI_MIN) -> DataFrame:
    """``wiki_lines`` of the documents whose lines have ``least`` characters or more together."""
    kept = wiki_lines(rows)
    size = kept.groupBy(F.col(key).alias("__of")).agg(F.sum(F.length("line")).alias("__size")).filter(F.col("__size") >= least)
    return kept.join(size, F.col(key).eqNullSafe(F.col("__of")), "left_semi")


def loader_lines(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """``(key, line_no, line)``: the first ``most`` lines, then stripped, and without blank ones; the limit counts blank lines too."""
    return rows.orderBy(key, "line_no").limit(most).withColumn("line", strip(F.col("line"))).filter("line <> ''")


def read_model(spark: SparkSession, path: str) -> Model:
    """A model in the binary interchange format."""
    return Model.from_bytes(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def write_model(model: Model, path: str) -> None:
    """Write the interchange format to a local path."""
    with open(path, "wb") as f:
        f.write(model.to_bytes())


def id_text(ids: Column, separator: str = "\n") -> Column:
    """Ids as text, one a line or separated by commas."""
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), separator)


def parse_ids(text: Column) -> Column:
    """Ids in a text: whole numbers, whatever is between them; null instead of an id out of range."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([+-]?[0-9]+)"), F.lit(1)), lambda x: F.try_to_number(F.ltrim(x, F.lit("+")), F.lit("S99999999999")).cast("bigint"))


def write_lines(rows: DataFrame, path: str, column: str = "text") -> None:
    """One text a line."""
    rows.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
