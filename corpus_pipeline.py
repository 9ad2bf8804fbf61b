"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next one's input;
what is read no more is deleted, and the last folder goes when the program ends.

Near copies lose the lines that they share to line dedup, which comes first.
Near-dedup therefore judges a document by the text that ``documents`` has for it, and
by what is left of it too: near copies by either are in one group.  Where a doc_id has
several texts there, or is null, the text is the one that has all lines left.

Defined results
* null texts: quality judges them by the prior and their site; line dedup and
  near-dedup leave them, they have no benchmark strings and no place in a window.
* empty texts likewise; texts that line dedup empties go in its stage.
* very long texts are worked on whole by every stage.
* ties and repeated rows: of equal lines, near copies and equal rows the first in
  order of (doc_id, hash of text) stays.
* without labels of both classes quality keeps every document with a text as
  likely good as not, that is all of them.
* extra columns are kept up to packing, whatever their names; empty tables give
  empty ones.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tokenlake.llm import op02_quality, op03_decontaminate, op04_lines, op05_simhash, op07_packing
from tokenlake.llm.common import ensure_checkpoint_dir, remove, remove_at_exit


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps."""
    return op02_quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that occurred earlier; a document of nothing else goes."""
    return op04_lines.deduplicated(docs, emptied=False)


def _near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by what is left and as they were before line dedup took shared lines out of the later ones."""
    return op05_simhash.deduplicated(docs, originals=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark strings."""
    return op03_decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' tokens in the training windows."""
    return op07_packing.packed(docs)


STAGES = [
    ("quality classifier", _quality),
    ("line dedup", _lines),
    ("SimHash near-dedup", _near),
    ("benchmark decontamination", _benchmark),
    ("packing", _packing),
]

#: The quality model, the fingerprints and the phases of packing have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    remove_at_exit(spark, folder)
    return docs
