"""Bounded, repeatable samples of labelled documents for the models trained here."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stable

#: At most so many labelled document rows train a model.
MAX_ROWS = 4000
#: At most so many bytes of text train a model; a document whose whole text doesn't fit any more is left out.
MAX_BYTES = 32 << 20
#: Labels of at most so many documents are broadcast (16 bytes each); more are joined by a shuffle of doc_ids.
MAX_BROADCAST = 1 << 20
#: Arrow types of doc_id, hash and label.
TYPES = (pa.int64(), pa.int64(), pa.int32())


def usable(labels: DataFrame, label: str) -> DataFrame:
    """``(doc_id, y)``: each doc_id once, without missing, contradictory or other labels than 0 and 1."""
    return (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .dropna()
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("top"))
        .filter("y = top and y in (0, 1)")
        .select("doc_id", "y")
    )


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[tuple[int, str, int]]:
    """``(doc_id, text, label)`` of at most ``max_rows`` labelled document rows.

    The sample is taken of the labelled documents that there are, by the smallest
    hashes of doc_id and text, so it does not depend on the partitioning, and a
    filtered corpus trains on what it has.  Rows equal in doc_id and text count
    once.  Rows without label or text, and doc_ids with contradictory labels, are
    left out.  First the hashes and sizes of the labelled rows are gathered, and
    only ``max_rows`` of them; then the texts of those.

    Texts are whole.  Where they have more than ``max_bytes`` bytes together, a
    document is left out when it doesn't fit beside those of smaller hash.
    """
    known = stable(usable(labels, label))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    few = F.broadcast(known) if known.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else known
    sizes = rows.select("doc_id", "h", F.octet_length("text").alias("size")).join(few, "doc_id").groupBy("doc_id", "h", "y").agg(F.min("size").alias("size"))
    fit, left = [], max_bytes
    for r in sizes.orderBy("h", "doc_id").limit(max_rows).collect():
        if r["size"] <= left:
            fit.append((r["doc_id"], r["h"], r["y"]))
            left -= r["size"]
    # by Arrow, as rows would start Python workers of another kind, which stay beside the others
    chosen = docs.sparkSession.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(zip(*fit) if fit else [()] * 3, TYPES)], ["doc_id", "h", "y"]))
    once = Window.partitionBy("doc_id", "h").orderBy("h")
    found = rows.join(F.broadcast(chosen), ["doc_id", "h"]).withColumn("k", F.row_number().over(once)).filter("k = 1")
    return sorted((r["doc_id"], r["text"], r["y"]) for r in found.select("doc_id", "text", "y").collect())
