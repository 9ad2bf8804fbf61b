"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of documents, in order of a hash of (doc_id, text).  In
every round each queue is credited its share of one window's tokens, and serves
whole documents from its head as long as its deficit pays for them; what is left
of the deficit is carried into the next round.  A queue that runs dry leaves the
round-robin, and the others go on in the same proportions.  The documents served,
in order of (round, source, place in the queue), are one stream, which is cut
into windows of ``window`` tokens, so every window but the last is full, and a
document is cut only where a window ends.  After r rounds a source has had its
share of r windows, but for less than the document at the head of its queue.

A queue's deficits depend on its own documents alone: the document that ends at
token C of a queue with credit q a round is served in round ceil(C / q).  So the
rounds come from prefix sums of token numbers by queue, and the places in the
stream from prefix sums in order of the rounds.  Both sums run over ranges of
sorted rows, one a partition, of equal size whatever the sources' sizes are; a
partition's total carries into the next.  Neither a hot source nor a window
across partitions needs a sequential pass, nothing that grows with the corpus
comes to the driver, and the cost is the same for one source as for millions.

Weights: by default each source's token total to the power ``alpha`` (as a whole
number of ``SCALE`` parts), or ``weights`` by source.  Sources without weight, or
of weight 0, follow after all others are dry, in equal shares.

Tokens are those of the tokenizer of token counts.

Defined results
* null and empty texts have no tokens and no place.
* very long texts are tokenized whole, in pieces, and go through as many windows
  as they need.
* a null source is a queue of its own, before the others in each round.
* rows equal in doc_id and text each have a place, one after the other.
* ties: documents of one source with equal hashes are in order of doc_id, then of
  the text's hash.
* a null doc_id is reported as null.
* extra columns are ignored, whatever their names; an empty table gives an empty one.
* the last window holds what is left and may be short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import stable
from .op09_token_counts import PATTERN, VOCABULARY, tokenizers
from .packed import null_back, partitions, row_id

WINDOW = 2048
ALPHA = 0.7
SCALE = 10_000
#: Rows of documents in one range of the prefix sums.
RANGE_ROWS = 1 << 22
#: At most so many sources are broadcast (under 100 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 200_000
_QUEUE = "doc_id long, key long, source string, n long"


def _rows(docs: DataFrame) -> DataFrame:
    doc, key = row_id(F.col("doc_id"), F.col("text"))
    return docs.select(doc.alias("doc_id"), key.alias("key"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def queues(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, key, source, n)`` of every document row with tokens, n their number."""
    make = tokenizers(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            n = [len(encode(t.as_py())) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64())], ["doc_id", "key", "source", "n"])

    return _rows(docs).mapInArrow(run, _QUEUE).filter("n > 0")


def running(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``rows`` in order, with the sum of ``value`` up to and with each row as ``name``.

    The rows are cut into ranges by ``order``, written, and summed range by range;
    the driver gets one total a range.
    """
    n = max(partitions(rows.sparkSession), -(-rows.count() // RANGE_ROWS))
    ranged = stable(rows.repartitionByRange(n, *order).sortWithinPartitions(*order))
    sums = dict(map(tuple, ranged.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.sum(value)).collect()))
    before = np.r_[0, np.cumsum([sums.get(p, 0) for p in range(n)])]
    names = ranged.columns
    at = names.index(value)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = before[TaskContext.get().partitionId()]
        for batch in batches:
            if batch.num_rows:
                sums = total + np.cumsum(np.asarray(batch.column(at)), dtype=np.int64)
                total = sums[-1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums)], [*names, name])

    return ranged.mapInArrow(add, StructType([*ranged.schema.fields, StructField(name, LongType())]))


def shares(queued: DataFrame, weights: dict[str | None, int] | None, alpha: float) -> tuple[DataFrame, dict[int, int]]:
    """``(of, base, tier, weight)`` of each source, base the tokens before it in ``through``, and the sum of weights by tier."""
    s = stable(queued.groupBy("source").agg(F.min(F.col("through") - F.col("n")).alias("base"), F.sum("n").alias("total")))
    if weights is None:
        most = s.agg(F.max("total")).first()[0] or 1
        s = s.withColumn("weight", F.greatest(F.lit(1), F.round(SCALE * F.pow(F.col("total") / F.lit(float(most)), F.lit(alpha))).cast("long")))
    else:
        given = s.sparkSession.createDataFrame([(k, int(w)) for k, w in weights.items()], "name string, weight long")
        s = s.join(F.broadcast(given), F.col("source").eqNullSafe(F.col("name")), "left")
    s = s.withColumn("tier", F.when(F.col("weight") > 0, 0).otherwise(1)).withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(1))
    sums = {r["tier"]: int(r["w"]) for r in s.groupBy("tier").agg(F.sum("weight").alias("w")).collect()}
    return s.select(F.col("source").alias("of"), "base", "tier", "weight"), sums


def placed(docs: DataFrame, window: int = WINDOW, weights: dict[str | None, int] | None = None, alpha: float = ALPHA, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(doc_id, key, source, n, at)``: each document row with the tokens before it in the stream."""
    rows = stable(queues(docs, vocabulary, pattern))
    queued = running(rows.withColumn("h", F.xxhash64("doc_id", "key")), [F.col(c) for c in ("source", "h", "doc_id", "key")], "n", "through")
    s, sums = shares(queued, weights, alpha)
    if s.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        s = F.broadcast(s)
    total = F.when(F.col("tier") == 0, F.lit(sums.get(0, 1))).otherwise(F.lit(sums.get(1, 1))).cast("decimal(17,0)")
    credit = (F.lit(window) * F.col("weight")).cast("decimal(18,0)")
    served = queued.join(s, F.col("source").eqNullSafe(F.col("of"))).withColumn("c", (F.col("through") - F.col("base")).cast("decimal(19,0)")).withColumn("t", total).withColumn("q", credit)
    served = served.select("doc_id", "key", "source", "n", "tier", F.expr("(c * t + q - 1) div q").alias("round"), F.col("c").cast("long").alias("c"))
    stream = running(served, [F.col(c) for c in ("tier", "round", "source", "c")], "n", "upto")
    return stream.select("doc_id", "key", "source", "n", (F.col("upto") - F.col("n")).alias("at"))


def _cut(stream: DataFrame, window: int) -> DataFrame:
    """Each document's pieces by window."""
    w = stream.withColumn("window_id", F.explode(F.expr(f"sequence(at div {window}, (at + n - 1) div {window})")))
    start = F.greatest(F.lit(0), F.col("window_id") * window - F.col("at"))
    return w.withColumn("doc_start", start).withColumn("n_tokens", F.least(F.col("n"), (F.col("window_id") + 1) * window - F.col("at")) - F.col("doc_start"))


def packed(docs: DataFrame, window: int = WINDOW, weights: dict[str | None, int] | None = None, alpha: float = ALPHA, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(window_id, source, doc_id, doc_start, n_tokens)``: the pieces of documents that fill each window."""
    return _cut(placed(docs, window, weights, alpha, vocabulary, pattern), window).select("window_id", "source", null_back(), "doc_start", "n_tokens")


def filled(docs: DataFrame, window: int = WINDOW, weights: dict[str | None, int] | None = None, alpha: float = ALPHA, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``(window_id, ids)``: the token ids of each window.

    Pieces meet their documents by (doc_id, hash of text) and each other by window;
    neither group is larger than a document or a window.
    """
    make = tokenizers(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([encode(t.as_py()) for t in batch.column(3)], pa.list_(pa.int32()))], ["d", "k", "all_ids"])

    ids = _rows(docs).dropDuplicates(["doc_id", "key"]).mapInArrow(run, "d long, k long, all_ids array<int>")
    pieces = _cut(placed(docs, window, weights, alpha, vocabulary, pattern), window)
    own = pieces.join(ids, (F.col("doc_id") == F.col("d")) & (F.col("key") == F.col("k"))).select("window_id", "at", F.expr("slice(all_ids, cast(doc_start + 1 as int), cast(n_tokens as int))").alias("ids"))
    return own.groupBy("window_id").agg(F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts")).select("window_id", F.flatten(F.col("parts.ids")).alias("ids"))
