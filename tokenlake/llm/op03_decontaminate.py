"""Benchmark decontamination by Wu-Manber multi-pattern search.

Test strings are all runs of ``n`` words of a benchmark item (the whole item
where it is shorter) after normalisation: lower case, every run of characters
that are neither letters nor digits becomes one space.  A hit is an occurrence
of a test string at word borders in a document normalised the same way.

The search is that of Wu and Manber: a *shift table* over blocks of ``block``
bytes tells how far the scan may jump from a block, a jump of zero leads to the
*bucket* of test strings whose window ends in that block (by the hash of that
suffix block), a prefix check thins the bucket and a direct comparison of bytes
confirms.  One scan runs in many lanes of a batch at once, so that numpy does
the jumps; the lanes overlap in nothing but the bytes they look at, hence each
occurrence is found once.

Defined results
* null or empty text, or text without letters and digits: no hit.
* null or empty benchmark text, or an empty benchmark: no test strings.
* an item with a null item_id is searched like any other and reported with a null
  item_id; ``contaminated`` adds up the hits of all such items in a document.
* repeated documents: each row is searched and reported by itself in ``hits``;
  ``contaminated`` adds up rows of one doc_id.
* repeated benchmark items are reported under each of their item_ids; rows with
  the same item_id and text count once.
* very long texts are searched whole.
* ties: overlapping occurrences, and strings of several items at one place, all count.
* other columns, whatever their names, are ignored by ``contaminated`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import normalized
from .packed import NULL_ID, slices
from .words import text_buffer

NGRAM = 8
BLOCK = 8
#: Bits of the hashed shift table.
TABLE_BITS = 20
#: Bytes of a document's text from which a new lane of the scan starts.
LANE = 512
#: Benchmark bytes in one matcher; a larger benchmark is searched in several passes over each batch.
MATCHER_BYTES = 64 << 20
#: Bytes of normalised benchmark text that are sent to all tasks at most; more is an error.
BENCHMARK_BYTES = 256 << 20
_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Of the Python worker: the matchers, by the job that they belong to.
_WORKER: dict[tuple[str, int], tuple] = {}


def test_strings(text: str, n: int = NGRAM) -> list[str]:
    """The test strings of a normalised benchmark text."""
    w = text.split(" ") if text else []
    if not w:
        return []
    return list(dict.fromkeys(" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))))


class WuManber:
    """Search of many byte strings, each of which begins and ends in a space."""

    def __init__(self, patterns: list[bytes], block: int = BLOCK, bits: int = TABLE_BITS):
        self.patterns = patterns
        self.m = min(map(len, patterns))
        self.block = b = max(1, min(block, self.m // 2, 8))
        self.bits = bits
        self.shift = np.full(1 << bits, self.m - b + 1, np.uint16)
        head = np.frombuffer(b"".join(p[: self.m] for p in patterns), np.uint8).reshape(-1, self.m)
        for j in range(self.m - b + 1):
            h = self._hash(self._columns(head, j))
            np.minimum.at(self.shift, h, np.uint16(self.m - b - j))
        suffix = self._hash(self._columns(head, self.m - b))
        self.order = np.argsort(suffix, kind="stable")
        self.suffix = suffix[self.order]
        self.prefix = self._columns(head, 0)[self.order]

    def _columns(self, head: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(head), np.uint64)
        for k in range(self.block):
            out |= head[:, at + k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def _hash(self, value: np.ndarray) -> np.ndarray:
        return (value * _MUL) >> np.uint64(64 - self.bits)

    def search(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern number of each occurrence in ``buf``."""
        n, b = len(buf), self.block
        last = n - b
        if n < self.m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        at_byte = np.ndarray((n,), "<u8", padded, strides=(1,))
        mask = np.uint64((1 << (8 * b)) - 1)
        pos = np.arange(self.m - b, last + 1, LANE, dtype=np.int64)
        end = np.minimum(pos + LANE, last + 1)
        found: list[np.ndarray] = []
        while len(pos):
            s = self.shift[self._hash(at_byte[pos] & mask)]
            zero = s == 0
            if zero.any():
                found.append(pos[zero])
            pos = pos + np.maximum(s, 1)
            on = pos < end
            if not on.all():
                pos, end = pos[on], end[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        h = self._hash(at_byte[at] & mask)
        lo = np.searchsorted(self.suffix, h, "left")
        size = np.searchsorted(self.suffix, h, "right") - lo
        start = np.repeat(at - (self.m - b), size)
        k = np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        ok = (at_byte[start] & mask) == self.prefix[k]
        start, which = start[ok], self.order[k[ok]]
        raw = buf.tobytes()
        good = np.fromiter((raw.startswith(self.patterns[p], s) for s, p in zip(start.tolist(), which.tolist())), bool, len(start))
        return start[good], which[good]


def _matchers(items: list[tuple[int, str]], n: int) -> tuple[list[WuManber], list[list[list[int]]]]:
    """Matchers, and for each the item numbers of each pattern."""
    owners: dict[bytes, list[int]] = {}
    for number, text in items:
        for t in test_strings(text, n):
            owners.setdefault(f" {t} ".encode(), []).append(number)
    # strings of very different lengths are kept apart: the shortest one bounds every jump
    groups: dict[int, list[bytes]] = {}
    for p in owners:
        groups.setdefault(len(p).bit_length() if len(p) < 32 else 6, []).append(p)
    out, whose = [], []
    for group in groups.values():
        part: list[bytes] = []
        size = 0
        for p in [*group, None]:
            if p is None or size + len(p) > MATCHER_BYTES:
                if part:
                    out.append(WuManber(part))
                    whose.append([owners[x] for x in part])
                part, size = [], 0
            if p is not None:
                part.append(p)
                size += len(p)
    return out, whose


def _normal_items(benchmark: DataFrame, most: int = BENCHMARK_BYTES) -> list[tuple[int, str]]:
    """``(item_id, normalised text)`` of the items that have test strings, ``NULL_ID`` for a null item_id; checked to be at most ``most`` bytes."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("i"), normalized(F.col("text")).alias("t")).filter("t <> ''").distinct()
    size = rows.agg(F.sum(F.octet_length("t") + 8)).first()[0] or 0
    if size > most:
        raise ValueError(f"the benchmark has {size} bytes; search {most} at a time, and join what is found")
    return [(r["i"], r["t"]) for r in rows.collect()]


def _shared(docs: DataFrame, benchmark: DataFrame):  # noqa: ANN202
    return docs.sparkSession.sparkContext.broadcast(_normal_items(benchmark)), uuid.uuid4().hex


def matchers_of(name: str, shared, n: int) -> tuple[list[WuManber], list[list[list[int]]]]:  # noqa: ANN001
    """The job's matchers, built once by a Python worker."""
    if (name, n) not in _WORKER:
        _WORKER.clear()
        _WORKER[name, n] = _matchers(shared.value, n)
    return _WORKER[name, n]


def hits(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """``(doc_id, item_id, n_hits)`` of each document row and item with at least one hit.

    The benchmark, a table of fixed size beside the corpus, travels to the tasks in
    a broadcast variable, after a check of its size; beyond ``MATCHER_BYTES`` its
    test strings are cut into matchers of bounded size.
    """
    shared, name = _shared(docs, benchmark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers, whose = matchers_of(name, shared, n)
        for batch in slices(batches, 1):
            buf, offsets = text_buffer(batch.column(1))
            doc, item = [], []
            for m, own in zip(matchers, whose):
                start, which = m.search(buf)
                row = np.searchsorted(offsets, start, side="right") - 1
                for r, p in zip(row.tolist(), which.tolist()):
                    for i in own[p]:
                        doc.append(r)
                        item.append(i)
            if doc:
                pairs, count = np.unique(np.array([doc, item], np.int64), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs[0])), pa.array(pairs[1], mask=pairs[1] == NULL_ID), pa.array(count.astype(np.int64))], ["doc_id", "item_id", "n_hits"])

    padded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.lit(" "), normalized(F.col("text")), F.lit(" ")).alias("text"))
    return padded.mapInArrow(search, "doc_id long, item_id long, n_hits long")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """Hits added up by document and item: ``(doc_id, item_id, n_hits)``."""
    return hits(docs, benchmark, n).groupBy("doc_id", "item_id").agg(F.sum("n_hits").alias("n_hits"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM) -> DataFrame:
    """The documents without any hit, with all their columns, in one pass and without a shuffle."""
    shared, name = _shared(docs, benchmark)

    def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matchers, _ = matchers_of(name, shared, n)
        for whole in parts:
            out = []
            for piece in slices(iter([pa.RecordBatch.from_arrays([whole], ["t"])]), 0):
                buf, offsets = text_buffer(piece.column(0))
                ok = np.ones(piece.num_rows, bool)
                for m in matchers:
                    ok[np.searchsorted(offsets, m.search(buf)[0], side="right") - 1] = False
                out.append(ok)
            yield pa.array(np.concatenate(out) if out else np.zeros(0, bool))

    clean.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.filter(F.arrow_udf(clean, "boolean")(F.concat(F.lit(" "), normalized(F.col("text")), F.lit(" "))))
