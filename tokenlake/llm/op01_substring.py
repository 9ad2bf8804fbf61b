"""Substring dedup with a count-min prefilter.

Passages of at least ``WIDTH`` words that occur more than once, in any two
places of the corpus, are found in two passes.  The first counts the anchors of
all windows (see ``spans``) in a count-min sketch by partition; the sketches are
merged by range of cells, with counters that stop at 2, as only "repeated or
not" is asked.  An anchor occurs at least as often as each of its windows, and a
sketch never underestimates, so no repeated window is lost.  The second pass
groups exactly those windows whose anchors are estimated to be repeated.

Windows meet by 128 bits of hashes of their words, not by their anchor, so what
many documents share does not draw the windows around it into one task.  A map
task first combines equal windows: only the earliest travels, and the others,
which are repeated and not the earliest whatever else there is, are reported at
once.  A group of copies thus sends one record a window and task.

The merged sketch is broadcast as one bit a cell.  Its width follows the size of
the corpus up to ``MAX_BITS`` in all, 128 MB; a larger corpus gets more false
positives, hence a larger second pass, and the same result.

Result: the maximal spans of words covered by repeated windows, as ``(doc_id,
start_word, n_words, removable_words)``; ``removable_words`` counts those covered
by windows that occurred earlier, in order of (doc_id, hash of text, position).

Defined results
* words are compared in lower case (ASCII) and without what is between them.
* null and empty texts, and texts of fewer than ``WIDTH`` words, have no spans.
* very long texts are worked on whole, one at a time.
* rows equal in doc_id and text are repeats of each other and reported once.
* ties: of equal windows the one that comes first in the order above is the
  original, the others are removable.
* a null doc_id is reported as null and comes first.
* extra columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed, spans
from .words import mix, text_buffer, window_hashes, word_hashes

#: Rows of the sketch.
ROWS = 2
#: Cells a row for each expected anchor.
LOAD = 4
#: Bytes of text to one expected anchor.
BYTES_PER_ANCHOR = 64
#: Cells of all rows at most.
MAX_BITS = 1 << 30
MIN_BITS = 1 << 16
_SEEDS = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3))
CELLS = np.dtype([("cell", "<u4"), ("count", "u1")])
#: Two hashes of a window's words, its place, and whether it is known to be repeated.
WINDOW = np.dtype([("h", "<u8"), ("g", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("start", "<i4"), ("twice", "u1")])
#: Windows that a map task gathers before it combines and sends them.
FLUSH = 1 << 20
_OTHER = np.uint64(0x8CB92BA72F3D8DD7)


def row_bits(total_bytes: int) -> int:
    """Binary logarithm of the cells in a row of the sketch."""
    want = max(MIN_BITS, min(MAX_BITS // ROWS, LOAD * total_bytes // BYTES_PER_ANCHOR))
    return int(want - 1).bit_length()


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Cell of each hash in each row."""
    return [mix(h ^ _SEEDS[r]) >> np.uint64(64 - bits) for r in range(ROWS)]


def sketch(docs: DataFrame, width: int = spans.WIDTH, gram: int = spans.GRAM) -> tuple[bytes, int]:
    """Merged sketch: for each row and cell in turn a bit that says whether the count is 2 or more; and ``row_bits``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = row_bits(total)
    # a range of cells for each partition, of whole bytes
    n = min(packed.partitions(docs.sparkSession), (ROWS << bits) // 64)
    span = -(-(ROWS << bits) // n) // 8 * 8 + 8

    def part_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held)
            cell = np.concatenate([c + np.uint64(r << bits) for r, c in enumerate(cells(h, bits))])
            cell.sort()
            head = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            r = np.empty(len(head), CELLS)
            part = cell[head].astype(np.int64) // span
            r["cell"], r["count"] = cell[head] - (part * span).astype(np.uint64), np.minimum(np.diff(np.r_[head, len(cell)]), 2)
            yield packed.pack(r, part, n)

        for batch in packed.slices(batches, 2):
            held.append(spans.runs(batch.column(2), width, gram)[0])
            if sum(map(len, held)) > 1 << 21:
                yield from out()
                held = []
        if sum(map(len, held)):
            yield from out()

    def merge(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, part = np.zeros(span, np.uint8), -1
        for batch in blocks:
            part = batch.column(0)[0].as_py()
            for k in range(batch.num_rows):
                r = packed.unpack(iter([batch.slice(k, 1)]), CELLS)
                count[r["cell"]] = np.minimum(count[r["cell"]] + r["count"], 2)
        if part >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(count == 2, bitorder="little").tobytes()], pa.binary())], ["part", "data"])

    out = bytearray(span // 8 * n)
    for row in packed.exchange(docs, part_sketch, merge, packed.SCHEMA, n).collect():  # MAX_BITS / 8 bytes at most
        out[row["part"] * span // 8 : (row["part"] + 1) * span // 8] = row["data"]
    return bytes(out), bits


def in_groups(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows sorted by hashes and place, and which of them begin a group of equal ones."""
    r = r[np.lexsort((r["start"], r["key"], r["doc"], r["g"], r["h"]))]
    return r, np.r_[True, (r["h"][1:] != r["h"][:-1]) | (r["g"][1:] != r["g"][:-1])] if len(r) else np.zeros(0, bool)


def combined(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The earliest of equal windows, and the others."""
    r, head = in_groups(r)
    first = r[head]
    many = np.diff(np.r_[np.flatnonzero(head), len(r)]) > 1
    first["twice"] = np.maximum(np.maximum.reduceat(r["twice"], np.flatnonzero(head)), many) if len(r) else 0
    return first, r[~head]


def window_runs(r: np.ndarray, later: np.ndarray, width: int) -> pa.RecordBatch:
    """Spans of successive windows of one document and state."""
    order = np.lexsort((r["start"], later, r["key"], r["doc"]))
    r, later = r[order], later[order]
    new = np.r_[True, (r["doc"][1:] != r["doc"][:-1]) | (r["key"][1:] != r["key"][:-1]) | (later[1:] != later[:-1]) | (r["start"][1:] > r["start"][:-1] + 1)] if len(r) else np.zeros(0, bool)
    a = np.flatnonzero(new)
    b = np.r_[a[1:], len(r)] - 1 if len(a) else a
    return pa.RecordBatch.from_arrays([pa.array(r["doc"][a]), pa.array(r["key"][a]), pa.array(r["start"][a].astype(np.int64)), pa.array(r["start"][b].astype(np.int64) + width), pa.array(later[a])], ["doc_id", "key", "start", "stop", "later"])


def exact(blocks: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Spans of the windows of a partition that really occur more than once."""
    r = packed.unpack(blocks, WINDOW)
    if not len(r):
        return
    first, rest = combined(r[r["h"] > 0])
    known = r[r["h"] == 0]  # windows that a map task has found to be repeated and not the earliest
    again = first[first["twice"] > 0]
    late = np.concatenate([rest, known])
    yield window_runs(np.concatenate([again, late]), np.r_[np.zeros(len(again), bool), np.ones(len(late), bool)], width)


def window_spans(docs: DataFrame, width: int = spans.WIDTH, gram: int = spans.GRAM) -> DataFrame:
    """Spans of repeated windows, not yet merged."""
    rows = packed.identity(docs)
    bitmap, bits = sketch(rows, width, gram)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    n = packed.partitions(docs.sparkSession, docs)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        held: list[np.ndarray] = []

        def likely(h: np.ndarray) -> np.ndarray:
            ok = np.ones(len(h), bool)
            for r, c in enumerate(cells(h, bits)):
                at = c + np.uint64(r << bits)
                ok &= (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return ok

        def out() -> Iterator[pa.RecordBatch]:
            first, rest = combined(np.concatenate(held))
            held.clear()
            rest["h"], rest["g"] = 0, 0
            for r, by in ((first, first["h"]), (rest, mix(rest["doc"].view(np.uint64) ^ rest["key"].view(np.uint64)))):
                block = packed.pack(r, packed.bucket(by, n), n)
                if block is not None:
                    yield block

        for batch in packed.slices(batches, 2):
            words, _, _, offsets = word_hashes(*text_buffer(batch.column(2)))
            anchor, text, start, count, _, full = spans.anchored(words, offsets, width, gram)
            other, _ = window_hashes(mix(words ^ _OTHER), offsets, width)
            on = np.flatnonzero(likely(anchor))
            at = spans.ragged(np.r_[0, np.cumsum(count)[:-1]].astype(np.int64)[on], count[on]) if len(on) else on
            r = np.empty(len(at), WINDOW)
            of = np.repeat(text[on], count[on])
            r["h"], r["g"], r["start"], r["twice"] = np.maximum(full[at], np.uint64(1)), other[at], spans.ragged(start[on], count[on]), 0
            r["doc"], r["key"] = np.asarray(batch.column(0))[of], np.asarray(batch.column(1))[of]
            held.append(r)
            if sum(map(len, held)) > FLUSH:
                yield from out()
        if sum(map(len, held)):
            yield from out()

    return packed.exchange(rows, send, lambda b: exact(b, width), spans.SPANS, n)


def repeated(docs: DataFrame, width: int = spans.WIDTH, gram: int = spans.GRAM) -> DataFrame:
    """``(doc_id, start_word, n_words, removable_words)`` of every maximal repeated span."""
    return spans.report(window_spans(docs, width, gram))
