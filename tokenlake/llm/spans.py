"""Windows of ``WIDTH`` words, their anchors, and the spans that repeated windows cover.

A window is a run of ``WIDTH`` words at any position of a text.  Its *anchor* is
the run of ``GRAM`` words inside it with the smallest hash, the leftmost of
equals, so equal windows have equal anchors at equal places.  Successive windows
mostly share their anchor, hence a text of n words has about
2 n / (WIDTH - GRAM + 2) anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed
from .words import text_buffer, window_hashes, word_hashes

WIDTH = 50
GRAM = 25
SPANS = "doc_id long, key long, start long, stop long, later boolean"
RESULT = "doc_id long, key long, start_word long, n_words long, removable_words long"


def anchored(words: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the texts' words: anchor hash, text, first window, number of windows and anchor's word of each run; the windows' hashes in order."""
    n = len(words)
    full, start = window_hashes(words, offsets, width)
    z = np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, np.uint64), z, z, z, z, full
    g = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    gh, gs = window_hashes(words, offsets, gram)
    g[gs] = gh
    reach = width - gram + 1
    value, at, have = g, np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64), 1
    while have < reach:
        step = min(have, reach - have)
        left, right = value[:-step], value[step:]
        take = left <= right
        at = np.where(take, at[:-step], at[step:])
        value = np.where(take, left, right)
        have += step
    anchor_at, anchor = at[start], value[start]
    new = np.r_[True, (anchor_at[1:] != anchor_at[:-1]) | (start[1:] != start[:-1] + 1)]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(start)])
    text = np.searchsorted(offsets, start[first], side="right") - 1
    return anchor[first], text, start[first] - offsets[text], count, anchor_at[first].astype(np.int64), full


def runs(texts: pa.Array, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' windows: anchor hash, text number, first window and number of windows of each run; the windows' hashes in order."""
    words, _, _, offsets = word_hashes(*text_buffer(texts))
    anchor, text, start, count, _, full = anchored(words, offsets, width, gram)
    return anchor, text, start, count, full


def ragged(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``count[i]`` of them) for each i in turn."""
    if not len(first):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal spans of each document of this partition, with the words of theirs that later windows cover."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    doc, key, s, e, late = (np.asarray(t.column(i)) for i in range(5))
    order = np.lexsort((s, key, doc))
    doc, key, s, e, late = doc[order], key[order], s[order], e[order], late[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]
    base = (np.cumsum(new) - 1).astype(np.int64) << 40

    def covered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End of all before each interval, and the words it adds to them."""
        before = np.r_[np.int64(-1), np.maximum.accumulate(b)[:-1]] if len(b) else b
        return before, np.maximum(0, b - np.maximum(a, before))

    before, _ = covered(base + s, base + e)
    head = np.flatnonzero(base + s > before)
    top = np.maximum.reduceat(base + e, head) - base[head]
    removable = np.zeros(len(head), np.int64)
    if late.any():
        _, add = covered((base + s)[late], (base + e)[late])
        np.add.at(removable, np.searchsorted(head, np.flatnonzero(late), side="right") - 1, add)
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[head], key[head], s[head], top - s[head], removable)], ["doc_id", "key", "start_word", "n_words", "removable_words"])


def merged(spans: DataFrame) -> DataFrame:
    """Spans of the windows joined into maximal ones: ``(doc_id, key, start_word, n_words, removable_words)``."""
    return spans.repartition("doc_id", "key").mapInArrow(_merge, RESULT)


def report(spans: DataFrame) -> DataFrame:
    """The maximal spans without the helper key."""
    return merged(spans).select(packed.null_back(), "start_word", "n_words", "removable_words")
