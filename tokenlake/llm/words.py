"""Vectorised word hashing shared by the operators of this subpackage.

A *word* is a maximal run of ASCII letters, digits and non-ASCII bytes; ASCII
letters are folded to lower case; everything else separates words.  Hashes are
64-bit polynomial hashes of a word's bytes, mixed so that every bit is usable;
words of over ``LONG`` bytes, among which such hashes have systematic collisions,
are hashed by XXH3.
They depend on the word alone, so they agree between tasks and machines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
LONG = 256

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
IS_WORD[128:] = True
#: Folded byte of a word character, 0 for a separator.
WORD_BYTE = np.where(IS_WORD, FOLD, 0).astype(np.uint8)

_pow: dict[int, np.ndarray] = {_R: np.ones(1, np.uint64), _RINV: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below n, modulo 2**64 (grown by doubling and kept)."""
    p = _pow.setdefault(base, np.ones(1, np.uint64))
    while len(p) < n:
        step = np.uint64(pow(base, len(p), 1 << 64))
        p = np.concatenate([p, p * step])
    _pow[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser (the one of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets into them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    if len(texts) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _segment(buf: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(buf)
    folded = WORD_BYTE[buf]
    inside = folded != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cut = breaks[(breaks > 0) & (breaks < n)]
    start[cut] = inside[cut]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cut - 1] = inside[cut - 1]
    s = np.flatnonzero(start)
    e = np.flatnonzero(end) + 1
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(folded * powers(_R, n), out=h[1:])
    out = mix((h[e] - h[s]) * powers(_RINV, n)[s] + (e - s).astype(np.uint64))
    for i in np.flatnonzero(e - s > LONG).tolist():
        out[i] = xxh3_64_intdigest(folded[s[i] : e[i]].tobytes())
    return s, e, out


def word_hashes(buf: np.ndarray, offsets: np.ndarray, piece: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, byte start and byte end of every word, and n + 1 word offsets of the texts.

    Words never span two texts.  The buffer is worked through in pieces cut at
    text borders or, in a longer text, at separators, which bounds the memory.
    """
    hs, ss, es, at, n = [], [], [], 0, len(buf)
    while at < n:
        stop = min(n, at + piece)
        if stop < n:
            k = int(np.searchsorted(offsets, stop, side="right")) - 1
            if offsets[k] > at:
                stop = int(offsets[k])
            else:
                while stop < n and IS_WORD[buf[stop]]:  # on to the next separator
                    gap = np.flatnonzero(~IS_WORD[buf[stop : stop + piece]])
                    stop = min(n, stop + (int(gap[0]) if len(gap) else piece))
        lo, hi = np.searchsorted(offsets, [at, stop])
        s, e, h = _segment(buf[at:stop], offsets[lo : hi + 1] - at)
        hs.append(h)
        ss.append(s + at)
        es.append(e + at)
        at = stop
    if not hs:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    s = np.concatenate(ss)
    return np.concatenate(hs), s, np.concatenate(es), np.searchsorted(s, offsets).astype(np.int64)


def window_hashes(words: np.ndarray, word_offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``width`` words inside one text, in order."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(_R, n), out=h[1:])
    text = np.repeat(np.arange(len(word_offsets) - 1), np.diff(word_offsets))
    start = np.flatnonzero(text[: n - width + 1] == text[width - 1 :])
    return mix((h[start + width] - h[start]) * powers(_RINV, n)[start]), start
