"""The malformed-UTF-8 path: columns of bytes that no string function may touch.

Clean rows take the JVM path of ``text``; these Arrow functions are for the rest.
Decoding is strict: a bad first or missing continuation byte is one U+FFFD and
one byte long, an overlong, surrogate or too large sequence one U+FFFD for all
of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

from . import arrays as A
from . import text as T

REPLACEMENT = 0xFFFD
_LEAST = {2: 0x80, 3: 0x800, 4: 0x10000}


def _table() -> list[str]:
    out = {}
    for kind, ranges in (("space", T.SPACE), ("digit", T.DIGIT), ("letter", T.LETTER)):
        for a, b in ranges:
            out |= dict.fromkeys(range(a, b + 1), kind)
    return out


_KIND = _table()


def codepoints(data: bytes) -> Iterator[tuple[int, int]]:
    """Code point and number of bytes of each step through ``data``."""
    at, end = 0, len(data)
    while at < end:
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 0
        tail = data[at + 1 : at + size]
        if size == 1:
            code = lead
        elif not size or len(tail) < size - 1 or any(b >> 6 != 2 for b in tail):
            code, size = REPLACEMENT, 1
        else:
            code = lead & (0x7F >> size)
            for b in tail:
                code = code << 6 | b & 0x3F
            if code < _LEAST[size] or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
                code = REPLACEMENT
        yield code, size
        at += size


def encode_codepoint(code: int) -> bytes:
    """UTF-8 of a code point; empty for surrogates and beyond U+10FFFF."""
    return b"" if 0xD800 <= code <= 0xDFFF or not 0 <= code <= 0x10FFFF else chr(code).encode()


def split(data: bytes) -> list[bytes]:
    """Pre-tokens of possibly malformed bytes."""
    steps, at = [], 0
    for code, size in codepoints(data):
        steps.append((_KIND.get(code, at), data[at : at + size]))
        at += size
    return [b"".join(x for _, x in run) for _, run in groupby(steps, key=lambda s: s[0])]


def length(data: bytes) -> int:
    return sum(1 for _ in codepoints(data))


def valid(data: bytes) -> bool:
    return all(code != REPLACEMENT for code, _ in codepoints(data))


def repaired(data: bytes) -> str:
    return "".join(chr(code) for code, _ in codepoints(data))


_CODES = {"space": 1, "digit": 2, "letter": 3}
_CLASS = np.zeros(0x110000, np.uint8)
_CLASS[list(_KIND)] = [_CODES[k] for k in _KIND.values()]


def steps(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``codepoints`` of many values at once: where the steps begin in ``data``, and their code points.

    A sequence of the right form begins with a byte that no other one continues with,
    so such sequences do not overlap, and whatever they leave are steps of one byte.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    high = np.flatnonzero(data >= 0xC0)
    lead = data[high]
    size = np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, 0)))
    room = bounds[np.searchsorted(bounds, high, side="right")] - high
    code = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07)).astype(np.int32)
    good = (size > 0) & (size <= room)
    for k in (1, 2, 3):
        on = np.flatnonzero(good & (size > k))
        tail = data[high[on] + k]
        code[on] = code[on] << 6 | tail & 0x3F
        good[on] &= tail >> 6 == 2
    least = np.select([size == 2, size == 3], [_LEAST[2], _LEAST[3]], _LEAST[4])
    code[~good | (code < least) | ((code >= 0xD800) & (code <= 0xDFFF)) | (code > 0x10FFFF)] = REPLACEMENT
    begins = np.ones(len(data), bool)
    for k in (1, 2, 3):
        begins[high[good & (size > k)] + k] = False
    codes = data.astype(np.int32)
    codes[data >= 0x80] = REPLACEMENT
    codes[high] = code
    at = np.flatnonzero(begins)
    return at, codes[at]


def _lengths(column: pa.Array) -> pa.Array:
    data, bounds = A.raw(column)
    at, _ = steps(data, bounds)
    return pa.array(np.diff(np.searchsorted(at, bounds)).astype(np.int32), mask=None if (m := A.nulls(column)) is None else np.asarray(m))


def chunks(column: pa.Array) -> pa.Array:
    """``split`` of each value of a binary column."""
    data, bounds = A.raw(column)
    at, codes = steps(data, bounds)
    kind = _CLASS[codes]
    first = np.ones(len(at), bool)
    first[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1])
    first[np.searchsorted(at, bounds[:-1][np.diff(bounds) > 0])] = True
    begin = at[first]
    ends = pa.array(np.r_[begin, len(data)].astype(np.int32))
    values = pa.Array.from_buffers(pa.binary(), len(begin), [None, ends.buffers()[1], pa.py_buffer(data)])
    return A.lists(values, np.searchsorted(begin, bounds), A.nulls(column))


def _repaired(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else repaired(x) for x in column.to_pylist()], pa.string())


def pretokens_binary():  # noqa: ANN201
    """Column function: binary to an array of binary chunks."""
    return A.function(lambda: chunks, "array<binary>")


def strlen_binary():  # noqa: ANN201
    """Column function: number of decoding steps."""
    return A.function(lambda: _lengths, "int")


def repair_binary():  # noqa: ANN201
    """Column function: text with U+FFFD for damage."""
    return A.function(lambda: _repaired, "string")
