"""Line dedup by a deletion-neighbourhood join.

A line (between newlines) is dropped when an earlier line, in order of (doc_id,
hash of text, line number), is equal to it, whatever its length, or, for lines of
at least ``MIN_CHARS`` characters, within one edit: a character inserted, deleted
or replaced.  Whether that earlier line is dropped itself makes no difference.

The join works on distinct lines in two steps, each of which emits variants of a
line as 64-bit hashed keys and joins equal ones:

1. *Block deletions.*  Of a line of n characters a block of less than 2 T is
   deleted between a prefix and a suffix whose lengths are multiples of T, for
   every such pair; T is the power of two with 4 T <= n < 8 T, so there are at
   most 18 variants, whatever the length.  Lines within one edit share the
   variant that deletes the blocks around the edit.  Only lines that share a
   variant with a different line go on.
2. *Character deletions.*  Those lines emit all variants within the bound: the
   line without character i, tagged with i, for each i (equal variants are lines
   that differ by a replacement there), the line without character i, untagged,
   and the line itself (equal variants are an insertion or deletion).

The earliest line of each group of equal tagged variants is a neighbour of all
others there, and a line that equals shortened ones is a neighbour of theirs; the
edit distance is then verified on the texts, and each line keeps the earliest of
its neighbours.

Equal lines are equal in a 128-bit hash of their bytes; lines within one edit are
compared as they are.

Defined results
* lines are compared as they are: case and spaces count, a carriage return is
  part of the line.  One edit turns lines of fewer than ``MIN_CHARS`` characters
  into other words, so these have equal lines only.  Shorter lines of nothing but
  white space are never dropped, as they part paragraphs.
* null and empty texts have no lines to drop and stay as they are.
* very long texts and lines are worked on whole; costs are linear in their length,
  and in the lines dropped of a document.
* rows equal in doc_id and text are one document; its lines are judged once.
* ties: of several earlier lines the first in the order above is reported, an
  equal one or not.
* a null doc_id comes first and is reported as null.
* ``deduplicated`` returns all rows and columns, whatever their names; text has the
  lines left, and n_chars, where there is such a column, their length.  A text
  whose lines are all dropped becomes empty, or its row goes where ``emptied`` is
  false.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from . import packed
from .common import fresh, release, stable
from .spans import ragged
from .words import _R, _RINV, mix, powers

MIN_CHARS = 20
#: White space: a line of nothing else is blank.
BLANK = np.array([9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
#: Bytes of lines that are hashed at once; an array of their characters takes 8 times as much, and there are some twenty.
PIECE = 1 << 18
#: Characters of lines whose variants are packed at once.
SPELLED = 1 << 16
#: At most so many line hashes are broadcast (8 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 4 << 20
#: At most so many documents' lines to drop are broadcast.
MAX_DOCS = 1 << 20
VARIANT = np.dtype([("variant", "<u8"), ("line", "<u8"), ("kind", "u1")])
#: Kinds of variants: joined with their like, or a shortened line with the line that it equals.
LIKE, SHORTENED, WHOLE = 0, 1, 2
#: Lines that a task remembers, to emit the variants of frequent ones once.
REMEMBER = 1 << 17
_TAG = np.uint64(0xC2B2AE3D27D4EB4F)


class Lines:
    """Lines of some texts as code points in one array, with prefix hashes."""

    def __init__(self, texts: list[str], least: int, short: bool = False):
        self.of = np.repeat(np.arange(len(texts)), [t.count("\n") + 1 for t in texts])
        joined = "\n".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cut = np.flatnonzero(code == 10)
        start, stop = np.r_[0, cut + 1], np.r_[cut, len(code)]
        first = np.r_[True, self.of[1:] != self.of[:-1]] if len(self.of) else np.zeros(0, bool)
        number = np.arange(len(self.of)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(self.of) else self.of
        on = stop - start >= least
        if short:
            full = np.r_[0, np.cumsum(~np.isin(code, BLANK))]
            on |= full[stop] > full[start]
        on = np.flatnonzero(on)
        self.of, self.number, self.start, self.stop = self.of[on], number[on], start[on], stop[on]
        n = len(code)
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum((code.astype(np.uint64) + np.uint64(1)) * powers(_R, n), out=self.sum[1:])
        self.back = powers(_RINV, n + 1)
        self.hash = self.part(self.start, self.stop)
        digest = b"".join(xxh3_128_digest(joined[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(self.start.tolist(), self.stop.tolist()))
        #: Both halves of the hash that stands for a line.
        self.line, self.rest = np.frombuffer(digest, "<u8").reshape(-1, 2).T.copy()

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the characters from a to b."""
        return mix((self.sum[b] - self.sum[a]) * self.back[a] + (b - a).astype(np.uint64))

    def pair(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Hash of characters a to b followed by c to d, as one string."""
        size = (b - a).astype(np.int64)
        joined = (self.sum[b] - self.sum[a]) * self.back[a] + (self.sum[d] - self.sum[c]) * self.back[c] * powers(_R, int(size.max(initial=0)) + 1)[size]
        return mix(joined + (size + (d - c)).astype(np.uint64))

    def text(self, joined: str, i: int) -> str:
        return joined[self.start[i] : self.stop[i]]


def block(n: np.ndarray) -> np.ndarray:
    """T of each line length."""
    return np.left_shift(np.int64(1), np.maximum(np.floor(np.log2(np.maximum(n, 4) + 0.5)).astype(np.int64) - 2, 0))


def block_variants(lines: Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line hash, variant key and kind of each block deletion of the chosen lines."""
    n = lines.stop[which] - lines.start[which]
    keys, owners = [], []
    t = block(n)
    # a line one longer than the last length of a smaller T meets that length under its T
    for i, step in ((np.arange(len(n)), t), (np.flatnonzero(block(n - 1) < t), block(n - 1))):
        m, step = n[i], step[i]
        count = m // step + 1
        row = np.repeat(np.arange(len(i)), count)
        p = ragged(np.zeros(len(i), np.int64), count) * step[row]
        most = (m[row] - p) // step[row] * step[row]
        for q in (most, most - step[row]):
            ok = q >= 0
            r, a, b = i[row[ok]], p[ok], q[ok]
            s, e = lines.start[which[r]], lines.stop[which[r]]
            head, tail = lines.part(s, s + a), lines.part(e - b, e)
            keys.append(mix(head * np.uint64(3) + mix(tail ^ _TAG)))
            owners.append(lines.line[which[r]])
    key = np.concatenate(keys)
    return np.concatenate(owners), key, np.full(len(key), LIKE)


def char_variants(lines: Lines, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line hash, variant key and kind of each character deletion, tagged and untagged, and of the line itself."""
    n = (lines.stop - lines.start)[which]
    row = np.repeat(which, n)
    i = ragged(lines.start[which], n)
    gone = lines.pair(lines.start[row], i, i + 1, lines.stop[row])
    tagged = mix(gone ^ ((i - lines.start[row]).astype(np.uint64) + np.uint64(1)) * _TAG)
    owner = np.concatenate([lines.line[row], lines.line[row], lines.line[which]])
    return owner, np.concatenate([tagged, gone, lines.hash[which]]), np.repeat([LIKE, SHORTENED, WHOLE], [len(row), len(row), len(which)])


def _pieces(batches: Iterator[pa.RecordBatch], least: int, short: bool = False) -> Iterator[tuple[pa.RecordBatch, str, Lines]]:
    for batch in packed.slices(batches, 2, PIECE):
        texts = batch.column(2).to_pylist()
        yield batch, "\n".join(texts), Lines(texts, least, short)


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def occurrences(rows: DataFrame, least: int) -> DataFrame:
    """``(line, rest, doc_id, key, line_no)`` of every line of ``rows`` that is judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, lines in _pieces(batches, least, True):
            yield pa.RecordBatch.from_arrays([_signed(lines.line), _signed(lines.rest), pa.array(np.asarray(batch.column(0))[lines.of]), pa.array(np.asarray(batch.column(1))[lines.of]), pa.array(lines.number.astype(np.int32))], ["line", "rest", "doc_id", "key", "line_no"])

    return rows.mapInArrow(run, "line long, rest long, doc_id long, key long, line_no int")


def _packed(variants: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> Iterator[pa.RecordBatch]:
    r = np.empty(len(variants[0]), VARIANT)
    r["line"], r["variant"], r["kind"] = variants
    out = packed.pack(r, packed.bucket(r["variant"], n), n)
    if out is not None:
        yield out


def _send(n: int, least: int):  # noqa: ANN202
    """Map function that packs the block deletions of the distinct lines of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, _, lines in _pieces(batches, least):
            h, which = np.unique(lines.line, return_index=True)
            new = np.fromiter((x not in seen for x in h.tolist()), bool, len(h))
            which = which[new]
            seen.update(h[new].tolist())
            if len(seen) > REMEMBER:
                seen.clear()
            for lo in range(0, len(which), 1 << 12):
                yield from _packed(block_variants(lines, which[lo : lo + (1 << 12)]), n)

    return run


def _shared(blocks: Iterator[pa.RecordBatch]) -> np.ndarray:
    """Records of variants that two or more different lines have, each once."""
    r = packed.unpack(blocks, VARIANT)
    if not len(r):
        return r
    r = r[np.lexsort((r["line"], r["variant"]))]
    r = r[np.r_[True, (r["variant"][1:] != r["variant"][:-1]) | (r["line"][1:] != r["line"][:-1])]]
    same = r["variant"][1:] == r["variant"][:-1]
    return r[np.r_[False, same] | np.r_[same, False]]


def candidates(rows: DataFrame, least: int) -> DataFrame:
    """``line`` hashes that share a block deletion with a different line."""

    def meet(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _shared(blocks)
        yield pa.RecordBatch.from_arrays([_signed(np.unique(r["line"]))], ["line"])

    n = packed.partitions(rows.sparkSession, rows)
    return stable(packed.exchange(rows, _send(n, least), meet, "line long", n).distinct())


def _hashes(lines: DataFrame) -> np.ndarray:
    """The hashes of a table of bounded size, packed by its tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column(0)).tobytes()], pa.binary())], ["data"])

    return np.sort(np.frombuffer(b"".join(r[0] for r in lines.mapInArrow(pack, "data binary").collect()), np.uint64))


def among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted ``known``, by bisection: what a piece of text costs hardly grows with ``known``."""
    at = np.searchsorted(known, h)
    on = at < len(known)
    on[on] = known[at[on]] == h[on]
    return on


def _chosen(rows: DataFrame, lines: DataFrame, least: int) -> DataFrame:
    """``(line, rest, text)`` of the distinct chosen lines; their hashes are broadcast if they are few enough."""
    few = lines.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    shared = rows.sparkSession.sparkContext.broadcast(_hashes(lines)) if few else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, joined, ls in _pieces(batches, least):
            on = np.arange(len(ls.line)) if shared is None else np.flatnonzero(among(ls.line, shared.value))
            h, which = np.unique(np.c_[ls.line[on], ls.rest[on]], axis=0, return_index=True)
            which = on[which]
            yield pa.RecordBatch.from_arrays([_signed(h[:, 0].copy()), _signed(h[:, 1].copy()), pa.array([ls.text(joined, i) for i in which.tolist()], pa.string())], ["line", "rest", "text"])

    texts = rows.mapInArrow(run, "line long, rest long, text string")
    if shared is None:
        texts = texts.join(lines, "line", "left_semi")
    return texts.groupBy("line", "rest").agg(F.min("text").alias("text"))


def within_one(a: str, b: str) -> bool:
    """Whether one edit at most leads from a to b; linear in their length."""
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    differ = np.flatnonzero(x != y[: len(x)])
    return not len(differ) or (len(a) == len(b) and len(differ) == 1) or (len(a) < len(b) and np.array_equal(x[differ[0] :], y[differ[0] + 1 :]))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(line, rest, at)`` of the pairs whose texts are within one edit."""
    for batch in batches:
        ok = [within_one(a.as_py(), b.as_py()) for a, b in zip(batch.column(3), batch.column(4))]
        yield batch.select([0, 1, 2]).filter(pa.array(ok, pa.bool_()))


def neighbours(rows: DataFrame, first: DataFrame, least: int) -> DataFrame:
    """``(line, rest, at)``: each distinct line that has an earlier one within one edit, and the earliest such place.

    ``first`` has each line's earliest place ``at``.  Half of a line's hash is
    enough to find candidates: whoever shares it is compared too.
    """
    chosen = candidates(rows, least)
    release(rows.sparkSession)  # of the block deletions
    known = stable(_chosen(rows, chosen, least).join(first, ["line", "rest"]))
    release(rows.sparkSession)
    n = packed.partitions(rows.sparkSession, rows)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in packed.slices(batches, 1, PIECE):
            lines = Lines(batch.column(1).to_pylist(), 0)
            so_far = np.cumsum(lines.stop - lines.start)
            for which in np.split(np.arange(len(so_far)), np.flatnonzero(np.diff(so_far // SPELLED)) + 1):
                yield from _packed(char_variants(lines, which), n)

    def meet(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = _shared(blocks)
        yield pa.RecordBatch.from_arrays([_signed(r["variant"]), _signed(r["line"]), pa.array(r["kind"].astype(np.int8))], ["variant", "line", "kind"])

    groups = packed.exchange(known.select("line", "text"), emit, meet, "variant long, line long, kind byte", n).join(known.select("line", "at"), "line")

    def lowest(kind: int) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.struct("at", "line"))).over(Window.partitionBy("variant"))

    other = F.when(F.col("kind") == LIKE, lowest(LIKE)).when(F.col("kind") == SHORTENED, lowest(WHOLE)).otherwise(lowest(SHORTENED))
    best = groups.withColumn("low", other).filter("low.line <> line")
    pairs = best.select("line", F.col("low.line").alias("other")).distinct()
    a, b = known.alias("a"), known.alias("b")
    ok = pairs.join(a.select("line", "rest", F.col("text").alias("mine")), "line").join(b.select(F.col("line").alias("other"), F.col("text").alias("theirs"), "at"), "other").select("line", "rest", "at", "mine", "theirs").mapInArrow(_verified, "line long, rest long, at struct<doc_id:long,key:long,line_no:int>")
    return ok.groupBy("line", "rest").agg(F.min("at").alias("at"))


def dropped(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, key, line_no, at)``: every line to drop, and the place of the line that stands for it."""
    rows = packed.identity(docs)
    spots = stable(occurrences(rows, least).distinct())
    first = stable(spots.groupBy("line", "rest").agg(F.min(F.struct("doc_id", "key", "line_no")).alias("at")))
    near = neighbours(rows, first, least).withColumnRenamed("at", "near")
    place = F.struct("doc_id", "key", "line_no")
    return (
        spots.join(first, ["line", "rest"])
        .join(near, ["line", "rest"], "left")
        .withColumn("to", F.when((F.col("at") < place) & (F.col("near").isNull() | (F.col("at") < F.col("near"))), F.col("at")).otherwise(F.col("near")))
        .filter(F.col("to") < place)
        .select("doc_id", "key", "line_no", F.col("to").alias("at"), F.when(F.col("to") == F.col("at"), 0).otherwise(1).alias("distance"))
    )


def report(docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """``(doc_id, line_no, first_doc_id, first_line_no, distance)`` of every line to drop; lines are numbered from 0."""
    return dropped(docs, least).select(packed.null_back(), "line_no", packed.null_back("at.doc_id", "at.key").alias("first_doc_id"), F.col("at.line_no").alias("first_line_no"), "distance")


def deduplicated(docs: DataFrame, least: int = MIN_CHARS, emptied: bool = True) -> DataFrame:
    """The documents without the lines to drop; those of which no line is left go too unless ``emptied``.

    The places of the lines to drop are broadcast after a check of their number;
    beyond, they are joined by a shuffle.
    """
    a, b, gone, lines = fresh("doc"), fresh("key"), fresh("gone"), fresh("lines")
    out = stable(dropped(docs, least).groupBy(F.col("doc_id").alias(a), F.col("key").alias(b)).agg(F.collect_set("line_no").alias(gone)))
    n = out.agg(F.count("*"), F.sum(F.size(gone))).first()
    if n[0] <= MAX_DOCS and (n[1] or 0) <= MAX_BROADCAST:
        out = F.broadcast(out)
    doc, key = packed.row_id(F.col("doc_id"), F.col("text"))
    rows = docs.withColumns({a: doc, b: key}).join(out, [a, b], "left")
    # the places left, in order, by one pass over each list
    rows = rows.withColumn(lines, F.when(F.col(gone).isNotNull(), F.split(F.col("text").cast("string"), "\n", -1)))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n")
    rows = rows.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    if not emptied:
        rows = rows.filter(F.col(gone).isNull() | F.col("text").rlike(r"[^\s\x0B\x{85}\p{Z}]"))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
