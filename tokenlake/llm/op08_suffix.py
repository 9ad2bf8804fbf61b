"""Suffix-array dedup with a logarithmic family of indexes.

The corpus comes in batches, in one job or over the years: ``Family`` keeps its
index in a folder that all machines share, and ``add`` may meet what an earlier
run has left there.

A batch gets a sparse suffix array.  Its suffixes begin at the *anchors* of the
texts (see ``spans``): every window of ``WIDTH`` words holds its anchor, so a match
of ``WIDTH`` words or more holds an anchor at the same place in both texts.  An
entry has the anchor's hash, its place, and the words around it that windows with
this anchor have.  Entries are sharded and bucketed by the anchor's hash, and
within a bucket in order of the suffix that begins at the anchor.

* *Merge scan.*  A shard of the new batch is merged with that shard of every
  level.  Where a bucket has several entries, of the batch or of levels, their
  windows are compared by their words: of two entries the common words to the left
  and to the right of the anchor say which windows are equal; of more, the suffixes
  of all windows are put in order and neighbours with a longest common prefix
  of ``WIDTH`` words are equal.  No hash stands for a text.
* *Insertion.*  Entries with windows that are new to the family become a level.
  Levels of one size, to the power of two, merge, so that sizes grow
  geometrically: n entries are in at most log2(n) + 1 levels, and each is
  rewritten at most as often.
* *Levels* are Parquet files by shard, committed by Spark, and a small table
  names those that count; it is written last, so a job that is lost changes nothing.

Copies: entries of equal words are combined in the map task and again in the
shard; only the earliest stays and the others are reported at once.  A group of
copies thus sends one entry a task.  What a passage shared by many documents has
at its ends, windows with words of the document's own, does meet in one bucket;
buckets of over two entries are sorted, never compared pair by pair.

Result: as of substring dedup, with the order of batches first: ``(doc_id,
start_word, n_words, removable_words)``.

Defined results
* ``matches``: a document comes in batch doc_id modulo ``BATCHES`` (null: 0), within
  it in order of (doc_id, hash of text, position); earlier is what comes first.
* words are compared in lower case (ASCII) and without what is between them.
* null and empty texts, and texts of fewer than ``WIDTH`` words, have no spans.
* very long texts are worked on whole, one at a time.
* rows equal in doc_id and text are repeats of each other and reported once.
* ties: of equal windows the one that comes first in the order above is the
  original, the others are removable.
* a null doc_id is reported as null and comes first.
* extra columns are ignored, whatever their names; an empty table gives an empty
  one, and an empty batch leaves the family as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import packed, spans
from .common import ensure_checkpoint_dir, release, remove, remove_at_exit
from .words import WORD_BYTE, text_buffer, word_hashes

BATCHES = 8
GRAM = 8
#: Bytes of text to a shard of a new index, where that makes more shards than the session has shuffle partitions.
SHARD_BYTES = 256 << 20
#: Parts in which a shard is scanned and merged, one after the other.
PARTS = 16
#: Entries that a map task gathers before it sends them on, in bytes of their words.
FLUSH_BYTES = 32 << 20
#: start: first window; n: windows; at: words, and byte, bytes of words before the anchor; size: bytes of all words; twice: whether there are copies.
ENTRY = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("batch", "<i4"), ("start", "<i4"), ("n", "<i4"), ("at", "<i4"), ("byte", "<i4"), ("size", "<i4"), ("twice", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("key", "<i8"), ("start", "<i8"), ("stop", "<i8"), ("later", "u1")])
_FIELDS = ", ".join(f"{n} binary" for n in ("entries", "words"))
STEP = f"kind string, shard int, part int, doc_id long, key long, start long, stop long, later boolean, n_entries long, {_FIELDS}"


class Entries:
    """Entries and the words of all of them in one buffer."""

    def __init__(self, rows: np.ndarray, text: bytes):
        self.rows, self.text = rows, text
        self.begin = np.r_[0, np.cumsum(rows["size"], dtype=np.int64)]

    def words(self, i: int) -> bytes:
        return self.text[self.begin[i] : self.begin[i + 1]]

    def take(self, which: np.ndarray) -> Entries:
        begin, stop = self.begin[:-1][which].tolist(), self.begin[1:][which].tolist()
        return Entries(self.rows[which], b"".join(map(self.text.__getitem__, map(slice, begin, stop))))

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        return Entries(np.concatenate([p.rows for p in parts]) if parts else np.empty(0, ENTRY), b"".join(p.text for p in parts))

    def in_order(self) -> Entries:
        """By anchor, and within a bucket by the suffix that begins at the anchor."""
        order = np.argsort(self.rows["anchor"], kind="stable")
        for lo, hi in buckets(self.rows["anchor"][order]):
            order[lo:hi] = sorted(order[lo:hi].tolist(), key=lambda i: self.text[self.begin[i] + self.rows["byte"][i] : self.begin[i + 1]])
        return self.take(order)

    def to_bytes(self) -> tuple[bytes, bytes]:
        """Compressed: the fields one after the other, and the words."""
        import zstandard

        fields = b"".join(np.ascontiguousarray(self.rows[f]).view("u1").reshape(-1, ENTRY[f].itemsize).T.tobytes() for f in ENTRY.names)
        return zstandard.ZstdCompressor(level=3).compress(fields), zstandard.ZstdCompressor(level=3).compress(self.text)

    @classmethod
    def from_bytes(cls, fields: bytes, text: bytes) -> Entries:
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(fields)
        n, at = len(raw) // ENTRY.itemsize, 0
        rows = np.empty(n, ENTRY)
        for f in ENTRY.names:
            size = n * ENTRY[f].itemsize
            rows[f] = np.ascontiguousarray(np.frombuffer(raw, "u1", size, at).reshape(-1, n).T).view(ENTRY[f]).ravel() if n else 0
            at += size
        return cls(rows, zstandard.ZstdDecompressor().decompress(text) if text else b"")

    def parts(self) -> Iterator[tuple[int, Entries]]:
        """Cut by the anchors' last bits, which bounds what is worked on at once."""
        part = (self.rows["anchor"] % np.uint64(PARTS)).astype(np.int64)
        for p in np.unique(part).tolist():
            yield p, self.take(np.flatnonzero(part == p))


def buckets(anchor: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of two or more equal hashes."""
    cut = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True]) if len(anchor) else np.zeros(1, np.int64)
    many = np.flatnonzero(np.diff(cut) > 1)
    return zip(cut[many].tolist(), cut[many + 1].tolist())


def entries(texts: pa.Array, doc: np.ndarray, key: np.ndarray, batch: int, width: int, gram: int) -> Entries:
    """The entries of some texts."""
    buf, off = text_buffer(texts)
    h, s, e, offsets = word_hashes(buf, off)
    anchor, text, start, count, place, _ = spans.anchored(h, offsets, width, gram)
    if not len(anchor):
        return Entries(np.empty(0, ENTRY), b"")
    # all words, each followed by a blank
    size = e - s + 1
    ends = np.cumsum(size)
    at = np.minimum(spans.ragged(s, size), len(buf) - 1)
    joined = WORD_BYTE[buf[at]]
    joined[ends - 1] = 32
    joined = joined.tobytes()
    begin = np.r_[0, ends]
    rows = np.empty(len(anchor), ENTRY)
    first = offsets[text] + start
    last = first + count + width - 1
    rows["anchor"], rows["doc"], rows["key"], rows["batch"], rows["start"], rows["n"], rows["twice"] = anchor, doc[text], key[text], batch, start, count, 0
    rows["at"], rows["byte"], rows["size"] = place - first, begin[place] - begin[first], begin[last] - begin[first]
    return Entries(rows, b"".join(map(joined.__getitem__, map(slice, begin[first].tolist(), begin[last].tolist()))))


def order_of(rows: np.ndarray, i: int) -> tuple:
    """What comes first."""
    r = rows[i]
    return r["batch"], r["doc"], r["key"], r["start"]


def combined(e: Entries, width: int) -> tuple[Entries, np.ndarray]:
    """Of entries with equal words the earliest, and the spans of the others, all of which are later."""
    r = e.rows
    order = np.lexsort((r["start"], r["key"], r["doc"], r["batch"], r["size"], r["anchor"]))
    keep, twice, late = np.ones(len(r), bool), r["twice"].copy(), []
    same = (r["anchor"][order][1:] == r["anchor"][order][:-1]) & (r["size"][order][1:] == r["size"][order][:-1])
    cut = np.flatnonzero(np.r_[True, ~same, True]) if len(r) else np.zeros(1, np.int64)
    many = np.flatnonzero(np.diff(cut) > 1)
    for lo, hi in zip(cut[many].tolist(), cut[many + 1].tolist()):
        first: dict[bytes, int] = {}
        for i in order[lo:hi].tolist():
            j = first.setdefault(e.words(i), i)
            if j != i:
                keep[i], twice[j] = False, 1
                late.append(i)
    gone = r[np.array(late, np.int64)]
    out = np.empty(len(gone), SPAN)
    out["doc"], out["key"], out["start"], out["stop"], out["later"] = gone["doc"], gone["key"], gone["start"], gone["start"] + gone["n"] - 1 + width, 1
    if not len(gone):
        return e, out
    e = Entries(r.copy(), e.text)
    e.rows["twice"] = twice
    return e.take(np.flatnonzero(keep)), out


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def pair(e: Entries, i: int, j: int, width: int) -> tuple[int, int] | None:
    """First and last place before the anchor, in words, of windows that two entries of one bucket share."""
    a, b, r = e.words(i), e.words(j), e.rows
    x, y = int(r["byte"][i]), int(r["byte"][j])
    right = a.count(b" ", x, x + common(a[x:], b[y:]))
    if right < width - max(int(r["at"][i]), 0):
        return None
    p, q = a[:x][::-1], b[:y][::-1]
    k = common(p, q)
    # a word counts when it is common with the blank, or the border, before it
    left = p.count(b" ", 0, k) - 1 + ((k == len(p) or p[k : k + 1] == b" ") and (k == len(q) or q[k : k + 1] == b" ")) if k else 0
    most = min(left, int(r["at"][i]), int(r["at"][j]))
    least = max(width - right, int(r["at"][i] - r["n"][i]) + 1, int(r["at"][j] - r["n"][j]) + 1, 0)
    return (most, least) if most >= least else None


def equal_windows(e: Entries, which: list[int], width: int) -> list[list[tuple[int, int]]]:
    """Groups of equal windows ``(entry, window)`` of a bucket: neighbours in suffix order with a common prefix of ``width`` words."""
    suffixes = []
    for i in which:
        w = e.words(i)
        at = [0, *(np.flatnonzero(np.frombuffer(w, np.uint8) == 32) + 1).tolist()]
        suffixes += [(w[at[k] :], at[k + width] - at[k], i, k) for k in range(int(e.rows["n"][i]))]
    suffixes.sort()
    groups: list[list[tuple[int, int]]] = []
    before = None
    for text, size, i, k in suffixes:
        if before is not None and text.startswith(before):
            groups[-1].append((i, k))
        else:
            groups.append([(i, k)])
            before = text[:size]
    return [g for g in groups if len(g) > 1]


def scan(batch: Entries, levels: Entries, width: int) -> tuple[Entries, np.ndarray]:
    """Match a shard of a batch against that of the levels.

    Returns the entries that become a level, and the spans of repeated windows.
    """
    batch, direct = combined(batch, width)
    hit = np.isin(levels.rows["anchor"], batch.rows["anchor"])
    everyone = Entries.joined([batch, levels.take(np.flatnonzero(hit))])
    r, own = everyone.rows, len(batch.rows)
    base = np.r_[0, np.cumsum(r["n"], dtype=np.int64)]
    state = np.zeros(base[-1], np.uint8)  # 1 repeated, 2 repeated and not the earliest
    for i in np.flatnonzero(r["twice"][:own]).tolist():
        state[base[i] : base[i + 1]] = 1
    order = np.argsort(r["anchor"], kind="stable")
    for lo, hi in buckets(r["anchor"][order]):
        which = order[lo:hi].tolist()
        if hi - lo == 2:
            i, j = sorted(which, key=lambda x: order_of(r, x))
            found = pair(everyone, i, j, width)
            if found:
                most, least = found
                for x, s in ((i, 1), (j, 2)):
                    part = state[base[x] + int(r["at"][x]) - most : base[x] + int(r["at"][x]) - least + 1]
                    np.maximum(part, s, out=part)
        else:
            for group in equal_windows(everyone, which, width):
                group.sort(key=lambda x: (*order_of(r, x[0])[:3], int(r["start"][x[0]]) + x[1]))
                for place, (i, k) in enumerate(group):
                    state[base[i] + k] = max(state[base[i] + k], 2 if place else 1)
    # runs of windows of one state
    of = np.repeat(np.arange(len(r)), r["n"])
    new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (state[1:] != state[:-1])]) if len(of) else np.zeros(0, np.int64)
    stop = np.r_[new[1:], len(of)]
    on = state[new] > 0
    new, stop = new[on], stop[on]
    out = np.empty(len(new), SPAN)
    start = r["start"][of[new]] - base[of[new]]
    out["doc"], out["key"], out["start"], out["stop"], out["later"] = r["doc"][of[new]], r["key"][of[new]], start + new, start + stop - 1 + width, state[new] == 2
    return trimmed(Entries(r[:own], everyone.text), state, base, width), np.concatenate([direct, out])


def trimmed(e: Entries, state: np.ndarray, base: np.ndarray, width: int) -> Entries:
    """The entries from their first to their last window that no earlier one equals, without those that have none."""
    rows, text = [], []
    fresh = state[: base[len(e.rows)]] < 2
    if fresh.all():
        return Entries(e.rows, e.text[: e.begin[-1]])
    some = np.add.reduceat(fresh, base[: len(e.rows)]) if len(e.rows) else np.zeros(0, int)
    for i in np.flatnonzero(some).tolist():
        row, words = e.rows[i], e.words(i)
        if some[i] < row["n"]:
            on = np.flatnonzero(fresh[base[i] : base[i + 1]])
            a, b = int(on[0]), int(on[-1]) + 1
            at = [0, *(np.flatnonzero(np.frombuffer(words, np.uint8) == 32) + 1).tolist()]
            row = row.copy()
            row["start"], row["n"], row["at"], row["byte"] = row["start"] + a, b - a, row["at"] - a, row["byte"] - at[a]
            words = words[at[a] : at[b + width - 1]]
            row["size"] = len(words)
        rows.append(row)
        text.append(words)
    return Entries(np.array(rows, ENTRY) if rows else np.empty(0, ENTRY), b"".join(text))


def _rows(n: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of a step, null where nothing is given."""
    types = {"kind": pa.string(), "shard": pa.int32(), "part": pa.int32(), "doc_id": pa.int64(), "key": pa.int64(), "start": pa.int64(), "stop": pa.int64(), "later": pa.bool_(), "n_entries": pa.int64(), "entries": pa.binary(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, t)) for c, t in types.items()], list(types))


def _span_rows(out: np.ndarray) -> pa.RecordBatch:
    n = len(out)
    return _rows(n, kind=pa.array(["span"] * n, pa.string()), shard=pa.array(np.full(n, -1, np.int32)), doc_id=pa.array(out["doc"]), key=pa.array(out["key"]), start=pa.array(out["start"]), stop=pa.array(out["stop"]), later=pa.array(out["later"] == 1))


def _level_row(e: Entries, shard: int, part: int) -> pa.RecordBatch:
    rows, text = e.in_order().to_bytes()
    return _rows(1, kind=pa.array(["level"]), shard=pa.array([shard], pa.int32()), part=pa.array([part], pa.int32()), n_entries=pa.array([len(e.rows)], pa.int64()), entries=pa.array([rows], pa.binary()), words=pa.array([text], pa.binary()))


class Shard:
    """A shard of some levels, from the shared folder; its parts are unpacked one at a time."""

    def __init__(self, paths: list[str], shard: int):
        import pyarrow.parquet as pq
        from pyarrow import fs

        self.packed: dict[int, list[tuple[bytes, bytes]]] = {}
        for path in paths:
            where, root = fs.FileSystem.from_uri(path)
            for info in where.get_file_info(fs.FileSelector(f"{root}/kind=level/shard={shard}", allow_not_found=True)):
                if info.base_name.endswith(".parquet"):
                    with where.open_input_file(info.path) as f:
                        t = pq.read_table(f, columns=["part", "entries", "words"])
                    for part, a, b in zip(*(c.to_pylist() for c in t.columns)):
                        self.packed.setdefault(part, []).append((a, b))

    def part(self, p: int) -> Entries:
        return Entries.joined([Entries.from_bytes(a, b) for a, b in self.packed.get(p, [])])


class Family:
    """An index in the shared folder ``path``; a new one is made there where none is."""

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None, width: int = spans.WIDTH, gram: int = GRAM):
        self.spark, self.path = spark, path
        states = [int(n.split("-")[1]) for n in self._names() if n.startswith("state-")]
        if states:
            last = spark.read.parquet(f"{path}/state-{max(states)}").first()
            self.step, self.shards, self.width, self.gram = last["step"], last["shards"], last["width"], last["gram"]
            self.levels = [(r["size"], r["path"]) for r in last["levels"]]
        else:
            self.step, self.shards, self.width, self.gram = 0, shards or packed.partitions(spark), width, gram
            self.levels: list[tuple[int, str]] = []

    def _names(self) -> list[str]:
        """Folders of complete steps and states; what is not complete is from a job that was lost."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        files = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(root):
            return []
        return [s.getPath().getName() for s in files.listStatus(root) if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]

    def _write(self, rows: DataFrame, name: str) -> tuple[int, str]:
        """Write a step; its number of entries and its path."""
        path, seen = f"{self.path}/{name}", Observation()
        rows.observe(seen, F.sum("n_entries").alias("n")).write.mode("overwrite").partitionBy("kind", "shard").parquet(path)
        return seen.get["n"] or 0, path

    def add(self, docs: DataFrame) -> DataFrame:
        """Take in a batch: ``(doc_id, key, start, stop, later)``, spans of windows that it repeats, its own and earlier ones."""
        width, gram, n, batch, paths = self.width, self.gram, self.shards, self.step, [p for _, p in self.levels]

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Entries] = []

            def out() -> Iterator[pa.RecordBatch]:
                e, late = combined(Entries.joined(held), width)
                held.clear()
                part = packed.bucket(e.rows["anchor"], n)
                if len(late):
                    yield pa.RecordBatch.from_arrays([pa.array([int(packed.bucket(late["key"][:1].view(np.uint64), n)[0])], pa.int32()), pa.array([b"S" + late.tobytes()], pa.binary())], ["part", "data"])
                order = np.argsort(part.astype(np.int32), kind="stable")
                part = part[order]
                cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.zeros(1, np.int64)
                for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    rows, text = e.take(order[lo:hi]).to_bytes()
                    yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])], pa.int32()), pa.array([b"E" + len(rows).to_bytes(8, "little") + rows + text], pa.binary())], ["part", "data"])

            for b in packed.slices(batches, 2):
                held.append(entries(b.column(2), np.asarray(b.column(0)), np.asarray(b.column(1)), batch, width, gram))
                if sum(len(x.text) for x in held) > FLUSH_BYTES:
                    yield from out()
            if held:
                yield from out()

        def meet(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = []
            for b in blocks:
                for value in b.column(1):
                    raw = value.as_py()
                    if raw[:1] == b"S":
                        yield _span_rows(np.frombuffer(raw, SPAN, offset=1))
                    else:
                        size = int.from_bytes(raw[1:9], "little")
                        own.append(Entries.from_bytes(raw[9 : 9 + size], raw[9 + size :]))
            if own:
                shard = TaskContext.get().partitionId()
                levels, batch_of = Shard(paths, shard), Entries.joined(own)
                own.clear()
                for p, e in batch_of.parts():
                    level, found = scan(e, levels.part(p), width)
                    yield _span_rows(found)
                    if len(level.rows):
                        yield _level_row(level, shard, p)

        size, path = self._write(packed.exchange(packed.identity(docs), send, meet, STEP, n), f"step-{self.step}")
        if size:
            self.levels.append((size, path))
        self._merge()
        self.step += 1
        self._commit()
        return self.spark.read.schema(STEP).parquet(path).filter("kind = 'span'").select("doc_id", "key", "start", "stop", "later")

    def _merge(self) -> None:
        """Merge the levels at the end whose sizes are of one power of two, and so on with the result."""
        k = len(self.levels) - 1
        total = self.levels[k][0] if k >= 0 else 0
        while k > 0 and self.levels[k - 1][0].bit_length() <= total.bit_length():
            k -= 1
            total += self.levels[k][0]
        if k < 0 or k == len(self.levels) - 1:
            return
        paths = [p for _, p in self.levels[k:]]

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard in b.column(0).to_pylist():
                    levels = Shard(paths, shard)
                    for p in sorted(levels.packed):
                        yield _level_row(levels.part(p), shard, p)

        self.levels[k:] = [self._write(self.spark.range(0, self.shards, 1, self.shards).mapInArrow(join, STEP), f"merge-{self.step}")]
        self.gone = paths

    def _commit(self) -> None:
        """Write which levels count, then delete those that do not any more."""
        row = [(self.step, self.shards, self.width, self.gram, self.levels)]
        self.spark.createDataFrame(row, "step int, shards int, width int, gram int, levels array<struct<size:long,path:string>>").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state-{self.step}")
        for p in getattr(self, "gone", []):
            remove(self.spark, f"{p}/kind=level")
        self.gone = []
        if self.step > 1:
            remove(self.spark, f"{self.path}/state-{self.step - 1}")
        release(self.spark)


def matches(docs: DataFrame, width: int = spans.WIDTH, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """``(doc_id, start_word, n_words, removable_words)`` of every maximal span that occurs elsewhere, by a family of its own."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/suffix-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    family = Family(spark, folder, max(packed.partitions(spark), -(-size // SHARD_BYTES)), width, gram)
    batch = F.coalesce(F.pmod(F.col("doc_id").cast("long"), F.lit(batches)), F.lit(0))
    found = [family.add(docs.filter(batch == b)) for b in range(batches)]
    remove_at_exit(spark, folder)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return spans.report(out)
