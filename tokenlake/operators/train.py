"""BPE training.

Spark reduces the corpus to its chunk dictionary.  Dictionaries of up to
``MAX_LOCAL`` chunks, a count that is checked, are learnt from in the driver with
an index from pairs to chunks, so that a merge touches only the chunks that have
it.  Larger ones stay distributed, as blocks of numbers in the shared folder: a job
counts pairs block by block, the driver gets the best of them and takes as many
merges as are sure, and the next job makes them before it counts.  Both follow the
same rules and are tested against each other.

Rules: the most frequent pair is merged, of equals the one with the smallest
ids; training ends at the target size, when the best pair occurs once, or when
its token would exceed 128 bytes.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from ..model import BASE, MAX_TOKEN_BYTES, Config, Model
from . import pairs as P

#: Chunks that the driver learns from, at some 1 kB each.
MAX_LOCAL = 200_000
#: Merges after which the distributed trainer writes its blocks anew.
WRITE_EVERY = 16
#: Best pairs that ``independent`` takes from.
MERGES_A_JOB = 64
#: Best pairs that one job of the distributed trainer brings to the driver.
PAIRS_A_JOB = 1024
#: Chunks to a task of the distributed trainer, and numbers to a block, which is worked on at once.
CHUNKS_A_TASK = 1 << 20
BLOCK = 1 << 19
#: Pairs of up to so many token numbers are counted in a table.
TABLE = 1 << 22
#: Stands behind each chunk of a block.
END = np.uint32(0xFFFFFFFF)
BLOCKS = "ids binary, n binary"


def symbol(number: int) -> str:
    """The character that stands for a token id inside token strings (surrogates are skipped)."""
    return chr(number if number < 0xD800 else number + 0x800)


def number_of(char: str) -> int:
    code = ord(char)
    return code if code < 0xD800 else code - 0x800


def learn(words: Iterable[tuple[bytes, int]], target: int, model: Model | None = None) -> Model:
    """Learn rules from distinct chunks and their counts."""
    fresh = model is None
    model = model or Model()
    seqs, weight = [], []
    count: dict[tuple[int, int], int] = defaultdict(int)
    where: dict[tuple[int, int], set[int]] = defaultdict(set)
    for data, n in words:
        if len(data) > 1:
            for pair in zip(data, data[1:]):
                count[pair] += n
                where[pair].add(len(seqs))
            seqs.append(list(data))
            weight.append(n)
    heap = [(-n, *pair) for pair, n in count.items()]
    heapq.heapify(heap)
    while len(model) < target and heap:
        n, left, right = heapq.heappop(heap)
        pair = (left, right)
        if count.get(pair, 0) != -n:
            continue  # stale
        if -n < 2 or len(model.tokens[left]) + len(model.tokens[right]) > MAX_TOKEN_BYTES:
            break
        new = model.add_merge(left, right)
        touched = set()
        for w in where.pop(pair):
            old, k = seqs[w], weight[w]
            out, i, size = [], 0, len(old)
            while i < size:
                if i + 1 < size and old[i] == left and old[i + 1] == right:
                    out.append(new)
                    i += 2
                else:
                    out.append(old[i])
                    i += 1
            if len(out) == size:
                continue
            for p in zip(old, old[1:]):
                count[p] -= k
                touched.add(p)
            for p in zip(out, out[1:]):
                count[p] += k
                where[p].add(w)
                touched.add(p)
            seqs[w] = out
        for p in touched:
            if count[p] > 0:
                heapq.heappush(heap, (-count[p], *p))
            else:
                del count[p]
                where.pop(p, None)
    model.learnt = model.learnt or fresh
    return model


def independent(ranked: list[tuple[str, int]], most: int) -> list[tuple[str, int]]:
    """The pairs, from the best on, that would be merged in this order one by one.

    A merge takes from the counts of pairs that share a symbol with it, and makes
    new pairs, each of at most the count of an old one beside it.  So a pair comes next for
    sure if it shares no symbol with those before it and is more frequent than any pair
    that the merges before it could make: as frequent as they are themselves, at most, but
    only as frequent as a pair that shares a symbol with them.
    """
    out, used = [], set()
    for k, (pair, n) in enumerate(ranked[:MERGES_A_JOB]):
        if len(out) == most or used & set(pair):
            break
        if out and any(used & set(p) and c >= n for p, c in ranked[k + 1 :]):
            break  # a neighbour of a merged symbol, as frequent as this one
        if out and n <= ranked[-1][1] and len(ranked) > MERGES_A_JOB:
            break  # pairs beyond the list may be such neighbours
        out.append((pair, n))
        used |= set(pair)
        if pair[0] == pair[1]:
            break  # its token may stand beside itself as often as the pair occurred
    return out


def certain(ranked: list[tuple[int, int, int]], most: int, whole: bool) -> list[tuple[int, int, int]]:
    """The pairs ``(left, right, n)``, from the best on, that would be merged in this order one by one.

    A merge of (a, b) takes from pairs that end in a or begin with b, and every pair that
    it makes stands where such a pair stood.  All other counts stay.  So a pair comes next
    for sure if it is not one of those, and more frequent than all of them.  ``whole``: the
    list has all pairs; else those beyond it are as frequent as its last one, at most.
    """
    out, firsts, seconds = [], set(), set()
    for left, right, n in ranked[:most]:
        if right in firsts or left in seconds:
            break
        if out and (not whole and n <= ranked[-1][2] or any(c >= n and (q in firsts or p in seconds) for p, q, c in ranked if (p, q, c) not in out)):
            break
        out.append((left, right, n))
        firsts.add(left)
        seconds.add(right)
        if left == right:
            break  # its token may stand beside itself as often as the pair occurred
    return out


def joined(ids: np.ndarray, left: int, right: int, new: int) -> np.ndarray:
    """A block with a pair replaced from left to right, without overlap."""
    at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
    if not len(at):
        return ids
    if left == right:  # of a run every second place
        k = np.arange(len(at))
        run = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, k, 0))
        at = at[(k - run) % 2 == 0]
    out = ids.copy()
    out[at] = new
    return np.delete(out, at + 1)


def sums(ids: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block as ``left * size + right``, and how often they occur; a pair may come more than once."""
    weight = np.repeat(n, np.diff(np.flatnonzero(ids == END), prepend=-1))
    on = np.flatnonzero((ids[:-1] != END) & (ids[1:] != END))
    key, weight = ids[on].astype(np.int64) * size + ids[on + 1], weight[on]
    if size * size > TABLE:
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        head = np.flatnonzero(np.diff(key, prepend=-1))
        return key[head], np.add.reduceat(weight, head) if len(head) else weight
    high, low = (np.bincount(key, w, size * size) for w in (weight >> 24, weight & 0xFFFFFF))  # exact as floats
    total = (high.astype(np.int64) << 24) + low.astype(np.int64)
    found = np.flatnonzero(total)
    return found, total[found]


def _packed(words: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of chunks of two bytes and more."""
    ids, counts, size = [], [], 0

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (ids, counts)], ["ids", "n"])

    for batch in words:
        data, bounds = A.raw(batch.column(0))
        length = np.diff(bounds)
        out = np.full(len(data) + len(length), END)
        out[np.arange(len(data)) + np.repeat(np.arange(len(length)), length)] = data
        ids.append(out[np.repeat(length > 1, length + 1)])
        counts.append(np.asarray(batch.column(1))[length > 1].astype(np.int64))
        size += len(out)
        if size >= BLOCK:
            yield block()
            ids, counts, size = [], [], 0
    if ids:
        yield block()


def _merged(batches: Iterator[pa.RecordBatch], rules: list[tuple[int, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks with the rules applied."""
    for batch in batches:
        for data, n in zip(batch.column(0), batch.column(1)):
            ids = np.frombuffer(data.as_buffer(), np.uint32)
            for rule in rules:
                ids = joined(ids, *rule)
            yield ids, np.frombuffer(n.as_buffer(), np.int64)
    A.give_back()


def _best(blocks: DataFrame, rules: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """The most frequent pairs after the rules, one more than ``PAIRS_A_JOB``; of equals the one with the smallest ids first."""
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size if size * size <= TABLE else 0, np.int64)

        def rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((key // size).astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n)], ["left", "right", "n"])

        for ids, n in _merged(batches, rules):
            key, found = sums(ids, n, size)
            if len(total):
                total[key] += found
            else:
                yield rows(key, found)
        key = np.flatnonzero(total)
        yield rows(key, total[key])

    counts = blocks.mapInArrow(run, "left int, right int, n long").groupBy("left", "right").agg(F.sum("n").alias("n"))
    return [tuple(r) for r in counts.orderBy(F.desc("n"), "left", "right").limit(PAIRS_A_JOB + 1).collect()]


def _after(blocks: DataFrame, rules: list[tuple[int, int, int]]) -> DataFrame:
    """Blocks with the rules applied, without the chunks that are one token."""
    rules = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n in _merged(batches, rules):
            length = np.diff(np.flatnonzero(ids == END), prepend=-1)
            ids, n = ids[np.repeat(length > 2, length)], n[length > 2]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, n)], ["ids", "n"])

    return blocks.mapInArrow(run, BLOCKS)


def _folder(spark: SparkSession) -> str:
    """A new name in the folder that all machines share."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tokenlake-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/train-{uuid.uuid4().hex}"


def learn_distributed(words: DataFrame, target: int) -> Model:
    """The same rules over a dictionary ``(chunk, n)`` that stays in the shared folder, in blocks."""
    spark = words.sparkSession
    folder, written = _folder(spark), 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-words.count() // CHUNKS_A_TASK))
    model, rules = Model(), []
    words.select("chunk", "n").repartition(tasks).mapInArrow(_packed, BLOCKS).write.parquet(f"{folder}/0")
    try:
        blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/0")
        while len(model) < target:
            top = _best(blocks, rules, len(model))
            done = not top
            for left, right, n in certain(top, target - len(model), len(top) <= PAIRS_A_JOB):
                if n < 2 or len(model.tokens[left]) + len(model.tokens[right]) > MAX_TOKEN_BYTES:
                    done = True
                    break
                rules.append((left, right, model.add_merge(left, right)))
            if done:
                break
            if len(rules) >= WRITE_EVERY and len(model) < target:
                written += 1
                _after(blocks, rules).write.parquet(f"{folder}/{written}")
                blocks, rules = spark.read.schema(BLOCKS).parquet(f"{folder}/{written}"), []
                _remove(spark, f"{folder}/{written - 1}")
    finally:
        _remove(spark, folder)
    model.learnt = True
    return model


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def train(docs: DataFrame, vocab_size: int = 32_000, normalize: T.Norm = T.Norm.NONE, distributed: bool | None = None) -> Model:
    """Learn a model from ``docs.text``; by default texts are taken as they are, as file training does.

    ``distributed`` forces the distributed trainer; otherwise the size of the
    dictionary decides, and False says only that a small one is expected: the driver
    could not hold a large one.
    """
    target = max(vocab_size, BASE)
    text = T.normalize(F.col("text"), normalize)
    words = P.dictionary(docs, text).filter(F.octet_length("chunk") > 1).persist()
    try:
        if distributed or words.count() > MAX_LOCAL:
            model = learn_distributed(words, target)
        else:
            model = learn(((r["chunk"].encode(), r["n"]) for r in words.toLocalIterator()), target)
    finally:
        words.unpersist()
    model.config = Config(vocab_size=target, norm=normalize)
    return model
