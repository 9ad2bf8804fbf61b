"""Token counts by a map-side lookup in two tiers.

Texts are cut into pre-tokens by the tokenizer's pattern.  The first tier is a
compact hash table of the frequent pre-tokens' token counts, broadcast to all
tasks; a pre-token outside it is encoded once by a Python worker and kept in the
worker's cache, the second tier, which outlives the task.  No pre-token is ever shuffled: the frequent ones are found by Misra-Gries
summaries, one of at most ``SUMMARY`` entries by task, and only these summaries
move, to be merged by groups of ``fan_in`` until so few are left that the driver
adds them up.  The summaries cover all texts; the choice they lead to decides
the speed only, since both tiers hold the tokenizer's own counts.

The vocabulary file is read by the driver and travels as a broadcast.

Defined results
* null and empty texts have 0 tokens, 0 pre-tokens and 0 bytes.
* special tokens' strings in a text are ordinary text.
* very long texts are counted whole, in pieces cut at single blanks.
* each row is counted alone: repeated rows get equal counts, extra columns are
  ignored, whatever their names, an empty table gives an empty one.
* a null doc_id is reported as null.
* ties: of pre-tokens with equal estimated counts the smaller string comes first
  into the table, which has no influence on the counts.
* the worker caches are emptied at ``CACHE`` entries, which bounds their memory
  on texts without repetition.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
FREQUENT = 1 << 15
SUMMARY = 1 << 13
CACHE = 1 << 20
#: Characters of a text that are worked on at once.
PIECE = 1 << 22
SCHEMA = "doc_id long, n_tokens long, n_pretokens long, n_bytes long"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Of the Python worker: both tiers, by the job that they belong to.
_WORKER: dict[str, Lengths] = {}
#: Of the Python worker: the tokenizer, by the job that it belongs to.
_TOKENIZERS: dict[str, object] = {}


def splitter(pattern: str = PATTERN) -> Callable[[str], list[str]]:
    """The pattern's ``findall``; for the default pattern a faster one for the texts on which both surely agree.

    Below U+0100 the standard library's classes say the same as the pattern's
    but for a few characters, such as superscript digits; texts that have one,
    or anything from U+0100 on, go to the full pattern.
    """
    import regex

    full = regex.compile(pattern).findall
    if pattern != PATTERN:
        return full
    quick = re.compile(r" ?[^\W\d_]++| ?\d++|'(?:[sdmt]|ll|ve|re)| ?(?:[^\s\w]|_)++|\s++$|\s+(?!\S)|\s").findall
    pairs = ((r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d"), (r"\s", r"\s"))
    odd = bytes(c for c in range(256) if any(bool(regex.match(a, chr(c))) != bool(re.match(b, chr(c))) for a, b in pairs))

    def find(text: str) -> list[str]:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return full(text)
        return full(text) if len(raw.translate(None, odd)) != len(raw) else quick(text)

    return find


def pieces(text: str, pattern: str = PATTERN, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about ``size`` characters; no pre-token of the default pattern goes across a single blank, where they are cut."""
    at = 0
    while len(text) - at > size and pattern == PATTERN and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def encoding(ranks: dict[bytes, int], pattern: str = PATTERN):  # noqa: ANN201
    """The tokenizer of these tokens."""
    import tiktoken

    return tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def read_ranks(vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """Tokens and their numbers of a ``.tiktoken`` vocabulary file."""
    with open(vocabulary, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def tokenizers(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Callable[[], Callable[[str], list[int]]]:
    """For tasks: a function that makes one from a text to its token ids; the tokenizer outlives the task."""
    shared, name = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary)), uuid.uuid4().hex

    def make() -> Callable[[str], list[int]]:
        if name not in _TOKENIZERS:
            _TOKENIZERS.clear()
            _TOKENIZERS[name] = encoding(shared.value, pattern)
        encode = _TOKENIZERS[name].encode_ordinary
        return lambda text: encode(text) if len(text) <= PIECE else [i for part in pieces(text, pattern) for i in encode(part)]

    return make


def _trim(counts: Counter, keep: int) -> Counter:
    """The Misra-Gries step: take the count of the (keep + 1)-th entry off all, drop what is left with none."""
    if len(counts) <= keep:
        return counts
    off = sorted(counts.values(), reverse=True)[keep]
    return Counter({k: c - off for k, c in counts.items() if c > off})


def _summary(counts: Counter) -> pa.RecordBatch:
    keys = list(counts)
    return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(pa.string())), pa.array([[counts[k] for k in keys]], pa.list_(pa.int64()))], ["keys", "counts"])


def frequent(docs: DataFrame, pattern: str = PATTERN, top: int = FREQUENT, keep: int = SUMMARY, fan_in: int = 64) -> list[str]:
    """Frequent pre-tokens of the corpus, at most ``top``, in descending order of estimated count.

    Every pre-token with more than total / ``keep`` occurrences is among them (if ``top`` >= ``keep``).
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = splitter(pattern)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                for part in pieces(text.as_py() or "", pattern):
                    counts.update(find(part))
                    if len(counts) > 16 * keep:
                        counts = _trim(counts, keep)
        yield _summary(_trim(counts, keep))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for keys, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.update(dict(zip(keys, n)))
                counts = _trim(counts, 4 * keep)
        yield _summary(_trim(counts, keep))

    schema = "keys array<string>, counts array<long>"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(summarise, schema)
    width = docs.rdd.getNumPartitions()
    while width > fan_in:
        width = -(-width // fan_in)
        parts = parts.repartition(width).mapInArrow(merge, schema)
    total: Counter = Counter()
    for row in parts.collect():  # at most fan_in rows of at most keep entries
        total.update(dict(zip(row["keys"], row["counts"])))
        total = _trim(total, 4 * keep)
    return [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:top]]


class Lengths(dict):
    """The first tier, and behind it what this worker has encoded itself: token counts by pre-token."""

    def __init__(self, table: dict[str, int], ranks: dict[bytes, int], pattern: str):
        super().__init__(table)
        self.table, self.ranks, self.pattern, self.encoder = table, ranks, pattern, None

    def __missing__(self, piece: str) -> int:
        if self.encoder is None:
            self.encoder = encoding(self.ranks, self.pattern)
        if len(self) > CACHE + len(self.table):
            self.clear()
            self.update(self.table)
        n = self[piece] = len(self.encoder.encode_ordinary(piece))
        return n


def counter(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, top: int = FREQUENT) -> Callable[[], Callable[[str], tuple[int, int]]]:
    """For tasks: a function that makes one from a text to its numbers of tokens and pre-tokens."""
    ranks = read_ranks(vocabulary)
    enc = encoding(ranks, pattern)
    table = {k: len(enc.encode_ordinary(k)) for k in frequent(docs, pattern, top)}
    shared = docs.sparkSession.sparkContext.broadcast((table, ranks))
    name = uuid.uuid4().hex

    def make() -> Callable[[str], tuple[int, int]]:
        if name not in _WORKER:
            _WORKER.clear()
            _WORKER[name] = Lengths(*shared.value, pattern)
        get, find = _WORKER[name].__getitem__, splitter(pattern)

        def count(text: str) -> tuple[int, int]:
            tokens = found = 0
            for part in pieces(text, pattern):
                own = find(part)
                tokens += sum(map(get, own))
                found += len(own)
            return tokens, found

        return count

    return make


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, top: int = FREQUENT) -> DataFrame:
    """``(doc_id, n_tokens, n_pretokens, n_bytes)`` of every document row; ``vocabulary`` is a file of the driver."""
    make = counter(docs, vocabulary, pattern, top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for batch in batches:
            tokens, found, size = [], [], []
            for text in batch.column(1):
                t, p = count(text.as_py()) if text.is_valid else (0, 0)
                tokens.append(t)
                found.append(p)
                size.append(text.as_buffer().size if text.is_valid else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(size, pa.int64())], ["doc_id", "n_tokens", "n_pretokens", "n_bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
