"""Encoding texts to token ids and back.

Encoding is map-side: no chunk is shuffled.  Models as training leaves them go
through a compiled byte-pair encoder, for which the lowest rank first is the same
as one pass in order of rank: two neighbouring tokens that together have a token's
bytes are always the parts of its rule.  For other models each Python worker keeps
the ids of the chunks it has seen.  For short rule
lists there is a form that stays in the JVM, a fold of the rules over the token
string.  Decoding stays in the JVM: the vocabulary comes as one broadcast row.
"""

from __future__ import annotations

import importlib.util
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import binary as B
from ..functions import text as T
from ..model import Model
from .train import symbol

#: Chunks that a worker remembers, and the longest of them.
CACHE = 1 << 17
LONGEST = 64
#: Characters of a text that the compiled encoder gets at once.
PIECE = 1 << 20
#: No chunk goes across the place between a letter and a space.
_CUT = re.compile(r"(?<=[A-Za-z]) ")


def _compiled(model: Model) -> Callable[[str], Iterator[list[int]]]:
    """Ids of a text by the compiled encoder, list by list."""
    import tiktoken

    encode = tiktoken.Encoding("model", pat_str=T.PRETOKEN, mergeable_ranks={t: i for i, t in enumerate(model.tokens)}, special_tokens={}).encode_ordinary

    def run(text: str) -> Iterator[list[int]]:
        at = 0
        while len(text) - at > PIECE and (m := _CUT.search(text, at + PIECE)):
            yield encode(text[at : m.start()])
            at = m.start()
        yield encode(text[at:] if at else text)

    return run


def _cached(model: Model) -> Callable[[Iterable[str | bytes]], Iterator[list[int]]]:
    """Ids of chunks, those of short ones remembered."""
    cache: dict[str | bytes, list[int]] = {}

    def run(chunks: Iterable[str | bytes]) -> Iterator[list[int]]:
        for chunk in chunks:
            out = cache.get(chunk)
            if out is None:
                out = model.encode_chunk(chunk.encode() if isinstance(chunk, str) else chunk)
                if len(chunk) <= LONGEST:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[chunk] = out
            yield out

    return run


def encode_udf(model: Model, docs: DataFrame, pretokenize: bool = True, raw: bool = False):  # noqa: ANN201
    """A column function from text (binary where ``raw``) to an array of ids; null stays null.

    Texts come in pieces of bounded size (see ``arrays``) and their ids leave as
    packed numbers, so that a worker never holds the ids of a whole batch.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fast = pretokenize and importlib.util.find_spec("tiktoken") is not None and model.is_fresh() and model.learnt

    def make() -> Callable[[pa.Array], pa.Array]:
        m = shared.value
        if not m.merges:
            return _bytes
        compiled, cached = _compiled(m) if fast else None, _cached(m)
        find = re.compile(python_pattern()).findall

        def ids(x: str | bytes) -> Iterator[list[int]]:
            if fast:
                try:
                    return compiled(x.decode() if raw else x)
                except UnicodeDecodeError:
                    pass
            return cached((B.split(x) if raw else find(x)) if pretokenize else [x])

        def work(texts: pa.Array) -> pa.Array:
            out, bounds = array("i"), np.zeros(len(texts) + 1, np.int64)
            for k, x in enumerate(texts):
                if x.is_valid:
                    for part in ids(x.as_py()):
                        out.extend(part)
                bounds[k + 1] = len(out)
            return A.lists(pa.array(np.frombuffer(out, np.int32)), bounds, A.nulls(texts))

        return work

    return A.function(make, "array<int>")


def _bytes(texts: pa.Array) -> pa.Array:
    """Ids by a model without rules: the bytes."""
    data, bounds = A.raw(texts)
    return A.lists(pa.array(data.astype(np.int32)), bounds, A.nulls(texts))


def python_pattern() -> str:
    """The pre-token pattern in Python's syntax."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda x: f"\\U{int(x[1], 16):08x}", T.PRETOKEN)


def encode(docs: DataFrame, model: Model, key: str = "doc_id", flags: T.Norm | None = None, raw: bool = False) -> DataFrame:
    """``(key, ids)`` of every row, with the model's normalisation and pre-tokenisation."""
    flags = model.config.norm if flags is None else flags
    text = F.col("text") if raw else T.normalize(F.col("text"), flags)
    return docs.select(key, encode_udf(model, docs, model.config.pretokenize, raw)(text).alias("ids"))


def rules_row(docs: DataFrame, model: Model) -> DataFrame:
    """One row with the rules as an array of (pair, result) strings in order of rank."""
    rules = [(symbol(a) + symbol(b), symbol(c)) for a, b, c in model.merges]
    return docs.sparkSession.createDataFrame([(rules,)], "rules array<struct<p:string,r:string>>")


def fold(s: Column, rules: Column) -> Column:
    """Apply the rules in order of rank to a token string."""
    return F.aggregate(rules, s, lambda acc, m: F.replace(acc, m["p"], m["r"]))


def ids_of(s: Column) -> Column:
    """Ids of the characters of a token string."""
    code = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return F.transform(code, lambda c: F.when(c >= 0xE000, c - 0x800).otherwise(c))


def encode_native(docs: DataFrame, model: Model, key: str = "doc_id", flags: T.Norm | None = None) -> DataFrame:
    """``encode`` without Python, for models of up to about a thousand rules.

    The chunks of a text stand in one token string, each two with a character between
    them that is no token, so that a rule is applied once a text and not once a chunk.
    """
    text = T.normalize(F.col("text"), model.config.norm if flags is None else flags)
    chunks = T.pretokens(text) if model.config.pretokenize else F.array(text)
    between = symbol(len(model))
    whole = F.array_join(F.transform(chunks, T.byte_string), between)
    with_rules = docs.select(key, whole.alias("whole")).crossJoin(F.broadcast(rules_row(docs, model)))
    return with_rules.select(key, ids_of(F.replace(fold(F.col("whole"), F.col("rules")), F.lit(between), F.lit(""))).alias("ids"))


def decode(encoded: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``(key, bytes)`` of ``(key, ids)``; null where an id is unknown."""
    vocab = encoded.sparkSession.createDataFrame([([t.decode("latin-1") for t in model.tokens],)], "vocab array<string>")
    parts = F.transform("ids", lambda i: F.get(F.col("vocab"), i))
    joined = F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(F.array_join(parts, ""))
    return encoded.crossJoin(F.broadcast(vocab)).select(key, T.from_byte_string(joined).alias("bytes"))


def escaped(data: Column, middle_dot: bool = False) -> Column:
    """Printable form of a binary token: quotes, backslashes, newlines and tabs escaped, other bytes as ``\\xHH``.

    ``middle_dot`` also escapes carriage returns and shows a space as a middle dot.
    """
    special = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t"} | ({"\r": "\\r", " ": "·"} if middle_dot else {})

    def one(c: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, v in special.items():
            out = F.coalesce(out, F.when(c == k, v))
        return F.coalesce(out, F.when((F.ascii(c) >= 0x20) & (F.ascii(c) <= 0x7E), c), F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(c)), 2, "0")))

    chars = F.filter(F.split(F.decode(data, "ISO-8859-1"), ""), lambda c: c != "")
    return F.array_join(F.transform(chars, one), "")


def shown_tokens(model: Model):  # noqa: ANN201
    """A function from an id to its token in printable form, ``<UNK>`` where there is none; as ``escaped`` without middle dots."""
    special = {0x22: '\\"', 0x5C: "\\\\", 0x0A: "\\n", 0x09: "\\t"}

    def show(number: int) -> str:
        token = model.token(number)
        return "<UNK>" if token is None else "".join(special.get(b) or (chr(b) if 0x20 <= b <= 0x7E else f"\\x{b:02X}") for b in token)

    return show


def encode_stats(n_bytes: int, n_tokens: int) -> str:
    """The line that tells what encoding did."""
    return f"{n_bytes} bytes, {n_tokens} tokens, {n_bytes / n_tokens if n_tokens else 0.0:.2f} bytes per token"


def decode_stats(n_tokens: int, n_bytes: int) -> str:
    """The line that tells what decoding did."""
    return f"{n_tokens} tokens, {n_bytes} bytes"


def coverage(texts: DataFrame, decoded: Column, ids: Column, by: list[str] | None = None) -> DataFrame:
    """Totals of ids and of the bytes that they decode to, and bytes for each token (0.0 without tokens)."""
    rows = texts.groupBy(*by) if by else texts
    n = rows.agg(F.coalesce(F.sum(F.size(ids).cast("long")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.octet_length(decoded).cast("long")), F.lit(0)).alias("bytes"))
    return n.withColumn("bytes_per_token", F.when(F.col("tokens") > 0, F.col("bytes").cast("double") / F.col("tokens")).otherwise(0.0))
