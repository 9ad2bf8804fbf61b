"""BPE models: vocabulary and ranked merge rules.

A model is bounded by its vocabulary, so it lives in the driver and is shipped
to tasks by broadcast; ``vocab_frame`` and ``merges_frame`` show it as tables.
"""

from __future__ import annotations

import json
import struct
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .functions.text import Norm

MAX_TOKEN_BYTES = 128
MAGIC, VERSION = 0x544B4250, 1
BASE = 256
VOCAB_SCHEMA = "id int, len int, bytes binary"
MERGE_SCHEMA = "rank int, left_id int, right_id int, result_id int"


@dataclass(frozen=True)
class Config:
    """Settings of a tokenizer."""

    vocab_size: int = 32_000
    norm: Norm = Norm.WHITESPACE
    pretokenize: bool = True


class ModelError(ValueError):
    """A model that is malformed, or an id that it does not have."""


@dataclass
class Model:
    """Tokens by id and rules by rank."""

    tokens: list[bytes] = field(default_factory=lambda: [bytes([i]) for i in range(BASE)])
    merges: list[tuple[int, int, int]] = field(default_factory=list)
    config: Config = field(default_factory=Config)
    #: Whether the rules come from training; the shape of a model read from a file does not tell.
    learnt: bool = False

    def __post_init__(self) -> None:
        self._ids = {t: i for i, t in enumerate(self.tokens)}
        self._ranks: dict[tuple[int, int], list[int]] = {}
        for rank, (a, b, _) in enumerate(self.merges):
            self._ranks.setdefault((a, b), []).append(rank)

    def __len__(self) -> int:
        return len(self.tokens)

    def token_id(self, data: bytes) -> int | None:
        return self._ids.get(data)

    def token(self, number: int) -> bytes | None:
        return self.tokens[number] if 0 <= number < len(self.tokens) else None

    def add_token(self, data: bytes) -> int:
        """The id of ``data``, a new one if need be."""
        if len(data) > MAX_TOKEN_BYTES:
            raise ModelError(f"a token has at most {MAX_TOKEN_BYTES} bytes")
        if data not in self._ids:
            self._ids[data] = len(self.tokens)
            self.tokens.append(data)
        return self._ids[data]

    def add_merge(self, left: int, right: int) -> int:
        """Append a rule; its result is the token of both parts' bytes."""
        out = self.add_token(self.tokens[left] + self.tokens[right])
        self._ranks.setdefault((left, right), []).append(len(self.merges))
        self.merges.append((left, right, out))
        return out

    def is_fresh(self) -> bool:
        """Whether the model is as training leaves it: all bytes first, then one new token a rule, in order."""
        base = self.tokens[:BASE] == [bytes([i]) for i in range(BASE)]
        return base and len(self.tokens) == BASE + len(self.merges) and all(r == BASE + k and max(a, b) < r and self.tokens[r] == self.tokens[a] + self.tokens[b] for k, (a, b, r) in enumerate(self.merges))

    def encode_chunk(self, data: Iterable[int]) -> list[int]:
        """One pass over the rules in order of rank, each applied from left to right.

        Rules that do not occur are skipped: the next one is the lowest rank
        above the last among the pairs at hand.
        """
        ids, last = list(data), -1
        ranks = self._ranks
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                have = ranks.get(pair)
                if have is not None:
                    i = bisect_right(have, last)
                    if i < len(have) and (best is None or have[i] < best):
                        best = have[i]
            if best is None:
                break
            left, right, result = self.merges[best]
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and ids[i] == left and ids[i + 1] == right:
                    out.append(result)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids, last = out, best
        return ids

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of ids; an unknown id is an error of the whole call."""
        parts = [self.token(i) for i in ids]
        if None in parts:
            raise ModelError(f"unknown token id {ids[parts.index(None)]}")
        return b"".join(parts)

    # tables

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, len(t), bytearray(t)) for i, t in enumerate(self.tokens)], VOCAB_SCHEMA)

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(r, *m) for r, m in enumerate(self.merges)], MERGE_SCHEMA)

    # files

    def save(self, spark: SparkSession, path: str) -> None:
        """As Parquet tables, with the settings."""
        self.vocab_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab")
        self.merges_frame(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges")
        spark.createDataFrame([(json.dumps(asdict(self.config) | {"learnt": self.learnt}),)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        tokens = [bytes(r["bytes"]) for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
        merges = [(r["left_id"], r["right_id"], r["result_id"]) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
        raw = json.loads(spark.read.parquet(f"{path}/config").first()[0])
        return cls(tokens, merges, Config(raw["vocab_size"], Norm(raw["norm"]), raw["pretokenize"]), raw.get("learnt", False))

    def to_bytes(self) -> bytes:
        """The binary interchange format, version 1, little endian."""
        out = [struct.pack("<4I", MAGIC, VERSION, len(self.tokens), len(self.merges))]
        out += [struct.pack("<IH", i, len(t)) + t for i, t in enumerate(self.tokens)]
        out += [struct.pack("<3I", *m) for m in self.merges]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        """Read the interchange format; settings are the defaults, as it has none.  A truncated file is an error."""
        try:
            magic, version, n, m = struct.unpack_from("<4I", data)
            if (magic, version) != (MAGIC, VERSION):
                raise ModelError("not a model file of version 1")
            at, tokens = 16, []
            for i in range(n):
                number, size = struct.unpack_from("<IH", data, at)
                at += 6
                token = data[at : at + size]
                at += size
                if size > MAX_TOKEN_BYTES or len(token) < size or number != i:
                    raise ModelError(f"bad token {i}")
                tokens.append(token)
            merges = [struct.unpack_from("<3I", data, at + 12 * i) for i in range(m)]
        except struct.error as e:
            raise ModelError("the model file is truncated") from e
        if len(set(tokens)) < len(tokens):
            raise ModelError("a token occurs twice")
        return cls(tokens, merges)
