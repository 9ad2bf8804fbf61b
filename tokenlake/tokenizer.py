"""The tokenizer: configuration, training, files, encoding and decoding in one handle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .model import Config, Model, ModelError
from .operators import codec, inspect
from .operators import train as trainer
from .sources import files


class Tokenizer:
    """Holds a configuration and, once trained or loaded, a model."""

    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config, self.model = spark, config or Config(), None

    @property
    def trained(self) -> bool:
        return self.model is not None

    def _need(self) -> Model:
        if self.model is None:
            raise ModelError("the tokenizer is not trained")
        return self.model

    def train(self, docs: DataFrame, normalize: bool = True, distributed: bool | None = None) -> Tokenizer:
        """Learn from ``docs.text``, normalised by the configuration unless told otherwise; once only."""
        if self.trained:
            raise ModelError("the tokenizer is trained already")
        self.model = trainer.train(docs, self.config.vocab_size, self.config.norm if normalize else T.Norm.NONE, distributed)
        self.model.config = Config(self.config.vocab_size, self.config.norm, self.config.pretokenize)
        return self

    def train_files(self, path: str) -> Tokenizer:
        """Learn from text files as they are: file training does not normalise."""
        return self.train(files.text_rows(self.spark, path), normalize=False)

    def save(self, path: str) -> None:
        """Write the interchange format, which holds no configuration."""
        files.write_model(self._need(), path)

    def load(self, path: str) -> Tokenizer:
        """Read the interchange format; the configuration becomes the default."""
        self.model, self.config = files.read_model(self.spark, path), Config()
        return self

    def encode(self, docs: DataFrame, key: str = "doc_id") -> DataFrame:
        return codec.encode(docs, self._need(), key, self.config.norm)

    def encode_text(self, text: str) -> list[int]:
        """Ids of one text."""
        row = self.spark.createDataFrame([(0, text)], "doc_id long, text string")
        return self.encode(row).first()["ids"]

    def decode(self, encoded: DataFrame, key: str = "doc_id") -> DataFrame:
        return codec.decode(encoded, self._need(), key)

    def decode_ids(self, ids: list[int]) -> bytes:
        return self._need().decode(ids)

    def vocab_size(self) -> int:
        return len(self._need())

    def token_bytes(self, number: int) -> bytes | None:
        return self._need().token(number)

    def token_to_id(self, data: bytes) -> int | None:
        return self._need().token_id(data)

    def stats(self) -> dict[str, int]:
        """Summary of the model."""
        m = self._need()
        return inspect.summary(m.vocab_frame(self.spark), m.merges_frame(self.spark)).first().asDict()

    def coverage(self, docs: DataFrame) -> DataFrame:
        """One row: tokens, original bytes, and bytes for each token (0.0 without tokens)."""
        text = T.normalize(F.col("text"), self.config.norm)
        rows = docs.select("text", codec.encode_udf(self._need(), docs, self.config.pretokenize)(text).alias("ids"))
        n = rows.agg(F.sum(F.size("ids")).alias("tokens"), F.sum(F.octet_length("text")).alias("bytes"))
        return n.withColumn("bytes_per_token", F.when(F.col("tokens") > 0, F.col("bytes") / F.col("tokens")).otherwise(0.0))
