"""Quality by hierarchical empirical Bayes over hosts and paths.

A logistic classifier on counts of character classes, repetition and hashed words
gives each document's own evidence, the log odds of good quality.  The
documents' probabilities are added up by host and by path within the host, over
all documents, and posteriors shrink from level to level:

* global prior: the mean over all documents;
* host: (sum + k_host * global) / (n + k_host);
* path: (sum + k_path * host) / (n + k_path).

The strengths k are estimated from the grouped sums by the method of moments:
the less the group means vary beyond what chance explains, the larger k, so
sparse sites shrink to the level above.  Each document's own part is taken out
of the sums that judge it.  The final log odds add to the document's the log
odds of its path's posterior over the global ones; a document is kept when its
final probability reaches ``KEEP``.

Host and path come from ``source``: without scheme, the host is what is before
the first slash, in lower case; the path what is after it, up to its last slash
('' where there is none).

Defined results
* null and empty texts have no evidence: log odds of the prior of the sample.
* very long texts are read whole.
* a null source is the host ''.
* ties: a document whose final probability is exactly ``KEEP`` is kept.
* repeated rows are documents of their own; extra columns, whatever their names,
  are kept by ``kept`` and ignored by ``judged``; an empty table gives an empty one.
* a label that is missing, contradictory or not 0 or 1 is not used; without
  labelled documents of both classes no text has evidence: every probability is
  one half, and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, small_batches, stable
from .packed import slices
from .training import MAX_ROWS, labelled_sample
from .words import text_buffer, word_hashes

BITS = 14
KEEP = 0.5
EPOCHS = 30
#: Limits of the strength of a prior, in documents.
K_MIN, K_MAX = 2.0, 1000.0
N_STATS = 9
#: At most so many sites are broadcast (under 200 bytes each); more are joined by a shuffle.
MAX_BROADCAST = 200_000
SLICE = 256
SLICE_BYTES = 1 << 20


@dataclass
class Model:
    """Weights of the standardised counts and of the hashed words."""

    mean: np.ndarray
    scale: np.ndarray
    stats: np.ndarray
    words: np.ndarray
    bias: float
    prior: float

    def evidence(self, texts: pa.Array) -> np.ndarray:
        """Log odds of each text."""
        x, ids, offsets = features(texts)
        out = ((x - self.mean) / self.scale) @ self.stats + self.bias
        n = np.diff(offsets)
        total = np.r_[0.0, np.cumsum(self.words[ids])]
        out += (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)
        return np.clip(np.where(n > 0, out, self.prior), -20, 20)


@dataclass(frozen=True)
class Untrained:
    """Stands for a model where there is nothing to learn from."""

    prior: float = 0.0

    def evidence(self, texts: pa.Array) -> np.ndarray:
        return np.zeros(len(texts))


UNTRAINED = Untrained()

_CLASS = np.full(256, 3, np.uint8)
_CLASS[97:123] = 0
_CLASS[128:] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 13, 32]] = 4
_CLASS[[33, 44, 46, 63]] = 5


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text, its hashed words and their offsets."""
    buf, off = text_buffer(texts)
    h, _, _, offsets = word_hashes(buf, off)
    n, size = len(off) - 1, np.maximum(np.diff(off), 1)
    x = np.zeros((n, N_STATS))
    cls = _CLASS[buf]
    for c in range(6):
        total = np.r_[0, np.cumsum(cls == c, dtype=np.int32)]
        x[:, c] = (total[off[1:]] - total[off[:-1]]) / size
    words = np.diff(offsets)
    again = np.r_[0, np.cumsum(np.r_[False, h[1:] == h[:-1]])] if len(h) else np.zeros(1)
    x[:, 6] = (again[offsets[1:]] - again[np.minimum(offsets[:-1] + 1, offsets[1:])]) / np.maximum(words, 1)
    x[:, 7] = np.log1p(words)
    x[:, 8] = np.diff(off) / np.maximum(words, 1)
    x[:, 8] = np.log1p(x[:, 8])
    return x, (h >> np.uint64(64 - BITS)).astype(np.int64), offsets


def fit(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Logistic regression by Adam with weight decay on the word weights."""
    y = np.asarray(y, float)
    if not 0 < y.sum() < len(y):
        raise ValueError("training needs labelled documents of both classes")
    batches = (pa.RecordBatch.from_arrays([pa.array(texts[i : i + SLICE], pa.large_string())], ["t"]) for i in range(0, len(texts), SLICE))
    parts = [features(b.column(0)) for b in slices(batches, 0, SLICE_BYTES)]
    x, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    offsets = np.r_[0, np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = (x - mean) / scale
    n = np.diff(offsets)
    p = [np.zeros(N_STATS), np.zeros(1 << BITS), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), 64):
            b = order[lo : lo + 64]
            row = np.repeat(np.arange(len(b)), n[b])
            w = ids[np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in b])]
            part = 1 / np.maximum(n[b], 1)
            logit = z[b] @ p[0] + np.bincount(row, p[1][w], len(b)) * part + p[2][0]
            d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[b]) / len(b)
            grads = [z[b].T @ d + 1e-4 * p[0], np.bincount(w, (d * part)[row], 1 << BITS) + 1e-5 * p[1], np.array([d.sum()])]
            step += 1
            fix = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= 0.02 * fix * m[k] / (np.sqrt(v[k]) + 1e-8)
    rate = y.mean()
    return Model(mean, scale, p[0], p[1], float(p[2][0]), float(np.log(rate / (1 - rate))))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model | Untrained:
    """Fit on a bounded sample of labelled documents; ``UNTRAINED`` where it hasn't both classes."""
    rows = labelled_sample(docs, labels, "quality", max_rows)
    y = np.array([r[2] for r in rows])
    return fit([r[1] for r in rows], y) if len(set(y.tolist())) == 2 else UNTRAINED


def site(source: Column) -> tuple[Column, Column]:
    """Host and path of a source."""
    s = F.regexp_replace(F.coalesce(source.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    s = F.regexp_extract(s, r"^[^?#]*", 0)
    return F.lower(F.regexp_extract(s, r"^[^/]*", 0)), F.regexp_extract(s, r"^[^/]*/(.*)/[^/]*$", 1)


def evidence_of(model: Model, docs: DataFrame):  # noqa: ANN201
    """A column function: log odds of a text."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for t in parts:
            out = [m.evidence(b.column(0)) for b in slices(iter([pa.RecordBatch.from_arrays([t], ["t"])]), 0, SLICE_BYTES)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, total: str, size: str) -> float:
    """Prior strength by the method of moments from the groups' sums: mean (1 - mean) / variance between groups - 1."""
    r = groups.agg(F.sum(total).alias("s"), F.sum(size).alias("n"), F.sum(F.col(total) * F.col(total) / F.col(size)).alias("q"), F.sum(F.col(size) * F.col(size)).alias("n2"), F.count("*").alias("g"), F.sum("squares").alias("sq")).first()
    if not r["n"] or r["g"] < 2:
        return K_MAX
    mean = r["s"] / r["n"]
    between = r["q"] - r["s"] * mean
    within = max(r["sq"] - r["q"], 0.0) / max(r["n"] - r["g"], 1)
    spread = (between - (r["g"] - 1) * within) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return float(np.clip(within / spread, K_MIN, K_MAX)) if spread > 0 else K_MAX


def posterior(docs: DataFrame, model: Model) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with evidence, site and posteriors, under fresh names.

    The texts are scored twice, once for the sums by site and once for the
    result, which costs less than a shuffle or a copy of them.
    """
    c = {k: fresh(k) for k in ("logit", "host", "path", "p", "host_p", "path_p", "final")}
    host, path = site(F.col("source"))
    # never null, and said so: else Spark filters by it below the join, which scores all texts once more at the same time
    score = F.coalesce(evidence_of(model, docs)(F.col("text").cast("string")), F.lit(0.0))
    rows = docs.withColumns({c["logit"]: score, c["host"]: host, c["path"]: path}).withColumn(c["p"], 1 / (1 + F.exp(-F.col(c["logit"]))))
    paths = rows.groupBy(F.col(c["host"]).alias("h"), F.col(c["path"]).alias("r")).agg(F.sum(c["p"]).alias("sum"), F.count("*").alias("n"), F.sum(F.col(c["p"]) * F.col(c["p"])).alias("squares"))
    paths = stable(paths)
    hosts = paths.groupBy("h").agg(F.sum("sum").alias("h_sum"), F.sum("n").alias("h_n"), F.sum("squares").alias("squares"))
    k_host, k_path = _strength(hosts, "h_sum", "h_n"), _strength(paths, "sum", "n")
    all_ = hosts.agg(F.sum("h_sum").alias("s"), F.sum("h_n").alias("n")).first()
    prior = float(np.clip(all_["s"] / all_["n"], 1e-3, 1 - 1e-3)) if all_["n"] else 0.5
    sums = paths.select("h", "r", "sum", "n").join(hosts.drop("squares").withColumnRenamed("h", "hh"), F.col("h") == F.col("hh")).drop("hh")
    names = {k: fresh(k) for k in ("h", "r", "sum", "n", "h_sum", "h_n")}
    sums = sums.select(*[F.col(k).alias(v) for k, v in names.items()])
    if paths.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        sums = F.broadcast(sums)  # else every text would be shuffled by its host
    rows = rows.join(sums, (F.col(c["host"]) == F.col(names["h"])) & (F.col(c["path"]) == F.col(names["r"])))
    own = F.col(c["p"])
    host_p = (F.col(names["h_sum"]) - own + k_host * prior) / (F.col(names["h_n"]) - 1 + k_host)
    rows = rows.withColumn(c["host_p"], F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), host_p)))
    path_p = (F.col(names["sum"]) - own + k_path * F.col(c["host_p"])) / (F.col(names["n"]) - 1 + k_path)
    rows = rows.withColumn(c["path_p"], F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), path_p)))
    final = F.col(c["logit"]) + _logit(F.col(c["path_p"])) - F.lit(float(np.log(prior / (1 - prior))))
    return rows.withColumn(c["final"], 1 / (1 + F.exp(-final))), c


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """``(doc_id, host, path, doc_p, host_p, path_p, score, keep)`` of every document row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    rows, c = posterior(base, train(docs, labels, max_rows))
    return rows.select("doc_id", F.col(c["host"]).alias("host"), F.col(c["path"]).alias("path"), F.col(c["p"]).alias("doc_p"), F.col(c["host_p"]).alias("host_p"), F.col(c["path_p"]).alias("path_p"), F.col(c["final"]).alias("score"), (F.col(c["final"]) >= KEEP).alias("keep"))


def kept(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents that are kept, with all their columns."""
    rows, c = posterior(docs, train(docs, labels, max_rows))
    return rows.filter(F.col(c["final"]) >= KEEP).select(*docs.columns)
