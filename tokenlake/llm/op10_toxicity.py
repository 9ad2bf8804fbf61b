"""Toxicity by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings, of the word itself and of its first 4 and
5 bytes, so that inflected and derived forms share what their stem has learnt.
Filters of several widths run over the words of a text, each followed by a
rectifier and by the maximum over the whole text, and a logistic layer on those
maxima gives the probability.  Training is stochastic gradient descent (Adam) on
a bounded sample of labelled rows.  On all labelled documents that it was not
trained on, a threshold is calibrated for each language: the one of the best F1
there, shrunk towards that of all languages where a language has few.  For that,
their scores are counted by language and narrow bin of log odds, with the least
and the greatest score of each bin, so that the driver gets a bounded number of
bins a language, however many labels there are.

For scoring, all filters' weights are multiplied into the embeddings once; a word
then costs one row of that table for each of its three hashes.

Defined results
* null, empty and wordless texts have score 0 and are not toxic; a text shorter
  than a filter is padded with the empty word.
* a language unseen in calibration, or null, has the threshold of all languages.
* each row is scored alone over its whole text, whatever its length; repeated
  rows get equal scores, extra columns, whatever their names, are ignored, an
  empty table gives an empty one.
* ties: a score equal to the threshold is toxic.
* without labelled documents of both classes there is nothing to learn: every
  score is 0 and no document is toxic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable
from .packed import slices
from .training import MAX_ROWS, labelled_sample, usable
from .words import WORD_BYTE, mix, text_buffer, word_hashes

BITS = 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Training goes on for about so many batches, within these numbers of passes.
STEPS, LEAST_EPOCHS, MOST_EPOCHS = 1000, 3, 40
PREFIXES = (4, 5)
#: Languages with fewer held-out rows of either class use the common threshold to a larger part.
PRIOR_ROWS = 20
#: Bins of scores for each unit of log odds, up to this size.
BINS, MOST_LOGIT = 32, 40
#: Words that are scored at once.
CHUNK = 1 << 16
SCHEMA = "doc_id long, lang string, score double, threshold double, toxic boolean"
#: First column of each filter width in the table of all filters.
_AT = np.r_[0, np.cumsum([w * FILTERS for w in WIDTHS])]


@dataclass
class Model:
    """Embeddings times all filters, the filters' biases, the last layer and the thresholds."""

    table: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    common: float = 0.5
    by_lang: dict[str, float] = field(default_factory=dict)

    def score(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text, given its words' hashed numbers and the texts' offsets."""
        n = len(offsets) - 1
        top = np.full((n, len(self.bias)), -np.inf, np.float32)
        for lo in range(0, int(offsets[-1]), CHUNK):
            stop = min(lo + CHUNK, int(offsets[-1]))
            hi = min(stop + max(WIDTHS) - 1, int(offsets[-1]))
            part = self.table[words[lo:hi, 0]]
            for k in range(1, words.shape[1]):
                part += self.table[words[lo:hi, k]]
            act = activations(part, np.clip(offsets, lo, hi) - lo, offsets - lo)[: stop - lo]
            first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, stop, "left")
            some = first + np.flatnonzero(np.diff(np.clip(offsets[first : last + 1], lo, stop)) > 0)
            top[some] = np.maximum(top[some], np.maximum.reduceat(act, np.maximum(offsets[some] - lo, 0), axis=0))
        some = np.diff(offsets) > 0
        logit = np.full(n, self.out_bias)
        logit[some] += np.maximum(top[some] + self.bias, 0) @ self.out
        return np.where(some, 1 / (1 + np.exp(-np.clip(logit, -60, 60))), 0.0)


def activations(part: np.ndarray, cut: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """All filters at all positions; minus infinity where a filter would leave a text that is not shorter than it.

    ``part`` has each word's contribution to each filter at each of its places;
    ``cut`` are the borders of the texts within it, ``offsets`` the true ones.
    """
    n = len(part)
    out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
    for i, width in enumerate(WIDTHS):
        a = out[:, i * FILTERS : (i + 1) * FILTERS]
        a[:] = part[:, _AT[i] : _AT[i] + FILTERS]
        for j in range(1, width):
            a[: n - j] += part[j:, _AT[i] + j * FILTERS : _AT[i] + (j + 1) * FILTERS]
        size = np.diff(offsets)
        for back in range(1, width):
            at = offsets[1:] - back
            at = at[(size >= width) & (at >= 0) & (at < n)]
            a[at] = -np.inf
        for t in np.flatnonzero((size < width) & (cut[1:] > cut[:-1])):
            lo, hi = offsets[t], offsets[t + 1]
            a[max(lo, 0) : hi] = -np.inf
            if lo >= 0:
                a[lo] = sum(part[lo + j, _AT[i] + j * FILTERS : _AT[i] + (j + 1) * FILTERS] for j in range(hi - lo) if lo + j < n)
    return out


def strongest(table: np.ndarray, filters: np.ndarray, words: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's greatest activation of each filter and its first place, -1 where there is none; ``CHUNK`` words at once."""
    total, n = len(WIDTHS) * FILTERS, int(off[-1])
    top, arg = np.full((len(off) - 1, total), -np.inf, np.float32), np.full((len(off) - 1, total), -1)
    for lo in range(0, n, CHUNK):
        stop = min(lo + CHUNK, n)
        hi = min(stop + max(WIDTHS) - 1, n)
        act = activations(table[words[lo:hi]].sum(1) @ filters, np.clip(off, lo, hi) - lo, off - lo)
        cut = np.clip(off, lo, stop) - lo
        for b in np.flatnonzero(np.diff(cut) > 0):
            k = cut[b] + act[cut[b] : cut[b + 1]].argmax(0)
            best = act[k, np.arange(total)]
            more = best > top[b]
            top[b, more], arg[b, more] = best[more], lo + k[more]
    return top, arg


def hashed_words(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 1 on of each word and its prefixes, and the texts' offsets."""
    buf, off = text_buffer(texts)
    h, start, stop, offsets = word_hashes(buf, off)
    out = np.empty((len(h), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = h % np.uint64((1 << bits) - 1) + np.uint64(1)
    key = np.zeros(len(h), np.uint64)
    for j in range(max(PREFIXES)):
        at = np.minimum(start + j, stop - 1)
        key = key << np.uint64(8) | np.where(start + j < stop, WORD_BYTE[buf[at]], 0).astype(np.uint64)
        if j + 1 in PREFIXES:
            out[:, 1 + PREFIXES.index(j + 1)] = mix(key + np.uint64(j + 1)) % np.uint64((1 << bits) - 1) + np.uint64(1)
    return out, offsets


def _hashed(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """``hashed_words`` of many texts, in slices."""
    batches = (pa.RecordBatch.from_arrays([pa.array(texts[i : i + 500], pa.large_string())], ["t"]) for i in range(0, len(texts), 500))
    parts = [hashed_words(b.column(0), bits) for b in slices(batches, 0)]
    return np.concatenate([w for w, _ in parts]), np.r_[0, np.cumsum(np.concatenate([np.diff(o) for _, o in parts]))]


def fit(texts: list[str], y: np.ndarray, epochs: int | None = None, seed: int = 7, bits: int = BITS) -> Model:
    """Train on texts and 0/1 labels."""
    y = np.asarray(y, float)
    if not 0 < y.sum() < len(y):
        raise ValueError("training needs labelled documents of both classes")
    epochs = epochs or int(np.clip(round(STEPS * 32 / len(y)), LEAST_EPOCHS, MOST_EPOCHS))
    rng = np.random.default_rng(seed)
    words, offsets = _hashed(texts, bits)
    total = FILTERS * len(WIDTHS)
    params = [
        rng.normal(0, 0.02, (1 << bits, DIM)).astype(np.float32),
        np.concatenate([rng.normal(0, (w * DIM) ** -0.5, (DIM, w * FILTERS)) for w in WIDTHS], 1).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.3, total).astype(np.float32),
        np.zeros(1, np.float32),
    ]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 32
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
    # the columns of each filter at each of its places
    place = [[slice(_AT[i] + j * FILTERS, _AT[i] + (j + 1) * FILTERS) for j in range(w)] for i, w in enumerate(WIDTHS)]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), size):
            batch = order[lo : lo + size]
            w = np.concatenate([words[offsets[i] : offsets[i + 1]] for i in batch])
            off = np.r_[0, np.cumsum(offsets[batch + 1] - offsets[batch])]
            top, arg = strongest(params[0], params[1], w, off)
            top = np.where(arg >= 0, top + params[2], np.float32(0))
            arg[top <= 0] = -1
            x = np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(x @ params[3] + params[4][0], -60, 60)))
            d = ((p - y[batch]) * weight[batch] / len(batch)).astype(np.float32)
            grads = [None, np.zeros_like(params[1]), np.zeros_like(params[2]), x.T @ d, np.array([d.sum()], np.float32)]
            b, f = np.nonzero(arg >= 0)
            g = d[b] * params[3][f]
            np.add.at(grads[2], f, g)
            places, pulls = [np.zeros(0, np.int64)], [np.zeros((0, DIM), np.float32)]
            for i, width in enumerate(WIDTHS):
                on = f // FILTERS == i
                for j in range(width):
                    at = arg[b[on], f[on]] + j
                    inside = at < off[b[on] + 1]
                    at, col, gg = at[inside], place[i][j].start + f[on][inside] % FILTERS, g[on][inside]
                    np.add.at(grads[1].T, col, gg[:, None] * params[0][w[at]].sum(1))
                    places.append(at)
                    pulls.append(gg[:, None] * params[1][:, col].T)
            used, inv = np.unique(np.concatenate(places), return_inverse=True)
            demb = np.zeros((len(used), DIM), np.float32)
            np.add.at(demb, inv, np.concatenate(pulls))
            some = demb.any(1)
            used, demb = used[some], demb[some]
            step += 1
            fix = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            if len(used):
                ids, inv = np.unique(w[used], return_inverse=True)
                ge = np.zeros((len(ids), DIM), np.float32)
                np.add.at(ge, inv.ravel(), np.repeat(demb, w.shape[1], 0))
                m[0][ids] = 0.9 * m[0][ids] + 0.1 * ge
                v[0][ids] = 0.999 * v[0][ids] + 0.001 * ge * ge
                params[0][ids] -= 0.02 * fix * m[0][ids] / (np.sqrt(v[0][ids]) + 1e-7)
            for k in range(1, len(params)):
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] * grads[k]
                params[k] -= (0.01 * fix * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
    seen = np.zeros(1 << bits, bool)
    seen[words.ravel()] = True
    params[0][~seen] = 0  # a word that training had no chance to learn about says nothing
    return Model(params[0] @ params[1], params[2], params[3], float(params[4][0]))


def best_threshold(bins: pd.DataFrame) -> float:
    """The threshold of the best F1: the middle of the gap below the last bin that is taken.

    ``bins`` has the rows ``n``, the toxic ones ``y`` and the least and greatest score ``low`` and ``high`` of each.
    """
    bins = bins.sort_values("low", ascending=False)
    f1 = 2 * bins["y"].cumsum() / (bins["n"].cumsum() + max(1, bins["y"].sum()))
    k = int(np.argmax(f1))
    below = bins["high"].iloc[k + 1] if k + 1 < len(bins) else 0.0
    return float((bins["low"].iloc[k] + below) / 2)


def fit_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[Model | None, list[int]]:
    """A model fitted on three quarters of the labelled sample, not calibrated, and their doc_ids; None where it hasn't both classes."""
    rows = [r for i, r in enumerate(labelled_sample(docs, labels, "toxic", max_rows)) if i % 4 != 3]
    y = np.array([r[2] for r in rows])
    return (fit([r[1] for r in rows], y) if len(set(y.tolist())) == 2 else None), sorted({r[0] for r in rows})


def calibrate(model: Model, scores: DataFrame, labels: DataFrame, fitted: list[int]) -> Model:
    """Set the thresholds by all labelled documents of ``raw_scores`` whose doc_id is not in ``fitted``."""
    seen = scores.sparkSession.createDataFrame([(i,) for i in fitted], "doc_id long")
    held = scores.filter("score is not null").join(usable(labels, "toxic"), "doc_id").join(F.broadcast(seen), "doc_id", "left_anti")
    counts = held.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.min("score").alias("low"), F.max("score").alias("high")).toPandas()
    if 0 < counts["y"].sum() < counts["n"].sum():
        model.common = best_threshold(counts.groupby("bin").agg({"n": "sum", "y": "sum", "low": "min", "high": "max"}))
        for name, bins in counts.groupby("lang"):
            few = min(bins["y"].sum(), (bins["n"] - bins["y"]).sum())
            if few:
                model.by_lang[name] = float((few * best_threshold(bins) + PRIOR_ROWS * model.common) / (few + PRIOR_ROWS))
    return model


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on a part of the labelled sample and calibrate on all other labelled documents."""
    model, fitted = fit_sample(docs, labels, max_rows)
    return calibrate(model, raw_scores(docs, model), labels, fitted)


def raw_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang, score, bin)`` of every document row, the score null where the text is; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, 2):
            score = m.score(*hashed_words(batch.column(2)))
            with np.errstate(divide="ignore"):
                logit = np.log(score) - np.log1p(-score)
            place = np.floor(np.clip(logit, -MOST_LOGIT, MOST_LOGIT) * BINS).astype(np.int32)
            null = np.asarray(batch.column(2).is_null())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64(), mask=null), pa.array(place)], ["doc_id", "lang", "score", "bin"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang string, score double, bin int")


def judged(scores: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang, score, threshold, toxic)`` of every row of ``raw_scores``; no shuffle."""
    common, by_lang = model.common, model.by_lang

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.asarray(batch.column(2).fill_null(0.0))
            limit = np.array([by_lang.get(x, common) for x in batch.column(1).to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array(limit, pa.float64()), pa.array((score >= limit) & (score > 0))], ["doc_id", "lang", "score", "threshold", "toxic"])

    return scores.mapInArrow(run, SCHEMA)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang, score, threshold, toxic)`` of every document row; no shuffle."""
    return judged(raw_scores(docs, model), model)


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``, once for the thresholds and the result."""
    model, fitted = fit_sample(docs, labels, max_rows)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.lit(0.0).alias("score"), F.lit(0.5).alias("threshold"), F.lit(False).alias("toxic"))
    scores = stable(raw_scores(docs, model))
    return judged(scores, calibrate(model, scores, labels, fitted))
