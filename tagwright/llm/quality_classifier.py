"""Operator 9 - quality by a regularised quadratic discriminant.

Statistics of every whole text (shares of symbols, stops, capitals and digits,
word lengths, repeated words, windows and lines), brought near normality by
logarithms and square roots, are modelled by one Gaussian per class. A class
covariance is shrunk towards the pooled one and that towards a multiple of the
identity:

    S_k' = (1 - GAMMA) * ((1 - LAMBDA) * S_k + LAMBDA * S) + GAMMA * tr(S) / d * I

The score is the posterior of label 1 from the difference of the two log
densities; Mahalanobis distances use the inverse Cholesky factors, computed
once on the driver and sent along. Fitting needs sums over the training rows
only (count, sum, sum of products per class), added up by Spark.

Only text reaches a score. Training rows are those whose crc32(doc_id as text)
mod 4 is not 2 and that have a label.

Defined cases: NULL and empty texts have zero statistics and a score like any
other; rows with a NULL doc_id are scored and not held out; repeated
labels count repeatedly; without labels of both classes every score is the
share of label 1 (0.5 without labels); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import keep, slim_batches, table, tidy

FOLDS, HELD_OUT = 4, 2
LAMBDA, GAMMA = 0.2, 0.02
CUT = 0.7
_CLASSES = {
    "symbols": b"#*$%&|<>@^~=+_\\{}[]",
    "stops": b".,;:",
    "marks": b"!?",
    "capitals": bytes(range(65, 91)),
    "digits": b"0123456789",
    "lines": b"\n",
    "wide": bytes(range(128, 256)),
}
FEATURES = (*_CLASSES, "log_words", "word_length", "word_spread", "same_words", "same_windows", "same_lines")


def _repeats(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Share of each document's hashes that equal an earlier one."""
    order = np.lexsort((h, doc))
    h, d = h[order], doc[order]
    again = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    return np.bincount(d[1:][again], minlength=n) / np.maximum(np.bincount(d, minlength=n), 1)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of transformed statistics per document."""
    n = len(offsets) - 1
    chars = np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(FEATURES)))
    for i, members in enumerate(_CLASSES.values()):
        is_in = np.zeros(256, bool)
        is_in[list(members)] = True
        places = np.flatnonzero(is_in[buf])
        out[:, i] = np.sqrt(np.diff(np.searchsorted(places, offsets)) / chars)
    starts, ends = textvec.word_bounds(buf, offsets[:-1])
    words = textvec.words_at(buf, starts, ends, offsets)
    at, per = len(_CLASSES), np.maximum(words.n_words, 1)
    doc = np.repeat(np.arange(n), words.n_words)
    length = np.log1p((ends - starts).astype(np.float64))
    mean = np.bincount(doc, length, n) / per
    out[:, at] = np.log1p(words.n_words)
    out[:, at + 1] = mean
    out[:, at + 2] = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per - mean**2, 0))
    out[:, at + 3] = np.sqrt(_repeats(words.hash, doc, n))
    windows, window_doc = words.windows(3)
    out[:, at + 4] = np.sqrt(_repeats(words.range_hash(windows, windows + 3), window_doc, n))
    feeds = np.flatnonzero(buf == 10)
    opens = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], feeds + 1]))
    opens = opens[opens < len(buf)]
    closes = np.append(opens[1:], len(buf))
    closes = np.where(buf[closes - 1] == 10, closes - 1, closes) if len(opens) else closes[:0]
    full = closes > opens
    opens, closes = opens[full], closes[full]
    line_doc = np.searchsorted(offsets, opens, "right") - 1
    out[:, at + 5] = np.sqrt(_repeats(textvec.bytes_hash(buf, opens, closes), line_doc, n))
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and x, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offsets in textvec.parts(b.column("text")):
                x = statistics(buf, offsets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), lists], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, x array<double>")


class Discriminant(NamedTuple):
    """Per class: mean, inverse Cholesky factor, log determinant and log prior; or a constant share of label 1."""

    classes: list
    share: float


def fit(rows: DataFrame, lam: float = LAMBDA, gamma: float = GAMMA) -> Discriminant:
    """From labelled rows (x, quality): sums by class, a few hundred numbers, reach the driver."""
    d = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False)) if len(b) else np.zeros((0, d))
            y = b.column("quality").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).reshape(-1)])
        k, at = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total.reshape(-1))], names=["k", "at", "v"])

    sums = np.zeros((2, 1 + d + d * d))
    for r in rows.select("x", "quality").mapInArrow(tidy(run), "k int, at int, v double").groupBy("k", "at").agg(F.sum("v").alias("v")).collect():
        sums[r["k"], r["at"]] = r["v"]
    return discriminant(sums, lam, gamma)


def discriminant(sums: np.ndarray, lam: float = LAMBDA, gamma: float = GAMMA) -> Discriminant:
    """From count, sum and sum of products of both classes."""
    d = len(FEATURES)
    n = sums[:, 0]
    share = float(n[1] / n.sum()) if n.sum() else 0.5
    if n.min() < 2:
        return Discriminant([], share)
    means = sums[:, 1 : 1 + d] / n[:, None]
    scatter = [sums[k, 1 + d :].reshape(d, d) - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
    pooled = sum(scatter) / n.sum()
    classes = []
    for k in (0, 1):
        s = (1 - gamma) * ((1 - lam) * scatter[k] / n[k] + lam * pooled) + gamma * (np.trace(pooled) / d + 1e-9) * np.eye(d)
        lower = np.linalg.cholesky((s + s.T) / 2)
        classes.append((means[k], np.linalg.inv(lower), 2 * np.log(np.diag(lower)).sum(), np.log(n[k] / n.sum())))
    return Discriminant(classes, share)


def scores(model: Discriminant, x: np.ndarray) -> np.ndarray:
    if not model.classes:
        return np.full(len(x), model.share)
    log = [prior - 0.5 * (det + (((x - mean) @ inverse.T) ** 2).sum(1)) for mean, inverse, det, prior in model.classes]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    found = keep(features(docs))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").filter("quality IN (0, 1)")
    model = fit(found.filter(fold != HELD_OUT).join(known, "doc_id"))
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack(b.column("x").to_numpy(zero_copy_only=False)) if len(b) else np.zeros((0, len(FEATURES)))
            s = scores(kept.value, x)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    held = F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "x").mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim_batches(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
