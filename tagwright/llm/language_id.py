"""Operator 4 - language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability per language. A word
(its letters, lower-cased, behind the word-start sign) scores the sum over all
its segmentations into pieces of the product of their probabilities, computed
by a forward recursion; a text's log-likelihood is the sum over its words.

Learning is expectation maximisation: from equal probabilities, expected piece
counts over all segmentations (forward-backward), ``ITERATIONS`` times, on the
words of at most ``TRAIN_DOCS`` documents (those with the smallest hash of
doc_id among the allowed ones). Only sums by language and piece reach the driver.

Scoring finds the distinct words of some megabytes of text with numpy, scores
those that a bounded cache does not know, all words of one length together, and
adds up cached vectors. Each text is scored whole, from its text alone.

score is the posterior probability of the predicted language under equal priors for a single word that is
as likely as the text's words are on average (the log-likelihoods divided by the number of words), so
that it tells clear texts from doubtful ones whatever their length.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0;
ties go to the first language in order; rows with a NULL doc_id are scored
and count as not held out; repeated rows are scored alike, and teach repeatedly; words and texts of any length are scored and taught whole; without any training row every text is ``und``; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textvec
from .common import slim_batches, smallest_hashes, table, tidy

FOLDS, HELD_OUT = 5, 0
TRAIN_DOCS = 3_000
ITERATIONS = 2
SMOOTHING = 0.5
CACHE_WORDS = 500_000
#: Places of a word after which the recursions are rescaled.
RESCALE = 16
START = "▁"
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOT_BITS, _SHIFTS = 18, (46, 23, 0)
_vocabularies: dict = {}


class Vocabulary:
    """Pieces of the public model by string; pieces that are not text are left out."""

    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        use = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        pieces = sorted({model.id_to_piece(i) for i in use})
        self.fill({p: i for i, p in enumerate(pieces)})

    def fill(self, ids: dict[str, int]) -> None:
        """Sets the pieces, and a hash table of them in which numpy looks up many strings at once."""
        self.ids = ids
        #: Ids behind the pieces: an unknown character, and no piece at all.
        self.unknown, self.none = len(ids), len(ids) + 1
        self.longest = max(map(len, ids))
        self.keys = np.zeros((len(_SHIFTS), 1 << _SLOT_BITS), np.uint64)
        self.slots = np.full(self.keys.shape, self.none, np.int32)
        for piece, i in ids.items():
            h = int(_substring_hashes(_codes([piece]), len(piece))[0, 0])
            for table, shift in enumerate(_SHIFTS):
                at = h >> shift & (1 << _SLOT_BITS) - 1
                if self.slots[table, at] == self.none:
                    self.keys[table, at], self.slots[table, at] = h, i
                    break
            else:
                raise ValueError("the table of pieces is too full")

    def look_up(self, h: np.ndarray) -> np.ndarray:
        out = np.full(h.shape, self.none, np.int32)
        for table, shift in enumerate(_SHIFTS):
            at = h >> np.uint64(shift) & np.uint64((1 << _SLOT_BITS) - 1)
            same = self.keys[table][at] == h
            out[same] = self.slots[table][at[same]]
        return out

    def edges(self, words: list[str]) -> np.ndarray:
        """Piece ids of words of one length: [word, end, length - 1], ``none`` where no piece is."""
        codes = _codes(words)
        n = codes.shape[1]
        reach = min(self.longest, n)
        out = np.full((len(words), n, reach), self.none, np.int32)
        for k in range(1, reach + 1):
            out[:, k - 1 :, k - 1] = self.look_up(_substring_hashes(codes, k))
        alone = out[:, :, 0]
        alone[alone == self.none] = self.unknown
        return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)


def _substring_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every substring of k code points, by its start."""
    h = np.zeros((codes.shape[0], codes.shape[1] - k + 1), np.uint64)
    for i in range(k):
        h = h * _BASE + codes[:, i : codes.shape[1] - k + 1 + i] + np.uint64(1)
    return textvec.mix(h)


def vocabulary(name: str) -> Vocabulary:
    if name not in _vocabularies:
        _vocabularies[name] = Vocabulary(name)
    return _vocabularies[name]


def letters(word: bytes) -> str:
    """The letters of a word, lower-cased, behind the start sign; '' if there are none."""
    w = word.decode()
    if not w.isalpha():
        w = "".join(c for c in w if c.isalpha())
    return START + w.lower() if w else ""


def forward(edges: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, log scale), both [word, place, language]: what is summed over the segmentations up to a place is alpha * exp(log scale).

    Every ``RESCALE`` places those that are still looked back at are brought near 1, at any length of a word.
    """
    m, n, reach = edges.shape
    alpha, scale = np.zeros((m, n + 1, p.shape[1])), np.zeros((m, n + 1, p.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        scale[:, j] = scale[:, j - 1]
        for k in range(1, min(reach, j) + 1):
            alpha[:, j] += alpha[:, j - k] * p[edges[:, j - 1, k - 1]]
        if j % RESCALE == 0:
            _rescale(alpha, scale, max(0, j + 1 - reach), j + 1)
    return alpha, scale


def backward(edges: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like ``forward``, of the segmentations from a place to the end, for one language: [word, place, 1]."""
    m, n, reach = edges.shape
    beta, scale = np.zeros((m, n + 1, 1)), np.zeros((m, n + 1, 1))
    beta[:, n] = 1
    for j in range(n - 1, -1, -1):
        scale[:, j] = scale[:, j + 1]
        for k in range(1, min(reach, n - j) + 1):
            beta[:, j] += beta[:, j + k] * p[edges[:, j + k - 1, k - 1]]
        if j % RESCALE == 0:
            _rescale(beta, scale, j, min(n + 1, j + reach))
    return beta, scale


def _rescale(values: np.ndarray, scale: np.ndarray, lo: int, hi: int) -> None:
    top = values[:, lo:hi].max(axis=1, keepdims=True)
    values[:, lo:hi] /= top
    scale[:, lo:hi] += np.log(top)


def log_likelihood(vocab: Vocabulary, words: list[str], p: np.ndarray) -> np.ndarray:
    """[word, language] for any words; '' scores 0."""
    out = np.zeros((len(words), p.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            by_length.setdefault(len(w), []).append(i)
    for n, own in by_length.items():
        step = max(1, 200_000 // (n * min(n, vocab.longest)))
        for i in range(0, len(own), step):
            at = own[i : i + step]
            alpha, scale = forward(vocab.edges([words[x] for x in at]), p)
            out[at] = np.log(alpha[:, n]) + scale[:, n]
    return out


def expected_counts(vocab: Vocabulary, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the weighted words, under p [piece]."""
    total = np.zeros(len(p))
    with np.errstate(divide="ignore"):
        log_p = np.log(p)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            by_length.setdefault(len(w), []).append(i)
    for n, own in by_length.items():
        step = max(1, 200_000 // (n * min(n, vocab.longest)))
        for i in range(0, len(own), step):
            at = own[i : i + step]
            edges = vocab.edges([words[x] for x in at])
            with np.errstate(divide="ignore"):  # a place that no segmentation reaches has the logarithm -inf
                up, down = ((np.log(x) + scale)[:, :, 0] for x, scale in (f(edges, p[:, None]) for f in (forward, backward)))
            up -= up[:, n:]
            for j in range(1, n + 1):
                for k in range(1, min(edges.shape[2], j) + 1):
                    e = edges[:, j - 1, k - 1]
                    total += np.bincount(e, weight[at] * np.exp(up[:, j - k] + down[:, j] + log_p[e]), len(total))
    total[vocab.none] = 0
    return total


class Model(NamedTuple):
    languages: list[str]
    p: np.ndarray  # [piece, language]
    vocabulary: str


def _fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, iterations: int = ITERATIONS, name: str = "piece_bpe_32k.model") -> Model:
    """From text and lang of the allowed rows of docs."""
    spark = docs.sparkSession
    allowed = docs.filter((_fold(docs["doc_id"]) != HELD_OUT) & F.col("lang").isNotNull())
    chosen = smallest_hashes(allowed.select("doc_id"), train_docs).distinct()
    sampled = allowed.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")  # train_docs ids at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        total: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                total.setdefault(lang, Counter()).update(letters(w) for w in text.encode().split())
        for lang, words in total.items():
            words.pop("", None)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

    counted = sampled.mapInArrow(tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(2 * spark.sparkContext.defaultParallelism, "word").persist()
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    vocab = vocabulary(name)
    if not languages:
        return Model([], np.zeros((vocab.none + 1, 0)), name)
    p = np.full((vocab.none + 1, len(languages)), 1.0 / vocab.none)
    p[vocab.none] = 0
    for _ in range(iterations):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            vocab, total = vocabulary(name), np.zeros(now.value.shape)
            for b in batches:
                lang = b.column("lang").to_pylist()
                words, n = b.column("word").to_pylist(), b.column("n").to_numpy().astype(float)
                for k, own in enumerate(languages):
                    at = [i for i, x in enumerate(lang) if x == own]
                    if at:
                        total[:, k] += expected_counts(vocab, [words[i] for i in at], n[at], now.value[:, k])
            piece, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[piece, k])], names=["piece", "k", "v"])

        got = counted.mapInArrow(tidy(expect), "piece int, k int, v double").groupBy("piece", "k").agg(F.sum("v").alias("v")).toArrow()
        total = np.zeros(p.shape)
        total[got["piece"].to_numpy(), got["k"].to_numpy()] = got["v"].to_numpy()
        total[: vocab.none] += SMOOTHING
        p = total / total.sum(axis=0)
    counted.unpersist()
    return Model(languages, p, name)


class Scorer:
    """Sums of cached word scores over whole texts."""

    def __init__(self, model: Model):
        self.model, self.vocab = model, vocabulary(model.vocabulary)
        self.forget()

    def forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.scores = np.empty((0, len(self.model.languages) + 1))

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """[document, language + 1]: log-likelihoods, and the number of words with a letter."""
        starts, ends = textvec.word_bounds(buf, offsets[:-1])
        words = textvec.words_at(buf, starts, ends, offsets)
        out = np.zeros((len(offsets) - 1, self.scores.shape[1]))
        if not len(starts):
            return out
        keys, first, which = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            raw, own = buf.tobytes(), first[new]
            text = [letters(raw[i:j]) for i, j in zip(starts[own].tolist(), ends[own].tolist(), strict=True)]
            rows = np.column_stack([log_likelihood(self.vocab, text, self.model.p), [bool(t) for t in text]])
            at = np.searchsorted(self.keys, keys[new])
            self.keys, self.scores = np.insert(self.keys, at, keys[new]), np.insert(self.scores, at, rows, axis=0)
        per_word = self.scores[np.searchsorted(self.keys, keys)][which]
        full = words.n_words > 0
        out[full] = np.add.reduceat(per_word, words.first[:-1][full], axis=0)
        return out


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is looked at."""
    kept = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, names = Scorer(kept.value), np.array([*kept.value.languages, UNKNOWN], object)
        for b in batches:
            for lo, hi, buf, offsets in textvec.parts(b.column("text")):
                found = scorer.texts(buf, offsets)
                log, known = found[:, :-1], found[:, -1] > 0
                if log.shape[1]:
                    best = np.where(known, log.argmax(axis=1), -1)
                    mean = (log - log.max(axis=1, keepdims=True)) / np.maximum(found[:, -1:], 1)
                    score = np.where(known, 1 / np.exp(mean).sum(axis=1), 0.0)
                else:
                    best, score = np.full(hi - lo, -1), np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), b.column("held_out").slice(lo, hi - lo), pa.array(names[best], pa.string()), pa.array(score)],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    held = F.coalesce(_fold(docs["doc_id"]) == HELD_OUT, F.lit(False)).alias("held_out")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs.select("doc_id", "text", "lang")))
