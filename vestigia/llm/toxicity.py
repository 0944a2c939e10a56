"""Toxicity scores by compression distance.

Two zstandard dictionaries are made from labelled text, one for ordinary and one for
toxic documents. Both begin with the same ordinary text, so that whatever they share
costs the same in both, and end with the terms of their own class's text, ranked by
likelihood ratio. Dictionaries of each class's windows alone tell little: a window is
short, and whether its ordinary words happen to stand in one dictionary or the other
outweighs the few words that make it toxic (the README has figures).
A document falls into windows of a few words; the bytes that a window saves under
the toxic dictionary against the ordinary one are turned into a log-likelihood
ratio, calibrated on the training windows, and a logistic model over the sums
gives the score.

The model is fitted on a bounded sample: at most ``per_class`` labelled rows of
each class, those of the lowest id hashes, leaving out rows of more than
``max_chars`` characters. Scores themselves cover all rows and whole texts.

Defined cases: null and empty texts have no window and get the score of the
empty text; labels other than 0 and 1 are ignored; without labelled rows of both
classes every score is 0; repeated ids are scored each for itself.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workers import lean

LOW, HIGH = -4, 7


@dataclass
class Params:
    per_class: int = 2000
    max_chars: int = 20_000
    folds: int = 5  # rows whose CRC-32 of the id leaves 0 are held out
    words: int = 4
    base_bytes: int = 60_000
    tail_bytes: int = 1200
    least_ratio: float = 2.0  # log-likelihood ratio of the terms of a tail
    level: int = 3
    min_share: float = 0.005  # of a class's documents that must hold a term
    positive_weight: float = 2.5
    seed: int = 7


@dataclass
class Model:
    params: Params
    ordinary: bytes = b""
    toxic: bytes = b""
    ratio: np.ndarray = field(default_factory=lambda: np.zeros(HIGH - LOW + 1))
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None

    def scorer(self) -> Scorer:
        return Scorer(self)


def _windows(text: str, words: int) -> list[bytes]:
    w = text.lower().split()
    return [f" {' '.join(w[i : i + words])} ".encode() for i in range(0, len(w), words)]


def _compressor(content: bytes, level: int):
    settings = zstandard.ZstdCompressionParameters.from_level(
        level, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    trained = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    trained.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings).compress


class Scorer:
    """A fitted model with its two compressors; made once in each worker."""

    def __init__(self, model: Model):
        p = self.params = model.params
        self.model = model
        self.lead = model.ordinary[5000:5032]
        self.by_ordinary, self.by_toxic = _compressor(model.ordinary, p.level), _compressor(model.toxic, p.level)

    def histogram(self, text: str) -> np.ndarray:
        """How many windows save how many bytes under the toxic dictionary."""
        lead, a, b = self.lead, self.by_ordinary, self.by_toxic
        saved = [len(a(w)) - len(b(w)) for w in (lead + x for x in _windows(text, self.params.words))]
        return np.bincount(np.clip(np.array(saved, np.int64), LOW, HIGH) - LOW, minlength=HIGH - LOW + 1)

    def features(self, h: np.ndarray) -> np.ndarray:
        n, s = max(1, h.sum()), float(h @ self.model.ratio)
        return np.array([s / n, s / n**0.5, min(max(s, -5.0), 20.0), np.log(n), h[3 - LOW :].sum() / n**0.5])

    def score(self, text: str) -> float:
        m = self.model
        x = (self.features(self.histogram(text)) - m.mean) / m.spread
        return float(1 / (1 + np.exp(-np.clip(x @ m.weights[:-1] + m.weights[-1], -30, 30))))


def _terms(texts: list[str]) -> Counter:
    return Counter(w for t in texts for w in set(t.lower().split()))


def _tail(own: Counter, other: Counter, n_own: int, n_other: int, params: Params) -> bytes:
    """The terms that tell a class by likelihood ratio and number, the most telling last: it is the cheapest to refer to."""
    least, out = max(3, params.min_share * n_own), b""
    ratio = {w: math.log((c + 0.5) / (n_own + 1)) - math.log((other[w] + 0.5) / (n_other + 1)) for w, c in own.items() if c >= least}
    for _, word in sorted((-r * own[w] ** 0.5, w) for w, r in ratio.items() if r >= params.least_ratio):
        piece = f" {word} ".encode()
        if len(out) + len(piece) > params.tail_bytes:
            break
        out = piece + out
    return out.rjust(params.tail_bytes, b"_")


def fit(rows: list[tuple[str, int]], params: Params) -> Model | None:
    """rows: text and label. None without rows of both classes."""
    texts = {label: [t for t, y in rows if y == label] for label in (0, 1)}
    if not texts[0] or not texts[1]:
        return None
    rng = random.Random(params.seed)
    ordinary = [w for t in texts[0] for w in _windows(t, params.words)]
    rng.shuffle(ordinary)
    base = b"".join(ordinary)[: params.base_bytes]
    counts = [_terms(texts[0]), _terms(texts[1])]
    n = len(texts[0]), len(texts[1])
    model = Model(params, base + _tail(counts[0], counts[1], n[0], n[1], params), base + _tail(counts[1], counts[0], n[1], n[0], params))
    scorer = model.scorer()
    found = [(scorer.histogram(t), y) for y in (0, 1) for t in texts[y]]
    by_class = [sum((h for h, y in found if y == c), np.zeros(HIGH - LOW + 1)) for c in (0, 1)]
    smooth = [20.0, 20.0 * by_class[1].sum() / max(1.0, by_class[0].sum())]
    shares = [(b + s) / (b + s).sum() if (b + s).sum() else np.ones_like(b) for b, s in zip(by_class, smooth, strict=True)]
    model.ratio = np.log(np.maximum(shares[1], 1e-9)) - np.log(np.maximum(shares[0], 1e-9))
    x, y = np.array([scorer.features(h) for h, _ in found]), np.array([y for _, y in found])
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.c_[(x - model.mean) / model.spread, np.ones(len(x))]
    weight, w = np.where(y == 1, params.positive_weight, 1.0), np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + 1e-2 * w
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), gradient)
    model.weights = w
    return model


def held_out(id_col: str, folds: int):
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % folds) == 0


def train(documents: DataFrame, labels: DataFrame, params: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Fits on the bounded sample of labelled rows that are not held out."""
    params = params or Params()
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & ~held_out("_id", params.folds))
    sample = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(params.per_class)
        sample = part if sample is None else sample.unionByName(part)
    texts = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.length("_t") <= params.max_chars)
    rows = texts.join(F.broadcast(sample), "_id").select("_id", "_t", "_y").collect()  # at most 2 * per_class label rows
    return fit([(r["_t"], r["_y"]) for r in sorted(rows, key=lambda r: (r["_id"], r["_y"], r["_t"]))], params)


def score(documents: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id and ``score``."""
    if model is None:
        return documents.select(F.col(id_col).cast("long").alias(id_col), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)  # two dictionaries and a few numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])

    return documents.select(F.col(id_col).cast("long").alias(id_col), text_col).mapInArrow(lean(work), f"{id_col} long, score double")


def kept(documents: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below ``threshold``, all columns as they are."""
    if model is None:
        return documents
    shared = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "") < threshold for t in batch.column(place)], pa.bool_()))

    return documents.mapInArrow(lean(work), documents.schema)


def judge(documents: DataFrame, labels: DataFrame, params: Params | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    params = params or Params()
    scored = score(documents, train(documents, labels, params))
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id", params.folds), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
