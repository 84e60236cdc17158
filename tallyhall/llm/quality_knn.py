"""Quality by nearest-neighbour voting among labelled documents in a latent space.

Terms of a text are pairs of neighbouring character classes, hashed words and
bins of a few shares (distinct words, repeated lines, the commonest word, the
length). Latent semantic analysis: log counts weighted by inverse document
frequency over all documents, projected on the leading singular vectors of a
bounded labelled sample. Every document's vector meets all labelled vectors in exact blocked
cosine products; the nearest labels are weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhall.llm.common import texts_of, tuned
from tallyhall.llm.labelled import held_out, sample

FOLDS, FOLD = 5, 0
#: Labelled documents of each class that the model is made from, at most.
PER_CLASS = 1000
DIMENSIONS = 48
NEIGHBOURS = 25
SHARPNESS = 12.0
_BLOCK = 256
_MARKS = ".,!?;:'\"()-_/\\|#*$%&<>@=+[]{}~^`"
_CLASSES = 7 + len(_MARKS)
_WORDS, _BINS = 1024, 12
TERMS = _CLASSES**2 + _WORDS + 4 * _BINS


def _class_table() -> np.ndarray:
    """Class of each byte: lower, upper, digit, space, line end, beyond ASCII, other, or its own mark."""
    t = np.full(256, 6, np.int64)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    t[ord(" ")] = t[ord("\t")] = 3
    t[ord("\n")] = 4
    t[128:] = 5
    for k, c in enumerate(_MARKS):
        t[ord(c)] = 7 + k
    return t


_TABLE = _class_table()


def terms(text: str) -> np.ndarray:
    """Counts of a whole text's terms; an empty text has only its bins."""
    out = np.zeros(TERMS, np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if len(data) > 1:
        c = _TABLE[data]
        out[: _CLASSES**2] = np.bincount(c[:-1] * _CLASSES + c[1:], minlength=_CLASSES**2)
    words = text.split()
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    for w, k in counts.items():
        out[_CLASSES**2 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % _WORDS] += k
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    shares = len(counts) / n, 1 - len(set(lines)) / max(1, len(lines)), max(counts.values(), default=0) / n, min(1.0, len(words).bit_length() / 16)
    for k, s in enumerate(shares):
        out[_CLASSES**2 + _WORDS + k * _BINS + min(_BINS - 1, int(s * _BINS))] = 8.0
    return out


@dataclass
class Model:
    idf: np.ndarray
    project: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled documents x dimensions, of unit length
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        v = v @ self.project
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity."""
        near = self.embed(counts) @ self.vectors.T
        k = min(k, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        sim = np.take_along_axis(near, at, 1)
        weight = np.exp(SHARPNESS * (sim - sim.max(axis=1, keepdims=True)))
        return (weight * self.labels[at]).sum(1) / weight.sum(1)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, of each term, how many have it: partial counts per task, ``TERMS`` rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for t in texts_of(batch[0]):
                own[:TERMS] += terms(t) > 0
                own[TERMS] += 1
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at])], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return int(out[TERMS]), out[:TERMS]


def fit(counts: np.ndarray, labels: np.ndarray, n: int, df: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """Leading singular vectors of the sample by subspace iteration; ``n`` and ``df`` are the corpus's document frequencies."""
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    a = np.log1p(counts) * idf
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(3)
    d = min(dimensions, len(a))
    q = a.T @ (a @ rng.standard_normal((a.shape[1], d)).astype(np.float32))
    for _ in range(4):  # subspace iteration
        q, _ = np.linalg.qr(q)
        q = a.T @ (a @ q)
    q, _ = np.linalg.qr(q)
    m = Model(idf, q.astype(np.float32), np.zeros((0, d), np.float32), np.asarray(labels, np.float32))
    m.vectors = m.embed(counts)
    return m


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse terms of sampled texts: places and counts as bytes."""
    for batch in batches:
        rows = []
        for t in texts_of(batch[1]):
            v = terms(t)
            at = np.flatnonzero(v)
            rows.append((at.astype(np.int32).tobytes(), v[at].tobytes()))
        cols = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([batch[0], batch[2].cast(pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], ["doc_id", "label", "at", "counts"])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """A model from at most ``per_class`` labelled documents of each class and all documents' term frequencies; None without labels."""
    rows = sample(docs, labels, "quality", FOLDS, FOLD, {0: per_class, 1: per_class}).mapInArrow(_packed, "doc_id long, label int, at binary, counts binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: r.doc_id)
    counts = np.zeros((len(rows), TERMS), np.float32)
    for k, r in enumerate(rows):
        counts[k, np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["counts"], np.float32)
    return fit(counts, np.array([r.label for r in rows]), *document_frequencies(docs))


def classify(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null texts are empty, and empty texts are scored like others. Without any
    label to learn from all scores are 0.5. A null id isn't held out. Equal
    similarities at the edge of the neighbourhood are cut by numpy's partition,
    the same way for equal texts. Repeated rows stay; other columns are ignored.
    """
    spark = tuned(docs.sparkSession)
    model = spark.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            texts, scores = texts_of(batch[2]), []
            for lo in range(0, len(texts), _BLOCK):
                block = texts[lo : lo + _BLOCK]
                counts = np.stack([terms(t) for t in block])
                scores.append(m.score(counts) if m else np.full(len(block), 0.5))
            s = np.clip(np.concatenate(scores).astype(np.float64), 0, 1) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch[0], batch[1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", FOLDS, FOLD).alias("held_out"), "text")
    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
