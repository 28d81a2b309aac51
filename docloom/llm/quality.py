"""Text quality by the votes of the nearest labelled documents in a latent-semantic space.

Terms are words and runs of three bytes, both hashed to a fixed number of buckets, pairs of neighbouring
character classes, and how words and lines recur; a truncated singular value decomposition of the labelled
sample's TF-IDF matrix gives the space. The labelled vectors, at most LABELLED of each label, are broadcast; documents
are multiplied with all of them in blocks, and the nearest vote by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_ids, id_fold

#: Labelled rows of each label at most, neighbours that vote, dimensions of the space, documents a block.
LABELLED, NEIGHBOURS, DIMENSIONS, BLOCK = 1024, 15, 48, 256
#: Buckets of words, and of runs of bytes; the weight of both against the terms of form.
BUCKETS, WORDING = 1024, 0.5
_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOUBCDFGHJKLMNPQRSTVWXYZ", "0123456789", " \t\r\f\v", "\n", ".", ",", "!", "?", "#", "$", "%", "&", "*", "|", "-_", "'\"`", "()[]{}<>", "@/\\:", ";=+~^")
_N = len(_CLASSES) + 2  # and bytes of other letters, and all that is left
_CLASS_OF = bytes(next((k for k, c in enumerate(_CLASSES) if chr(i) in c), _N - 2 if i >= 128 else _N - 1) for i in range(256))
_LINES = re.compile(r"[^\n]+")
#: New and recurring words of a block, the same word twice in a row, new and recurring lines.
_MORE = 5
_FORM = _N * _N + _MORE
TERMS = _FORM + 2 * BUCKETS
_WORDS = 64


def terms(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's terms of each kind, over the whole text; zeros for an empty or null text."""
    out = np.zeros(TERMS, np.float32)
    if not isinstance(text, str) or not text:
        return out
    c = np.frombuffer(text.encode("utf-8", "replace").translate(_CLASS_OF), np.uint8)
    for a in range(0, len(c), 1 << 20):
        part = c[a : a + (1 << 20) + 1]
        out[: _N * _N] += np.bincount(part[:-1].astype(np.intp) * _N + part[1:], minlength=_N * _N)
    out[: _N * _N] /= max(1, len(c) - 1)
    words = text.split()
    new = sum(len(set(words[a : a + _WORDS])) for a in range(0, len(words), _WORDS))
    twice = sum(map(eq, words, words[1:]))
    lines = _LINES.findall(text)
    fresh = len(set(lines))
    n, m = max(1, len(words)), max(1, len(lines))
    out[_N * _N : _FORM] = new / n, (len(words) - new) / n, twice / n, fresh / m, (len(lines) - fresh) / m
    lower = text.lower()
    for a in range(0, len(words), 1 << 16):
        part = [zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in (w.lower() for w in words[a : a + (1 << 16)])]
        out[_FORM : _FORM + BUCKETS] += np.bincount(part, minlength=BUCKETS)
    raw = np.frombuffer(lower.encode("utf-8", "replace"), np.uint8)
    for a in range(0, len(raw) - 2, 1 << 20):
        b = raw[a : a + (1 << 20) + 2].astype(np.uint32)
        run = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
        out[_FORM + BUCKETS :] += np.bincount((run >> np.uint32(8)) % np.uint32(BUCKETS), minlength=BUCKETS)
    out[_FORM : _FORM + BUCKETS] *= WORDING**2 / n
    out[_FORM + BUCKETS :] *= WORDING**2 / max(1, len(raw) - 2)
    return np.sqrt(out)


def leading(a: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The first right singular vectors of a, as columns, by subspace iteration from a fixed start."""
    a = a.astype(np.float64)
    q = np.random.default_rng(0).standard_normal((a.shape[1], min(a.shape[1], dimensions + 16)))
    for _ in range(rounds):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, turned = np.linalg.eigh((a @ q).T @ (a @ q))
    return np.ascontiguousarray((q @ turned[:, ::-1])[:, :dimensions]).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray  # TERMS x dimensions
    vectors: np.ndarray  # labelled x dimensions, of length 1
    labels: np.ndarray
    weights: np.ndarray  # rows of a label for each sampled one
    prior: float

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.idf) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """The weighted share of label 1 among the k nearest; the prior for rows without a term."""
        n = len(self.labels)
        out = np.full(len(x), self.prior)
        if not n:
            return out
        for a in range(0, len(x), BLOCK):
            part = x[a : a + BLOCK]
            cos = self.project(part) @ self.vectors.T
            # to six places, then by the order of the labelled rows, which is that of their ids
            rank = np.round(cos.astype(np.float64) * 1e6).astype(np.int64) * -n + np.arange(n)
            near = np.argpartition(rank, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(part), 1))
            sim = np.maximum(np.take_along_axis(cos, near, 1), 0.0).astype(np.float64) ** 8 * self.weights[near]
            total = sim.sum(1)
            votes = (sim * self.labels[near]).sum(1)
            some = (total > 0) & part.any(1)
            out[a : a + BLOCK][some] = votes[some] / total[some]
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """From at most LABELLED documents of each label, weighted to the labels' true shares.

    A document with contradicting label rows counts with the larger label; null labels and
    labels of missing documents are passed over.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = bounded_ids(rows, "doc_id", ["label"], LABELLED)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "x": [terms(t).tobytes() for t in pdf["text"]]})

    got = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(ids), "doc_id")
        .select("doc_id", "label", "text")
        .mapInPandas(run, "doc_id long, label int, x binary")
        .groupBy("doc_id", "label")
        .agg(F.min("x").alias("x"))
        .collect()
    )
    got.sort(key=lambda r: r["doc_id"])
    if not got:
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    y = np.array([r["label"] for r in got], np.float64)
    sampled = {k: int((y == k).sum()) for k in counts}
    weights = np.array([counts[int(k)] / sampled[int(k)] for k in y])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1).astype(np.float32)
    axes = leading(x * idf, DIMENSIONS)
    model = QualityModel(idf, axes, np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5)
    return QualityModel(idf, axes, model.project(x).astype(np.float32), y, weights, float((weights * y).sum() / weights.sum()))


def predict(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for each row, from the whole text alone.

    Null and empty texts get the share of label 1 among the labelled rows (0.5 without any).
    Repeated rows and null ids are rows as any other; cosines that are equal to six places
    are taken by the labelled rows' ids; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK):
                part = pdf.iloc[a : a + BLOCK]
                scores = sent.value.scores(np.stack([terms(t) for t in part["text"]]))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "score": np.clip(scores, 0.0, 1.0)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double")


def keep(docs: DataFrame, model: QualityModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is at least the threshold; only the text goes through Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [sent.value.scores(np.stack([terms(t) for t in texts.iloc[a : a + BLOCK]])) for a in range(0, len(texts), BLOCK)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    score = F.pandas_udf(run, "double")
    return docs.where(score(F.col(text_col)) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted: labels of two folds by id are learned, the third is held out."""
    model = fit(docs, labels.where(id_fold(F.col(id_col)) != 1), id_col, text_col, label_col)
    return predict(docs, model, id_col, text_col).select(
        "doc_id", (id_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
