"""Toxicity by the nearest labelled examples in exact TF-IDF cosine, through a block-max inverted index.

Terms are all words of the labelled sample and the beginnings of its words, which stand for inflected
forms; none is left out. A term weighs (1 + ln tf) * idf * rf, where rf is the relevance frequency of supervised
term weighting (Lan et al., 2009): log2(2 + a / max(1, c)) for a toxic and c other examples that hold it.

The labelled vectors lie in an inverted index cut into blocks of similar examples, with the largest weight of each
term in each block. A query adds up the postings of its rare terms; its common terms, which many examples hold,
are bounded by the block maxima at first. It visits blocks by falling bound, adds the common terms there, and stops when
no block left can hold one of its nearest, so the result is exact. Queries go through together, those that visit
the same block in one product. Votes count by distance, and are
calibrated by the votes that the labelled examples get from each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import bounded_ids, id_fold

#: Labelled documents of each label at most, neighbours that vote, examples a block, words whose terms a worker remembers.
LABELLED, NEIGHBOURS, BLOCK, CACHE_WORDS = 512, 15, 32, 400_000
#: Documents and characters that are scored together.
TOGETHER, CHARACTERS = 128, 2_000_000
#: Examples and terms that are given as evidence.
EVIDENCE = 5
#: A term that more than one in so many examples holds is common.
COMMON = 32
_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of word beginnings that are terms, written with a star.
_STEMS = (4, 5, 6, 7)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if isinstance(text, str) else []


def terms_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in _STEMS if len(word) > n)]


def known_terms(word: str, vocabulary: dict[str, int]) -> list[int]:
    """The word's terms that are in the vocabulary. Longer beginnings, and the word, are there only if the shorter ones are."""
    out = []
    n = len(word)
    for k in _STEMS:
        if n <= k:
            break
        t = vocabulary.get(word[:k] + "*")
        if t is None:
            return out
        out.append(t)
    t = vocabulary.get(word)
    if t is not None:
        out.append(t)
    return out


def together(texts: pd.Series) -> Iterator[slice]:
    """Runs of texts of at most TOGETHER texts, and CHARACTERS characters or one text."""
    at = size = 0
    for k, text in enumerate(texts):
        n = len(text) if isinstance(text, str) else 0
        if k > at and (k - at >= TOGETHER or size + n > CHARACTERS):
            yield slice(at, k)
            at, size = k, 0
        size += n
    if len(texts):
        yield slice(at, len(texts))


def term_counts(text: str | None) -> dict[str, int]:
    tf: dict[str, int] = {}
    for w in words_of(text):
        for t in terms_of(w):
            tf[t] = tf.get(t, 0) + 1
    return tf


@dataclass
class BlockMaxIndex:
    """Unit vectors ``rows`` (terms, weights) over a vocabulary, in blocks of neighbouring rows; ``labels`` and ``weights`` by row."""

    vocabulary: dict[str, int]
    idf: np.ndarray  # of each term, times its relevance frequency
    rows: list[tuple[np.ndarray, np.ndarray]]
    ids: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float
    knots: tuple[np.ndarray, np.ndarray] | None = None
    known: dict[str, list[int]] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        n, size = len(self.rows), len(self.vocabulary)
        terms = np.concatenate([t for t, _ in self.rows]) if n else np.zeros(0, np.int64)
        value = np.concatenate([w for _, w in self.rows]) if n else np.zeros(0)
        row = np.repeat(np.arange(n), [len(t) for t, _ in self.rows]) if n else np.zeros(0, np.int64)
        df = np.bincount(terms, minlength=size)
        self.place = np.where(df * COMMON > n, np.cumsum(df * COMMON > n) - 1, -1)  # of a common term among those
        often = self.place[terms] >= 0 if n else np.zeros(0, bool)
        blocks = -(-n // BLOCK)
        dense = np.zeros((int((self.place >= 0).sum()), blocks * BLOCK))
        dense[self.place[terms[often]], row[often]] = value[often]
        self.blocks = np.ascontiguousarray(dense.reshape(len(dense), blocks, BLOCK).transpose(1, 0, 2))  # block, common term, row
        self.maxima = self.blocks.max(axis=2).T.copy()  # common term, block
        order = np.argsort(terms[~often], kind="stable")
        self.posting_rows, self.posting_values = row[~often][order], value[~often][order]
        self.posting_starts = np.searchsorted(terms[~often][order], np.arange(size + 1))

    def vectors(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text's words the known terms, ascending, and their weights, of length 1; both empty without a known term."""
        vocabulary, known = self.vocabulary, self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        words = [*set().union(*texts)]
        place = dict(zip(words, range(len(words)), strict=True))
        flat: list[int] = []
        starts = [0]
        for w in words:
            found = known.get(w)
            if found is None:
                found = known[w] = known_terms(w, vocabulary)
            flat += found
            starts.append(len(flat))
        none = (np.zeros(0, np.int64), np.zeros(0))
        if not flat:
            return [none] * len(texts)
        ids = [np.fromiter(map(place.__getitem__, t), np.int64, len(t)) for t in texts]
        terms, first, wide = np.array(flat), np.array(starts), len(self.vocabulary)
        pair, times = np.unique(np.concatenate([i + k * len(place) for k, i in enumerate(ids)]), return_counts=True)
        doc, word = np.divmod(pair, len(place))
        length = first[word + 1] - first[word]
        at = np.repeat(first[word] - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        key, inverse = np.unique(np.repeat(doc, length) * wide + terms[at], return_inverse=True)
        tf = np.bincount(inverse, weights=np.repeat(times, length))
        owner, ts = np.divmod(key, wide)
        v = (1 + np.log(tf)) * self.idf[ts]
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        parts = [(ts[a:b], v[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        return [(t, w / max(float(np.linalg.norm(w)), 1e-300)) if len(t) else none for t, w in parts]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query the k rows of the greatest positive cosine, ties to the smaller row; ``skip`` has a row for each
        that is left out. Cosines are rounded to 12 places."""
        n, m, blocks = len(self.rows), len(queries), len(self.blocks)
        if not n or not m:
            return [[] for _ in queries]
        size = blocks * BLOCK
        of = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        ts, ws = (np.concatenate(x) for x in zip(*queries, strict=True))
        place = self.place[ts]
        common, rare = place >= 0, place < 0
        q = np.zeros((m, self.blocks.shape[1]))
        q[of[common], place[common]] = ws[common]
        first = self.posting_starts[ts[rare]]
        length = self.posting_starts[ts[rare] + 1] - first
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(int(length.sum()))
        to = np.repeat(of[rare] * size, length) + self.posting_rows[at]
        base = np.bincount(to, weights=self.posting_values[at] * np.repeat(ws[rare], length), minlength=m * size).reshape(m, size)
        base[:, n:] = -2.0
        if skip is not None:
            base[np.arange(m), skip] = -2.0
        base = base.reshape(m, blocks, BLOCK)
        bounds = base.max(axis=2) + q @ self.maxima
        order = np.argsort(-bounds, axis=1, kind="stable")
        total = np.full((m, blocks, BLOCK), -2.0)
        edge, done, step = np.zeros(m), 0, 2
        while done < blocks:
            part = order[:, done : done + step]
            bound = np.take_along_axis(bounds, part, 1)
            asks, which = np.nonzero((bound >= edge[:, None] - 1e-9) & (bound > 0))
            if not len(asks):
                break
            visited = part[asks, which]
            by = np.argsort(visited, kind="stable")
            for b, js in zip(np.unique(visited).tolist(), np.split(asks[by], np.flatnonzero(np.diff(visited[by])) + 1), strict=True):
                total[js, b] = base[js, b] + (q if len(js) == m else q[js]) @ self.blocks[b]
            if size > k:
                edge = np.maximum(np.partition(total.reshape(m, size), size - k, axis=1)[:, size - k], 0.0)
            done, step = done + step, step * 2
        out = []
        for scores, least in zip(total.reshape(m, size), edge.tolist(), strict=True):
            rows = np.flatnonzero(scores >= least - 1e-9)
            found = np.round(scores[rows], 12)
            best = np.lexsort((rows, -found))[:k]
            out.append([(float(found[i]), int(rows[i])) for i in best if found[i] > 0])
        return out

    def votes(self, queries: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[float]:
        found = []
        for a in range(0, len(queries), TOGETHER):
            found += self.nearest(queries[a : a + TOGETHER], skip=None if skip is None else skip[a : a + TOGETHER])
        return [self.vote(x) for x in found]

    def vote(self, near: list[tuple[float, int]]) -> float:
        up = down = 0.0
        for cos, r in near:
            w = self.weights[r] / (1.02 - min(cos, 1.0))
            up, down = up + w * self.labels[r], down + w
        return up / down if down else -1.0

    def calibrated(self, vote: float) -> float:
        """The share of toxic examples among those with such a vote (-1: without a known term)."""
        if vote < 0 or self.knots is None:
            return self.prior
        return float(np.interp(vote, *self.knots))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("rows", "known")} | {"rows": range(len(self.rows)), "known": {}}


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y by x (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, c in zip(x[order], y[order], w[order], strict=True):
        pools.append([a, a, b * c, c])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            last = pools.pop()
            pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
    return np.array([e for p in pools for e in p[:2]]), np.array([p[2] / p[3] for p in pools for _ in range(2)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> BlockMaxIndex:
    """From at most LABELLED documents of each label, weighted to the labels' true shares; their distinct terms go to the driver.

    A document with contradicting label rows counts with the larger label; null labels and labels
    of missing documents are passed over. Without labelled documents the index is empty and the prior 0.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = bounded_ids(rows, "doc_id", ["label"], LABELLED)
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, label, text in zip(pdf["doc_id"], pdf["label"], pdf["text"], strict=True):
                tf = term_counts(text)
                yield pd.DataFrame({"doc_id": [i], "label": [label], "terms": [list(tf)], "tf": [list(tf.values())]})

    got = sample.mapInPandas(counted, "doc_id long, label int, terms array<string>, tf array<int>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["terms"]))
    sizes = {k: sum(r["label"] == k for r in got) for k in (0, 1)}
    weight = {k: counts.get(k, 0) / max(1, sizes[k]) for k in sizes}
    vocabulary = {t: k for k, t in enumerate(sorted({t for r in got for t in r["terms"]}))}
    at = [np.array([vocabulary[t] for t in r["terms"]], np.int64) for r in got]
    held = {k: np.bincount(np.concatenate([np.zeros(0, np.int64), *(a for a, r in zip(at, got, strict=True) if r["label"] == k)]), minlength=len(vocabulary)) for k in sizes}
    idf = np.log((1 + len(got)) / (1 + held[0] + held[1])) + 1
    scale = idf * np.log2(2 + held[1] / np.maximum(1, held[0]))
    rows = []
    for r, ts in zip(got, at, strict=True):
        v = (1 + np.log(np.array(r["tf"], np.float64))) * scale[ts]
        o = np.argsort(ts)
        rows.append((ts[o], (v / max(float(np.linalg.norm(v)), 1e-300))[o]))
    bare = [r for r in got if not r["terms"]]
    bare_all = sum(weight[r["label"]] for r in bare)
    prior = sum(weight[r["label"]] * r["label"] for r in bare) / bare_all if bare_all else counts.get(1, 0) / max(1, sum(counts.values()))
    # neighbours in the index share their weightiest term among those of several examples
    several = held[0] + held[1] > 1
    top = [int(ts[np.argmax(ws * several[ts])]) if len(ts) else -1 for ts, ws in rows]
    order = sorted((k for k, r in enumerate(got) if r["terms"]), key=lambda k: (got[k]["label"], top[k], got[k]["doc_id"]))
    index = BlockMaxIndex(
        vocabulary, scale, [rows[k] for k in order], np.array([got[k]["doc_id"] for k in order], np.int64),
        np.array([got[k]["label"] for k in order], np.float64), np.array([weight[got[k]["label"]] for k in order]), float(prior),
    )
    if order:
        votes = np.array(index.votes(index.rows, [*range(len(order))]))
        index.knots = monotone(np.where(votes < 0, 0.5, votes), index.labels, index.weights)
    return index


def predict(docs: DataFrame, index: BlockMaxIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, evidence_ids, evidence_terms for each row, from the whole text alone.

    The evidence is the nearest labelled toxic examples and the known terms of the text that weigh most. Null and
    empty texts, and texts without a known term, get the share of toxic ones among such
    examples, or of all if there are none such. Repeated rows and null ids are rows as any other; neighbours that tie at the
    edge of the vote are taken by the index's order; other columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = sent.value
        names = list(x.vocabulary)
        for pdf in batches:
            out = []
            for part in together(pdf["text"]):
                texts = [words_of(t) for t in pdf["text"].iloc[part]]
                vectors = x.vectors(texts)
                for i, (ts, ws), near in zip(pdf["doc_id"].iloc[part], vectors, x.nearest(vectors), strict=True):
                    most = ts[np.argsort(-ws, kind="stable")[:EVIDENCE]].tolist()
                    out.append((i, x.calibrated(x.vote(near)), [int(x.ids[r]) for _, r in near if x.labels[r] == 1][:EVIDENCE], [names[t] for t in most]))
            out = pd.DataFrame(out, columns=["doc_id", "score", "evidence_ids", "evidence_terms"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, "doc_id long, score double, evidence_ids array<long>, evidence_terms array<string>")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence: labels of two folds by id are learned, the third is held out."""
    index = fit(docs, labels.where(id_fold(F.col(id_col)) != 1), id_col, text_col, label_col)
    return predict(docs, index, id_col, text_col).select(
        "doc_id", (id_fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence_ids", "evidence_terms"
    )
