"""Exact top-k by inner product with Fagin's threshold algorithm (Fagin, Lotem and Naor, 2001).

Vectors are dealt into blocks of bounded size; a block keeps one sorted list a
dimension. A query walks all lists of a block in step, from the end that its sign
favours, scores each vector it meets for the first time in full, and stops as soon
as the threshold (the score that a vector unseen so far could have at most) is under
its k-th best score. Queries are dealt in blocks too, so that a task holds one block
of each side, whatever the numbers of rows are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """Not null, and neither a null nor a non-finite component."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def quantised(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def threshold_topk(query: np.ndarray, own: int | None, rows: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int, stride: int = 8) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of one block, ties to the smaller id, and how many rows were scored.

    ``rows``: n x d; ``order``: d x n, per dimension the rows by ascending value. The
    lists are walked ``stride`` entries at a time, the stride growing fourfold. The walk stops
    only when the threshold is under the k-th score: at equality a smaller id may still come.
    """
    n, d = rows.shape
    seen = np.zeros(n, bool)
    live = np.flatnonzero(query)
    best: list[tuple[int, int]] = []
    depth = 0
    q = query[live]
    lists = order[live]
    lists = np.where((q > 0)[:, None], lists[:, ::-1], lists) if len(live) else lists
    while depth < n:
        end = min(n, depth + stride) if len(live) else n
        met = np.zeros(n, bool)
        met[lists[:, depth:end] if len(live) else slice(None)] = True
        fresh = np.flatnonzero(met & ~seen)
        seen[fresh] = True
        # gathering many rows costs more than multiplying the block
        scores = (rows @ query)[fresh] if 4 * len(fresh) > n else rows[fresh] @ query
        if own is not None:  # before the cut, as the query's own rows can be many
            others = ids[fresh] != own
            fresh, scores = fresh[others], scores[others]
        if len(fresh) > k:  # ties are kept
            keep = scores >= np.partition(scores, len(fresh) - k)[len(fresh) - k]
            fresh, scores = fresh[keep], scores[keep]
        found = [(int(s), int(i)) for s, i in zip(scores, ids[fresh], strict=True)]
        best = sorted([*best, *found], key=lambda x: (-x[0], x[1]))[:k]
        depth, stride = end, stride * 4
        if len(best) == k and depth < n:
            edge = rows[lists[:, depth - 1], live]
            if int(edge @ q) < best[-1][0]:
                break
    return best, int(seen.sum())


def _matrix(vectors: pd.Series) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.int64) for v in vectors])
    top = int(np.abs(m).max(initial=0))
    # products and sums of doubles are exact below 2**53; larger values keep to integers
    return m.astype(np.float64) if top < (1 << 26) and top * top * m.shape[1] < _EXACT else m


def _block(key: tuple, left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    out = []
    if len(left) and len(right):
        left = left.sort_values("id", kind="stable")
        rows, queries = _matrix(left["v"]), _matrix(right["v"])
        if rows.dtype != queries.dtype:
            rows, queries = rows.astype(np.int64), queries.astype(np.int64)
        elif rows.dtype == np.float64 and np.abs(rows).max(initial=0) * np.abs(queries).max(initial=0) * rows.shape[1] >= _EXACT:
            rows, queries = rows.astype(np.int64), queries.astype(np.int64)
        ids = left["id"].to_numpy()
        order = np.argsort(rows, axis=0, kind="stable").T.copy()
        for qid, q in zip(right["id"], queries, strict=True):
            best, scored = threshold_topk(q, qid, rows, ids, order, k)
            out += [(qid, i, s, scored) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "scored"]).astype("int64")


def topk(
    vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 4096, query_rows: int = 512, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256
) -> DataFrame:
    """For each row of ``queries`` its k best rows of ``vectors`` but those of its own id: query_id, rank, vec_id, score.

    Components become floor(scale * x); the score is the integer inner product, ties go
    to the smaller id. Rows whose id or vector is null, or whose vector holds a null or
    non-finite component, take no part on either side. A query meets vectors of its own
    length only. Repeated rows of an id count each: as candidates they all rank, and a
    repeated query's rows are searched once. Fewer than k candidates: all of them. Empty
    tables give no rows. Scores must fit 64 bits. Other columns are ignored.
    """

    def side(df: DataFrame) -> DataFrame:
        df = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v"))
        df = df.where(F.col("id").isNotNull() & usable(F.col("_v")))
        return df.select("id", quantised(F.col("_v"), scale).alias("v"), F.size("_v").alias("dim"))

    rows, asks = side(vectors), side(queries).dropDuplicates(["id", "v"])
    blocks = max(1, -(-vectors.count() // block_rows))
    groups = max(1, -(-queries.count() // query_rows))
    at = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    of = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    rows = rows.withColumn("b", at).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asks = asks.withColumn("g", of).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = (
        rows.groupBy("b", "g", "dim")
        .cogroup(asks.groupBy("b", "g", "dim"))
        .applyInPandas(lambda key, x, y: _block(key, x, y, k), "query_id long, vec_id long, score long, scored long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
