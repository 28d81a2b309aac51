"""Connected components over a table of links, without collecting them anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import dropped, written

#: Links that a task joins at once before the rounds.
PIECE = 250_000


def _stars(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """The links of these that lead from each node straight to the smallest node it reaches over them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    to = np.arange(len(ids))
    while (to[x] != to[y]).any():
        p, q = to[x], to[y]
        np.minimum.at(to, np.maximum(p, q), np.minimum(p, q))
        while (to[to] != to).any():
            to = to[to]
    moved = to != np.arange(len(ids))
    return pd.DataFrame({"a": ids[moved], "b": ids[to[moved]]})


def _contracted(edges: DataFrame, n: int, piece: int) -> DataFrame:
    """The ``n`` links, at most ``piece`` at a time, as stars of the same components."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for pdf in batches:
            a, b = np.concatenate([a, pdf["a"].to_numpy()]), np.concatenate([b, pdf["b"].to_numpy()])
            while len(a) > piece:
                yield _stars(a[:piece], b[:piece])
                a, b = a[piece:], b[piece:]
        if len(a):
            yield _stars(a, b)

    return edges.coalesce(-(-n // piece)).mapInPandas(run, "a long, b long")


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step (Kiveris et al., 2014): neighbours are hung onto the smallest one."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.where("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least.hint("merge"), "a").select("b", "m").withColumnRenamed("b", "a").withColumnRenamed("m", "b").unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str, piece: int = PIECE) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. ``a`` and ``b`` hold long ids.

    Each task first joins what it has, at most ``piece`` links at a time; if that is all there is, the stars are the components.
    Else links are replaced by stars around smaller nodes, two steps a round, until nothing changes;
    every round ends in a table in the shared folder. No side of a join is broadcast, as both grow with the links. Only counts go to the driver. Nulls and
    self-links are passed over; without links the result is empty.
    """
    edges = written(links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def sign(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = sign(edges)
    whole = was[0] <= piece
    if was[0]:
        links, edges = edges, written(_contracted(edges, was[0], piece))
        dropped(links)
    while not whole:
        new = written(_step(_step(edges, True), False))
        now = sign(new)
        dropped(edges)
        edges = new
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
