"""Near-duplicates by SimHash (Charikar, 2002) and deletion-variant signatures.

Fingerprints that differ in at most three bits differ in at most one bit in one of their two
halves. So each half is indexed as it is and under its 32 variants with one bit as a wildcard: two fingerprints
with such a near half share a key. Equal fingerprints are one node. Under a variant only those that differ in its
wildcard are compared, as the others share the whole half.

No key is expanded into pairs. The least fingerprint of each side of a key stands for that side; all others are
verified against it, and against the one before them, on all 64 bits, and the links so far are joined into components.
A key is settled if its fingerprints lie in one component, or if a side has its least alone. What is left
of the others goes under keys that are narrower by the same rule: the half that the key leaves open is cut in two
again, and again every part has its one-wildcard variants. After DEPTH cuts four bits and the wildcards are
open, so that a key holds at most 2 ** (4 + DEPTH) fingerprints; only then pairs are listed, and only between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm._common import written
from docloom.llm._graph import components

SEED, SHINGLE, BITS = 42, 3, 3
#: Cuts of the 64 bits: into 32, 16, 8 and 4.
DEPTH = 4
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each the majority over the XXH64 of the word shingles, repeats included; 0 without a word."""
    from xxhash import xxh64_intdigest as xx

    words = text.encode("utf-8", "replace").translate(_LOWER).split() if isinstance(text, str) else []
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xx(b" ".join(words), SEED)]
    else:
        hashes = [xx(b" ".join(w), SEED) for w in zip(*(words[k:] for k in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[a : a + (1 << 16)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def _near(a: Column, b: Column, bits: int = BITS) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= bits


def _variants(members: DataFrame, depth: int) -> DataFrame:
    """(key, at, may, side, fp) for members (key, at, may, fp): ``at`` is where the bits lie that the key leaves open, 64 >> depth of them.

    The open bits are cut in two. Each part, as it is (side null) or without one of its bits (that bit is the side), joins
    the key; the other part is what the new key leaves open. ``may`` is how many open bits a key's fingerprints that are
    to be compared may differ in, one less after each wildcard. Three need wildcards in both parts, two in one
    part (else a part is equal), and one needs none.
    """
    width = 64 >> (depth + 1)
    part = members.select("key", "at", "may", "fp", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("h"))
    part = part.select("key", (F.col("at") + (1 - F.col("h")) * width).alias("at"), "may", "fp", "h", F.expr(f"shiftrightunsigned(fp, at + h * {width})").bitwiseAND(F.lit((1 << width) - 1).cast("long")).alias("bits"))
    first = F.when(F.col("may") + (1 - F.col("h")) > 2, 0).otherwise(width)
    wild = part.select("*", F.explode(F.sequence(first, F.lit(width))).alias("w"))
    one = F.expr("shiftleft(1L, w)")
    bits = F.when(F.col("w") < width, F.col("bits").bitwiseAND(F.bitwise_not(one))).otherwise(F.col("bits"))
    side = F.when(F.col("w") < width, (F.col("bits").bitwiseAND(one) != 0).cast("int"))
    tag = F.col("h") * (width + 1) + F.col("w")
    # the first key is exact; narrower ones are hashes, where a collision can only bring more to be verified
    key = F.shiftleft(tag.cast("long"), 32).bitwiseOR(bits) if depth == 0 else F.xxhash64("key", tag, bits)
    return wild.select(key.alias("key"), "at", (F.col("may") - (F.col("w") < width).cast("int")).alias("may"), side.alias("side"), "fp")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints ``fp``, all at most three bits apart, that join the same components as all such pairs.

    At most two links a key and fingerprint, so the links are linear in the fingerprints however they crowd.
    """
    spark = nodes.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = nodes.repartition(tasks, "fp").select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("at"), F.lit(BITS).alias("may"), "fp")
    found, of_key, zero = None, Window.partitionBy("key", "at"), F.coalesce("side", F.lit(0)) == 0
    for depth in range(DEPTH):
        ranked = _variants(members, depth).select(
            "key", "at", "may", "side", "fp", F.lag("fp").over(of_key.orderBy("fp")).alias("before"),
            F.min(F.when(zero, F.col("fp"))).over(of_key).alias("least0"), F.min(F.when(~zero, F.col("fp"))).over(of_key).alias("least1"), F.count(F.lit(1)).over(of_key).alias("n"),
        ).where("n > 1 AND (side IS NULL OR least0 IS NOT NULL AND least1 IS NOT NULL)")
        shared = written(ranked.select("key", "at", "may", "side", "fp", "before", F.when(F.col("side") == 0, F.col("least1")).otherwise(F.col("least0")).alias("least")))
        new = shared.select("fp", F.explode(F.array("least", "before")).alias("a")).where(F.col("a").isNotNull() & (F.col("a") != F.col("fp")) & _near(F.col("a"), F.col("fp")))
        new = new.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
        found = written(new.distinct() if found is None else found.unionByName(new).distinct())
        of = components(found, "a", "b").select(F.col("node").alias("_fp"), "component")
        named = shared.join(of.hint("merge"), F.col("fp") == F.col("_fp"), "left").select("key", "at", "may", "side", "fp", F.coalesce("component", "fp").alias("c"))
        sides = named.select(
            "key", "at", "may", "fp", "c", F.min("c").over(of_key).alias("lo"), F.max("c").over(of_key).alias("hi"),
            F.count(F.when(zero, 1)).over(of_key).alias("n0"), F.count(F.when(~zero, 1)).over(of_key).alias("n1"),
        )
        members = written(sides.where("lo <> hi AND (n1 = 0 AND n0 > 2 OR n0 > 1 AND n1 > 1)").select("key", "at", "may", "fp", "c"))
        if members.isEmpty():
            return found
    sides = members.select("key", "at", F.col("fp").alias("a"), F.col("c").alias("ca")).join(members.select("key", "at", F.col("fp").alias("b"), F.col("c").alias("cb")).hint("merge"), ["key", "at"])
    last = sides.where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _near(F.col("a"), F.col("b"))).select("a", "b")
    return found.unionByName(last).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for each row: the smallest doc_id that is reachable over links of at most three bits.

    Null texts and texts without words have fingerprint 0 and link like any other. Rows with a null id form
    no links of their own; they get the component of their fingerprint, or null if no row with an id shares it.
    Repeated rows and ids are rows of their own. Whole texts count. Other columns are ignored; an empty table gives no rows.
    """
    rows = written(fingerprints(docs, id_col, text_col, shingle))
    nodes = written(rows.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = links(nodes.select("fp"))
    named = found.join(nodes.select(F.col("fp").alias("a"), F.col("least").alias("la")).hint("merge"), "a").join(nodes.select(F.col("fp").alias("b"), F.col("least").alias("lb")).hint("merge"), "b")
    groups = components(named, "la", "lb")
    of = nodes.join(groups.hint("merge"), F.col("least") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "least").alias("component_id"))
    return rows.join(of.hint("merge"), F.col("fp") == F.col("_fp"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, share: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates by runs of ``shingle`` words, a similarity of ``share`` or more.

    Fingerprints propose pairs as in :func:`near_duplicates`; each pair is verified on the whole sets of runs, and
    similar pairs with more than three bits between them are found exactly, too: see :mod:`docloom.llm.jaccard`.
    """
    from docloom.llm import jaccard

    return jaccard.one_of_each(docs, share, shingle, id_col, text_col)
