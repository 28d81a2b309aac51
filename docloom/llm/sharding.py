"""Sharding by jump consistent hashing (Lamping and Veach, 2014), with SQL functions alone.

A document's shard depends on its key and the number of shards only; no ring or
table is kept. With one more shard a key either stays or moves to the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm._common import gapless

#: Fixed: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_M22, _M20 = (1 << 22) - 1, (1 << 20) - 1
_C = (MULTIPLIER & _M22, (MULTIPLIER >> 22) & _M22, MULTIPLIER >> 44)


def _next_state(key: Column) -> Column:
    """key * MULTIPLIER + 1 modulo 2**64, in limbs of 22 bits: none of the products overflows, so ANSI mode doesn't matter."""
    a0 = key.bitwiseAND(F.lit(_M22))
    a1 = F.shiftrightunsigned(key, 22).bitwiseAND(F.lit(_M22))
    a2 = F.shiftrightunsigned(key, 44)
    t0 = a0 * _C[0] + 1
    t1 = a0 * _C[1] + a1 * _C[0] + F.shiftright(t0, 22)
    t2 = a0 * _C[2] + a1 * _C[1] + a2 * _C[0] + F.shiftright(t1, 22)
    low = t0.bitwiseAND(F.lit(_M22)).bitwiseOR(F.shiftleft(t1.bitwiseAND(F.lit(_M22)), 22))
    return low.bitwiseOR(F.shiftleft(t2.bitwiseAND(F.lit(_M20)), 44))


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key, 0 to shards - 1.

    The jumps are counted by a fold over a short array; the few keys that need more
    jumps than that (none in practice) take a fold of full length, so all are exact.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(s: Column, _: Column) -> Column:
        def moved(k: Column) -> Column:
            ratio = F.lit(2147483648.0) / (F.shiftrightunsigned(k, 33) + 1).cast("double")
            return F.struct(k.alias("k"), s["j"].alias("b"), F.floor((s["j"] + 1).cast("double") * ratio).cast("long").alias("j"))

        return F.when(s["j"] < shards, F.transform(F.array(_next_state(s["k"])), moved)[0]).otherwise(s)

    start = F.struct(key.cast("long").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, 64))), start, step)
    if shards > 64:
        full = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step)
        end = F.transform(F.array(end), lambda s: F.when(s["j"] >= shards, s).otherwise(full))[0]
    return end["b"].cast("int")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the number of shards alone decide. ``slot`` numbers
    the rows of a shard from 0 without gaps; ``grown_shard`` is the shard with one more.

    Null text: size 1 and the checksum of no bytes (0). Null id: key 0. Repeated ids
    share a shard and have different slots (rows alike in id and text are alike in any
    order). An empty table gives no rows. Other columns are ignored. Slots are spread
    over ``buckets`` pieces a shard, so no task sorts a whole shard.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")).select(
        "doc_id",
        (F.coalesce(F.octet_length("_text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("_text")), F.lit(0)).cast("long").alias("text_crc32"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
    )
    return gapless(rows, "shard", ["doc_id", "size", "text_crc32"], "slot", buckets).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
