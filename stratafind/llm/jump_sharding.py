"""Sharding by jump consistent hashing (operator 10), native.

The shard of a row follows from its key and the number of shards alone, without a ring or any table; appending a shard
moves rows only into the new one. The generator's 64-bit state is held as two 32-bit halves, so that the arithmetic stays
exact under ANSI mode. Slots number a shard's rows without gaps: the (small) digests are written once, counted by shard and
range of partitions, and each range is numbered on its own from its offset, so a shard is never gathered into one task.

Defined results: null text has no bytes (size is the overhead alone, checksum 0); a null key hashes like any other value;
repeated rows each get a slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut_lineage, require

SHARDS = 24
ROW_OVERHEAD = 8
#: Ranges of partitions that number their rows apart; shards * RANGES bounds the broadcast table of offsets.
RANGES = 512

#: Fixed value: the multiplier of the published jump consistent hash.
MULTIPLIER = 2862933555777941757


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2**64, the state as halves below 2**32."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    m1, m0 = m_lo >> 16, m_lo & 0xFFFF
    p1 = lo * F.lit(m1)
    low = lo * F.lit(m0) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
    high = (
        F.shiftright(low, 32) + F.shiftright(p1, 16) + lo * F.lit(m_hi)
        + hi * F.lit(m0) + F.shiftleft((hi * F.lit(m1)).bitwiseAND(F.lit(0xFFFF)), 16)
    )
    mask = F.lit(0xFFFFFFFF)
    return high.bitwiseAND(mask), low.bitwiseAND(mask)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among `shards`, and among one more."""
    h = F.xxhash64(key)
    mask = F.lit(0xFFFFFFFF)
    start = F.struct(
        F.shiftrightunsigned(h, 32).bitwiseAND(mask).alias("hi"), h.bitwiseAND(mask).alias("lo"),
        F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("grown"),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _next_state(s["hi"], s["lo"])
        # j = floor((b + 1) * 2**31 / (upper 31 bits + 1)), b being the last place below the number of shards
        j = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))).cast("long")
        n = F.lit(shards)
        moved = F.struct(
            hi.alias("hi"), lo.alias("lo"), j.alias("j"),
            F.when(j < n, j).otherwise(s["shard"]).alias("shard"),
            F.when(j <= n, j).otherwise(s["grown"]).alias("grown"),
        )
        return F.when(s["j"] <= n, moved).otherwise(s)

    # a jump goes ahead by one place at least, so `shards` + 1 steps end every key's walk
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards + 1)), start, jump)


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", overhead: int = ROW_OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for documents(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    digest = require(docs, *dict.fromkeys(["doc_id", "text", key])).select(
        "doc_id",
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        jump_shards(F.col(key), shards).alias("to"),
    ).select("doc_id", "size", "text_crc32", F.col("to.shard").cast("int").alias("shard"), F.col("to.grown").cast("int").alias("grown_shard"))
    digest = cut_lineage(digest).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(RANGES)))
    counts = digest.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = digest.withColumn("k", F.row_number().over(inside))
    # offsets has at most (shards) * RANGES rows, whatever the input: safe to broadcast
    return numbered.join(F.broadcast(offsets), ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("base") + F.col("k") - F.lit(1)).cast("long").alias("slot"), "grown_shard",
    )
