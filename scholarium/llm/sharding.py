"""Sharding by jump consistent hashing, in DataFrame functions alone.

The published loop (Lamping and Veach, 2014) runs as a fold over at most
``shards`` steps: a 64-bit linear congruential generator, kept as two 32-bit
halves so that no product leaves the range of a long, draws the next shard
count at which a key moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The generator's multiplier, split as hi, then lo as two 16-bit halves.
_MULTIPLIER = 2862933555777941757
_MASK = 0xFFFFFFFF
#: Blocks of a shard in which slots are counted; a block is what one task numbers.
BLOCKS = 1024


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0 to shards - 1, of a 64-bit key (null counts as 0)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    a_hi, a_1, a_0 = _MULTIPLIER >> 32, (_MULTIPLIER >> 16) & 0xFFFF, _MULTIPLIER & 0xFFFF
    mask, half, long = F.lit(_MASK).cast("long"), F.lit(0xFFFF).cast("long"), lambda x: F.lit(x).cast("long")

    def low_part(s: Column) -> Column:  # lo * multiplier + 1, before its carry leaves
        upper = s["lo"] * long(a_1)
        return s["lo"] * long(a_0) + long(1) + F.shiftleft(upper.bitwiseAND(half), 16)

    def high_part(s: Column) -> Column:  # hi * multiplier mod 2^32
        upper = s["hi"] * long(a_1)
        return s["hi"] * long(a_0) + F.shiftleft(upper.bitwiseAND(half), 16)

    def step(s: Column, _: Column) -> Column:
        low = low_part(s)
        carry = F.shiftright(low, 32) + F.shiftright(s["lo"] * long(a_1), 16)
        cross = s["lo"] * long(a_hi & 0xFFFF) + F.shiftleft((s["lo"] * long(a_hi >> 16)).bitwiseAND(half), 16)
        hi = (high_part(s).bitwiseAND(mask) + cross.bitwiseAND(mask) + carry).bitwiseAND(mask)
        drawn = F.shiftright(hi, 1) + long(1)  # the upper 31 bits, plus 1
        jump = F.floor((s["j"] + long(1)).cast("double") * (F.lit(float(1 << 31)) / drawn.cast("double"))).cast("long")
        moved = F.struct(s["j"].alias("b"), jump.alias("j"), hi.alias("hi"), low.bitwiseAND(mask).alias("lo"))
        return F.when(s["j"] < long(shards), moved).otherwise(s)

    start = F.struct(
        long(-1).alias("b"), long(0).alias("j"), F.shiftright(key, 32).bitwiseAND(mask).alias("hi"), key.bitwiseAND(mask).alias("lo")
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda s: s["b"].cast("int"))


def shard_rows(docs: DataFrame, shards: int, key: str = "doc_id", out: str = "shard") -> DataFrame:
    """``docs`` with a column ``out``.  Equal keys share a shard; null keys share the shard of 0."""
    return docs.withColumn(out, jump_hash(F.col(key), shards))


def number_slots(rows: DataFrame, key: str = "doc_id", shard: str = "shard", ties: tuple[str, ...] = (), blocks: int = BLOCKS) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard.

    A shard is cut into blocks by a hash of the key.  Block sizes, counted in a
    pass over the key column alone, give each block its first slot; rows are
    then numbered within blocks, so no task holds a shard.  The order is block,
    then key (nulls first), then ``ties``; rows alike in all of these are
    interchangeable.
    """
    from pyspark.sql import Window

    block = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(blocks)).cast("int")
    rows = rows.withColumn("_block", block)
    sizes = rows.groupBy(F.col(shard).alias("_s"), F.col("_block").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("_s", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(shard, "_block").orderBy(F.col(key).asc_nulls_first(), *ties)
    numbered = rows.withColumn("_row", F.row_number().over(within))
    joined = numbered.join(firsts, (F.col(shard) == F.col("_s")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn("slot", F.col("_first") + F.col("_row") - F.lit(1)).drop("_block", "_s", "_b", "_first", "_row")


def write_shards(docs: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """One folder ``shard=k`` per shard, as Parquet; each task writes what it has, so no shard passes through one task."""
    shard_rows(docs, shards, key).write.partitionBy("shard").parquet(path)
