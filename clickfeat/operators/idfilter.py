"""Wide tables cut to the ids that some rows ask for, before they are shuffled.

The asked ids set bits of a bitmap at the place that a hash of the id names. The bitmap is broadcast in chunks of 32,768
bits, and a row of the wide table stays if its bit is set: no asked row is lost, and of the others about one in
``BITS_PER_ID`` stays, for the join that follows to drop. The bitmap has at most ``MAX_BITS`` bits (8 MB) however many ids there are;
where so many are asked that it would let most rows through, there is no filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BITS = 1 << 15
BITS_PER_ID = 16
MAX_BITS = 1 << 26


def bitmap_bits(ids: int) -> int:
    """Size of the bitmap for so many ids: a power of two; 0 where a filter would not pay."""
    bits = CHUNK_BITS
    while bits < BITS_PER_ID * ids and bits < MAX_BITS:
        bits *= 2
    return bits if 2 * ids <= bits else 0


def _place(key: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("long")), F.lit(bits))


def id_bitmap(ids: DataFrame, key: str, bits: int) -> DataFrame:
    """(__chunk, __words): every chunk of the bitmap, as 512 longs each."""
    at = ids.filter(F.col(key).isNotNull()).select(_place(F.col(key), bits).alias("__at"))
    words = at.groupBy(F.floor(F.col("__at") / 64).alias("__word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(__at % 64 as int))")).alias("__bits"))
    # a word without a bit is added as 0, so a chunk's words sorted by number are its array
    none = ids.sparkSession.range(bits // 64).select(F.col("id").alias("__word"), F.lit(0).cast("long").alias("__bits"))
    whole = words.unionByName(none).groupBy("__word").agg(F.bit_or("__bits").alias("__bits"))
    per = CHUNK_BITS // 64
    chunk = whole.groupBy(F.floor(F.col("__word") / per).alias("__chunk")).agg(
        F.sort_array(F.collect_list(F.struct((F.col("__word") % per).alias("w"), "__bits"))).alias("__set"))  # 512 words
    return chunk.select("__chunk", F.col("__set")["__bits"].alias("__words"))


def rows_asked_for(table: DataFrame, key: str, ids: DataFrame, id_col: str | None = None) -> DataFrame:
    """Rows of ``table`` whose ``key`` may be among ``ids`` (all that are, and few others). ``ids`` is counted and read once."""
    id_col = id_col or key
    bits = bitmap_bits(ids.count())
    if not bits:
        return table
    at = _place(F.col(key), bits)
    bitmap = F.broadcast(id_bitmap(ids, id_col, bits))
    hit = F.expr("getbit(get(__words, cast((__at % {0}) div 64 as int)), cast(__at % 64 as int)) = 1".format(CHUNK_BITS))
    placed = table.withColumn("__at", at).withColumn("__of", F.floor(F.col("__at") / CHUNK_BITS))
    return placed.join(bitmap, F.col("__of") == F.col("__chunk")).filter(hit).select(*[placed[c] for c in table.columns])
