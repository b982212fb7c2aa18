"""Sharding by rendezvous hashing of record keys over weighted shards.

Each (key, shard) pair gets a uniform number u in (0, 1) from XXH64; a record goes to the shard with the least
-ln(u) / weight. A shard therefore gets records in proportion to its weight, and a shard that is added takes records
only into itself. All of it is column arithmetic: assigning needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut

#: Buckets into which the numbering of each shard is split, so that no task numbers a whole shard.
SLOT_BUCKETS = 256
#: Copies of one record that are laid out by one row.
COPY_CHUNK = 1000


def _cost(key: Column, shard: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key.cast("string"), F.lit(shard)), 11).cast("double")
    return -F.log((bits + 0.5) * 2.0**-53) / F.lit(float(weight))


def _weights(shards: int, weights: list[float] | None) -> list[float]:
    weights = [1.0] * shards if weights is None else list(weights)
    if shards < 1 or len(weights) != shards or min(weights) <= 0:
        raise ValueError("give one positive weight for each of at least one shard")
    return weights


def _costs(key: Column, shards: int, weights: list[float] | None) -> Column:
    # Plain numbers: a record costs one small array and no object for each shard.
    return F.array(*[_cost(key, s, w) for s, w in enumerate(_weights(shards, weights))])


def _cheapest(costs: Column) -> Column:
    return (F.array_position(costs, F.array_min(costs)) - 1).cast("int")


def shard_of(key: Column, shards: int, weights: list[float] | None = None) -> Column:
    """The shard (0-based int) of ``key``. Equal keys share a shard; null is a key like any other.

    Ties go to the lower shard. Raises ValueError unless there is a shard and every weight is positive.
    """
    return _cheapest(_costs(key, shards, weights))


def assign_shards(df: DataFrame, key: str, shards: int, weights: list[float] | None = None, shard_col: str = "shard") -> DataFrame:
    """``df`` with ``shard_col`` (which replaces a column of that name); an empty table stays empty."""
    return df.withColumn(shard_col, shard_of(F.col(f"`{key}`"), shards, weights))


def shard_manifest(df: DataFrame, key: str, text: str, shards: int, weights: list[float] | None = None) -> DataFrame:
    """One row per record: key, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``size`` is the UTF-8 length of the text plus 16; a null text has no bytes, so size 16 and checksum 0. ``slot``
    counts each shard's records from 0 without gaps. ``grown_shard`` is the shard after one more of weight 1 (or the
    mean weight) is added. Records that agree in key, size and checksum are counted before the shuffle and laid out
    again afterwards, so a key that a third of all rows hold stays one row until the end.
    """
    more = _weights(shards, weights)
    more = sum(more) / len(more)
    k = F.col(f"`{key}`")
    size = F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 16
    crc = F.coalesce(F.crc32(F.col(f"`{text}`").cast("binary")), F.lit(0)).cast("long")
    records = df.select(k.alias("k"), size.alias("size"), crc.alias("crc")).groupBy("k", "size", "crc").agg(F.count("*").alias("copies"))
    bucket = F.pmod(F.xxhash64("k", "size", "crc"), F.lit(SLOT_BUCKETS)).cast("int")
    costed = records.select("*", _costs(F.col("k"), shards, weights).alias("costs"), _cost(F.col("k"), shards, more).alias("cost"))
    # One more shard takes a record if it costs less there than anywhere else; the other costs stay as they are.
    grown = F.when(F.col("cost") < F.array_min("costs"), shards).otherwise(_cheapest(F.col("costs")))
    placed = cut(costed.select("k", "size", "crc", "copies", _cheapest(F.col("costs")).alias("shard"), grown.alias("grown_shard"), bucket.alias("bucket")))

    # At most shards * SLOT_BUCKETS rows, whatever the input.
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n"))
    starts = totals.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "bucket").orderBy("k", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("copies").over(within), F.lit(0))
    laid = placed.join(F.broadcast(starts), ["shard", "bucket"]).withColumn("first", first)
    chunks = laid.withColumn("chunk", F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / COPY_CHUNK).cast("long"))))
    copy = F.explode(F.sequence(F.col("chunk") * COPY_CHUNK, F.least(F.col("copies"), (F.col("chunk") + 1) * COPY_CHUNK) - 1))
    rows = chunks.withColumn("copy", copy)
    return rows.select(
        F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard",
        (F.col("first") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
    )


def write_shards(df: DataFrame, path: str, key: str, shards: int, weights: list[float] | None = None) -> None:
    """Write ``df`` as Parquet in one folder per shard.

    Rows are brought together by shard, and adaptive execution splits shards that are too large for a task by the map
    outputs they come from, so neither a hot key nor repeated rows end in one task, and a task that runs again writes the
    same rows. Columns named ``shard`` are replaced.
    """
    assign_shards(df, key, shards, weights).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(path)
