"""Semantic chunking: units are packed in order until the topic changes or the token budget is full."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators.numbering import cut


def adjacent_cosine(units: DataFrame, parent: str, pos: str, vec: str = "embedding", spread: bool = False) -> DataFrame:
    """``units`` with ``sim``, the cosine to the unit before it; null for a parent's first unit.

    With ``spread``, for parents of any size, units are ordered over range partitions, and only the last unit of each
    partition is carried to the next one. Without, a parent is one document and a window of its own.
    """
    if not spread:
        before = F.lag(vec).over(Window.partitionBy(parent).orderBy(pos))
        placed = units.withColumn("__before", before)
    else:
        ranged = cut(units.repartitionByRange(parent, pos).withColumn("__part", F.spark_partition_id()))
        # One row per partition: its last unit. Of the partitions before, the nearest one has the unit before.
        last = ranged.groupBy("__part").agg(F.max_by(F.struct(F.col(parent).alias("p"), F.col(vec).alias("v")), F.struct(parent, pos)).alias("l"))
        parts = ranged.select("__part").distinct()
        carried = parts.withColumn("l", F.lit(None).cast(last.schema["l"].dataType)).unionByName(last, allowMissingColumns=True)
        carried = carried.groupBy("__part").agg(F.first("l", ignorenulls=True).alias("l")).withColumn("__carry", F.lag("l").over(Window.orderBy("__part"))).drop("l")
        inside = F.lag(vec).over(Window.partitionBy("__part", parent).orderBy(pos))
        first = F.row_number().over(Window.partitionBy("__part", parent).orderBy(pos)) == 1
        joined = ranged.join(F.broadcast(carried), "__part").withColumn("__in", inside).withColumn("__first", first)
        held = F.when(F.col("__first"), F.when(F.col("__carry.p").eqNullSafe(F.col(parent)), F.col("__carry.v"))).otherwise(F.col("__in"))
        placed = joined.withColumn("__before", held).drop("__part", "__carry", "__in", "__first")
    return placed.withColumn("sim", F.when(F.col("__before").isNotNull(), V.cosine(vec, "__before"))).drop("__before")


def segments(docs: DataFrame, key: str, granularity: str = "paragraph", text: str = "text") -> DataFrame:
    """``key``, ``pos``, ``start``, ``end``, ``text`` of the units of each text; offsets in code points, texts trimmed.

    A paragraph ends at a blank line, a sentence at ``.``, ``!``, ``?`` or a line feed. Blank texts have no unit.
    """
    if granularity not in T.UNITS:
        raise ValueError(f"granularity is one of {', '.join(T.UNITS)}")
    each = docs.select(key, F.posexplode(T.spans_of(T.UNITS[granularity], text)).alias("pos", "u"))
    return each.select(key, F.col("pos").cast("bigint").alias("pos"), "u.start", "u.end", "u.text")


def chunks(units: DataFrame, docs: DataFrame, key: str, max_tokens: int = 1024, drop_threshold: float = 0.5, sim: str | None = "sim", text: str = "text") -> DataFrame:
    """``pack`` with each chunk's ``start``, ``end``, ``text`` (the document's, so with what stands between units) and ``chunk_id``.

    ``units``: ``key``, ``pos``, ``start``, ``end``, ``tokens`` and ``sim``, as ``segments`` numbers them.
    """
    packed = pack(units, key, "pos", max_tokens, drop_threshold, sim=sim, spans=True)
    whole = packed.join(docs.select(F.col(key), F.col(text).alias("__text")), key)
    piece = F.substring(F.col("__text"), F.col("start") + 1, F.col("end") - F.col("start"))
    out = whole.withColumn("text", piece).drop("__text")
    return out.withColumn("chunk_id", F.sha2(F.concat_ws("|", key, "start", "end", "text"), 256))


def pack(units: DataFrame, parent: str, pos: str, max_tokens: int = 1024, drop_threshold: float = 0.5, tokens: str = "tokens", sim: str | None = "sim", spans: bool = False) -> DataFrame:
    """One row per chunk: parent, ``chunk`` (from 0), ``first_pos``, ``last_pos``, ``tokens``, ``unit_indices``, and with ``spans`` ``start`` and ``end``.

    A chunk ends before a unit that is less similar to the one before than ``drop_threshold`` (0: never), or that
    would take the chunk over ``max_tokens``; a unit over the budget is a chunk of its own. Null tokens count as 0.
    A parent is one document: its units' numbers and sizes, not their texts, meet in a task.
    """
    if max_tokens <= 0 or not 0 <= drop_threshold <= 1:
        raise ValueError("max_tokens is positive, drop_threshold from 0 to 1")

    @F.pandas_udf("array<int>")
    def cuts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for sizes, sims in batches:
            yield pd.Series([_chunks(t, s, max_tokens, drop_threshold) for t, s in zip(sizes, sims, strict=True)])

    span = [F.col(c).cast("bigint").alias(c) for c in ("start", "end")] if spans else []
    unit = F.struct(F.col(pos).alias("pos"), F.coalesce(F.col(tokens), F.lit(0)).cast("bigint").alias("tokens"), (F.col(sim) if sim else F.lit(None)).cast("double").alias("sim"), *span)
    whole = units.groupBy(parent).agg(F.sort_array(F.collect_list(unit)).alias("u"))
    numbered = whole.select(parent, F.posexplode(F.arrays_zip(F.col("u"), cuts(F.col("u.tokens"), F.col("u.sim")).alias("chunk"))).alias("i", "z"))
    numbered = numbered.select(parent, "i", F.col("z.chunk").alias("chunk"), F.col("z.u.pos").alias("pos"), F.col("z.u.tokens").alias("tokens"), *[F.col(f"z.u.{c}").alias(c) for c in ("start", "end") if spans])
    return numbered.groupBy(parent, "chunk").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.sum("tokens").alias("tokens"), F.sort_array(F.collect_list("i")).alias("unit_indices"),
        *([F.min("start").alias("start"), F.max("end").alias("end")] if spans else []),
    )


def _chunks(tokens: list, sims: list, max_tokens: int, drop_threshold: float) -> list[int]:
    out, chunk, held = [], 0, 0
    for i, (t, s) in enumerate(zip(tokens, sims, strict=True)):
        if i and ((s is not None and s == s and drop_threshold > 0 and s < drop_threshold) or held + t > max_tokens):
            chunk, held = chunk + 1, 0
        held += t
        out.append(chunk)
    return out
