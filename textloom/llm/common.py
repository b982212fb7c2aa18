"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.numbering import cut as cut


#: Rows that Python hands back at once, so that wide results of long texts stay small.
ROWS_BACK = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sample_below(limit: int, n: int) -> int:
    """The signed 64-bit number at or below which a uniform hash of about ``limit`` of ``n`` rows lies, whatever ``n``; all rows if ``n <= limit``."""
    return min((limit << 64) // max(1, n), (1 << 64) - 1) - (1 << 63)


#: Rows up to which a table is broadcast; rows that share a key from which it is looked up apart from the others.
FEW, MANY = 1_000_000, 200_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", plain: bool = False, n: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``, both small or kept.

    A table of at most ``FEW`` rows is broadcast. A larger one is joined by a shuffle, but for the keys that over
    ``MANY`` of ``rows`` share, of which there are at most a ``MANY``-th as many as rows; their part of the table is broadcast.
    ``plain``: no key has many rows, so that is not looked for. ``n``: rows of ``table``, counted if not given; over
    ``FEW`` it may be any number over it.
    """
    if (table.limit(FEW + 1).count() if n is None else n) <= FEW:
        return rows.join(F.broadcast(table), keys, how)
    if plain:
        return rows.join(table, keys, how)
    hot = cut(rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > MANY).drop("__n"))
    if hot.limit(FEW + 1).count() > FEW or hot.isEmpty():
        return rows.join(table, keys, how)
    part = table.join(F.broadcast(hot), keys, "left_semi")
    apart = rows.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(part), keys, how)
    return rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys, how).unionByName(apart)


def add_columns(df: DataFrame, inputs: list[str | Column], fields: list[tuple[str, str]], make: Callable[[], Callable[..., pd.DataFrame]]) -> DataFrame:
    """``df`` with the columns ``fields`` (name, type) that Python computes from ``inputs``.

    ``make()`` runs once per task and returns a function from the input series to a frame of the new columns. Only
    the inputs go to Python; every other column stays in the JVM. A column of ``df`` named like a new one is replaced.
    """
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])

    @F.pandas_udf(schema)
    def computed(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        step = make()
        for batch in batches:
            inputs = batch if isinstance(batch, tuple) else (batch,)
            for at in range(0, len(inputs[0]), ROWS_BACK):
                yield step(*[x.iloc[at : at + ROWS_BACK] for x in inputs])

    columns = [F.col(c) if isinstance(c, str) else c for c in inputs]
    names = [n for n, _ in fields]
    held = free_name(df, "__computed")
    rest = [c for c in df.columns if c not in names]
    out = df.withColumn(held, computed(*columns))
    return out.select(*[F.col(f"`{c}`") for c in rest], *[F.col(held)[n].alias(n) for n in names])
