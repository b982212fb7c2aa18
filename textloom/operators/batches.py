"""Micro-batches of texts of like length, so that padding costs a model little."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.scorers import Embedder
from textloom.operators.numbering import numbered

#: Lengths that count as one, and padded tokens of a batch.
BAND, BUDGET = 16, 4096


def length_batches(rows: DataFrame, id_col: str, tokens: str = "n_tokens", budget: int = BUDGET, band: int = BAND) -> DataFrame:
    """``rows`` with ``band`` (the length, rounded up to a multiple) and ``batch``, the place of its batch within the band.

    The rows of a band are numbered by length and id and cut so that a batch, padded to the band, has at most ``budget`` tokens;
    a row longer than that is a batch of its own. Numbers come from range partitions, so a length that very
    many rows have is spread out. Null lengths count as 0.
    """
    if budget < 1 or band < 1:
        raise ValueError("budget and band are 1 at least")
    n = F.coalesce(F.col(tokens), F.lit(0))
    placed = numbered(rows.withColumn("band", (F.greatest(F.ceil(n / band), F.lit(1)) * band).cast("bigint")), ["band", tokens, id_col], "__n")
    # A row for each band: as many as the longest text has bands.
    starts = placed.groupBy("band").agg(F.min("__n").alias("__start"))
    room = F.greatest(F.floor(F.lit(budget) / F.col("band")), F.lit(1))
    return placed.join(F.broadcast(starts), "band").withColumn("batch", F.floor((F.col("__n") - F.col("__start")) / room).cast("bigint")).drop("__n", "__start").select(*rows.columns, "band", "batch")


def padding(batched: DataFrame, keys: list[str], tokens: str = "n_tokens") -> DataFrame:
    """One row: ``n_batches``, ``tokens``, ``padded`` (rows times the longest of each batch) and ``share`` of padding among those."""
    each = batched.groupBy(*keys).agg(F.sum(tokens).alias("t"), (F.count("*") * F.max(tokens)).alias("p"))
    total = each.agg(F.count("*").alias("n_batches"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("p"), F.lit(0)).alias("padded"))
    return total.withColumn("share", F.coalesce(1 - F.try_divide(F.col("tokens").cast("double"), "padded"), F.lit(0.0)))


def embed_in_batches(rows: DataFrame, load: Callable[[], Embedder], id_col: str, text: str = "text", tokens: str = "n_tokens", budget: int = BUDGET, band: int = BAND) -> DataFrame:
    """``id``, ``embedding`` (unit length): a model sees the texts batch by batch, as ``length_batches`` makes them.

    Ids are longs or strings; rows with one id are rows of their own. A batch is in one task. Null texts are empty.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    made = length_batches(rows.select(id_col, F.coalesce(text, F.lit("")).alias("__text"), tokens), id_col, tokens, budget, band)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, held = load(), None

        def embedded(b: pd.DataFrame) -> pd.DataFrame:
            x = np.asarray(model.embed(b["__text"].tolist()), dtype=np.float64)
            if len(x) != len(b):
                raise ValueError(f"the embedder gave {len(x)} rows for {len(b)} texts")
            length = np.linalg.norm(x, axis=1, keepdims=True)
            return pd.DataFrame({id_col: b[id_col].to_numpy(), "embedding": list(x / np.where(length == 0, 1, length))})

        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            groups = [g for _, g in held.groupby(["band", "batch"], sort=False)]
            for g in groups[:-1]:
                yield embedded(g)
            held = groups[-1] if groups else None
        if held is not None:
            yield embedded(held)

    sorted_rows = made.repartition("band", "batch").sortWithinPartitions("band", "batch")
    return sorted_rows.mapInPandas(run, f"`{id_col}` {kind}, embedding array<double>")
