"""Running sums within groups of any size, over range partitions.

Rows are sorted over range partitions, so a group may lie over several. A first pass gives one row for each partition:
its first and last group and the sums of the last one. What a partition's first group has before it follows from
those, and a second pass adds it. No group is gathered anywhere. Whole numbers wrap around at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import cut


def spread(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` sorted over range partitions and kept, with ``part``, the number of each row's partition."""
    return cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


def _starts(keys: np.ndarray) -> np.ndarray:
    """For each place where the run of equal keys that it is in begins."""
    begins = np.ones(len(keys), dtype=bool)
    begins[1:] = keys[1:] != keys[:-1]
    return np.maximum.accumulate(np.where(begins, np.arange(len(keys)), 0))


def _within(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.cumsum(values)
    return total - (total[starts] - values[starts])


def running_sums(rows: DataFrame, key: str, sums: dict[str, str], last: str | None = None) -> DataFrame:
    """``rows`` (from ``spread``, by ``key`` first) with, for each column of ``sums``, the running sum under its new name.

    ``key`` and the columns are longs without nulls. With ``last``, a column that marks each group's last row.
    """
    names = list(sums)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = key_at = None
        held = np.zeros(len(names), dtype=np.int64)
        for b in batches:
            if not len(b):
                continue
            keys = b[key].to_numpy()
            if part is None:
                part, first, key_at = int(b["part"].iloc[0]), int(keys[0]), int(keys[0])
            start = _starts(keys)[-1]
            if keys[-1] != key_at or start:
                held[:] = 0
            with np.errstate(over="ignore"):
                held += np.array([b[c].to_numpy()[start:].sum(dtype=np.int64) for c in names], dtype=np.int64)
            key_at = int(keys[-1])
        if part is not None:
            yield pd.DataFrame({"part": [part], "first": [first], "last": [key_at], "held": [held]})

    # One row for each partition.
    found = rows.select("part", key, *names).mapInPandas(ends, "part int, first long, last long, held array<long>").collect()
    before: dict[int, tuple[int, np.ndarray]] = {}
    after: dict[int, int] = {}
    at: tuple[int, np.ndarray] | None = None
    parts = sorted(found, key=lambda r: r.part)
    for r, follower in zip(parts, [*parts[1:], *([None] if parts else [])], strict=True):
        held = np.array(r["held"], dtype=np.int64)
        if at is not None and at[0] == r["first"]:
            before[r.part] = at
            held = held + at[1] if r["last"] == r["first"] else held
        at = (r["last"], held)
        if follower is not None:
            after[r.part] = follower["first"]
    added = [T.StructField(n, T.LongType()) for n in sums.values()] + ([T.StructField(last, T.BooleanType())] if last else [])
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_at: int | None = None
        held, waiting = np.zeros(len(names), dtype=np.int64), None
        part = None

        def done(b: pd.DataFrame, following: int | None) -> pd.DataFrame:
            if last:
                keys = b[key].to_numpy()
                b[last] = np.append(keys[1:] != keys[:-1], following is None or following != keys[-1])
            return b

        for b in batches:
            if not len(b):
                continue
            keys = b[key].to_numpy()
            if part is None:
                part = int(b["part"].iloc[0])
                key_at, carried = before.get(part, (None, held))
                held = carried.copy()
            starts = _starts(keys)
            goes_on = np.where((starts == 0) & (keys == key_at), np.int64(1), np.int64(0)) if key_at is not None else np.zeros(len(keys), dtype=np.int64)
            out = {}
            for i, c in enumerate(names):
                out[sums[c]] = _within(b[c].to_numpy(), starts) + goes_on * held[i]
            key_at, held = int(keys[-1]), np.array([out[sums[c]][-1] for c in names], dtype=np.int64)
            b = b.assign(**out)
            if waiting is not None:
                yield done(waiting, int(keys[0]))
            waiting = b
        if waiting is not None:
            yield done(waiting, after.get(part))

    return rows.mapInPandas(run, schema)
