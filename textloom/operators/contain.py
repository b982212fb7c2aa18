"""Joins of texts with the strings that they hold: one pass over each text for all strings, not a comparison for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.automaton import Automaton
from textloom.operators.numbering import cut

#: Bytes of strings, or of texts, that are broadcast at once.
BLOCK = 1 << 20


def _bytes(values: pa.Array | list) -> list[bytes]:
    return [(v or "").encode("utf-8", "surrogatepass") for v in (values.to_pylist() if isinstance(values, pa.Array) else values)]


def _blocks(df: DataFrame, column: str, size: int, block: int) -> Iterator[list[str]]:
    """The distinct values of a column of ``size`` bytes, one block after the other; each is a few times ``block`` at the most, or one long value."""
    n = max(1, -(-size // block))
    numbered = df.withColumn("__block", F.pmod(F.xxhash64(column), F.lit(n)))
    for b in range(n):
        yield [r[0] for r in numbered.filter(F.col("__block") == b).select(column).collect()]


def containing(texts: DataFrame, strings: DataFrame, text: str = "text", string: str = "string", block: int = BLOCK) -> DataFrame:
    """Every distinct ``text`` of ``texts`` with every distinct ``string`` of ``strings`` that it holds, a row for each pair.

    Every text is read whole. The smaller of both tables is broadcast, ``block`` bytes at a time, and the other is read once
    for each block: strings as an automaton that goes over the texts, or texts over which automata of the
    strings go. Empty strings and nulls are in no pair. Strings are compared as they are.
    """
    distinct = lambda df, c: cut(df.select(F.col(c)).filter(F.col(c) != "").distinct())
    texts, strings = distinct(texts, text), distinct(strings, string)
    sizes = [df.agg(F.coalesce(F.sum(F.octet_length(c)), F.lit(0))).first()[0] for df, c in ((texts, text), (strings, string))]
    sc, schema = texts.sparkSession.sparkContext, f"`{text}` string, `{string}` string"
    few_strings = sizes[1] <= sizes[0]
    streamed, column = (texts, text) if few_strings else (strings, string)
    held, held_column = (strings, string) if few_strings else (texts, text)
    parts = []
    for values in _blocks(held, held_column, min(sizes), block):
        if not values:
            continue
        sent = sc.broadcast((values, Automaton(_bytes(values)) if few_strings else _bytes(values)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, other = sent.value
            for b in batches:
                for at in range(0, b.num_rows, T.TEXTS_BACK * 5):
                    own_rows = b.column(0).slice(at, T.TEXTS_BACK * 5)
                    rows = own_rows.to_pylist()
                    # The first of a pair is the text, the second the string.
                    found = other.scan(_bytes(rows)) if few_strings else Automaton(_bytes(rows)).scan(other)
                    left, right = (rows, own) if few_strings else (own, rows)
                    yield pa.record_batch([pa.array([left[i] for i, _ in found], pa.string()), pa.array([right[j] for _, j in found], pa.string())], names=[text, string])

        parts.append(streamed.select(column).mapInArrow(run, schema))
    if not parts:
        return texts.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def first_match(texts: DataFrame, key: str, rules: DataFrame, text: str = "text", string: str = "string", priority: str = "priority", value: str = "value") -> DataFrame:
    """``key`` and ``value`` of the rule of least ``priority`` whose string the lower-cased text holds; null where none does.

    ``rules`` has a row for each string, in lower case here. Of equal priorities the lesser string counts.
    """
    rows = texts.select(key, F.lower(F.col(text)).alias("__text"))
    lowered = rules.select(F.lower(F.col(string)).alias("__string"), F.col(priority).alias("__p"), F.col(value).alias(value))
    best = F.min_by(F.struct(value), F.struct("__p", "__string"))
    found = containing(rows, lowered, "__text", "__string").join(lowered, "__string").groupBy("__text").agg(best.alias("__best"))
    # Keyed by the text's digest, so that a text goes over the network but for its own row.
    digest = F.sha2(F.col("__text"), 256)
    return rows.select(key, digest.alias("__d")).join(found.select(digest.alias("__d"), "__best"), "__d", "left").select(key, F.col("__best")[value].alias(value))


def either_way(gold: DataFrame, predicted: DataFrame, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """Pairs ``g``, ``p`` of distinct normalised strings of which one holds the other; empty ones match nothing."""
    norm = lambda df, c, name: cut(df.select(T.normalised(c).alias(name)).filter(F.col(name) != "").distinct())
    g, p = norm(gold, gold_col, "g"), norm(predicted, pred_col, "p")
    return containing(p, g, "p", "g").select("g", "p").union(containing(g, p, "g", "p").select("g", "p")).distinct()


def matched(rows: DataFrame, pairs: DataFrame, column: str, side: str) -> DataFrame:
    """``rows`` with ``matched``: whether the normalised ``column`` is in a pair on this ``side``."""
    hit = pairs.select(F.col(side).alias("__n")).distinct().withColumn("matched", F.lit(True))
    joined = rows.withColumn("__n", T.normalised(column)).join(hit, "__n", "left").drop("__n")
    return joined.withColumn("matched", F.coalesce("matched", F.lit(False)))
