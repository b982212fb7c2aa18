"""A static embedder: token vectors learned from texts, kept as a table, and texts embedded by looking tokens up.

A token's contexts are the tokens up to ``REACH`` places away, hashed to ``BUCKETS``. Its weights are the positive
pointwise mutual information with each bucket, its vector their projection on random signs, of unit length and in
whole millionths, so that sums of vectors are exact. Tokens are lower-cased white-space words; a token met less than
``least`` times is in no table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators.numbering import cut

DIM, REACH, BUCKETS, LEAST = 16, 2, 1024, 5
#: Tokens that are looked up from a broadcast part of the table, at the most; texts that a task handles at once.
HEAVY, TEXTS = 1 << 16, 1000
SCALE = 1_000_000


def bucket_of(token: str) -> int:
    return int(hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % BUCKETS


def signs() -> np.ndarray:
    """The random signs of each bucket: (buckets, dim)."""
    digests = [hashlib.md5(f"bucket:{b}".encode()).digest() for b in range(BUCKETS)]
    return np.array([[1 if d[j] & 1 else -1 for j in range(DIM)] for d in digests], dtype=np.int64)


def neighbours(texts: DataFrame, text: str = "text") -> DataFrame:
    """``token``, ``bucket``, ``n``: how often a context of the bucket stands within ``REACH`` of the token; added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                places: dict[str, int] = {}
                pairs = []
                for t in batch.column(0).slice(at, TEXTS).to_pylist():
                    ids = np.fromiter((places.setdefault(w, len(places)) for w in T.white_space_split(t or "")), dtype=np.int64)
                    for d in range(1, REACH + 1):
                        pairs += [(ids[:-d], ids[d:]), (ids[d:], ids[:-d])]
                if not places:
                    continue
                tokens, buckets = list(places), np.array([bucket_of(w) for w in places])
                left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
                key, n = np.unique(left * BUCKETS + buckets[right], return_counts=True)
                yield pa.record_batch([pa.array(tokens, pa.string()).take(pa.array(key // BUCKETS)), pa.array(key % BUCKETS), pa.array(n)], names=["token", "bucket", "n"])

    counts = texts.select(text).mapInArrow(run, "token string, bucket long, n long")
    return counts.groupBy("token", "bucket").agg(F.sum("n").alias("n"))


def _framed(run):
    return lambda batches: (pa.RecordBatch.from_pandas(df, preserve_index=False) for df in run(batches))


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """``token``, ``n`` of all texts, counted within tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                counts: Counter[str] = Counter()
                for t in batch.column(0).slice(at, TEXTS).to_pylist():
                    counts.update(T.white_space_split(t or ""))
                if counts:
                    yield pd.DataFrame({"token": list(counts), "n": list(counts.values())})

    return texts.select(text).mapInArrow(_framed(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def learn(texts: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``token``, ``n``, ``vector`` (whole millionths) of every token met ``least`` times or more. No texts give no rows.

    A token without contexts, or none closer than chance, has a zero vector. Contexts are counted over all texts and tokens.
    """
    if least < 1:
        raise ValueError("least is 1 at least")
    each = cut(neighbours(texts, text))
    of_bucket = each.groupBy("bucket").agg(F.sum("n").alias("of_bucket"))  # at most BUCKETS rows
    of_token = each.groupBy("token").agg(F.sum("n").alias("of_token"))
    total = each.agg(F.sum("n").alias("all"))
    weighed = each.join(of_token, "token").join(F.broadcast(of_bucket), "bucket").crossJoin(F.broadcast(total))
    weighed = weighed.withColumn("weight", F.greatest(F.lit(0.0), F.log(F.col("n").cast("double") * F.col("all") / F.col("of_token") / F.col("of_bucket"))))
    rows = [(b, s.tolist()) for b, s in enumerate(signs())]
    projection = texts.sparkSession.createDataFrame(rows, "bucket long, sign array<long>")
    summed = weighed.join(F.broadcast(projection), "bucket").groupBy("token").agg(*[F.sum(F.col("weight") * F.col("sign")[j]).alias(f"x{j}") for j in range(DIM)])
    unit = V.unit(F.array(*[F.coalesce(F.col(f"x{j}"), F.lit(0.0)) for j in range(DIM)]))
    known = counted(texts, text).filter(F.col("n") >= least)
    return known.join(summed, "token", "left").select("token", "n", F.transform(unit, lambda x: F.round(x * SCALE).cast("long")).alias("vector"))


def heavy_hitters(texts: DataFrame, k: int = HEAVY, text: str = "text") -> DataFrame:
    """``token``, fewer than ``k`` of them, each token of over two in ``k`` of all among them (Misra-Gries).

    A task keeps ``k`` counters: where there are more, all are lowered until at most ``k`` are left, by one in ``k`` of its
    tokens in all at the most. The counters of all tasks are added up, and those over one in ``k`` of all tokens count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                words = T.white_space_split(t or "")
                held.update(words)
                total += len(words)
                if len(held) > 4 * k:
                    held = lowered(held, k)
        held = lowered(held, k)
        yield pd.DataFrame({"token": [None, *held], "n": [total, *held.values()]})

    summaries = cut(texts.select(text).mapInArrow(_framed(run), "token string, n long").groupBy("token").agg(F.sum("n").alias("n")))
    total = F.broadcast(summaries.filter("token IS NULL").select(F.col("n").alias("__all")))
    return summaries.filter("token IS NOT NULL").crossJoin(total).filter(F.col("n") > F.col("__all") / k).select("token")


def lowered(held: Counter[str], k: int) -> Counter[str]:
    """The counters less the (k + 1)-th largest, those that are left."""
    if len(held) <= k:
        return held
    level = sorted(held.values(), reverse=True)[k]
    return Counter({w: n - level for w, n in held.items() if n > level})


def embed(texts: DataFrame, table: DataFrame, keys: list[str], text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """``keys``, ``n_tokens``, ``n_unknown``, ``embedding``: the unit sum of the vectors of each text's tokens in ``table``.

    The vectors of the ``heavy`` most frequent tokens are broadcast and added up where the text is; the others of a text
    are joined with the table by token, none of which is frequent, and their sums come back by row. Tokens that
    are not in the table are counted. Null texts are empty; texts without a known token have a zero vector.
    """
    spark = texts.sparkSession
    often = F.broadcast(heavy_hitters(texts, heavy, text))
    # At most ``heavy`` rows.
    known = table.join(often, "token", "left_semi").select("token", "vector").toArrow()
    sent = spark.sparkContext.broadcast((known["token"].to_pylist(), np.array(known["vector"].to_pylist(), dtype=np.int64).reshape(-1, DIM)))

    @F.pandas_udf("struct<n_tokens:bigint,n_known:bigint,total:array<bigint>,rare:array<string>,times:array<bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tokens, vectors = sent.value
        place = {w: i for i, w in enumerate(tokens)}
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                rows = []
                for t in batch.iloc[at : at + TEXTS]:
                    words = T.white_space_split(t or "")
                    ids = np.fromiter((place.get(w, -1) for w in words), dtype=np.int64, count=len(words))
                    rare = Counter([words[i] for i in np.flatnonzero(ids < 0)])
                    there = ids[ids >= 0]
                    rows.append((len(words), len(there), vectors[there].sum(axis=0), list(rare), list(rare.values())))
                yield pd.DataFrame(rows, columns=["n_tokens", "n_known", "total", "rare", "times"])

    each = texts.select(*keys, run(F.col(text)).alias("e")).select(*keys, "e.*")
    each = cut(each.withColumn("__row", F.monotonically_increasing_id()))
    rare = each.select("__row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("__row", F.col("w.rare").alias("token"), F.col("w.times").alias("times"))
    found = rare.join(table.join(often, "token", "left_anti").select("token", "vector"), "token")
    sums = found.groupBy("__row").agg(F.sum("times").alias("more"), *[F.sum(F.col("times") * F.col("vector")[j]).alias(f"x{j}") for j in range(DIM)])
    out = each.join(sums, "__row", "left")
    total = F.array(*[F.col("total")[j] + F.coalesce(f"x{j}", F.lit(0)) for j in range(DIM)])
    unknown = F.col("n_tokens") - F.col("n_known") - F.coalesce("more", F.lit(0))
    return out.select(*keys, "n_tokens", unknown.alias("n_unknown"), V.unit(total).alias("embedding"))
