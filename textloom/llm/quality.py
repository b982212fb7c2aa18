"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

A text becomes a vector of statistics (lengths, character classes, repetition of words and lines). Random Fourier
features approximate a Gaussian kernel over the standardised statistics; ridge weights come from normal equations that
every partition sums for itself. A quarter of the labelled rows is kept apart to calibrate: their raw scores are
counted in bins, and pool-adjacent-violators turns the bins into a rising step curve, read with interpolation.

Only a bounded sample of labelled rows is learned from (``max_labelled``, picked by a hash of the id, so the same rows
at every run); every text is scored whole. A null text counts as an empty one. Several labels of one id are averaged.
Rows without an id are scored but never learned from; without any labelled row each score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import add_columns, cut, free_name, sample_below

MAX_LABELLED = 20_000
FEATURES, RIDGE, SEED = 256, 1e-4, 11
#: Partitions of the sample, and those in which their sums, about (FEATURES + 1) squared doubles each, are added up.
PARTS, SUMS = 16, 4
BINS = 512

_CLASSES = np.zeros((256, 10))
for _i, _chars in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r", b"\n", b"!", b"|", b"#$%&*@^~=+<>{}[]_\\/", b".,;:?'\"()-"]):
    _CLASSES[list(_chars), _i] = 1
_CLASSES[128:, 9] = 1
DIM = _CLASSES.shape[1] + 9


def statistics(text: str | None) -> np.ndarray:
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts / max(1, len(data))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    seen = counts[counts > 0] / max(1, len(data))
    more = [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / n, np.log1p(max(map(len, words), default=0)), len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n, np.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), -(seen * np.log(seen)).sum(),
    ]
    return np.concatenate((share @ _CLASSES, more))


def learned(doc_id: Column) -> Column:
    """Whether a row may be learned from; False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    beta: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.weights + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), *self.curve), 0.0, 1.0)


def isotonic(x: np.ndarray, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``x``: the centres of the pools and their means, which rise."""
    pools: list[list[float]] = []
    for a, t, c in zip(x, total, count, strict=True):
        pools.append([a * c, t, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _summed(sample: DataFrame, fn: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all partitions of what ``fn`` makes of each batch of statistics and labels."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for b in batches:
            if len(b):
                yield fn(np.stack(b["stats"].to_list()), b["y"].to_numpy())

    def given(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        for b in batches:
            yield from map(np.asarray, b["total"])

    def added(read: Callable[[Iterator[pd.DataFrame]], Iterator[np.ndarray]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for part in read(batches):
                total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"total": [total.ravel()]})

        return run

    schema = "total array<double>"
    tree = sample.mapInPandas(added(parts), schema).repartition(SUMS).mapInPandas(added(given), schema)
    return np.sum([np.asarray(r.total) for r in tree.collect()], axis=0)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> Model | None:
    """The model, or None without labelled rows that may be learned from."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("y")).filter(F.col("y").isNotNull() & learned(F.col("id")))
    known = known.groupBy("id").agg(F.avg("y").alias("y"))
    n = known.count()
    picked = known.filter(F.xxhash64("id", F.lit(1)) <= sample_below(max_labelled, n))
    # About max_labelled rows of 16 bytes.
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(picked), "id")

    def make() -> Callable[[pd.Series], pd.DataFrame]:
        return lambda series: pd.DataFrame({"stats": [statistics(t) for t in series]})

    apart = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)) == 0
    sample = cut(add_columns(texts, ["text"], [("stats", "array<double>")], make).select("stats", "y", apart.alias("apart")).repartition(PARTS))
    if sample.isEmpty():
        return None
    ones = lambda x: np.ones((len(x), 1))
    total, squares, count = np.split(_summed(sample, lambda x, y: np.hstack([x, x * x, ones(x)]).sum(axis=0)), [DIM, 2 * DIM])
    mean = total / count
    scale = np.sqrt(np.maximum(squares / count - mean**2, 1e-9))
    rng = np.random.default_rng(SEED)
    width = np.sqrt(DIM)
    model = Model(mean, scale, rng.standard_normal((DIM, FEATURES)) / width, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(1), np.zeros(1)))

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    fitted = sample.filter("NOT apart")
    if fitted.isEmpty():
        fitted = sample
    ab = np.asarray(_summed(fitted, equations)).reshape(FEATURES + 1, FEATURES + 2)
    model.beta = np.linalg.solve(ab[:, :-1] + RIDGE * ab[-1, -2] * np.eye(FEATURES + 1), ab[:, -1])
    kept = sample.filter("apart")
    if kept.isEmpty():
        kept = sample
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(edges, model.raw(x)) - 1, 0, BINS - 1)
        return np.stack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    ys, ns = np.asarray(_summed(kept, binned)).reshape(2, BINS)
    full = ns > 0
    model.curve = isotonic(((edges[1:] + edges[:-1]) / 2)[full], ys[full], ns[full])
    return model


def add_score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of a good text (0 to 1), in place of a column of that name."""

    def make() -> Callable[[pd.Series], pd.DataFrame]:
        def step(texts: pd.Series) -> pd.DataFrame:
            if model is None or not len(texts):
                return pd.DataFrame({out: np.full(len(texts), 0.5)})
            return pd.DataFrame({out: model.score(np.stack([statistics(t) for t in texts]))})

        return step

    return add_columns(docs, [text], [(out, "double")], make)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for each row of ``docs``."""
    scored = add_score(docs.select("doc_id", "text"), fit(docs, labels))
    held_out = F.col("doc_id").isNotNull() & ~learned(F.col("doc_id"))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns of ``docs``.

    Null texts score as empty ones. A row at the threshold stays, repeated rows stay or go alike, an empty table stays empty.
    """
    spare = free_name(docs, "__score")
    return add_score(docs, fit(docs, labels), "text", spare).filter(F.col(spare) >= threshold).drop(spare)
