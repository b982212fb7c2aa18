"""Brute-force cosine retrieval over an embedding index."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import vectors as V
from textloom.operators.numbering import cut

#: Query vectors that meet in a task, and index rows that they meet there where there are more of them.
QUERY_BLOCK, INDEX_SPLIT = 2048, 65_536


def scored(index: DataFrame, query: DataFrame, vec_col: str = "embedding", query_col: str = "q") -> DataFrame:
    """Every index row with its cosine to the vector in the one row of ``query``."""
    return index.crossJoin(F.broadcast(query.limit(1))).withColumn("score", V.cosine(vec_col, query_col)).drop(query_col)


def top_k(index: DataFrame, query: DataFrame, k: int = 10, id_col: str = "doc_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows nearest to the one row of ``query``; ties go to the lowest id, k <= 0 gives no rows."""
    return scored(index, query, vec_col).orderBy(F.desc("score"), id_col).limit(max(0, k))


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each row of ``scores`` the places of its ``k`` highest, by falling score and then rising id."""
    k = min(k, scores.shape[1])
    if scores.shape[1] > 4 * k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        n = int((scores >= least).sum(axis=1).max())  # more than k where the last score is tied
        near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    else:
        near = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    order = np.lexsort((ids[near], -np.take_along_axis(scores, near, 1)), axis=1)[:, :k]
    return np.take_along_axis(near, order, 1)


def _nearest(q: tuple[np.ndarray, np.ndarray], batches: Iterable[pd.DataFrame], k: int, query_id: str, id_col: str) -> pd.DataFrame:
    """The ``k`` best of each query (ids, unit vectors) among the rows (``id_col``, ``v``) of all batches."""
    best = pd.DataFrame({query_id: q[0][:0], id_col: np.zeros(0, dtype=np.int64), "score": np.zeros(0)})
    for b in batches:
        if len(b) and len(q[0]):
            scores, rows = q[1] @ _unit(b["v"].to_list()).T, b[id_col].to_numpy()
            at = best_of(scores, rows, k)
            found = pd.DataFrame({query_id: np.repeat(q[0], at.shape[1]), id_col: rows[at].ravel(), "score": np.take_along_axis(scores, at, 1).ravel()})
            both = pd.concat([best, found]) if len(best) else found
            best = both.sort_values([query_id, "score", id_col], ascending=[True, False, True]).groupby(query_id).head(k)
    return best


def top_k_batch(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", id_col: str = "doc_id", vec_col: str = "embedding", block: int = QUERY_BLOCK, split: int = INDEX_SPLIT) -> DataFrame:
    """``query_id``, id, ``score`` and ``rank`` (from 0) of the k rows nearest to each query.

    Up to ``block`` queries are broadcast, and the index stays where it is. More are dealt out in blocks, the index in
    splits of about ``split`` rows, and every (block, split) is a task of its own. Either way a task keeps its own k
    best per query, so only those are ranked. Ids are integers; rows and queries without a vector are left out.
    """
    schema = f"{query_id} bigint, {id_col} bigint, score double"
    asked = queries.select(F.col(query_id).cast("bigint").alias(query_id), F.col(vec_col).alias("q")).filter("q IS NOT NULL")
    usable = index.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vec_col).alias("v")).filter("v IS NOT NULL")
    if k <= 0:
        return index.sparkSession.createDataFrame([], f"{schema}, rank int")

    def nearest(q: tuple[np.ndarray, np.ndarray], batches: Iterable[pd.DataFrame]) -> pd.DataFrame:
        return _nearest(q, batches, k, query_id, id_col)

    few = asked.limit(block + 1).collect()
    if len(few) <= block:
        sent = index.sparkSession.sparkContext.broadcast((np.array([r[0] for r in few], dtype=np.int64), _unit([r[1] for r in few]) if few else np.zeros((0, 1))))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield nearest(sent.value, batches)

        found = usable.mapInPandas(run, schema)
    else:
        blocks, splits = -(-asked.count() // block), max(1, -(-usable.count() // split))
        mine = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
        all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = asked.withColumn("block", mine(query_id, blocks, 1)).withColumn("split", all_of(splits))
        spread = usable.withColumn("split", mine(id_col, splits, 2)).withColumn("block", all_of(blocks))

        def task(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
            if not len(asked) or not len(rows):
                return pd.DataFrame({query_id: [], id_col: [], "score": []})
            step = 8192
            return nearest((asked[query_id].to_numpy(), _unit(asked["q"].to_list())), (rows.iloc[i : i + step] for i in range(0, len(rows), step)))

        found = dealt.groupBy("block", "split").cogroup(spread.groupBy("block", "split")).applyInPandas(task, schema)
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k)


# Cells: exact search that leaves out rows which cannot be among the nearest

#: Cells of an index, at the most, vectors that their centers are learned from for each, and rounds of that.
CELLS, LEARNED, ROUNDS = 1024, 64, 8
#: What a bound is raised by, for the rounding of angles.
SLACK = 1e-7


class Cells:
    """Centers (unit vectors), and for each cell its greatest angle and how many rows it has. The last cell has the zero vectors."""

    def __init__(self, centers: np.ndarray) -> None:
        self.centers = centers
        self.radius, self.count = np.zeros(len(centers) + 1), np.zeros(len(centers) + 1, dtype=np.int64)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector, and its angle to the center."""
        zero = ~x.any(axis=1)
        if not len(self.centers):
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        near = x @ self.centers.T
        cell = near.argmax(axis=1)
        angle = np.arccos(np.clip(near[np.arange(len(x)), cell], -1, 1))
        return np.where(zero, len(self.centers), cell), np.where(zero, 0, angle)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer to a query than this: the cosine of the angle to the center less the cell's greatest."""
        angle = np.arccos(np.clip(q @ self.centers.T, -1, 1)) if len(self.centers) else np.zeros((len(q), 0))
        bound = np.cos(np.maximum(0, angle - self.radius[:-1])) + SLACK
        bound[~q.any(axis=1)] = SLACK
        return np.concatenate([bound, np.full((len(q), 1), SLACK)], axis=1)


def centers_of(x: np.ndarray, n: int, seed: int = 11) -> np.ndarray:
    """Up to ``n`` unit vectors that the unit vectors ``x`` gather around."""
    x = x[x.any(axis=1)]
    if not len(x):
        return x
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(n, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
    return centers


def in_cells(index: DataFrame, id_col: str = "doc_id", vec_col: str = "embedding", cells: int | None = None) -> tuple[DataFrame, Cells]:
    """The index as rows (id, ``v``, ``cell``), kept, and its cells: as many as the root of its rows, ``CELLS`` at the most.

    Centers are learned from about ``LEARNED`` rows for each cell, picked by a hash of the id; every row is placed.
    Rows without a vector are left out.
    """
    usable = index.select(F.col(id_col).cast("bigint").alias(id_col), F.col(vec_col).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    total = usable.count()
    n = max(1, min(CELLS, int(total**0.5))) if cells is None else cells
    share = max(1, total // (n * LEARNED))
    learned = usable.filter(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(share)) == 0).select("v").limit(4 * n * LEARNED).collect()
    made = Cells(centers_of(_unit([r.v for r in learned]) if learned else np.zeros((0, 1)), n))
    sent = index.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, angle = sent.value.place(_unit(b["v"].to_list()))
                yield b.assign(cell=cell, angle=angle)

    rows = cut(usable.mapInPandas(run, f"`{id_col}` bigint, v array<double>, cell bigint, angle double"))
    for r in rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n")).collect():  # a row for each cell
        made.radius[r.cell], made.count[r.cell] = r.radius, r.n
    return rows.drop("angle"), made


def top_k_cells(index: DataFrame, queries: DataFrame, k: int = 10, query_id: str = "query_id", id_col: str = "doc_id", vec_col: str = "embedding", cells: int | None = None, block: int = QUERY_BLOCK, split: int = INDEX_SPLIT) -> DataFrame:
    """``top_k_batch``, with rows in cells: ``query_id``, id, ``score``, ``rank`` of the k rows nearest to each query.

    A query first meets the cells nearest to it that have ``k`` rows. Its k-th score there is a floor, and of the other
    cells it meets only those whose bound reaches the floor, so the result is exact. Queries go to cells, and the index
    is dealt out by cell twice at the most, whatever the number of queries; a cell of over ``split`` rows or ``block``
    queries is a grid of tasks.
    """
    if k <= 0:
        return index.sparkSession.createDataFrame([], f"`{query_id}` bigint, `{id_col}` bigint, score double, rank int")
    rows, made = in_cells(index, id_col, vec_col, cells)
    asked = cut(queries.select(F.col(query_id).cast("bigint").alias(query_id), F.col(vec_col).cast("array<double>").alias("q")).filter("q IS NOT NULL"))
    first = meetings(asked, made, query_id, k)
    near = cut(_met(first, rows, made, query_id, id_col, k, block, split))
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    floor = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select(query_id, F.col("score").alias("floor"))
    more = meetings(asked.join(floor, query_id, "left"), made, query_id, k, floored=True)
    far = _met(more, rows, made, query_id, id_col, k, block, split)
    return near.union(far).withColumn("rank", F.row_number().over(best) - 1).filter(F.col("rank") < k)


def meetings(asked: DataFrame, made: Cells, query_id: str, k: int, floored: bool = False) -> DataFrame:
    """``query_id``, ``q``, ``cell``: the first cells of each query, or with ``floored`` the others whose bound reaches ``floor``."""
    sent = asked.sparkSession.sparkContext.broadcast(made)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = sent.value
        for b in batches:
            for at in range(0, len(b), 512):
                some = b.iloc[at : at + 512]
                bound = made.bounds(_unit(some["q"].to_list()))
                order = np.argsort(-bound, axis=1, kind="stable")
                held = made.count[order]
                # Cells come first until those before them have k rows.
                wanted = (np.cumsum(held, axis=1) - held < k) & (held > 0)
                if floored:
                    floor = some["floor"].fillna(-2.0).to_numpy()
                    wanted = ~wanted & (held > 0) & (np.take_along_axis(bound, order, 1) >= floor[:, None])
                i, j = np.nonzero(wanted)
                if not len(i):
                    continue
                yield pd.DataFrame({query_id: some[query_id].to_numpy()[i], "q": some["q"].iloc[i].to_list(), "cell": order[i, j]})

    return asked.mapInPandas(run, f"`{query_id}` bigint, q array<double>, cell bigint")


def _met(pairs: DataFrame, rows: DataFrame, made: Cells, query_id: str, id_col: str, k: int, block: int, split: int) -> DataFrame:
    """The k best of each query in each task: cells of many rows or queries are cut into parts, every two of which meet."""
    pairs = cut(pairs)
    spark = pairs.sparkSession
    # A row for each cell.
    sizes = [(r.cell, -(-r.n // block), max(1, -(-int(made.count[r.cell]) // split))) for r in pairs.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    parts = F.broadcast(spark.createDataFrame(sizes, "cell bigint, blocks bigint, splits bigint"))
    mine = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    dealt = pairs.join(parts, "cell").withColumn("block", mine(query_id, "blocks", 1)).withColumn("split", all_of("splits"))
    spread = rows.join(parts, "cell").withColumn("split", mine(id_col, "splits", 2)).withColumn("block", all_of("blocks"))

    def task(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(own):
            return pd.DataFrame({query_id: [], id_col: [], "score": []})
        step = 8192
        return _nearest((asked[query_id].to_numpy(), _unit(asked["q"].to_list())), (own.iloc[i : i + step] for i in range(0, len(own), step)), k, query_id, id_col)

    key = ["cell", "block", "split"]
    schema = f"`{query_id}` bigint, `{id_col}` bigint, score double"
    return dealt.select(*key, query_id, "q").groupBy(*key).cogroup(spread.select(*key, id_col, "v").groupBy(*key)).applyInPandas(task, schema)
