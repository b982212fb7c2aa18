"""Extractive ranking: salience to a centroid or query, with MMR diversification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators.numbering import cut


def centroids(rows: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """``group``, ``centroid``: the normalised mean of the unit rows, averaged per dimension before the shuffle."""
    each = rows.select(group, F.posexplode(V.unit(vec)).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("x"))
    mean = F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return each.groupBy(group).agg(mean.alias("centroid")).select(group, V.unit("centroid").alias("centroid"))


def salience(rows: DataFrame, group: str, vec: str = "embedding") -> DataFrame:
    """``rows`` with ``score``, the cosine to their group's centroid."""
    # A row for each group: few for labels, many for documents.
    return rows.join(_small(cut(centroids(rows, group, vec))), group).withColumn("score", V.cosine(vec, "centroid")).drop("centroid")


def ranked(scored: DataFrame, group: str, id_col: str, k: int | None = None, score: str = "score") -> DataFrame:
    """With ``rank`` from 0 by falling ``score``, ties to the lowest id; the best ``k`` of each group, or all."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), id_col)) - 1)
    return out if k is None else out.filter(F.col("rank") < k)


def reranked(units: DataFrame, group: str, id_col: str, logit: Column, k: int | None = None, diversify: float = 0.0, score: str = "score") -> DataFrame:
    """``ranked`` by ``score``, that of a pair scorer, sigmoid(logit). There are no vectors here, so ``diversify`` changes nothing."""
    if not 0 <= diversify <= 1:
        raise ValueError("diversify is from 0 to 1")
    return ranked(units.withColumn(score, T.sigmoid(logit)), group, id_col, k, score)


#: Candidates of a group that meet in a task; groups up to which their picks are broadcast.
CANDIDATES, FEW = 256, 100_000


def mmr(scored: DataFrame, group: str, id_col: str, k: int, diversify: float, vec: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """The first ``k`` picks of each group by maximal marginal relevance, with ``rank``; ``score`` stays the raw one.

    The first pick has the highest score; each later one the highest (1 - d) * score - d * (greatest cosine to a pick),
    ties to the lowest id. A value only falls as picks are added, so what a row was worth is a bound on what it is.
    A pass over all rows takes the ``candidates`` worth most in each group; picks are made among those as long as the best one is
    worth more than any row outside was. A group for which that ends too soon is passed over again, with the picks so
    far; each pass makes one pick at the least. Groups of any size stay spread out. Null vectors are like no pick.
    """
    if not 0 <= diversify <= 1:
        raise ValueError("diversify is from 0 to 1")
    if candidates < 1:
        raise ValueError("candidates are 1 at least")
    kind = {f: scored.schema[c].dataType.simpleString() for f, c in (("g", group), ("id", id_col))}
    empty = f"g {kind['g']}, id {kind['id']}, score double, v array<double>, rank int"
    picks = scored.sparkSession.createDataFrame([], empty)
    out = lambda: picks.select(F.col("g").alias(group), F.col("id").alias(id_col), "score", "rank")
    if k <= 0:
        return out()
    rows = cut(scored.select(F.col(group).alias("g"), F.col(id_col).alias("id"), F.col("score").cast("double").alias("score"), V.unit(vec).alias("v")))
    sizes = cut(rows.groupBy("g").agg(F.count("*").alias("size")))
    d = float(diversify)

    def pick(own: pd.DataFrame) -> pd.DataFrame:
        """The picks among one group's candidates; ``taken`` has the vectors of those before, ``size`` the rows of the group."""
        own = own.sort_values(["worth", "id"], ascending=[False, True], kind="stable")
        ids, score, worth = own["id"].to_numpy(), own["score"].to_numpy(), own["worth"].to_numpy(dtype=float).copy()
        width = max((len(v) for v in own["v"] if v is not None), default=1)
        x = np.stack([np.zeros(width) if v is None else np.asarray(v, dtype=float) for v in own["v"]])
        before, whole = int(own["n_taken"].iloc[0]), len(own) + int(own["n_taken"].iloc[0]) >= int(own["size"].iloc[0])
        # Before the first pick a row outside is worth its score; one pick later at most this, as no cosine is under -1.
        outside = worth.min() if before else (1 - d) * worth.min() + d
        made, free = [], np.ones(len(own), dtype=bool)
        while free.any() and before + len(made) < k:
            at = int(np.flatnonzero(free)[np.lexsort((ids[free], -worth[free]))[0]])
            if made and not whole and worth[at] <= outside:
                break
            made.append(at)
            free[at] = False
            near = x @ x[at]
            fresh = (1 - d) * score - d * near
            worth = fresh if before + len(made) == 1 else np.minimum(worth, fresh)
        return pd.DataFrame({"g": own["g"].iloc[made].to_numpy(), "id": ids[made], "score": score[made], "v": [x[i] for i in made], "rank": np.arange(before, before + len(made), dtype=np.int32)})

    left = rows.join(_small(sizes), "g")
    while True:
        taken = cut(picks.groupBy("g").agg(F.collect_list(F.struct("id", "v")).alias("taken")))
        each = left.join(_small(taken), "g", "left").filter(~F.coalesce(F.exists("taken", lambda p: p["id"].eqNullSafe(F.col("id"))), F.lit(False)))
        near = F.array_max(F.transform("taken", lambda p: F.coalesce(V.dot("v", p["v"]), F.lit(0.0))))
        worth = F.when(F.col("taken").isNull(), F.col("score")).otherwise((1 - d) * F.col("score") - d * near)
        best = each.select("g", "id", "score", "v", "size", F.coalesce(F.size("taken"), F.lit(0)).alias("n_taken"), worth.alias("worth"))
        order = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("worth"), "id"))
        best = best.withColumn("__n", order).filter(F.col("__n") <= candidates).drop("__n")
        fresh = cut(best.groupBy("g").applyInPandas(pick, empty))
        picks = picks.unionByName(fresh)
        done = picks.groupBy("g").agg(F.count("*").alias("n")).join(sizes, "g").filter((F.col("n") >= k) | (F.col("n") >= F.col("size"))).select("g")
        waiting = cut(sizes.join(done, "g", "left_anti"))
        if fresh.isEmpty() or waiting.isEmpty():
            return out()
        left = rows.join(_small(waiting), "g")


def _small(table: DataFrame) -> DataFrame:
    """A kept table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table
