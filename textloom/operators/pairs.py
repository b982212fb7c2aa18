"""Operators on (query, text) and (premise, hypothesis) pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.scorers import PairScorer

#: Queries that are broadcast at once.
QUERIES = 1024


def rerank(candidates: DataFrame, logit: Column, top_k: int | None = None, pos: str = "pos") -> DataFrame:
    """``candidates`` with ``rerank_score`` = sigmoid(logit), best first, ties in input order; ``top_k`` None keeps all."""
    out = candidates.withColumn("rerank_score", T.sigmoid(logit)).orderBy(F.desc("rerank_score"), pos)
    return out if top_k is None else out.limit(max(0, top_k))


def rerank_each(candidates: DataFrame, queries: DataFrame, load: Callable[[], PairScorer], k: int = 10, query_id: str = "query_id", query: str = "query", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``query_id``, id, ``rerank_score`` and ``rank`` (from 0) of the ``k`` best candidates of each query, ties to the lowest id.

    Queries are broadcast, ``QUERIES`` at a time, and the candidates stay where they are: a task keeps its own ``k``
    best of each query, so only those are ranked. Ids are integers; ``k`` <= 0 gives no rows. Null texts are empty.
    """
    spark, schema = candidates.sparkSession, f"`{query_id}` bigint, `{id_col}` bigint, rerank_score double"
    asked = queries.select(F.col(query_id).cast("bigint"), F.coalesce(F.col(query), F.lit("")))
    blocks = -(-asked.count() // QUERIES) if k > 0 else 0
    rows = candidates.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = asked.withColumn("__block", F.pmod(F.xxhash64(query_id), F.lit(max(1, blocks))))
    parts = []
    for b in range(blocks):
        sent = spark.sparkContext.broadcast([(r[0], r[1]) for r in numbered.filter(F.col("__block") == b).collect()])

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            scorer, best = load(), {}
            for batch in batches:
                texts, ids = batch["text"].tolist(), batch["id"].to_numpy()
                for q, asked in sent.value if len(ids) else []:
                    score = 1.0 / (1.0 + np.exp(-np.asarray(scorer.score_pairs(asked, texts), dtype=np.float64)))
                    own_ids, own = best.get(q, (ids[:0], score[:0]))
                    own_ids, own = np.concatenate([own_ids, ids]), np.concatenate([own, score])
                    kept = np.lexsort((own_ids, -own))[:k]
                    best[q] = own_ids[kept], own[kept]
            for q, (ids, score) in best.items():
                yield pd.DataFrame({query_id: q, id_col: ids, "rerank_score": score})

        parts.append(rows.mapInPandas(run, schema))
    if not parts:
        return spark.createDataFrame([], f"{schema}, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    order = Window.partitionBy(query_id).orderBy(F.desc("rerank_score"), id_col)
    return found.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def nli(premises: DataFrame, hypotheses: list[str], logits: Callable[[Column, Column], Column], text: str = "text") -> DataFrame:
    """Each premise with each hypothesis: ``hyp_pos``, ``hypothesis``, ``entailment``, ``neutral``, ``contradiction``.

    ``logits`` gives an array in the model's order contradiction, entailment, neutral. No hypotheses give no rows.
    """
    listed = F.array(*[F.struct(F.lit(i).alias("hyp_pos"), F.lit(h).alias("hypothesis")) for i, h in enumerate(hypotheses)])
    if not hypotheses:
        listed = F.from_json(F.lit("[]"), "array<struct<hyp_pos:int,hypothesis:string>>")
    each = premises.withColumn("__h", F.explode(listed)).select("*", "__h.*").drop("__h")
    p = each.withColumn("__p", T.softmax(logits(F.col(text), F.col("hypothesis"))))
    return p.select("*", F.col("__p")[1].alias("entailment"), F.col("__p")[2].alias("neutral"), F.col("__p")[0].alias("contradiction")).drop("__p")


def best_hypothesis(scored: DataFrame, key: str) -> DataFrame:
    """``key``, ``hypothesis``, ``entailment`` of the most entailed hypothesis; the first of equals."""
    top = F.max_by(F.struct("hypothesis", "entailment"), F.struct("entailment", -F.col("hyp_pos")))
    return scored.groupBy(key).agg(top.alias("t")).select(key, "t.hypothesis", "t.entailment")


def ranked_hypotheses(scored: DataFrame, key: str) -> DataFrame:
    """``scored`` with ``rank`` from 0: each premise's hypotheses by falling entailment, equals in their order."""
    order = Window.partitionBy(key).orderBy(F.desc("entailment"), "hyp_pos")
    return scored.withColumn("rank", F.row_number().over(order) - 1)


def first_keyword(texts: DataFrame, keywords: list[tuple[str, str]], text: str = "text") -> Column:
    """The hypothesis of the first keyword that the lower-cased text holds, else null."""
    return F.coalesce(*[F.when(F.contains(F.lower(F.col(text)), F.lit(k.lower())), F.lit(h)) for k, h in keywords])
