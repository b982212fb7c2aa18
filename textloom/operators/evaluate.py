"""Evaluation: gold against predictions, accuracies, percentiles, registry checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators.numbering import cut


def matches(gold: Column, predicted: Column) -> Column:
    """Whether one normalised string holds the other; never for an empty one."""
    g, p = T.normalised(gold), T.normalised(predicted)
    return (g != "") & (p != "") & (F.contains(g, p) | F.contains(p, g))


def gold_hits(gold: DataFrame, predicted: DataFrame, key: str, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """``gold`` rows that some prediction of their document matches."""
    p = predicted.select(F.col(key).alias("__key"), F.col(pred_col).alias("__pred"))
    return gold.join(p, (F.col(key) == F.col("__key")) & matches(F.col(gold_col), F.col("__pred")), "left_semi")


def gold_missed(gold: DataFrame, predicted: DataFrame, key: str, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    p = predicted.select(F.col(key).alias("__key"), F.col(pred_col).alias("__pred"))
    return gold.join(p, (F.col(key) == F.col("__key")) & matches(F.col(gold_col), F.col("__pred")), "left_anti")


def matched_predictions(gold: DataFrame, predicted: DataFrame, key: str, gold_col: str = "gold", pred_col: str = "pred") -> DataFrame:
    """``predicted`` rows that some gold of their document matches: the hits of the precision proxy."""
    g = gold.select(F.col(key).alias("__key"), F.col(gold_col).alias("__gold"))
    return predicted.join(g, (F.col(key) == F.col("__key")) & matches(F.col("__gold"), F.col(pred_col)), "left_semi")


def not_redacted(text: Column) -> Column:
    """Whether a gold string is one without the redaction mark."""
    return ~F.contains(text, F.lit("[*]"))


def invalid_probabilities(scored: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which a probability is not from 0 to 1 or their sum not within 0.01 of 1; null counts as invalid."""
    each = [F.coalesce(F.col(c).between(0.0, 1.0), F.lit(False)) for c in columns]
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    valid = total.between(0.99, 1.01)
    for c in each:
        valid &= c
    return scored.filter(~F.coalesce(valid, F.lit(False)))


def chunk_metrics(chunks: DataFrame, parent: str, tokens: str = "tokens") -> DataFrame:
    """One row: ``n_docs``, ``n_chunks``, ``max_tokens``, ``mean_tokens``, ``mean_chunks`` per document."""
    each = chunks.groupBy(parent).agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.max(tokens).alias("most"))
    total = each.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.max("most").alias("max_tokens"), F.sum("tokens").alias("t"))
    n = F.col("n_chunks")
    return total.select("n_docs", F.coalesce(n, F.lit(0)).alias("n_chunks"), "max_tokens", F.try_divide("t", n).alias("mean_tokens"), F.try_divide(n, "n_docs").alias("mean_chunks"))


def least_cosine(rows: DataFrame, reference: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """One row: ``n`` rows that the reference has too, and their ``least`` cosine to it."""
    other = reference.select(key, F.col(vec).alias("__other"))
    return rows.join(other, key).agg(F.count("*").alias("n"), F.min(V.cosine(vec, "__other")).alias("least"))


def entity_totals(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: ``n_docs``, ``n_entities``, ``n_ok`` documents with an entity and ``n_failed`` without, of each document's number ``n``."""
    return counts.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(n), F.lit(0)).alias("n_entities"), F.count_if(F.col(n) > 0).alias("n_ok"), F.count_if(F.coalesce(n, F.lit(0)) == 0).alias("n_failed"))


def disjoint(registry: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: how many models are both registered and excluded, and whether none is."""
    both = registry.select("model_id").intersect(excluded.select("model_id"))
    return both.agg(F.count("*").alias("n_both"), (F.count("*") == 0).alias("disjoint"))


def distinctness(rows: DataFrame, column: str) -> DataFrame:
    """One row: ``n`` values, ``n_distinct``, and whether all differ; nulls are not counted."""
    return rows.agg(F.count(column).alias("n"), F.count_distinct(column).alias("n_distinct"), (F.count(column) == F.count_distinct(column)).alias("all_distinct"))


def ratio(hits: Column, total: Column) -> Column:
    """hits / total, 0 for an empty total."""
    return F.coalesce(F.try_divide(hits.cast("double"), total.cast("double")), F.lit(0.0))


def value_counts(values: DataFrame, x: str) -> DataFrame:
    """Distinct non-null values with how many are below and how many there are: what exact order statistics need.

    Values are counted before they are ordered, so a measure with few distinct values, such as entities per document,
    is small however many rows there are; the running sum goes over range partitions.
    """
    counts = values.filter(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.count("*").alias("n"))
    spread = cut(counts.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    parts = spread.groupBy("part").agg(F.sum("n").alias("m"))
    starts = parts.select("part", F.coalesce(F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inner = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return spread.join(F.broadcast(starts), "part").select("x", "n", (F.col("start") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("below"))


def order_statistics(values: DataFrame, x: str) -> DataFrame:
    """One row: ``n``, ``mean``, ``median``, ``max``, ``p50`` and ``p95`` by nearest rank, ``p95_exclusive``.

    Nearest rank takes place n // 2 and min(n - 1, int(0.95 n)) of the sorted values, from 0. The exclusive p95 is the
    value at rank 0.95 (n + 1), interpolated; the maximum if there are fewer than 20. All null for no values.
    """
    counts = value_counts(values, x)
    total = counts.agg(F.sum("n").alias("total"), F.max("x").alias("max"), F.sum(F.col("x") * F.col("n")).alias("sum"))
    both = counts.crossJoin(F.broadcast(total))  # one row
    n = F.col("total")

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col("x")))

    rank = F.floor(n * 19 / 20 + F.lit(19) / 20)  # floor of 0.95 (n + 1)
    part = (n + 1) * 19 / 20 - rank
    low, high = at(rank - 1), at(F.least(rank, n - 1))
    out = both.agg(
        F.max(n).cast("bigint").alias("n"), (F.max("sum") / F.max(n)).alias("mean"), ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"),
        F.max("max").alias("max"), at(F.floor(n / 2)).alias("p50"), at(F.least(n - 1, F.floor(n * 19 / 20))).alias("p95"),
        low.alias("low"), high.alias("high"), F.max(part).alias("part"),
    )
    exclusive = F.when(F.col("n") < 20, F.col("max")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("part"))
    return out.withColumn("p95_exclusive", exclusive).drop("low", "high", "part")


def registry_gate(requested: DataFrame, registry: DataFrame, excluded: DataFrame, allow_unregistered: bool = False) -> DataFrame:
    """``requested`` models with ``status``: ``excluded: reason``, ``registered``, ``allowed`` or ``unknown``."""
    r = requested.join(F.broadcast(excluded.select("model_id", "reason")), "model_id", "left").join(F.broadcast(registry.select("model_id", F.lit(True).alias("known"))), "model_id", "left")
    status = F.when(F.col("reason").isNotNull(), F.concat(F.lit("excluded: "), "reason")).when(F.col("known"), "registered").otherwise("allowed" if allow_unregistered else "unknown")
    return r.select("model_id", status.alias("status"))
