"""Building and growing an embedding index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.numbering import numbered


def append(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with ``new`` rows added; columns are matched by name, missing ones are null, duplicates stay."""
    return index.unionByName(new, allowMissingColumns=True)


def cache_split(texts: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows whose text is cached (with the cached columns) and the distinct texts that are not."""
    known = cache.dropDuplicates([text])
    return texts.join(known, text), texts.select(text).filter(F.col(text).isNotNull()).distinct().join(known, text, "left_anti")


def group_concat(units: DataFrame, by: str, uri: str = "doc_uri", row: str = "row", text: str = "text", separator: str = "\n") -> DataFrame:
    """Corpus units joined by (uri, attribute): ``group_uri``, ``doc_id``, ``text``, ``first_row``, ``n_units``.

    A unit without the attribute is a group of its own, ``uri#ungrouped-N`` with N counting over the whole corpus.
    Texts are joined in row order; groups are numbered from 0 by their first row.
    """
    key = lambda tail: F.concat(F.col(uri).cast("string"), F.lit("#"), tail)
    alone = numbered(units.filter(F.col(by).isNull()), [row], "__n").withColumn("group_uri", key(F.concat(F.lit("ungrouped-"), F.col("__n")))).drop("__n")
    named = units.filter(F.col(by).isNotNull()).withColumn("group_uri", key(F.col(by).cast("string")))
    parts = F.sort_array(F.collect_list(F.struct(F.col(row).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    groups = named.unionByName(alone).groupBy("group_uri").agg(F.array_join(parts["text"], separator).alias("text"), F.min(row).alias("first_row"), F.count("*").alias("n_units"))
    return numbered(groups, ["first_row"], "doc_id")
