"""An embedding cache that lasts: vectors by (model, revision, text), found again by later jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators.numbering import cut
from textloom.sources.versions import Versions

SCHEMA = "digest binary, embedding array<double>, used long"
#: Rows of a run that share a text from which its vector is broadcast to them.
MANY = 100_000


class EmbeddingCache:
    """Vectors of one ``model`` and ``revision`` under ``path``; another model or revision shares nothing with it.

    Every run is a version of the table: new vectors, and a mark of use for those found. ``evict`` keeps those used last.
    """

    def __init__(self, spark: SparkSession, path: str, model: str, revision: str) -> None:
        self.model, self.revision = model, revision
        self.table = Versions(spark, f"{path.rstrip('/')}/{model}@{revision}".replace(" ", "_"), SCHEMA)

    def known(self) -> DataFrame:
        """``digest``, ``embedding``, ``used`` (version of the last use) of every vector, a row each."""
        each = self.table.read().groupBy("digest").agg(F.max("used").alias("used"), F.first("embedding", ignorenulls=True).alias("embedding"))
        return each.select("digest", "embedding", "used")

    def embed(self, rows: DataFrame, embed: Callable[[DataFrame], DataFrame], text: str = "text", out: str = "embedding") -> tuple[DataFrame, int]:
        """``rows`` with their vectors under ``out``, and how many texts were embedded for that.

        ``embed`` turns a frame (``digest``, ``text``) of distinct texts into (``digest``, ``embedding``). It is given those only that
        the cache does not have, each once. Rows keep their columns, so a column for their order is kept. Null texts have a null vector.
        """
        digest = F.unhex(F.sha2(F.col(text).cast("binary"), 256))
        keyed = rows.withColumn("__digest", digest)
        wanted = cut(keyed.filter(F.col(text).isNotNull()).groupBy(F.col("__digest").alias("digest")).agg(F.first(text).alias("text"), F.count("*").alias("n")))
        known = self.known().select("digest", "embedding")
        hits = cut(wanted.select("digest").join(known, "digest"))
        fresh = cut(embed(wanted.select("digest", "text").join(hits.select("digest"), "digest", "left_anti")).select("digest", "embedding"))
        version, made = self.table.version + 1, fresh.count()
        marks = hits.select("digest", F.lit(None).cast("array<double>").alias("embedding"), F.lit(version).alias("used"))
        both = fresh.withColumn("used", F.lit(version).cast("long")).unionByName(marks)
        if made or not hits.isEmpty():
            self.table.commit(f"run-{version}", self.table.stage(both))
        vectors = hits.unionByName(fresh).withColumnRenamed("digest", "__digest").withColumnRenamed("embedding", out)
        # A text that very many rows share goes to them by broadcast; there are few such.
        hot = F.broadcast(wanted.filter(F.col("n") > MANY).select(F.col("digest").alias("__digest")))
        apart = keyed.join(hot, "__digest", "left_semi").join(F.broadcast(vectors.join(hot, "__digest", "left_semi")), "__digest", "left")
        other = keyed.join(hot, "__digest", "left_anti").join(vectors, "__digest", "left")
        return other.unionByName(apart).drop("__digest"), made

    def evict(self, rows: int) -> int:
        """Keep about the ``rows`` vectors used last, whole versions of use at a time, at most ``rows``; how many are left."""
        known = cut(self.known())
        # A row for each version.
        counts = known.groupBy("used").agg(F.count("*").alias("n")).withColumn("held", F.sum("n").over(Window.orderBy(F.desc("used"))))
        kept = counts.filter(F.col("held") <= rows).agg(F.min("used").alias("least"), F.max("held").alias("held")).first()
        left = known.filter(F.col("used") >= (kept.least if kept.least is not None else 1 << 62))
        self.table.commit(f"evict-{self.table.version + 1}", self.table.stage(left), whole=True)
        return kept.held or 0
