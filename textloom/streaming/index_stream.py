"""Indexes that grow with a stream, of documents or events."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions import scorers
from textloom.functions import text as T
from textloom.operators.numbering import shared_folder
from textloom.sources.versions import Versions


def scored(stream: DataFrame, text: str = "text") -> DataFrame:
    """The stateless projection that the stream and a batch job share."""
    return stream.withColumn("n_tokens", T.token_count(text)).withColumn("snippet", T.snippet(text, 80))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the scored stream to the Parquet index at ``path``; what is there already is worked off, then it ends."""
    return scored(stream).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a stream, appended to an index in the shared checkpoint folder; the index read back."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/documents.parquet*")
    base = f"{shared_folder(spark)}/stream-{uuid4()}"
    append_to(stream.select("doc_id", "text"), f"{base}/index", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/index").select("doc_id", F.col("n_tokens"), "snippet")


def grow(stream: DataFrame, table: Versions, checkpoint: str, prepare: Callable[[DataFrame], DataFrame], name: str = "stream") -> StreamingQuery:
    """Append every micro-batch, ``prepare``d, to the versioned ``table``: all of it or nothing, and once, however often it is replayed."""

    def add(batch: DataFrame, number: int) -> None:
        table.append(prepare(batch), f"{name}-{number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_events(events: DataFrame, ts: str = "ts", key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """The stream without repeats of a ``key`` that come within ``late`` of each other; ``ts`` without a zone is read in the session's."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.dropDuplicatesWithinWatermark([key])


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, embedding array<double>"


def event_rows(batch: DataFrame) -> DataFrame:
    """What the index holds of events: their fields, and a vector of type and properties."""
    text = F.concat_ws(" ", "event_type", F.regexp_replace(F.coalesce("props", F.lit("")), r'[{}":,]+', " "))
    return scorers.vocab_embed(batch.withColumn("__text", text), ["event_id", "ts", "user_id", "event_type", "value"], "__text").drop("n_tokens")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, appended to a versioned index batch by batch; its latest version.

    Files may come in any order, so the watermark stays behind as far as the events reach, a month.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = first_events(late="31 days", events=spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*"))
    base = f"{shared_folder(spark)}/events-{uuid4()}"
    table = Versions(spark, f"{base}/index", EVENTS)
    grow(stream, table, f"{base}/state", event_rows).awaitTermination()
    return table.read()
