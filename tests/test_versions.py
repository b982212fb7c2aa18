"""Batches that are added whole or not at all, and a cache that lasts."""

import pytest
from pyspark.sql import functions as F

from textloom.operators.cache import EmbeddingCache
from textloom.sources.versions import Versions
from textloom.streaming import index_stream

SCHEMA = "i long, x string"


def ids(df):
    return sorted(r.i for r in df.collect())


def rows(spark, *ids):
    return spark.createDataFrame([(i, f"x{i}") for i in ids], SCHEMA)


def test_batches_versions_and_replays(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), SCHEMA)
    assert table.version == 0 and ids(table.read()) == []
    assert [table.append(rows(spark, 1, 2), "a"), table.append(rows(spark, 2), "b"), table.append(rows(spark, 9), "a")] == [1, 2, 2]
    assert ids(Versions(spark, str(tmp_path / "t"), SCHEMA).read()) == [1, 2, 2] and ids(table.read(1)) == [1, 2] and ids(table.read(0)) == []
    table.commit("c", table.stage(rows(spark, 7)), whole=True)
    assert table.append(rows(spark, 8), "d") == 4
    assert ids(table.read()) == [7, 8] and ids(table.read(2)) == [1, 2, 2]
    with pytest.raises(Exception):
        table.append(spark.createDataFrame([(1,)], "i long"), "e")
    assert table.version == 4


def test_what_is_not_committed_is_not_there(spark, tmp_path, monkeypatch):
    table = Versions(spark, str(tmp_path / "t"), SCHEMA)
    table.append(rows(spark, 1), "a")
    monkeypatch.setattr(Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError, match="killed"):
        table.append(rows(spark, 2), "b")
    monkeypatch.undo()
    assert ids(table.read()) == [1]
    table.append(rows(spark, 2), "b")
    assert ids(table.read()) == [1, 2]


def test_a_stream_killed_between_write_and_commit_adds_each_batch_once(spark, tmp_path, monkeypatch):
    for k in range(4):
        rows(spark, *range(k * 10, k * 10 + 5)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, state, commit, calls = Versions(spark, str(tmp_path / "t"), SCHEMA), str(tmp_path / "state"), Versions.commit, []

    def dies(self, *a, **k):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed before the commit")
        out = commit(self, *a, **k)
        if len(calls) == 4:
            raise RuntimeError("killed after the commit")
        return out

    monkeypatch.setattr(Versions, "commit", dies)
    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            index_stream.grow(stream(), table, state, lambda b: b).awaitTermination()
    index_stream.grow(stream(), table, state, lambda b: b).awaitTermination()
    assert ids(table.read()) == sorted(k * 10 + i for k in range(4) for i in range(5)) and table.version == 4


def test_repeated_events_within_the_watermark(spark, tmp_path):
    data = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:20:00"), (3, "2024-01-01 00:30:00")]
    events = spark.createDataFrame(data, "event_id long, at string").select("event_id", F.col("at").cast("timestamp_ntz").alias("ts"))
    events.coalesce(1).write.parquet(str(tmp_path / "e"))
    table = Versions(spark, str(tmp_path / "t"), "event_id long")
    stream = index_stream.first_events(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    index_stream.grow(stream, table, str(tmp_path / "state"), lambda b: b).awaitTermination()
    assert sorted(r.event_id for r in table.read().collect()) == [1, 2, 3]


def test_a_cache_embeds_each_text_once_and_forgets_what_is_not_used(spark, tmp_path, monkeypatch):
    asked = []

    def embed(texts):
        asked.append(sorted(r.text for r in texts.collect()))
        return texts.select("digest", F.array(F.length("text").cast("double")).alias("embedding"))

    def run(texts, revision="1"):
        df = spark.createDataFrame(list(enumerate(texts)), "pos long, text string").repartition(3)
        out, n = EmbeddingCache(spark, str(tmp_path), "m", revision).embed(df, embed)
        got = [(r.text, r.embedding) for r in out.orderBy("pos").collect()]
        assert got == [(t, None if t is None else [float(len(t))]) for t in texts]
        return n

    assert run(["b", "a", "b", None, ""]) == 3 and run(["b", "a", "b", None, ""]) == 0 and run(["b", "ccc"]) == 1
    assert run(["b"], "2") == 1
    assert asked == [["", "a", "b"], [], ["ccc"], ["b"]]
    cache = EmbeddingCache(spark, str(tmp_path), "m", "1")
    assert cache.known().count() == 4 and cache.evict(3) == 2
    assert cache.known().count() == 2 and run(["b", "ccc", "a"]) == 1
    monkeypatch.setattr("textloom.operators.cache.MANY", 1)
    assert run(["a", "a", "b", "a"]) == 0
    assert cache.evict(0) == 0 and cache.known().count() == 0 and run([]) == 0
