import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size string"


def rows(n):
    return [(i, f"text {i % 7} é", "x", "y") for i in range(n)]


def test_manifest_law_sizes_and_slots(spark):
    data = [*rows(500), (None, None, None, None), (None, "", None, None), *[(7, "same", "s", None)] * 2500]
    got = sharding.shard_manifest(spark.createDataFrame(data, SCHEMA), "doc_id", "text", 5).collect()
    assert len(got) == len(data)
    want = sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in data)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    by_key, slots = {}, {}
    for r in got:
        assert by_key.setdefault(r.doc_id, (r.shard, r.grown_shard)) == (r.shard, r.grown_shard)
        assert r.grown_shard in (r.shard, 5) and r.law == "key"
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_are_kept_and_growth_moves_few(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    one = sharding.assign_shards(df, "doc_id", 3, [1.0, 1.0, 2.0])
    n = {r.shard: r["count"] for r in one.groupBy("shard").count().collect()}
    assert abs(n[2] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02
    moved = sharding.assign_shards(one, "doc_id", 4, [1.0, 1.0, 2.0, 1.0], "grown").filter("grown <> shard")
    assert moved.filter("grown <> 3").count() == 0 and abs(moved.count() / 20000 - 0.2) < 0.02


def test_empty_and_bad_weights(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_manifest(empty, "doc_id", "text", 4).count() == 0
    for bad in (0, 2):
        with pytest.raises(ValueError):
            sharding.shard_of(F.lit(1), bad, [1.0] if bad else [])


def test_files_hold_every_row(spark, tmp_path):
    df = spark.createDataFrame(rows(50), SCHEMA).drop("shard")
    sharding.write_shards(df, str(tmp_path / "out"), "doc_id", 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_choice_like_a_plain_one(spark):
    """The shard of the least -ln(u) / weight, with u from a hash of key and shard."""

    def cost(key, shard, weight):
        first = 42 if key is None else xxhash.xxh64_intdigest(str(key).encode(), 42)
        bits = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), first) >> 11
        return -math.log((bits + 0.5) * 2.0**-53) / weight

    for weights in (None, [1.0, 0.5, 3.0, 2.0, 1.0, 1.0, 4.0]):
        given = weights or [1.0] * 7
        got = {r.doc_id: r.shard for r in sharding.assign_shards(spark.createDataFrame([*rows(800), (None, "", "", "")], SCHEMA), "doc_id", 7, weights).collect()}
        for key, shard in got.items():
            assert shard == min(range(7), key=lambda s: (cost(key, s, given[s]), s))


def test_a_record_makes_no_object_for_each_shard(spark):
    """Costs are plain numbers: no struct for each shard, which filled the executors' memory; one more shard is the choice among all of them."""
    df = spark.createDataFrame([*rows(800), (None, "", "", "")], SCHEMA)
    for weights in (None, [1.0, 0.5, 3.0, 2.0, 1.0, 1.0, 4.0]):
        chosen = sharding.assign_shards(df, "doc_id", 7, weights)
        assert "struct" not in chosen._jdf.queryExecution().optimizedPlan().toString()
        given = weights or [1.0] * 7
        more = {r.doc_id: r.shard for r in sharding.assign_shards(df, "doc_id", 8, [*given, sum(given) / 7]).collect()}
        one = {r.doc_id: r.shard for r in chosen.collect()}
        got = {r.doc_id: (r.shard, r.grown_shard) for r in sharding.shard_manifest(df, "doc_id", "text", 7, weights).collect()}
        assert got == {k: (one[k], more[k]) for k in one}


def test_written_shards_hold_their_rows(spark, tmp_path):
    df = spark.createDataFrame([*rows(300), *[(7, "same", "s", None)] * 200], SCHEMA)
    sharding.write_shards(df, f"{tmp_path}/out", "doc_id", 5)
    want = sorted((r.doc_id, r.text, r.shard) for r in sharding.assign_shards(df, "doc_id", 5).collect())
    assert sorted((r.doc_id, r.text, r.shard) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want
