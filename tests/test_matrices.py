import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.sources import matrices


def rows(df):
    return sorted((r.row, list(r.vector)) for r in df.collect())


def test_round_trip_append_and_overwrite(spark, tmp_path):
    spark.dataSource.register(matrices.Matrices)
    path = str(tmp_path / "m")
    df = spark.range(1000).select(F.col("id").alias("row"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vector")).repartition(3)
    df.write.format("matrix").mode("append").save(path)
    back = spark.read.format("matrix").option("rows", 100).load(path)
    assert back.rdd.getNumPartitions() >= 10
    assert rows(back) == [(i, [float(i), 0.5]) for i in range(1000)]
    df.filter("row < 2").withColumn("row", F.col("row") + 5000).write.format("matrix").mode("append").save(path)
    assert spark.read.format("matrix").load(path).count() == 1002
    df.filter("row < 3").write.format("matrix").mode("overwrite").save(path)
    assert rows(spark.read.format("matrix").load(path)) == [(i, [float(i), 0.5]) for i in range(3)]
    assert sum(f.endswith(".npy") for f in os.listdir(path)) <= 6


def test_plain_files_are_read_by_ranges(spark, tmp_path):
    spark.dataSource.register(matrices.Matrices)
    x = np.arange(30, dtype=np.float32).reshape(10, 3)
    np.save(tmp_path / "x.npy", x)
    for path in (str(tmp_path), str(tmp_path / "x.npy")):
        assert rows(spark.read.format("matrix").option("rows", 4).load(path)) == [(i, v.tolist()) for i, v in enumerate(x)]


def test_a_failed_task_leaves_nothing_to_read(spark, tmp_path):
    spark.dataSource.register(matrices.Matrices)
    path = str(tmp_path / "m")
    good = spark.range(100).select(F.col("id").alias("row"), F.array(F.col("id").cast("float")).alias("vector")).repartition(4)
    good.write.format("matrix").mode("append").save(path)
    bad = good.withColumn("vector", F.when(F.col("row") == 77, F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float"))).otherwise(F.col("vector")))
    files = sorted(os.listdir(path))
    with pytest.raises(Exception, match="one length"):
        bad.write.format("matrix").mode("append").save(path)
    assert spark.read.format("matrix").load(path).count() == 100
    assert [f for f in sorted(os.listdir(path)) if f.startswith("list-")] == [f for f in files if f.startswith("list-")]
