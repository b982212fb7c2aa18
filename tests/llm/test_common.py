from pyspark.sql import functions as F

from textloom.llm import common


def test_lookups_of_small_and_large_tables_agree(spark, monkeypatch):
    rows = spark.range(3000).select((F.col("id") % 7).alias("k"), F.when(F.col("id") < 2000, 9).otherwise(F.col("id") % 5).alias("j"), "id")
    table = spark.createDataFrame([(k, j, f"{k}{j}") for k in range(6) for j in (*range(4), 9)], "k long, j long, x string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(table, ["k", "j"], how).collect()), key=str)
        for few, many in ((10**6, 10**6), (3, 10**6), (10, 100)):
            monkeypatch.setattr(common, "FEW", few)
            monkeypatch.setattr(common, "MANY", many)
            assert sorted(map(tuple, common.looked_up(rows, table, ["k", "j"], how).collect()), key=str) == want
