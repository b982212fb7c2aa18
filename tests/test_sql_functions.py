import pytest

from textloom.functions import sql
from textloom.functions import text as T
from textloom.operators import chunk


def test_functions_in_sql_text(spark):
    sql.register(spark)
    spark.createDataFrame([(1, " One. Two!\n\nThree é "), (2, None), (3, "")], "d long, t string").createOrReplaceTempView("sql_docs")
    got = spark.sql("SELECT d, s.* FROM sql_docs, LATERAL text_segments(t, 'sentence') s ORDER BY d, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1, 5, "One."), (1, 1, 6, 10, "Two!"), (1, 2, 12, 19, "Three é")]
    assert [r.word for r in spark.sql("SELECT w.word FROM sql_docs, LATERAL text_words(t) w ORDER BY pos").collect()] == ["One", ".", "Two", "!", "Three", "é"]
    with pytest.raises(Exception, match="granularity"):
        spark.sql("SELECT * FROM sql_docs, LATERAL text_segments(t, 'page')").collect()


def test_packing_in_sql_is_packing(spark):
    sql.register(spark)
    rows = [(p, i, (i * 7 + p) % 9, None if i == 0 else (i * 5 + p) % 10 / 10) for p in range(6) for i in range(p * 4)]
    df = spark.createDataFrame(rows, "parent long, pos long, tokens long, sim double").repartition(3)
    df.createOrReplaceTempView("sql_units")
    for most, drop in ((10, 0.0), (15, 0.4), (1, 1.0)):
        want = sorted((r.parent, r.chunk, r.first_pos, r.last_pos, r.tokens, len(r.unit_indices)) for r in chunk.pack(df, "parent", "pos", most, drop).collect())
        got = spark.sql(f"SELECT * FROM pack_units(TABLE(sql_units) PARTITION BY parent ORDER BY (pos), {most}, CAST({drop} AS DOUBLE))")
        assert sorted(map(tuple, got.collect())) == want
    assert T.UNITS.keys() == {"paragraph", "sentence", "line"}
