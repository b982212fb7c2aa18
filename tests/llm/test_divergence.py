import duckdb
import pyarrow as pa
import pytest

from textloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, part string"


def sql(rows, min_docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, part VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    return sorted(con.execute(divergence.AUDIT_SQL.replace(f"count(*) >= {divergence.MIN_DOCS}", f"count(*) >= {min_docs}")).fetchall())


def rows():
    out = [(i, f"The cat{i % 7} sat ÄÖ-{i % 3} the MAT_x9y" + " dog" * (i % 4), "en", f"s{i % 3}", "p") for i in range(60)]
    out += [(100 + i, "le chat É " * (i % 3 + 1), "fr", "s0" if i % 2 else None, None) for i in range(12)]
    out += [(None, None, None, None, None), (7, "", "en", "s9", "x"), (7, "", "en", "s9", "x"), (8, "1 2 3", "de", "s1", "x"), (9, "eins", "de", "s2", "x")]
    return out


@pytest.mark.parametrize("min_docs", [1, 3, 10])
def test_same_rows_as_sql(spark, min_docs):
    docs = spark.createDataFrame(rows(), SCHEMA)
    assert sorted(map(tuple, divergence.audit(docs, min_docs).collect())) == sql(rows(), min_docs)


def test_slices_pieces_and_stretches_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 40)
    monkeypatch.setattr(divergence, "ROWS", 3)
    long = (500, "word another " * 50 + "x" * 300, "en", "s0", None)
    batch = pa.record_batch({"lang": ["en", "fr", "en"], "source": ["a", "b", "a"], "text": [long[1], "un deux un", ""]})
    got: dict = {}
    for b in divergence.count_terms(iter([batch])):
        for r in b.to_pylist():
            at = got.setdefault((r["lang"], r["source"], r["term"]), [0, 0])
            at[0] += r["n"]
            at[1] += r["docs"]
    assert got == {("en", "a", "word"): [50, 1], ("en", "a", "another"): [50, 1], ("en", "a", "x" * 300): [1, 1], ("fr", "b", "un"): [2, 1], ("fr", "b", "deux"): [1, 1]}
    table = pa.table({"lang": ["en"] * 7, "term": list("aaabbcd"), "source": list("xyzxyxx"), "n": [1] * 7, "docs": [1] * 7})
    run = divergence.shard_sql(divergence.KEEP_SQL.format(least=2), divergence.KEPT)
    kept = [r for b in run(iter(table.to_batches(max_chunksize=2))) for r in b.to_pylist()]
    assert sorted((r["term"], r["source"], r["head"], r["total"]) for r in kept) == [("a", "x", 1, 3), ("a", "y", 0, 3), ("a", "z", 0, 3), ("b", "x", 1, 2), ("b", "y", 0, 2)]


def test_empty_table_and_arguments(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        divergence.audit(spark.createDataFrame([], SCHEMA), 0)
