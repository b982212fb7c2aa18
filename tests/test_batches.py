import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import batches
from textloom.sources import documents as D


def test_batches_by_length_keep_the_budget(spark):
    rows = [(i, "w", n) for i, n in enumerate([3, 500, 0, None, 16, 17, *[20] * 30, 90, 3, 3])]
    df = spark.createDataFrame(rows, "i long, text string, n_tokens int").repartition(3)
    got = batches.length_batches(df, "i", budget=100, band=16).collect()
    assert len(got) == len(rows)
    held: dict = {}
    for r in got:
        assert r.band >= max(r.n_tokens or 0, 1) > r.band - 16 or r.n_tokens in (0, None)
        held.setdefault((r.band, r.batch), []).append(r.n_tokens or 0)
    assert all(len(x) * band <= 100 or len(x) == 1 for (band, _), x in held.items())
    assert sorted(len(x) for (band, _), x in held.items() if band == 32) == [1, *[3] * 10]
    one = batches.padding(df.filter("n_tokens IS NOT NULL").withColumn("b", F.lit(0)), ["b"]).first()
    assert (one.n_batches, one.tokens, one.padded) == (1, 1232, 500 * 38)
    assert batches.padding(df.limit(0).withColumn("b", F.lit(0)), ["b"]).first().share == 0.0
    with pytest.raises(ValueError):
        batches.length_batches(df, "i", budget=0)


def test_embedding_in_batches_gives_each_row_its_own(spark):
    class Lengths:
        def embed(self, texts):
            assert sum(max(map(len, texts)) for _ in texts) <= 200 or len(texts) == 1
            return [[float(len(t)), 1.0] for t in texts]

    rows = [(i, "x" * (i * 7 % 50), i * 7 % 50) for i in range(300)] + [(5, None, 0)]
    df = spark.createDataFrame(rows, "i long, text string, n_tokens int").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    got = sorted((r.i, round(r.embedding[0] / r.embedding[1])) for r in batches.embed_in_batches(df, Lengths, "i", budget=200, band=4).collect())
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted((i, n) for i, _, n in rows)


def test_bad_items_are_set_apart(spark):
    items = ['"plain"', '{"text": "a", "doc_id": 7, "external_id": "e", "metadata": {"k": "v", "n": 1}}', '{"text": "b", "doc_id": null}', '{"text": ""}', "{", None, "12", "null", "[1]",
             '{"doc_id": 1}', '{"text": 3}', '{"text": "c", "doc_id": "x"}', '{"text": "c", "doc_id": 1.5}', '{"text": "c", "external_id": 4}', '{"text": "c", "metadata": [1]}', json.dumps({"text": "é\n\"q\""})]
    df = spark.createDataFrame(list(enumerate(items)), "at int, item string").repartition(3)
    good, bad = D.checked(df, order=["at"])
    assert sorted((r.doc_id, r.text, r.external_id, r.metadata) for r in good.collect()) == [
        (0, "plain", None, {}), (2, "b", None, {}), (3, "", None, {}), (7, "a", "e", {"k": "v", "n": "1"}), (15, 'é\n"q"', None, {})]
    fields = {r.place: (r.field, r.reason) for r in bad.collect()}
    assert {k: v[0] for k, v in fields.items()} == {4: "item", 5: "item", 6: "item", 7: "item", 8: "item", 9: "text", 10: "text", 11: "doc_id", 12: "doc_id", 13: "external_id", 14: "metadata"}
    assert fields[4][1] == fields[5][1] == "malformed" and fields[6][1] == "found BIGINT" and fields[11][1] == "found STRING"
    assert [x.count() for x in D.checked(df.limit(0), order=["at"])] == [0, 0]
