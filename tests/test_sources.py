import json

import pytest

from textloom.sources import documents as D


def test_documents_of_either_shape(spark):
    items = ['"plain"', '{"text": "full", "doc_id": 7, "external_id": "x", "metadata": {"a": "b"}}']
    df = spark.createDataFrame(list(enumerate(items)), "n long, item string")
    got = D.documents(df, order=["n"]).orderBy("doc_id").collect()
    assert [(r.text, r.doc_id, r.external_id, r.metadata) for r in got] == [("plain", 0, None, {}), ("full", 7, "x", {"a": "b"})]
    with pytest.raises(Exception, match="documents need"):
        D.documents(spark.createDataFrame([("{}",)], "item string")).collect()


def test_candidates(spark):
    df = spark.createDataFrame([('{"text": "t", "doc_id": 3, "external_id": "e", "metadata": {"k": "v"}}',), ('"s"',)], "item string")
    got = {r.text: r for r in D.candidates(df).collect()}
    assert got["t"].doc_id == "3" and got["t"].metadata == {"k": "v", "external_id": "e"} and got["s"].score == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "", "content": "c"}\n\n{"id": "2", "body": "b"}\n{"id": "3"}\n')
    assert [(r.id, r.text) for r in D.corpus_lines(spark, str(tmp_path / "a.jsonl")).orderBy("id").collect()] == [("1", "c"), ("2", "b"), ("3", "")]
    (tmp_path / "s.txt").write_text(" one \n\n two\n")
    assert sorted(r.sentence for r in D.sentence_lines(spark, str(tmp_path / "s.txt")).collect()) == ["one", "two"]
    (tmp_path / "gold.jsonl").write_text('{"doc_id": "x", "clause_answers": {"Parties": ["A"]}}\n{"doc_id": "y", "clause_answers": {}}\n')
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("text\nof x")
    assert [(r.doc_id, r.text, r.clause_answers["Parties"]) for r in D.golden(spark, str(tmp_path / "gold.jsonl"), str(tmp_path / "t")).collect()] == [("x", "text\nof x", ["A"])]


def test_config_labels(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"id2label": {str(i): f"L{i}" for i in range(12)}}))
    assert [r.label for r in D.config_labels(spark, str(tmp_path / "c.json")).collect()] == [f"L{i}" for i in range(12)]
    (tmp_path / "d.json").write_text('{"id2label": {"0": "a", "2": "b"}}')
    with pytest.raises(ValueError):
        D.config_labels(spark, str(tmp_path / "d.json"))


def test_ids_follow_the_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "c")], "n long, text string")
    assert [r.text for r in D.from_texts(df, order=["n"]).orderBy("doc_id").collect()] == ["b", "c", "a"]
