"""Spans that stay in their text's row, against plain loops and the forms that take tables."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import spans

LABELS = ["a", "b"]
TAGS = ["O", "B-X", "I-X", "B-Y", "I-Y", "Z"]


def scorers():
    """Made here, so that tasks get them by value."""
    import numpy as np

    n_tags = len(TAGS)

    class Logits:
        def span_logits(self, key, text, words, first, stop, max_width, labels):
            word, width, label = np.ogrid[first:stop, 0:max_width, 0 : len(labels)]
            return ((key * 13 + word * 7 + width * 5 + label * 11) % 17 - 8) / 2.0

    class Tags:
        def tag_logits(self, key, text, words):
            pos, label = np.ogrid[0 : len(words), 0:n_tags]
            return (pos * (3 + label) * 7 + (key or 0) * 5 + label) % 11 / 2.0

    return Logits, Tags


Logits, Tags = scorers()


def texts():
    rng = random.Random(4)
    made = [(i, " ".join(rng.choice(["wörd", "x-y_z", "a.b", "😀", "(c)", "İ"]) for _ in range(rng.choice([1, 2, 7, 40])))) for i in range(30)]
    return [*made, (100, ""), (101, None), (102, " \n "), (103, "one " * 3000)]


@pytest.mark.parametrize("rules", [{}, {"flat": False}, {"flat": False, "multi_label": True}, {"flat": False, "multi_label": True, "dup_label": True}])
@pytest.mark.parametrize("block", [3, 1 << 14])
def test_entities_are_those_of_the_table_forms(spark, monkeypatch, rules, block):
    df = spark.createDataFrame(texts(), "d long, text string")
    monkeypatch.setattr(spans, "WORDS", block)
    got = {r.d: [tuple(e) for e in r.entities] for r in spans.extract(df, "d", LABELS, Logits, 4, 0.6, **rules).collect()}
    logit = lambda s, p: ((F.col("d") * 13 + s["word"] * 7 + s["width"] * 5 + p * 11) % 17 - 8) / 2.0
    each = spans.label_spans(spans.enumerate_spans(df, "d", 4), LABELS, logit, 0.6)
    want = {r.d: [(e.start, e.end, e.text, e.label, round(e.score, 9)) for e in r.entities] for r in spans.greedy(each, "d", **rules).collect()}
    assert set(got) == {i for i, _ in texts()}
    for i, text in texts():
        assert [(s, e, x, label, round(p, 9)) for s, e, _, _, x, label, p in got[i]] == want.get(i, [])
        assert all(text[s:e] == x for s, e, _, _, x, _, _ in got[i])


def test_all_candidates_and_enumeration(spark):
    df = spark.createDataFrame(texts(), "d long, text string")
    logit = lambda s, p: ((F.col("d") * 13 + s["word"] * 7 + s["width"] * 5 + p * 11) % 17 - 8) / 2.0
    want = sorted((r.d, r.word, r.width, r.label, r.text) for r in spans.label_spans(spans.enumerate_spans(df, "d", 3), LABELS, logit, 0.5).collect())
    rows = spans.extract(df, "d", LABELS, Logits, 3, 0.5, walk=False).select("d", F.inline("entities"))
    assert sorted((r.d, r.word, r.width, r.label, r.text) for r in rows.collect()) == want
    listed = sorted((r.d, r.word, r.width) for r in spans.span_table(df, "d", 3).select("d", F.inline(F.arrays_zip("word", "width"))).collect())
    assert listed == sorted((r.d, r.word, r.width) for r in spans.enumerate_spans(df, "d", 3).collect())


@pytest.mark.parametrize("threshold", [0.0, 0.4])
def test_tagged_spans_are_those_of_the_table_form(spark, threshold):
    df = spark.createDataFrame(texts(), "d long, text string")
    words = spans.tag_words(df, "d", TAGS, Tags).select("d", F.posexplode(F.arrays_zip("place", "prob")).alias("pos", "w"))
    rows = words.select("d", "pos", F.element_at(F.array(*[F.lit(x) for x in TAGS]), F.col("w.place") + 1).alias("label"), "w.prob")
    key = lambda r: (r.d, r.label, r.first_pos, r.last_pos, round(r.score, 9))
    want = sorted(map(key, spans.bio_spans(rows, "d", threshold=threshold).collect()))
    got = spans.tag_spans(df, "d", TAGS, Tags, threshold).select("d", F.inline("spans"))
    assert sorted(map(key, got.collect())) == want and len(want) > 20


def test_no_shuffle_and_arguments(spark):
    df = spark.createDataFrame(texts(), "d long, text string")
    for made in (spans.extract(df, "d", LABELS, Logits), spans.tag_spans(df, "d", TAGS, Tags), spans.span_table(df, "d")):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for wrong in ({"max_width": 0}, {"threshold": 1.5}, {"labels": []}):
        with pytest.raises(ValueError):
            spans.extract(df, "d", **({"labels": LABELS, "load": Logits} | wrong))
    with pytest.raises(ValueError):
        spans.tag_spans(df, "d", TAGS, Tags, -0.1)
    assert spans.extract(df.limit(0), "d", LABELS, Logits).count() == 0


def test_word_offsets(spark):
    for text in ("a-b c_d  e.", "naïve é x\x1cy\x0bz", "", "tab\tand\nline"):
        at = T.offsets_of(text)
        assert [text[a:b] for a, b in at.tolist()] == [text[m.start : m.end] for m in _spans(spark, text)]
    assert T.offsets_of(None).shape == (0, 2)


def _spans(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(T.word_spans("t").alias("w")).first().w
