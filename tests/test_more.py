"""Operators behind the further queries, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.functions import scorers, tokens
from textloom.functions import text as T
from textloom.operators import chunk, evaluate, rank, retrieve
from textloom.plans.more import SPECIALS, TOKENIZER


def test_paragraphs_and_chunks(spark):
    text = "  Alpha one.\nAlpha two.  \n \n\nBeta 😀 one. \n\n\tGamma.\n\n  \n"
    docs = spark.createDataFrame([(1, text), (2, " \n\n "), (3, None), (4, "x")], "d long, text string")
    got = [(r.pos, r.text) for r in chunk.segments(docs, "d").filter("d = 1").orderBy("pos").collect()]
    assert got == [(0, "Alpha one.\nAlpha two."), (1, "Beta 😀 one."), (2, "Gamma.")]
    rows = chunk.segments(docs, "d").collect()
    assert {r.d for r in rows} == {1, 4} and all(text[r.start : r.end] == r.text for r in rows if r.d == 1)
    assert [r.text for r in chunk.segments(docs, "d", "sentence").filter("d = 1").orderBy("pos").collect()] == ["Alpha one.", "Alpha two.", "Beta 😀 one.", "Gamma."]
    units = chunk.segments(docs, "d").withColumn("tokens", F.lit(3)).withColumn("sim", F.when(F.col("pos") == 1, 0.9).when(F.col("pos") == 2, 0.1))
    out = chunk.chunks(units, docs, "d").orderBy("d", "chunk").collect()
    assert [(r.d, r.tokens, r.unit_indices, r.text) for r in out] == [(1, 6, [0, 1], text[2 : text.index("one. \n\n\t") + 4]), (1, 3, [2], "Gamma."), (4, 3, [0], "x")]
    assert len({r.chunk_id for r in out}) == 3 and chunk.segments(docs.limit(0), "d").count() == 0
    with pytest.raises(ValueError):
        chunk.segments(docs, "d", "page")


def test_spread_cosines_equal_windowed_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, rng.standard_normal(3).tolist() if i % 7 else None) for g, n in (("a", 300), ("b", 1), ("c", 40), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, embedding array<double>").repartition(7)
    one, other = (sorted((str(r.g), r.i, r.sim) for r in chunk.adjacent_cosine(df, "g", "i", spread=s).select("g", "i", F.coalesce("sim", F.lit(9.0)).alias("sim")).collect()) for s in (False, True))
    assert one == other


def test_many_queries_are_dealt_out(spark):
    rng = np.random.default_rng(4)
    x = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(200)] + [(200, None)]
    df = spark.createDataFrame(x, "doc_id long, embedding array<float>").repartition(3)
    asked = df.filter("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id")
    few, many = (sorted(map(tuple, retrieve.top_k_batch(df, asked, k=6, block=b, split=50).select("query_id", "doc_id", F.round("score", 9), "rank").collect())) for b in (2048, 7))
    assert few == many and len(few) == 40 * 6
    scores, ids = rng.integers(0, 3, (20, 50)).astype(float), rng.permutation(50)
    for k in (1, 3, 50, 80):
        got = retrieve.best_of(scores, ids, k)
        assert [[(-s[j], ids[j]) for j in g] for s, g in zip(scores, got, strict=True)] == [sorted((-s[j], ids[j]) for j in range(50))[:k] for s in scores]


def test_reranked_ignores_diversification(spark):
    df = spark.createDataFrame([("g", i, float(i % 3)) for i in range(6)], "g string, i long, l double")
    rows = rank.reranked(df, "g", "i", F.col("l"), 4, 0.5).orderBy("rank").collect()
    assert [r.i for r in rows] == [2, 5, 1, 4] and rows[0].score == pytest.approx(1 / (1 + np.exp(-2)))
    with pytest.raises(ValueError):
        rank.reranked(df, "g", "i", F.col("l"), 4, 2.0)


def test_tokens_like_the_tokenizer(spark):
    texts = ["Hello wörld of tokens", "", None, "a b c " * 400]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    plain = Tokenizer.from_file(TOKENIZER)
    for r in df.select("i", tokens.encode(TOKENIZER, 50, SPECIALS)(F.col("text")).alias("e")).select("i", "e.*", tokens.words_mask(F.col("e.word_ids")).alias("mask")).collect():
        e = plain.encode(texts[r.i] or "", add_special_tokens=False)
        assert r.input_ids == [SPECIALS[0], *e.ids[:48], SPECIALS[1]] and len(r.attention_mask) == len(r.input_ids)
        want, last = [0], None
        for w in e.word_ids[:48]:
            want.append(w + 1 if w != last else 0)
            last = w
        assert r["mask"] == [*want, 0]
    pair = df.select("i", tokens.encode(TOKENIZER, 20, SPECIALS)(F.lit("what is it"), F.coalesce("text", F.lit(""))).alias("e")).select("i", "e.*", tokens.padded(F.col("e.input_ids"), F.lit(20)).alias("full")).collect()
    for r in pair:
        first, second = (plain.encode(t, add_special_tokens=False).ids for t in ("what is it", texts[r.i] or ""))
        assert r.input_ids == [SPECIALS[0], *first, SPECIALS[1], *second[: 20 - 3 - len(first)], SPECIALS[1]]
        assert r.type_ids == [0] * (len(first) + 2) + [1] * (len(r.input_ids) - len(first) - 2) and len(r.full) == 20
    assert df.select(tokens.entity_prompt(["x"], T.words("text")).alias("p")).first().p == ["<<ENT>>", "x", "<<SEP>>", "Hello", "wörld", "of", "tokens"]


def test_backends_and_shapes(spark):
    assert scorers.backend("auto") is scorers.OnnxEmbedder and scorers.backend("auto", static=True) is scorers.StaticEmbedder
    for name, said in (("fastembed", "retired"), ("other", "no backend")):
        with pytest.raises(ValueError, match=said):
            scorers.backend(name)
    load = lambda: scorers.StaticEmbedder({"a": [3.0, 4.0], "b": [0.0, 2.0]})
    df = spark.createDataFrame([("A a",), ("z",), (None,)], "text string")
    got = {r.text: r.v for r in df.select("text", scorers.embed_udf(load, 2)(F.col("text")).alias("v")).collect()}
    assert got["A a"] == pytest.approx([0.6, 0.8]) and got["z"] == [0.0, 0.0] and got[None] is None
    with pytest.raises(Exception, match="expected"):
        df.select(scorers.embed_udf(load, 3)(F.col("text"))).collect()


def test_checks(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.2, -0.2), (3, 0.5, 0.6), (4, None, 1.0)], "i long, p double, q double")
    assert sorted(r.i for r in evaluate.invalid_probabilities(df, ["p", "q"]).collect()) == [2, 3, 4]
    none = evaluate.chunk_metrics(spark.createDataFrame([], "d long, tokens long"), "d").first()
    assert (none.n_docs, none.n_chunks, none.mean_tokens) == (0, 0, None)
    assert evaluate.distinctness(df, "p").first().all_distinct is False
