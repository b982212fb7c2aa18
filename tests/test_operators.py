import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import scorers
from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import chunk, evaluate, index, numbering, pairs, rank, retrieve, spans


def col(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


def test_vectors(spark):
    for v, want in (([3.0, 4.0], [0.6, 0.8]), ([0.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [1.0, 0.0]), ([], [])):
        assert col(spark, v, "array<float>", V.unit) == pytest.approx(want)
    assert col(spark, None, "array<float>", V.unit) is None
    assert col(spark, [0.0, 0.0], "array<float>", lambda c: V.cosine(c, F.array(F.lit(1.0), F.lit(0.0)))) == 0
    hidden = [[1.0, 1.0], [3.0, 3.0], [99.0, 99.0]]
    assert col(spark, hidden, "array<array<double>>", lambda c: V.masked_mean(c, F.array(F.lit(1), F.lit(1), F.lit(0)), 2)) == [2, 2]
    assert col(spark, hidden, "array<array<double>>", lambda c: V.masked_mean(c, F.array(*[F.lit(0)] * 3), 2)) == [0, 0]
    assert col(spark, hidden, "array<array<double>>", V.first_token) == [1, 1]


def test_text(spark):
    assert col(spark, "Anti-fraud my_var foo", "string", T.words) == ["Anti-fraud", "my_var", "foo"]
    assert col(spark, "Hello, world!", "string", T.words) == ["Hello", ",", "world", "!"]
    assert col(spark, "a b \n", "string", T.token_count) == 2 and col(spark, None, "string", T.token_count) == 0
    text = "Hello “quoted” world 😀 naïve"
    got = col(spark, text, "string", T.word_spans)
    assert [w.start for w in got if w.text == "world"] == [15] and all(text[w.start : w.end] == w.text for w in got)
    assert col(spark, None, "string", T.word_spans) is None
    assert col(spark, "One. Two!  \n three", "string", T.sentences) == ["One.", "Two!", "three"]
    assert col(spark, " \"Acme, Inc.\" ", "string", T.normalised) == "acme, inc"
    assert col(spark, 0.0, "double", T.sigmoid) == 0.5
    p = col(spark, [1.0, 2.0, 3.0], "array<double>", T.softmax)
    assert sum(p) == pytest.approx(1) and p == sorted(p)
    assert col(spark, [-50.0, 0.0, -50.0], "array<double>", T.softmax)[1] > 0.999
    assert col(spark, [-1.0, 2.0, 0.0, 2.0], "array<double>", T.first_argmax) == 1
    assert [col(spark, x, "string", T.bio_category) for x in ("O", "B-A", "I-B", "C")] == [None, "A", "B", "C"]


def test_batch_retrieval_is_that_of_each_query(spark):
    rng = np.random.default_rng(1)
    x = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((60, 8)))] + [(60, [0.0] * 8), (61, None)]
    df = spark.createDataFrame(x, "doc_id long, embedding array<float>").repartition(5)
    asked = df.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    got = {}
    for r in retrieve.top_k_batch(df, asked, k=4, block=2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.doc_id
    for q, found in got.items():
        one = df.filter(F.col("doc_id") == q).select(F.col("embedding").alias("q"))
        assert [r.doc_id for r in retrieve.top_k(df.filter("embedding IS NOT NULL"), one, 4).collect()] == [found[i] for i in range(4)]
    assert sorted(got) == [0, 20, 40, 60] and retrieve.top_k_batch(df, asked, k=0).count() == 0
    assert retrieve.top_k_batch(df.limit(0), asked.limit(0), k=3).count() == 0


def test_mmr_like_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(rng.random()), rng.standard_normal(4).tolist()) for g in ("a", "b") for i in range(12)]
    got = {}
    for r in rank.mmr(spark.createDataFrame(rows, "g string, id long, score double, embedding array<double>"), "g", "id", 5, 0.4).collect():
        got.setdefault(r.g, {})[r["rank"]] = r.id
    for g in ("a", "b"):
        mine = [r for r in rows if r[0] == g]
        unit = {r[1]: np.array(r[3]) / np.linalg.norm(r[3]) for r in mine}
        picks = []
        while len(picks) < 5:
            left = [r for r in mine if r[1] not in picks]
            value = lambda r: r[2] if not picks else 0.6 * r[2] - 0.4 * max(unit[r[1]] @ unit[p] for p in picks)  # noqa: B023, E731
            picks.append(max(left, key=lambda r: (value(r), -r[1]))[1])
        assert [got[g][i] for i in range(5)] == picks


def test_pack_rules(spark):
    units = [("d", 0, 5, None), ("d", 1, 5, 0.9), ("d", 2, 50, 0.9), ("d", 3, 1, 0.9), ("d", 4, 1, 0.1), ("d", 5, None, 0.5), ("e", 0, 1, None)]
    df = spark.createDataFrame(units, "p string, pos long, tokens long, sim double")
    got = [(r.p, r.chunk, r.unit_indices, r.tokens) for r in chunk.pack(df, "p", "pos", 10, 0.5).orderBy("p", "chunk").collect()]
    assert got == [("d", 0, [0, 1], 10), ("d", 1, [2], 50), ("d", 2, [3], 1), ("d", 3, [4, 5], 1), ("e", 0, [0], 1)]
    assert chunk.pack(df, "p", "pos", 10, 0.0).count() == 4 and chunk.pack(df.limit(0), "p", "pos").count() == 0
    with pytest.raises(ValueError):
        chunk.pack(df, "p", "pos", 0)


def test_group_concat(spark):
    units = [(0, "u", "s", "a"), (1, "u", None, "b"), (2, "v", "s", "c"), (3, "u", "s", None), (4, "v", None, "d")]
    got = index.group_concat(spark.createDataFrame(units, "row long, doc_uri string, k string, text string"), "k").orderBy("doc_id").collect()
    assert [(r.doc_id, r.group_uri, r.text) for r in got] == [(0, "u#s", "a\n"), (1, "u#ungrouped-0", "b"), (2, "v#s", "c"), (3, "v#ungrouped-1", "d")]


def test_numbering_and_cache(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    got = numbering.numbered(df.repartition(7), ["k", "id"]).orderBy("k", "id").collect()
    assert [r.n for r in got] == list(range(1000))
    texts = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("c",)], "text string")
    hits, misses = index.cache_split(texts, texts.filter("text = 'a'"))
    assert hits.count() == 2 and sorted(r.text for r in misses.collect()) == ["b", "c"]
    assert index.append(texts, texts.limit(0)).count() == 5


def walk(spark, found, **rules):
    rows = [(1, s, e, i, 0, p, x, sc, "t") for i, (s, e, p, x, sc) in enumerate(found)]
    df = spark.createDataFrame(rows, "doc long, start int, end int, word int, width int, label_pos int, label string, score double, text string")
    return [(x.start, x.end, x.label) for x in spans.greedy(df, "doc", **rules).first().entities]


def test_greedy(spark):
    assert walk(spark, [(0, 5, 0, "a", 0.9), (6, 11, 0, "a", 0.8)]) == [(0, 5, "a"), (6, 11, "a")]
    assert walk(spark, [(0, 6, 0, "a", 0.7), (0, 12, 0, "a", 0.95)]) == [(0, 12, "a")]
    assert walk(spark, [(0, 6, 0, "a", 0.7), (0, 6, 1, "b", 0.7)]) == [(0, 6, "a")]
    both = [(0, 6, 0, "a", 0.7), (2, 8, 1, "b", 0.6), (3, 9, 1, "b", 0.9)]
    assert walk(spark, both, flat=False, multi_label=True) == [(0, 6, "a"), (3, 9, "b")]
    assert len(walk(spark, both, flat=False, multi_label=True, dup_label=True)) == 3
    assert walk(spark, both, flat=False) == walk(spark, both)


def test_bio_like_a_state_machine(spark):
    rng = random.Random(3)
    rows, want = [], []
    for d in range(40):
        at = None
        for i in range(rng.randint(0, 14)):
            tag, p = rng.choice(["O", "B-A", "I-A", "B-B", "I-B", None]), rng.random()
            rows.append((d, i, tag, p))
            cat = None if tag in ("O", None) else tag[2:]
            if cat and tag[0] == "I" and at and at[0] == cat:
                at[2], at[3] = i, min(at[3], p)
            else:
                want += [(d, *at)] if at else []
                at = [cat, i, i, p] if cat else None
        want += [(d, *at)] if at else []
    df = spark.createDataFrame(rows, "d long, pos long, label string, prob double")
    got = [tuple(r[c] for c in ("d", "label", "first_pos", "last_pos", "score")) for r in spans.bio_spans(df, "d").collect()]
    assert sorted(got) == sorted(want)
    assert spans.bio_spans(df, "d", threshold=0.5).count() == sum(w[-1] >= 0.5 for w in want)


def test_span_enumeration(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "d long, text string")
    got = [(r.word, r.width, r.text) for r in spans.enumerate_spans(df, "d", 2).orderBy("word", "width").collect()]
    assert got == [(0, 0, "a"), (0, 1, "a b"), (1, 0, "b"), (1, 1, "b c"), (2, 0, "c")]
    with pytest.raises(ValueError):
        spans.enumerate_spans(df, "d", 0)


def test_pairs(spark):
    df = spark.createDataFrame([(0, "x", 0.0), (1, "y", 2.0), (2, "z", 2.0)], "pos long, text string, l double")
    got = pairs.rerank(df, F.col("l")).collect()
    assert [r.text for r in got] == ["y", "z", "x"] and got[2].rerank_score == 0.5 and pairs.rerank(df, F.col("l"), 0).count() == 0
    scored = pairs.nli(df, ["h1", "h2"], lambda t, h: F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0)))
    assert all(math.isclose(r.entailment + r.neutral + r.contradiction, 1) for r in scored.collect())
    assert {r.hypothesis for r in pairs.best_hypothesis(scored, "pos").collect()} == {"h1"}
    assert pairs.nli(df, [], lambda t, h: F.array(F.lit(0.0))).count() == 0


def test_order_statistics(spark):
    rng = random.Random(4)
    for n in (1, 5, 19, 20, 57):
        x = [rng.randint(0, 9) for _ in range(n)]
        r = evaluate.order_statistics(spark.createDataFrame([(v,) for v in [*x, None]], "x int"), "x").first()
        s = sorted(x)
        assert (r.n, r.max, r.p50, r.p95) == (n, max(x), s[n // 2], s[min(n - 1, int(0.95 * n))])
        assert r.mean == pytest.approx(statistics.mean(x)) and r.median == statistics.median(x)
        assert r.p95_exclusive == pytest.approx(statistics.quantiles(x, n=20)[-1] if n >= 20 else max(x))


def test_gold_and_registry(spark):
    gold = spark.createDataFrame([(1, "Acme Inc."), (2, "Bolt"), (3, " ")], "d long, gold string")
    pred = spark.createDataFrame([(1, "the acme inc"), (2, "Nut"), (3, "")], "d long, pred string")
    assert [r.d for r in evaluate.gold_hits(gold, pred, "d").collect()] == [1]
    assert sorted(r.d for r in evaluate.gold_missed(gold, pred, "d").collect()) == [2, 3]
    reg, out = spark.createDataFrame([("m",)], "model_id string"), spark.createDataFrame([("x", "old")], "model_id string, reason string")
    asked = spark.createDataFrame([("m",), ("x",), ("z",)], "model_id string")
    assert {r.model_id: r.status for r in evaluate.registry_gate(asked, reg, out).collect()} == {"m": "registered", "x": "excluded: old", "z": "unknown"}


def test_scorers(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b a a")], "d long, text string")
    got = {r.d: r for r in scorers.vocab_embed(df, ["d"]).collect()}
    assert got[1].embedding == pytest.approx(got[4].embedding) and got[1].n_tokens == 3 and sum(x * x for x in got[1].embedding) == pytest.approx(1)
    assert got[2].embedding == got[3].embedding == [0.0] * scorers.DIM

    class Fake:
        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, feeds):
            assert set(feeds) == {"input_ids", "attention_mask"}
            return [np.stack([feeds["input_ids"], feeds["input_ids"] * 2], axis=2)]

        def encode_batch(self, texts):
            one = lambda t: type("E", (), {"ids": [len(t), 3], "attention_mask": [1, 0], "type_ids": [0, 0]})
            return [one(t) for t in texts]

    for pooling in ("cls", "mean"):
        assert scorers.OnnxEmbedder(Fake(), Fake(), pooling).embed(["ab"]).tolist() == [[2.0, 4.0]]


def test_scorer_functions(spark):
    class Ones:
        def embed(self, texts):
            return np.array([[len(t), 0.0] for t in texts])

        def score_pairs(self, query, texts):
            return [float(len(t)) for t in texts]

    df = spark.createDataFrame([("ab",), (None,), ("",)], "text string")
    got = df.select("text", scorers.embed_udf(Ones)(F.col("text")).alias("v"), scorers.score_udf(Ones, "q")(F.col("text")).alias("s")).collect()
    assert {r.text: (r.v, r.s) for r in got} == {"ab": ([1.0, 0.0], 2.0), None: (None, 0.0), "": ([0.0, 0.0], 0.0)}
