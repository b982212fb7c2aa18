import random

import pytest

from textloom.functions import automaton
from textloom.operators import contain, pairs


def test_automaton_against_plain_search(monkeypatch):
    rng = random.Random(2)
    for _ in range(300):
        stretch, head = rng.choice([(3, 4), (7, 3), (4096, 192), (1, 1)])
        monkeypatch.setattr(automaton, "STRETCH", stretch)
        monkeypatch.setattr(automaton, "HEAD", head)
        monkeypatch.setattr(automaton, "ONCE", rng.choice([1, 20, 1 << 23]))
        patterns = ["".join(rng.choices("abç", k=rng.randint(0, 6))).encode() for _ in range(rng.randint(0, 12))]
        texts = ["".join(rng.choices("abçd", k=rng.randint(0, 40))).encode() for _ in range(rng.randint(0, 6))]
        want = sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns) if p and p in t)
        assert automaton.Automaton(patterns).scan(texts) == want


def rows(rng, n, longest):
    return [None, "", *["".join(rng.choices("ab cß", k=rng.randint(0, longest))) for _ in range(n)], "x" * 5000 + "aß" + "y" * 5000]


@pytest.mark.parametrize("block", [1 << 20, 30])
def test_both_layouts_against_plain_pairs(spark, block):
    rng = random.Random(5)
    long, short = rows(rng, 60, 60), [*rows(rng, 30, 4)[:-1], "aß", "x" * 400 + "x"]
    for texts, strings in ((long, short), (short, long), (long, []), ([], short)):
        t, s = spark.createDataFrame([(x,) for x in texts], "text string"), spark.createDataFrame([(x,) for x in strings], "string string")
        got = sorted(map(tuple, contain.containing(t, s, block=block).collect()))
        assert got == sorted({(a, b) for a in texts for b in strings if a and b and b in a})


def test_first_match_and_either_way(spark):
    docs = spark.createDataFrame([(1, "The QUICK fox"), (2, "slow fox"), (3, None), (4, "none"), (5, "slow fox")], "d long, text string")
    rules = spark.createDataFrame([("fox", 2, "animal"), ("Quick", 1, "fast"), ("slow", 2, "pace"), ("", 0, "all")], "string string, priority int, value string")
    got = {r.d: r.value for r in contain.first_match(docs, "d", rules).collect()}
    assert got == {1: "fast", 2: "animal", 3: None, 4: None, 5: "animal"}
    gold = spark.createDataFrame([(1, "Acme Inc."), (2, "Bolt"), (3, " "), (4, '"the acme inc. of x"')], "i long, gold string")
    pred = spark.createDataFrame([("acme inc",), ("(Bolts)",), (None,), ("no",)], "pred string")
    found = contain.either_way(gold, pred)
    assert sorted(map(tuple, found.collect())) == [("acme inc", "acme inc"), ("bolt", "bolts"), ("the acme inc. of x", "acme inc")]
    assert {r.i: r.matched for r in contain.matched(gold, found, "gold", "g").collect()} == {1: True, 2: True, 3: False, 4: True}
    assert {r.pred: r.matched for r in contain.matched(pred, found, "pred", "p").collect()} == {"acme inc": True, "(Bolts)": True, None: False, "no": False}


@pytest.mark.parametrize("many", [1, 1024])
def test_rerank_each_query(spark, monkeypatch, many):
    monkeypatch.setattr(pairs, "QUERIES", many)

    class Lengths:
        def score_pairs(self, query, texts):
            return [float(-abs(len(query) - len(t))) for t in texts]

    docs = spark.createDataFrame([(i, "x" * (i % 7)) for i in range(40)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "xx"), (2, None), (3, "x" * 9)], "query_id long, query string")
    got = sorted(map(tuple, pairs.rerank_each(docs, asked, Lengths, 3).select("query_id", "rank", "doc_id").collect()))
    assert got == [(1, 0, 2), (1, 1, 9), (1, 2, 16), (2, 0, 0), (2, 1, 7), (2, 2, 14), (3, 0, 6), (3, 1, 13), (3, 2, 20)]
    assert pairs.rerank_each(docs, asked, Lengths, 0).count() == pairs.rerank_each(docs, asked.limit(0), Lengths, 3).count() == 0
