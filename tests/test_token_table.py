import math
import random
from collections import Counter

import numpy as np
import pytest

from textloom.operators import token_table as K


def texts():
    rng = random.Random(6)
    words = ["the", "The", "of", "ça", "İx", *[f"w{i}" for i in range(30)]]
    made = [" ".join(rng.choices(words, weights=[60, 9, 30, 5, 3, *[1] * 30], k=rng.randint(0, 25))) for _ in range(60)]
    return [*enumerate(made), (100, None), (101, ""), (102, "lone"), (103, "the " * 2000), (103, "the of")]


def plain(rows, least):
    words = [(t or "").lower().split() for _, t in rows]
    pairs = Counter((a, K.bucket_of(w[j])) for w in words for i, a in enumerate(w) for j in range(max(0, i - K.REACH), min(len(w), i + K.REACH + 1)) if i != j)
    counts, of_token, of_bucket = Counter(x for w in words for x in w), Counter(), Counter()
    for (t, b), n in pairs.items():
        of_token[t] += n
        of_bucket[b] += n
    vectors, signs = {t: np.zeros(K.DIM) for t, n in counts.items() if n >= least}, K.signs()
    for (t, b), n in pairs.items():
        if t in vectors:
            vectors[t] += max(0.0, math.log(n * sum(pairs.values()) / of_token[t] / of_bucket[b])) * signs[b]
    return {t: (counts[t], v / (np.linalg.norm(v) or 1) * K.SCALE) for t, v in vectors.items()}


@pytest.mark.parametrize("heavy", [1, 3, 1000])
def test_table_and_embeddings_against_plain_versions(spark, heavy):
    rows = texts()
    df = spark.createDataFrame(rows, "d long, text string").repartition(3)
    table = K.learn(df, least=4).cache()
    want = plain(rows, 4)
    got = {r.token: r for r in table.collect()}
    assert set(got) == set(want)
    for t, (n, v) in want.items():
        assert got[t].n == n and np.abs(np.array(got[t].vector) - v).max() <= 1
    found = sorted((r.d, r.n_tokens, r.n_unknown, [round(x, 9) for x in r.embedding]) for r in K.embed(df, table, ["d"], heavy=heavy).collect())
    each = []
    for d, t in rows:
        w = (t or "").lower().split()
        v = sum((np.array(got[x].vector, dtype=float) for x in w if x in got), np.zeros(K.DIM))
        each.append((d, len(w), sum(x not in got for x in w), [round(float(x), 9) for x in v / (np.linalg.norm(v) or 1)]))
    assert found == sorted(each)


def test_heavy_hitters_hold_every_frequent_token(spark):
    rng = random.Random(1)
    words = [f"r{rng.random()}" for _ in range(3000)] + ["hot"] * 900 + ["warm"] * 500
    rng.shuffle(words)
    df = spark.createDataFrame([(" ".join(words[i : i + 40]),) for i in range(0, len(words), 40)], "text string").repartition(5)
    for k in (10, 20, 5000):
        got = [r.token for r in K.heavy_hitters(df, k).collect()]
        assert len(got) < k and {"hot", "warm"} <= set(got)
    assert K.lowered(Counter(a=5, b=3, c=3, d=1), 2) == Counter(a=2)


def test_no_rows_and_arguments(spark):
    df = spark.createDataFrame([], "d long, text string")
    table = K.learn(df)
    assert table.count() == 0 and K.embed(df, table, ["d"]).count() == 0
    one = spark.createDataFrame([(1, "a b")], "d long, text string")
    assert [(r.n_tokens, r.n_unknown, set(r.embedding)) for r in K.embed(one, table, ["d"]).collect()] == [(2, 2, {0.0})]
    with pytest.raises(ValueError):
        K.learn(df, least=0)
