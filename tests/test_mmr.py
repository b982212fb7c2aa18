import random

import numpy as np
import pytest

from textloom.operators import rank


def plain(rows, k, d):
    """The plain loop: every value anew for every pick."""
    out = []
    for g in {r[0] for r in rows}:
        left, picked = {r[1]: r for r in rows if r[0] == g}, []
        while left and len(picked) < k:
            def value(r):
                if not picked:
                    return r[2]
                return (1 - d) * r[2] - d * max(float(np.dot(r[3], p[3])) for p in picked)
            best = max(left.values(), key=lambda r: (round(value(r), 12), -r[1]))
            picked.append(left.pop(best[1]))
        out += [(g, p[1], i) for i, p in enumerate(picked)]
    return sorted(out)


@pytest.mark.parametrize("d", [0.0, 0.3, 0.7, 1.0])
@pytest.mark.parametrize(("candidates", "few"), [(256, 10**5), (3, 10**5), (1, 0)])
def test_same_picks_as_the_plain_loop(spark, monkeypatch, d, candidates, few):
    monkeypatch.setattr(rank, "FEW", few)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(160):
        v = rng.standard_normal(6) + (3 if i % 3 else 0)
        v = np.round(v / np.linalg.norm(v), 6)
        rows.append(("ab"[i % 2] if i > 3 else "tiny", i, round(float(rng.uniform(-1, 1)), 3), v / np.linalg.norm(v)))
    rows.append(("a", 500, *rows[8][2:]))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(g, i, s, v.tolist()) for g, i, s, v in rows], "g string, i long, score double, embedding array<double>").repartition(3)
    for k in (1, 6):
        got = sorted((r.g, r.i, r["rank"]) for r in rank.mmr(df, "g", "i", k, d, candidates=candidates).collect())
        assert got == plain(rows, k, d)


def test_few_passes_where_bounds_hold(spark, monkeypatch):
    """With all candidates of a group in the first pass there is no second one."""
    df = spark.createDataFrame([("a", i, i / 50, [1.0, i / 50]) for i in range(50)], "g string, i long, score double, embedding array<double>")
    passes, window = [], rank.Window.partitionBy
    monkeypatch.setattr(rank.Window, "partitionBy", lambda *c: passes.append(1) or window(*c))
    assert rank.mmr(df, "g", "i", 5, 0.5).count() == 5 and len(passes) == 1


def test_no_rows_no_picks_and_arguments(spark):
    df = spark.createDataFrame([("a", 1, 0.5, [1.0, 0.0]), ("a", 2, 0.4, None), ("b", 3, None, [0.0, 1.0])], "g string, i long, score double, embedding array<double>")
    assert sorted((r.g, r.i, r["rank"]) for r in rank.mmr(df, "g", "i", 3, 0.5).collect()) == [("a", 1, 0), ("a", 2, 1), ("b", 3, 0)]
    assert rank.mmr(df.limit(0), "g", "i", 3, 0.5).count() == rank.mmr(df, "g", "i", 0, 0.5).count() == 0
    with pytest.raises(ValueError):
        rank.mmr(df, "g", "i", 3, 1.5)
