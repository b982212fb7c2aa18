import numpy as np

from textloom.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, id string, links long"


def vectors():
    rng = np.random.default_rng(5)
    out = []
    for c in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            out.append(base + rng.standard_normal(16) * 0.02 * rng.integers(0, 6))
    hub = rng.standard_normal(16)
    out += [hub + rng.standard_normal(16) * 0.1 for _ in range(150)]
    out += [out[0]] * 30
    return np.array(out, dtype=np.float32)


def brute(x, t=0.9):
    x = x.astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    c = (x @ x.T) / np.outer(n, n) >= t
    np.fill_diagonal(c, False)
    root = np.arange(len(x))
    while True:
        new = np.array([min(root[i], root[c[i]].min(initial=len(x))) for i in range(len(x))])
        if (new == root).all():
            return c.sum(1), root
        root = new


def test_against_brute_force_in_any_block_size(spark, monkeypatch):
    x = vectors()
    df = spark.createDataFrame([(i, v.tolist(), "", None) for i, v in enumerate(x)], SCHEMA)
    links, root = brute(x)
    for block, whole, sampled in ((1024, E.WHOLE, E.SAMPLED), (16, E.WHOLE, 1), (16, 40, 1)):
        monkeypatch.setattr(E.link, "__defaults__", (whole,))
        monkeypatch.setattr(E, "SAMPLED", sampled)
        got = {r.vec_id: r for r in E.near_duplicates(df, tables=60, signs=6, block=block).collect()}
        assert [got[i].n_links for i in range(len(x))] == links.tolist()
        assert [got[i].component_id for i in range(len(x))] == root.tolist()
        assert all(got[i].kept == (root[i] == i) for i in range(len(x)))


def test_the_same_links_whatever_the_size_of_a_group(spark, monkeypatch):
    """At so few tables many close pairs share no bucket; the same ones count on both sides of the limit."""
    rng = np.random.default_rng(8)
    hub = rng.standard_normal(16)
    x = [hub + rng.standard_normal(16) * 0.09 for _ in range(300)]
    df = spark.createDataFrame([(i, v.tolist(), "", None) for i, v in enumerate(x)], SCHEMA)
    got = []
    for block, whole, few in ((1024, 8192, 10**6), (64, 8192, 10**6), (64, 50, 0)):
        monkeypatch.setattr(E.link, "__defaults__", (whole,))
        monkeypatch.setattr("textloom.llm.common.FEW", few)
        got.append(sorted(map(tuple, E.near_duplicates(df, tables=2, signs=12, block=block).collect())))
    assert got[0] == got[1] == got[2]
    every, found = int(brute(np.array(x))[0].sum()), sum(r[1] for r in got[0])
    assert 0.2 * every < found < 0.999 * every


def test_a_task_of_one_side_counts_nothing():
    x, one = np.ones((2, 3)), np.ones(2, dtype=np.int64)
    nodes, sigs = np.arange(2), np.zeros((2, 4), dtype=np.int32)
    assert E.block_links(x, one, nodes, sigs, np.zeros(2, dtype=np.int64), -1, 0.9)[0].tolist() == [0, 0]
    assert E.block_links(x, one, nodes, sigs, None, -1, 0.9)[0].tolist() == [1, 1]
    assert E.block_links(x, one, nodes, sigs, None, 1, 0.9)[0].tolist() == [0, 0]


def test_unsound_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame([(*d, "", None) for d in data], SCHEMA)).collect()}
    alone = {i: (0, i, True) for i in (1, 2, 3, 4, 5, 6, 9)}
    assert got == alone | {7: (1, 7, True), 8: (1, 7, False), None: (0, None, False)}


def test_repeated_ids_and_no_rows(spark):
    data = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])]
    df = spark.createDataFrame([(*d, "", None) for d in data], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_recall_of_borderline_pairs_at_the_production_parameters(spark):
    """Of 2000 planted pairs at cosine 0.90 to 0.92, links and kept rows equal brute force for all but the stated share."""
    rng = np.random.default_rng(11)
    rows, cosines = [], rng.uniform(0.9005, 0.92, 2000)
    for c in cosines:
        u, w = rng.standard_normal((2, 64))
        u /= np.linalg.norm(u)
        w -= (w @ u) * u
        rows += [u, c * u + np.sqrt(1 - c * c) * w / np.linalg.norm(w)]
    x = np.array(rows, dtype=np.float32)
    links, root = brute(x)
    assert links.tolist() == [1] * len(x) and (root == np.arange(len(x)) // 2 * 2).all()
    df = spark.createDataFrame([(i, v.tolist(), "", None) for i, v in enumerate(x)], SCHEMA)
    got = {r.vec_id: r for r in E.near_duplicates(df).collect()}
    found = [i for i in range(0, len(x), 2) if got[i].n_links == 1]
    print("recall", len(found) / 2000)
    for i in range(0, len(x), 2):
        hit = got[i].n_links == 1
        assert (got[i + 1].n_links, got[i + 1].component_id, got[i + 1].kept) == ((1, i, False) if hit else (0, i + 1, True))
    assert len(found) / 2000 >= 0.97


def test_groups_of_like_sketches():
    rng = np.random.default_rng(3)
    for _ in range(50):
        task = np.sort(rng.integers(0, 6, 40))
        sketches = rng.integers(-8, 8, (40, 2))
        near = (task[:, None] == task) & (np.bitwise_count((sketches[:, None] ^ sketches).view(np.uint64)).sum(axis=2) <= 1)
        root = np.arange(40)
        for _ in range(40):
            root = np.array([root[near[i]].min() for i in range(40)])
        assert E.alike(task, sketches, 1).tolist() == root.tolist()
