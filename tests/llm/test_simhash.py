import random

import xxhash
from pyspark.sql import functions as F

from textloom.llm import common, components, jaccard
from textloom.llm import simhash as S
from textloom.llm.components import connected_components


def brute_print(text, k):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints, d=4):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ps = sorted(root)
    for i, a in enumerate(ps):
        for b in ps[i + 1 :]:
            if (a ^ b).bit_count() <= d:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in ps}


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100)] + [(1000, i) for i in range(200, 400)] + [(7, 7), (None, 3), (5, 4)]
    ids = list(range(2000, 2100))
    rng.shuffle(ids)
    edges += list(zip(ids, ids[1:], strict=False))
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == 200 for i in [*range(200, 400), 1000])
    assert all(got[i] == 2000 for i in ids) and len(got) == 101 + 201 + 100


def test_leaves_are_no_lookup_table(spark, monkeypatch):
    """What is broadcast to follow pointers are nodes on the way to a root, not the members of stars."""
    sizes = []

    def recorded(rows, table, *args, **kwargs):
        sizes.append(table.count())
        return common.looked_up(rows, table, *args, **kwargs)

    monkeypatch.setattr(components, "looked_up", recorded)
    # A chain of hubs 0 to 29, each with 40 leaves.
    edges = [(i, i + 1) for i in range(29)] + [(i, 1000 * (i + 1) + j) for i in range(30) for j in range(40)]
    for few in (common.FEW, 10):
        monkeypatch.setattr(common, "FEW", few)
        got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.root for r in got} == {0} and len(got) == len({r.node for r in got}) == 30 + 1200
    assert sizes and max(sizes) <= 30


def test_estimated_sizes_stay_small(spark):
    """Rounds of joins don't multiply the driver's size estimate, a whole number of any length."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    for _ in range(2):
        found = connected_components(edges)
        edges = found.select(F.col("root").alias("a"), F.col("node").alias("b"))
        assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 1000
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in range(301)}


def test_fingerprints_of_texts(spark):
    texts = ["", None, " \t\n", "One", "one two three", "a b c d e f A B c d", "é ü x  y\nz w", "x " * 70000]
    df = spark.createDataFrame([(t, "?") for t in texts], "text string, fingerprint string")
    got = {r.text: r.fingerprint & (2**64 - 1) for r in S.add_fingerprint(df).collect()}
    assert got == {t: brute_print(t, 4) for t in texts}


def test_every_link_is_found(spark):
    rng = random.Random(2)
    prints = [0]
    for _ in range(120):
        p = rng.getrandbits(64)
        prints.append(p)
        for _ in range(rng.randint(0, 8)):
            for b in rng.sample(range(64), rng.randint(0, 6)):
                p ^= 1 << b
            prints.append(p)
    hub = rng.getrandbits(64)
    prints += [hub ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(300)]
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    got = {r.fp & (2**64 - 1): r.root & (2**64 - 1) for r in S.fingerprint_components(spark.createDataFrame(signed, "fp long"), "fp").collect()}
    want = brute_components(set(prints))
    classes = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    full = {p: got.get(p, p) for p in want}
    assert classes(full) == classes(want)


def test_embedding_bounds_hamming(spark):
    rng = random.Random(4)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(300)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", S.manhattan(F.col("a"), F.col("b")).alias("m")).collect()
    for r in rows:
        count = lambda v: [(v >> 2 * i & 3).bit_count() for i in range(32)]
        assert r.m == sum(abs(x - y) for x, y in zip(count(r.a), count(r.b), strict=True)) <= (r.a ^ r.b).bit_count()


def test_documents_with_nulls_repeats_and_no_rows(spark):
    schema = "doc_id long, text string, fingerprint string, id string, fp string"
    data = [(5, "a b c d e", "", "", ""), (3, "A b c d e", "", "", ""), (3, "a b c d e", "", "", ""), (None, None, None, None, None), (9, "", "", "", ""), (8, "q r s t u v", "", "", "")]
    df = spark.createDataFrame(data, schema)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.components(df).collect()), key=str)
    a, q = (f"{brute_print(t, 4):016x}" for t in ("a b c d e", "q r s t u v"))
    assert got == sorted([(5, a, 3), (3, a, 3), (3, a, 3), (None, "0" * 16, 9), (9, "0" * 16, 9), (8, q, 8)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 8, 9]
    assert S.components(df.limit(0)).count() == 0 and jaccard.keep_one(df.limit(0)).count() == 0
