import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import prefix_trie, running

SCHEMA = "conv_id long, turn int, role string, text string, shard string"


def sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR, shard VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?)", rows)
    return sorted(con.execute(prefix_trie.TRIE_SQL).fetchall(), key=str)


def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(-25, 160), 10_007, 10_009]:
        n = rng.choice([1, 1, 2, 3, 5, 9])
        hot = rng.random() < 0.4
        for t in range(n):
            text = "same start" if hot and t < 4 else rng.choice(["a", "b b", None, "", "c\nd"])
            out.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", None]) if not hot else "user", text, "x"))
    return out + [out[0], out[0], (None, 1, "user", "lost", "x")]


@pytest.mark.parametrize("limit", [1, 1000])
def test_same_rows_as_sql(spark, limit):
    given = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = sorted(map(tuple, prefix_trie.trie(given, limit).collect()), key=str)
    assert got == sql(rows()) and any(r[3] > 28 and r[1] > 1 for r in got)


def test_sha_and_crc_and_turnless(spark):
    # 10 007 borrows turns of a base that is not there and has fewer turns of its own.
    c = next(i for i in range(10_001, 10_020) if zlib.crc32(str(i).encode()) % 4 == 3)
    got = prefix_trie.trie(spark.createDataFrame([(c, 0, "user", "x", "")], SCHEMA)).collect()
    assert [tuple(r)[:7] for r in got] == [(c, 0, None, 1, 0, 1, 0)]
    assert got[0].ends_sha256 == __import__("hashlib").sha256(str(c).encode()).hexdigest()
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_many_copies_and_runs_of_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    given = [(c, t, "user", f"turn {t}", "") for c in range(0, 4000, 20) for t in range(3)]
    got = {r.depth: r for r in prefix_trie.trie(spark.createDataFrame(given, SCHEMA), 5).collect()}
    assert sorted(got) == [0, 1, 2, 3] and {r.n_convs for r in got.values()} == {200}
    ids = ",".join(map(str, range(0, 4000, 20)))
    assert got[3].ends_sha256 == __import__("hashlib").sha256(ids.encode()).hexdigest()
    assert got[1].saved_tokens == 3 * 2 * 199 and got[0].n_leaves == 1


def test_louds():
    bits = prefix_trie.louds(np.array([2, 1, 0, 0, 0]), 2)
    assert bits.astype(int).tolist() == [1, 1, 0, 1, 1, 0, 1, 0, 0, 0, 0]
    assert prefix_trie.parents_of(bits).tolist() == [-1, -1, 0, 0, 1]


def test_running_sums_over_partitions(spark):
    keys = [5] * 40 + [6] + [7] * 30 + [8, 9]
    df = spark.createDataFrame([(k, i, i * i - 50) for i, k in enumerate(keys)], "k long, i long, x long").repartition(4)
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = running.running_sums(running.spread(df, "k", "i"), "k", {"x": "s"}, last="last").orderBy("i").collect()
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        for r in got:
            assert r.s == sum(j * j - 50 for j in range(r.i + 1) if keys[j] == r.k)
            assert r["last"] == (r.i == max(j for j in range(len(keys)) if keys[j] == r.k))
    big = spark.createDataFrame([(1, i, (1 << 62)) for i in range(5)], "k long, i long, x long")
    sums = [r.s for r in running.running_sums(running.spread(big, "k", "i"), "k", {"x": "s"}).orderBy("i").collect()]
    assert sums == [((i + 1) * (1 << 62) + (1 << 63)) % (1 << 64) - (1 << 63) for i in range(5)]
    assert running.running_sums(running.spread(df.filter(F.col("k") < 0), "k", "i"), "k", {"x": "s"}).count() == 0
