"""Conversation prefix trie: LOUDS bitvectors and label arrays by prefix shard, rolled up level by level.

Every conversation takes the first turns of its base conversation (its id less the id modulo ``family``) and then its
own; how many is told by its id alone. A node is a distinct sequence of the first d turns (role, text) so rebuilt, the
root the empty one; conversations that begin with it are its members.

1. Turns become small rows: a 128-bit digest of (role, text) and a number of words. They are numbered and rebuilt over
   range partitions, so a conversation of any length is spread out. A node's key is two 64-bit sums over the digests
   of its turns mixed with their places, so equal sequences, and but for a chance of about 2^-128 no others, have equal keys.
2. Spark counts members by key; a frequent prefix is combined before the shuffle, and copies of a conversation are the
   same nodes.
3. A node with more than ``limit`` members is heavy; there are at most (turns / limit) of these, and ``limit`` is at least the
   root of the number of turns, so they are few at any size and are broadcast. A node with one member has nothing to roll
   up, so of those only the topmost of each conversation goes on. The rest are dealt out by their topmost light
   prefix. A task takes whole prefix shards, numbers their nodes level by level, writes the children of each node in
   unary (LOUDS), reads the parents back from the bits, and adds up from the last level with ``np.add.at``.
4. The heavy levels get what the shards under them add up to and are rolled up the same way.
5. The ids that end at a node are joined in runs where they are sorted, and hashed run by run.

Nulls in role or text are empty strings, a null turn comes first; turns with the same number go by the SHA-256 of
(role, text), and repeated rows are turns of their own. Rows without a conversation id are left out. A conversation that is rebuilt
without turns is a member of the root alone. An empty table gives no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut
from textloom.llm.running import running_sums, spread

FAMILY, SHARED = 20, 4
#: Members from which a node is heavy, at the least; nodes that a task takes at once; ids that are joined to a run.
LIMIT, NODES, RUN = 256, 1 << 17, 4096
#: Fixed value: what a word is made of.
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["k1", "k2"]
NODE = "shard long, k1 long, k2 long, q1 long, q2 long, depth long, conv_id long, n_convs long, ends long, gain long"
ROLLED = "k1 long, k2 long, q1 long, q2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def labelled(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``label`` (16 bytes of the SHA-256 of role and text), ``words`` of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)).cast("long")
    of = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("label"), words.alias("words"))
    return of.filter("conv_id IS NOT NULL")


def base(conv: str = "conv_id") -> Column:
    return F.col(conv) - F.col(conv) % FAMILY


def borrowed(conv: str = "conv_id") -> Column:
    """How many turns of its base a conversation begins with, at the most."""
    return F.crc32(F.col(conv).cast("string").cast("binary")) % SHARED


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id``, ``late``, ``place``, ``label``, ``words`` of every rebuilt turn, and ``conv_id`` of every conversation."""
    one = spread(labelled(turns).withColumn("one", F.lit(1).cast("long")), "conv_id", "turn", "label")
    placed = cut(running_sums(one, "conv_id", {"one": "n"}).select("conv_id", (F.col("n") - 1).alias("place"), "label", "words"))
    convs = placed.filter("place = 0").select("conv_id")
    taken = convs.select("conv_id", base().alias("base"), borrowed().alias("h")).filter("conv_id <> base AND h > 0")
    # A base has at most 2 * FAMILY - 1 conversations, and gives at most SHARED - 1 turns.
    given = placed.filter((F.col("conv_id") % FAMILY == 0) & (F.col("place") < SHARED - 1)).withColumnRenamed("conv_id", "base")
    early = taken.join(given, "base").filter("place < h").select("conv_id", F.lit(0).alias("late"), "place", "label", "words")
    own = placed.filter((F.col("place") >= borrowed()) | (F.col("conv_id") == base())).select("conv_id", F.lit(1).alias("late"), "place", "label", "words")
    return early.unionByName(own), convs


def prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for every prefix of every rebuilt conversation: its key ``k1``, ``k2``, its parent's, ``depth``, ``words``, ``last``."""
    rows, convs = rebuilt(turns)
    one = spread(rows.withColumn("one", F.lit(1).cast("long")), "conv_id", "late", "place")
    deep = running_sums(one, "conv_id", {"one": "depth"})
    # The second number is that of the prefix before: sums wrap around, so it is found without a subtraction.
    mixed = [F.xxhash64("label", "depth").alias("m1"), F.xxhash64("depth", F.lit(17), "label").alias("m2")]
    mixed = deep.select("part", "conv_id", "depth", "words", *mixed)
    summed = running_sums(mixed, "conv_id", {"m1": "k1", "m2": "k2"}, last="last")

    def parents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(q1=b["k1"].to_numpy() - b["m1"].to_numpy(), q2=b["k2"].to_numpy() - b["m2"].to_numpy())[["conv_id", "depth", "words", "k1", "k2", "q1", "q2", "last"]]

    return cut(summed.mapInPandas(parents, "conv_id long, depth long, words long, k1 long, k2 long, q1 long, q2 long, last boolean")), convs


def louds(degrees: np.ndarray, roots: int) -> np.ndarray:
    """The bits of a forest in level order: a 1 for each root and a 0, then for each node a 1 for each child and a 0."""
    counts = np.concatenate([[roots], degrees])
    bits = np.ones(int(counts.sum()) + len(counts), dtype=bool)
    bits[np.cumsum(counts + 1) - 1] = False
    return bits


def parents_of(bits: np.ndarray) -> np.ndarray:
    """Each node's parent, -1 for a root: the number of zeros before its one, less one."""
    return np.cumsum(~bits)[bits] - 1


def level_order(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of ``nodes`` in level order, the LOUDS bits, and where levels begin: children stand together in their parents' order."""
    depth = nodes["depth"].to_numpy()
    keys = nodes[["k1", "k2"]].assign(at=np.arange(len(nodes)))
    parent = nodes[["q1", "q2"]].merge(keys, left_on=["q1", "q2"], right_on=["k1", "k2"], how="left")["at"].fillna(-1).to_numpy(dtype=np.int64)
    # A parent is one less deep, so it has its level before its children ask for it.
    level = np.zeros(len(depth), dtype=np.int64)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for some in np.split(by_depth, cuts):
        level[some] = np.where(parent[some] >= 0, level[parent[some]] + 1, 0)
    place = np.full(len(depth), -1, dtype=np.int64)
    order, begins, n = [], [], 0
    by_level = np.argsort(level, kind="stable")
    for some in np.split(by_level, np.flatnonzero(np.diff(level[by_level])) + 1):
        above = np.where(parent[some] >= 0, place[parent[some]], -1)
        some = some[np.lexsort((nodes["k2"].to_numpy()[some], nodes["k1"].to_numpy()[some], above))]
        place[some] = n + np.arange(len(some))
        begins.append(n)
        order.append(some)
        n += len(some)
    order = np.concatenate(order)
    degrees = np.bincount(place[parent[parent >= 0]], minlength=len(depth))
    return order, louds(degrees, int((parent < 0).sum())), np.array([*begins, n])


def rolled_up(nodes: pd.DataFrame) -> pd.DataFrame:
    """``nodes`` of whole tries with ``parent_conv_id``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``top``.

    ``gain`` is what a node itself saves; ``below`` columns, where there are any, are what is under it but not here.
    """
    order, bits, begins = level_order(nodes)
    nodes = nodes.iloc[order].reset_index(drop=True)
    parent = parents_of(bits)
    zero = np.zeros(len(nodes), dtype=np.int64)
    children = np.bincount(parent[parent >= 0], minlength=len(nodes)) + nodes.get("children", zero)
    saved = nodes["gain"].to_numpy() + nodes.get("saved", zero).__array__()
    leaves = np.where(children == 0, 1, 0) + nodes.get("leaves", zero).__array__()
    for a, b in zip(begins[-2:0:-1], begins[:1:-1], strict=True):  # all levels but the first, the last one first
        np.add.at(saved, parent[a:b], saved[a:b])
        np.add.at(leaves, parent[a:b], leaves[a:b])
    conv = nodes["conv_id"].to_numpy()
    above = pd.array(np.where(parent >= 0, conv[parent], 0), dtype="Int64")
    above[parent < 0] = pd.NA
    out = nodes[["k1", "k2", "q1", "q2", "depth", "conv_id"]].assign(parent_conv_id=above, n_convs=nodes["n_convs"], n_children=np.asarray(children, dtype=np.int64))
    return out.assign(n_leaves=leaves, saved_tokens=saved, top=parent < 0)


def roll_up_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole shards of sorted rows, many small ones at once."""
    held: list[pd.DataFrame] = []
    size = 0
    for b in batches:
        if not len(b):
            continue
        held, size = [*held, b], size + len(b)
        if size < NODES:
            continue
        rows = pd.concat(held, ignore_index=True)
        stop = int(np.searchsorted(rows["shard"].to_numpy(), rows["shard"].iloc[-1]))
        if stop:
            yield rolled_up(rows.iloc[:stop])
        held, size = [rows.iloc[stop:]], len(rows) - stop
    if size:
        yield rolled_up(pd.concat(held, ignore_index=True))


def ended(rows: DataFrame) -> DataFrame:
    """``k1``, ``k2``, ``ends_sha256`` of the ids of ``rows`` (``k1``, ``k2``, ``conv_id``), each id once, ascending."""

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            new = (b["k1"].to_numpy()[1:] != b["k1"].to_numpy()[:-1]) | (b["k2"].to_numpy()[1:] != b["k2"].to_numpy()[:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(b)]])
            out = []
            for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                for i in range(a, z, RUN):
                    some = b["conv_id"].to_numpy()[i : min(z, i + RUN)]
                    out.append((b["k1"].iat[a], b["k2"].iat[a], some[0], ",".join(map(str, some.tolist()))))
            yield pd.DataFrame(out, columns=["k1", "k2", "least", "ids"])

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for b in batches:
            out = []
            for k1, k2, ids in zip(b["k1"].tolist(), b["k2"].tolist(), b["ids"], strict=True):
                if (k1, k2) != at:
                    if at is not None:
                        out.append((*at, digest.hexdigest()))
                    at, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])

    pieces = rows.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInPandas(runs, "k1 long, k2 long, least long, ids string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "least").mapInPandas(hashed, "k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per node: ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``limit`` is the least number of members from which a node is heavy; only the work's layout depends on it.
    """
    rows, convs = prefixes(turns)
    ends = F.count_if("last").alias("ends")
    found = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("words").alias("words"), ends)
    nodes = cut(found.withColumn("gain", (F.col("n_convs") - 1) * F.col("words")).drop("words"))
    spark = turns.sparkSession
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    if total.n == 0:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    # All heavy nodes have more members than the root of all turns, so there are fewer than that.
    most = max(limit, isqrt(rows.count()))
    heavy = cut(nodes.filter(F.col("n_convs") > most))
    keys = F.broadcast(heavy.select(*KEY))
    light = nodes.filter(F.col("n_convs") <= most)
    shards = rows.join(keys, KEY, "left_anti").groupBy("conv_id").agg(F.min_by(F.struct(*KEY), "depth").alias("s")).select("conv_id", F.xxhash64("s.k1", "s.k2").alias("shard"))
    shared, alone = light.filter("n_convs > 1"), light.filter("n_convs = 1")
    every = F.struct(*[F.col(c) for c in nodes.columns])
    tops = cut(alone.groupBy("conv_id").agg(F.min_by(every, "depth").alias("t")).select("t.*"))
    dealt = shared.unionByName(tops).join(shards, "conv_id")
    columns = [c.split(" ")[0] for c in NODE.split(", ")]
    # The private top of a conversation has no more children here; what is under it is told by its ends.
    rolled = dealt.select(*columns).repartition("shard").sortWithinPartitions("shard").mapInPandas(roll_up_shards, ROLLED)
    under = heavy.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("above"))
    root = (total.least, total.n)
    placed = cut(rolled.join(F.broadcast(under), ["q1", "q2"], "left"))

    sums = placed.filter("top").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("children"), F.sum("saved_tokens").alias("saved"), F.sum("n_leaves").alias("leaves"))
    rows_of_root = spark.createDataFrame([(0, 0, -1, -1, 0, root[0], root[1], 0, 0)], "k1 long, k2 long, q1 long, q2 long, depth long, conv_id long, n_convs long, ends long, gain long")
    # Fewer rows than the root of the number of turns.
    upper = heavy.select(rows_of_root.columns).unionByName(rows_of_root).join(sums, KEY, "left").fillna(0, ["children", "saved", "leaves"])
    upper = upper.withColumn("shard", F.lit(0).cast("long")).repartition("shard").mapInPandas(roll_up_heavy, ROLLED)

    private = F.col("n_convs") == 1
    lower = placed.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above", F.lit(root[0])))
    inner = alone.join(tops.select(*KEY), KEY, "left_anti").select(
        *KEY, "depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", (1 - F.col("ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
    out = lower.select(inner.columns).unionByName(upper.select(inner.columns))
    # A private top has a child unless its conversation ends there.
    out = out.join(tops.select(*KEY, (1 - F.col("ends")).alias("deeper")), KEY, "left").withColumn("n_children", F.when(private, F.coalesce("deeper", "n_children")).otherwise(F.col("n_children"))).drop("deeper")
    empty = convs.join(rows.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    digests = ended(rows.filter("last").select(*KEY, "conv_id").unionByName(empty))
    whole = out.unionByName(inner).join(digests, KEY, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def roll_up_heavy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = [b for b in batches if len(b)]
    if rows:
        yield rolled_up(pd.concat(rows, ignore_index=True))


_STEP = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda d: [ascii(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, x: {_STEP}))"
#: DuckDB SQL for ``trie`` over ``conversations``.
TRIE_SQL = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, length(role) || ':' || role || text AS label, len(regexp_extract_all(text, '{WORD}')) AS words,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) - 1 AS i FROM t),
c AS (SELECT DISTINCT conv_id FROM o),
b AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {_CRC} % {SHARED} AS h FROM c),
r AS (SELECT b.conv_id, 0 AS late, o.i, label, words FROM b JOIN o ON o.conv_id = b.base WHERE o.i < h UNION ALL SELECT b.conv_id, 1, o.i, label, words FROM b JOIN o ON o.conv_id = b.conv_id WHERE o.i >= h),
p AS (SELECT conv_id, row_number() OVER w AS depth, list(label) OVER w AS path, words, count(*) OVER (PARTITION BY conv_id) AS size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY late, i)
  UNION ALL SELECT conv_id, 0, [], 0, (SELECT count(*) FROM r WHERE r.conv_id = c.conv_id) FROM c),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth) AS ids FROM p GROUP BY depth, path),
u AS (SELECT n.*, m.conv_id AS parent_conv_id FROM n LEFT JOIN n m ON m.depth = n.depth - 1 AND m.path = n.path[:n.depth - 1]),
k AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
f AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN k USING (conv_id, depth)),
s AS (SELECT a.depth, a.path, sum((f.n_convs - 1) * f.words) AS saved_tokens, count(*) FILTER (f.n_children = 0) AS n_leaves FROM f JOIN p a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY a.depth, a.path)
SELECT conv_id::BIGINT AS conv_id, depth::BIGINT AS depth, parent_conv_id::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM f JOIN s USING (depth, path)
"""
