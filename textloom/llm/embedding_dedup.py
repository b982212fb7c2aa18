"""Embedding near-duplicates: sign hashing in several tables, exact cosine, connected components.

Each table hashes a vector to the signs of its products with random hyperplanes. Vectors that share a bucket in any
table and whose sketches (``SKETCH`` more signs) differ in few enough bits are candidates; a pair at the threshold
passes but for five standard deviations. Buckets hold ids and sketches only. Candidates that reach each other form a
group, and of a group the pairs that share a bucket are compared by cosine in double precision, so no link below the
threshold is made. A pair at cosine 0.9 shares a bucket with probability 0.98 (44 tables of 16 signs), a
closer pair with a higher one; that probability depends on the tables and signs and not on the number of vectors. A
bucket holds about one vector in 2 ** ``signs``: far more than 100 million vectors want more signs in more tables.

Equal vectors are one point with a weight. Full buckets and groups are dealt out in blocks, each pair of blocks a task
of its own, so no task gathers a whole one; a task gives each point's number of links and one edge to the smallest
point of its local component, never the pairs. A vector goes once to its group; where a group has over ``WHOLE`` points,
which chains of candidates may hold together, it goes to its buckets instead, and a pair that shares several counts in
the first. Either way the same pairs are links.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows without an id link with nothing:
0 links, their own id as component. Vectors of different lengths never link. Rows with one id are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import add_columns, cut, looked_up
from textloom.llm.components import connected_components

TABLES, SIGNS, BLOCK, SEED = 44, 16, 1024, 20240229
SKETCH, WHOLE = 128, 8192
#: Sketches that a block holds for each vector of one, and the share of points that full buckets are told by.
SMALLER, SAMPLED = 4, 64


def planes(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((n, dim))


def add_signatures(df: DataFrame, vec: str, tables: int, signs: int, seed: int, out: tuple[str, str] = ("sigs", "sketch")) -> DataFrame:
    """``df`` with each vector's bucket in every table, and its sketch."""
    powers = 1 << np.arange(signs)

    def make():
        known: dict[int, np.ndarray] = {}

        def step(vectors: pd.Series) -> pd.DataFrame:
            found: list = [None] * len(vectors)
            dims = np.array([len(v) for v in vectors])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in known:
                    known[d] = planes(int(d), tables * signs + SKETCH, seed)
                x = np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in at])
                bits = x @ known[d].T > 0
                codes = (bits[:, SKETCH:].reshape(len(at), tables, signs) * powers).sum(axis=2)
                sketches = np.packbits(bits[:, :SKETCH], axis=1).view(np.int64)
                for i, c, s in zip(at, codes, sketches, strict=True):
                    found[i] = (c.astype(np.int32), s)
            return pd.DataFrame(found, columns=list(out))

        return step

    return add_columns(df, [vec], [(out[0], "array<int>"), (out[1], "array<bigint>")], make)


def differing(threshold: float) -> int:
    """Bits in which the sketches of two vectors at ``threshold`` differ at the most, five standard deviations allowed."""
    p = np.arccos(threshold) / np.pi
    return int(SKETCH * p + 5 * np.sqrt(SKETCH * p * (1 - p)))


def join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make the places ``a`` and ``b`` share their least root, in ``root``."""
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while ((up := root[root]) != root).any():
            root[:] = up


def alike(task: np.ndarray, sketches: np.ndarray, most: int) -> np.ndarray:
    """Each row's least row that rows with the same ``task``, which stand together, and like sketches reach from it."""
    sketches = np.ascontiguousarray(sketches).view(np.uint64)  # bits of a negative number are not counted as they are
    root, step = np.arange(len(task)), 1
    at = np.flatnonzero(task[1:] == task[:-1])
    while len(at):
        near = at[np.bitwise_count(sketches[at] ^ sketches[at + step]).sum(axis=1) <= most]
        join_up(root, near, near + step)
        step += 1
        at = at[at < len(task) - step]
        at = at[task[at] == task[at + step]]
    return root


def block_links(x: np.ndarray, weights: np.ndarray, nodes: np.ndarray, sigs: np.ndarray, side: np.ndarray | None, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each point to points of the other ``side`` (None: there is but one), and its local component's node.

    Points link that share a bucket. With a ``table`` from 0 on they share that one's, and links that share one before are not counted.
    """
    lengths = np.sqrt((x * x).sum(axis=1))
    close = (x @ x.T) / np.outer(lengths, lengths) >= threshold
    np.fill_diagonal(close, False)
    if side is not None:
        close &= side[:, None] != side[None, :]
    i, j = np.nonzero(close)
    # Places of pairs for which no shared bucket has been found yet.
    left = np.arange(len(i))
    for t in range(table if table >= 0 else sigs.shape[1]):
        left = left[sigs[i[left], t] != sigs[j[left], t]]
        if not len(left):
            break
    new = np.zeros(len(i), dtype=bool)
    new[left] = True
    if table < 0:
        i, j = i[~new], j[~new]
        new = np.ones(len(i), dtype=bool)
    links = np.bincount(i[new], weights=weights[j[new]], minlength=len(x)).astype(np.int64)
    root = nodes.copy()
    while len(i):
        lower = root.copy()
        np.minimum.at(lower, i, root[j])
        if (lower == root).all():
            break
        root = lower
    return links, root


def dealt(rows: DataFrame, group: str, blocks: str = "blocks") -> DataFrame:
    """``rows`` with ``task``, ``own`` and ``within``, a row for each task: every pair of a group's ``blocks``, and every one alone."""
    own = F.pmod(F.xxhash64("node"), F.coalesce(blocks, F.lit(1))).cast("int")
    each = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)).cast("int") - 1)))
    task = F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))
    return each.withColumn("task", task).withColumn("within", F.col("own") == F.col("other")).drop("other", blocks)


def candidates(signed: DataFrame, threshold: float, block: int) -> DataFrame:
    """``a``, ``b``: edges that join the points (``node``, ``bucket``, ``sketch``) that share a bucket and have like sketches."""
    counted = signed.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SAMPLED)) == 0).groupBy("bucket").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") * SAMPLED / (block * SMALLER)).cast("int")
    full = counted.select("bucket", blocks.alias("blocks")).filter("blocks > 1")
    tasks = dealt(looked_up(signed, cut(full), ["bucket"], "left"), "bucket").select("task", "node", F.col("sketch")[0].alias("s0"), F.col("sketch")[1].alias("s1"))
    most = differing(threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, 4), dtype=np.int64)

        def edges(rows: np.ndarray) -> pd.DataFrame:
            root = alike(rows[:, 0], rows[:, 2:], most)
            at = np.flatnonzero(root != np.arange(len(rows)))
            return pd.DataFrame({"a": rows[root[at], 1], "b": rows[at, 1]})

        for batch in batches:
            rows = np.concatenate([held, batch.to_numpy(dtype=np.int64)])
            if not len(rows):
                continue
            last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # where the last task begins
            held = rows[last:]
            yield edges(rows[:last])
        yield edges(held)

    return tasks.repartition("task").sortWithinPartitions("task").mapInPandas(run, "a long, b long")


def link(points: DataFrame, threshold: float, tables: int, signs: int, seed: int, block: int, whole: int = WHOLE) -> DataFrame:
    """``node``, ``links``, ``root`` from every task in which a point has a link. ``points``: node, weight, vec."""
    signed = cut(add_signatures(points.select("node", "vec", F.size("vec").alias("dim")), "vec", tables, signs, seed).drop("vec"))
    each = signed.select("node", "dim", "sketch", F.posexplode("sigs").alias("table", "sig"))
    each = each.select("node", "table", "sketch", F.xxhash64("table", "sig", "dim").alias("bucket"))
    reached = connected_components(candidates(each, threshold, block))
    sizes = cut(reached.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > block))
    placed = cut(looked_up(reached, sizes, ["root"], "left"))
    blocks = F.ceil(F.col("n") / block).cast("int").alias("blocks")
    small = placed.filter(F.coalesce("n", F.lit(0)) <= whole).select("node", F.xxhash64(F.lit(0), "root").alias("grp"), F.lit(-1).alias("table"), blocks)
    wide = each.join(placed.filter(F.col("n") > whole).select("node", "root"), "node").select("node", F.xxhash64("bucket", "root").alias("grp"), "table")
    counts = wide.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("grp", blocks)
    tasks = dealt(small.unionByName(looked_up(wide, cut(counts), ["grp"], "left").select(small.columns)), "grp")
    held = points.join(signed.select("node", "sigs"), "node").select("node", "weight", "vec", "sigs")
    paired = tasks.join(held, "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in grouped(batches, "task"):
            if len(group) < 2:
                continue
            side = None if group["within"].iloc[0] else group["own"].to_numpy()
            nodes, table = group["node"].to_numpy(), int(group["table"].iloc[0])
            x = np.stack([np.asarray(v, dtype=np.float64) for v in group["vec"]])
            links, root = block_links(x, group["weight"].to_numpy(), nodes, np.stack(group["sigs"].to_list()), side, table, threshold)
            out = pd.DataFrame({"node": nodes, "links": links, "root": root})
            yield out[(links > 0) | (root != nodes)]

    return paired.repartition("task").sortWithinPartitions("task", "node").mapInPandas(run, "node long, links long, root long")


def grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The runs of equal ``key`` in sorted batches; a run may go over several batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        at = batch[key].to_numpy()
        starts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(starts, starts[1:], strict=False):
            part = batch.iloc[a:b]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", threshold: float = 0.9, tables: int = TABLES, signs: int = SIGNS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id that links reach), ``kept`` (id is that)."""
    v = F.col(f"`{vec}`")
    rows = vectors.select(F.col(f"`{vec_id}`").alias("id"), v.alias("vec"))
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    sound = F.col("id").isNotNull() & F.col("vec").isNotNull() & F.coalesce(~F.exists("vec", bad) & F.exists("vec", lambda c: c != 0), F.lit(False))
    marked = rows.withColumn("sound", sound)
    weighed = marked.filter("sound").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
    # Numbers of a checkpointed table stay what they are.
    points = cut(weighed.withColumn("node", F.monotonically_increasing_id()))
    found = cut(link(points, threshold, tables, signs, seed, block))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    twins = marked.filter("sound").groupBy("id").agg(F.min("vec").alias("lo"), F.max("vec").alias("hi")).filter("lo <> hi").select("id")
    held = marked.filter("sound").join(twins, "id", "left_semi").select("id", "vec").distinct().join(points.select("vec", "node"), "vec").select("id", "node")
    same_id = held.join(held.groupBy("id").agg(F.min("node").alias("a")), "id").select("a", F.col("node").alias("b"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).union(same_id))
    # Vectors stay where they are; components go by numbers and ids.
    placed = cut(roots.join(points.select("node", "id"), "node"))
    least = cut(placed.groupBy("root").agg(F.min("id").alias("least")))
    component = looked_up(placed.select("node", "root"), least, ["root"]).select("node", "least")
    numbers = links.join(component, "node", "full")
    named = points.join(numbers, "node", "left").select(
        F.col("vec").alias("point"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("least", "id").alias("least"))
    out = marked.join(cut(named), F.col("sound") & (F.col("vec") == F.col("point")), "left")
    component = F.coalesce(F.col("least"), F.col("id"))
    return out.select(
        F.col("id").alias(vec_id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
