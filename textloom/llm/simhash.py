"""SimHash near-duplicates: segment-popcount embedding, grid range-join under Manhattan distance, exact verification.

A fingerprint's 64 bits form 32 segments of two; its embedding is the 32 bit counts (0, 1 or 2). The Manhattan distance
of two embeddings is at most the Hamming distance of the fingerprints, so it is a lower bound: fingerprints at Hamming
distance 4 or less are at Manhattan distance 4 or less, and then either the first 18 counts differ by 2 at the most or
the last 14 by 1 at the most. The grid is the unit grid of each of these two parts:

* first part: a fingerprint is put into its own cell and the adjoining ones, so two at distance 2 or less share a cell;
* second part: it is put into its own cell and onto the faces towards adjoining ones, so two at distance 1 share a face.

Counts are kept in unary (00, 01, 11), so a step on the grid is one bit and Manhattan distance is a bit count.

Equal texts have equal fingerprints and are one point throughout. A cell that a large group of near copies fills is
never expanded into pairs: all its points are compared with the smallest one, and links found so are contracted. Then
small cells are searched for links between different components; of a large cell, only the points outside the
component that has most of it are compared with points of other components, in blocks of ``BLOCK_CELL`` points, so no
task has a whole cell. Every pair that can link two components is examined, so the components are exact.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import add_columns, cut
from textloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
#: Shingles that are hashed and counted at once, so that a very long text takes no more memory.
BLOCK = 1 << 16
FIRST_BITS = 36
_LOW = 0x5555555555555555
_FIRST = (1 << FIRST_BITS) - 1
MAX_DISTANCE = 4
#: Points from which a cell is searched by its components; up to so many, each is compared with each.
LARGE_CELL, BLOCK_CELL = 64, 4096
#: Tasks over which the members of one component are spread where they look up its smallest id.
SALT = 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each of the 64 bits, from the lowest."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8", copy=False)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes as a signed 64-bit int: the bits that over half of them have."""
    value = int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def fingerprint(text: str | None, words: int = 4) -> int:
    """The fingerprint as a signed 64-bit int; 0 for a text without words (null too).

    A bit is 1 if it is set in over half of the hashes of the shingles of ``words`` words, repeats included; a text
    of fewer words is one shingle.
    """
    found = [] if text is None else WORD.findall(text.translate(_LOWER))
    if not found:
        return 0
    data = " ".join(found).encode("utf-8", "surrogatepass")
    spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(data)]))
    width = min(words, len(starts))
    starts, ends = starts[: len(starts) - width + 1], ends[width - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), BLOCK):
        span = zip(starts[at : at + BLOCK].tolist(), ends[at : at + BLOCK].tolist(), strict=True)
        counts += bit_counts(np.array([digest(data[i:j], 42) for i, j in span], dtype="<u8"))
    return majority(counts, len(starts))


def add_fingerprint(docs: DataFrame, text: str = "text", words: int = 4, out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a long column ``out``, which replaces one of that name."""

    def make() -> Callable[[pd.Series], pd.DataFrame]:
        return lambda texts: pd.DataFrame({out: np.array([fingerprint(t, words) for t in texts], dtype=np.int64)})

    return add_columns(docs, [text], [(out, "bigint")], make)


def unary(fp: Column) -> Column:
    """The embedding: each segment's count as 00, 01 or 11."""
    half = F.shiftrightunsigned(fp, 1)
    any_bit, both = fp.bitwiseOR(half).bitwiseAND(F.lit(_LOW)), fp.bitwiseAND(half).bitwiseAND(F.lit(_LOW))
    return any_bit.bitwiseOR(F.shiftleft(both, 1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of the embeddings of two fingerprints."""
    return hamming(unary(a), unary(b))


def cells(fp: Column) -> Column:
    """The grid keys (longs) of a fingerprint: cells of the first part, then cell and faces of the second."""
    u = unary(fp)
    first, second = u.bitwiseAND(F.lit(_FIRST)), F.shiftrightunsigned(u, FIRST_BITS)

    def on_grid(v: Column) -> Column:
        return F.shiftrightunsigned(v, 1).bitwiseAND(F.lit(_LOW)).bitwiseAND(F.bitwise_not(v)) == 0

    one = F.lit(1).cast("long")
    near = F.filter(F.transform(F.sequence(F.lit(0), F.lit(FIRST_BITS - 1)), lambda k: first.bitwiseXOR(F.call_function("shiftleft", one, k))), on_grid)
    bits = F.filter(F.sequence(F.lit(0), F.lit(63 - FIRST_BITS)), lambda k: on_grid(second.bitwiseXOR(F.call_function("shiftleft", one, k))))
    mark = F.lit(1 << 62)
    lower = lambda k: second.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", one, k)))
    faces = F.transform(bits, lambda k: F.shiftleft(lower(k), 6).bitwiseOR((k + 1).cast("long")).bitwiseOR(mark))
    return F.concat(F.array(first), near, F.array(F.shiftleft(second, 6).bitwiseOR(mark)), faces)


def fingerprint_components(prints: DataFrame, fp: str = "fingerprint", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``fp``, ``root`` for each distinct fingerprint that links to another: components at ``max_distance`` bits or fewer."""
    if not 0 <= max_distance <= MAX_DISTANCE:
        raise ValueError(f"the grid finds distances from 0 to {MAX_DISTANCE}")

    def linked(x: str, y: str) -> Column:
        return (manhattan(F.col(x), F.col(y)) <= max_distance) & (hamming(F.col(x), F.col(y)) <= max_distance)

    distinct = prints.select(F.col(fp).alias("fp")).distinct()
    dealt = distinct.select(F.explode(cells(F.col("fp"))).alias("cell"), "fp").repartition("cell")
    pivots = dealt.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = dealt.withColumnRenamed("fp", "b").join(pivots, "cell").filter((F.col("a") != F.col("b")) & linked("a", "b")).select("a", "b")
    near = connected_components(stars)

    rooted = cut(distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    placed = rooted.select(F.explode(cells(F.col("fp"))).alias("cell"), "fp", "root").repartition("cell")
    x, y = F.col("fp").alias("x"), F.col("fp").alias("y")
    a, b = F.col("root").alias("a"), F.col("root").alias("b")
    large = placed.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE_CELL).select("cell")
    small = placed.join(large, "cell", "left_anti")
    inside = small.select("cell", x, a).join(small.select("cell", y, b), "cell").filter((F.col("a") != F.col("b")) & (F.col("x") < F.col("y")) & linked("x", "y"))

    full = cut(placed.join(large, "cell"))
    counts = full.groupBy("cell", "root").agg(F.count("*").alias("n"))
    most = counts.groupBy("cell").agg(F.max(F.struct("n", "root")).alias("most"), F.count("*").alias("roots"), F.sum("n").alias("n")).filter("roots > 1")
    blocks = F.ceil(F.col("n") / BLOCK_CELL).cast("int").alias("blocks")
    mixed = cut(full.join(most.select("cell", F.col("most.root").alias("main"), blocks), "cell"))
    beside = mixed.filter("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    inner = mixed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # Two outside the main component meet once; one outside and one inside always.
    met = (F.col("a") != F.col("b")) & ((F.col("b") == F.col("main")) | (F.col("x") < F.col("y"))) & linked("x", "y")
    outside = beside.select("cell", "block", x, a).join(inner.select("cell", "block", y, b, "main"), ["cell", "block"]).filter(met)
    bridges = inside.select("a", "b").union(outside.select("a", "b")).distinct()
    far = connected_components(bridges)
    joined = near.join(far.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    lone = far.join(near.select("node"), "node", "left_anti").select("node", "root")
    return joined.unionByName(lone).select(F.col("node").alias(fp), "root")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id that links reach, for each row.

    Null ids are never the smallest; a component of rows without ids has a null one. Repeated ids are rows of their own.
    """
    prints = cut(add_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")), "text", words, "fp").drop("text"))
    linked = fingerprint_components(prints, "fp", max_distance)
    least = prints.groupBy("fp").agg(F.min("id").alias("least"))
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALT)).cast("int").alias("salt")
    members = cut(linked.join(least, "fp").select("fp", "root", "least", salt))
    # Only fingerprints that link to another are here; each looks its component up under one of SALT keys.
    roots = members.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALT)])))
    found = members.join(roots, ["root", "salt"]).select("fp", F.struct("component_id").alias("found"))
    component = F.when(F.col("found").isNotNull(), F.col("found.component_id")).otherwise(F.col("least"))
    named = cut(least.join(found, "fp", "left").select("fp", component.alias("component_id")))
    out = prints.join(named, "fp")
    return out.select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
