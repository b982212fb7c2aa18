"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are the runs of ASCII digits, ASCII letters (lower-cased) and characters from U+0080 on. A window is ``n``
consecutive words of an item; an item with fewer words, but not none, is one window. The distinct windows' 64-bit
hashes are a broadcast set; every window of a document is hashed and looked up, and a hit is verified word by word.

Only windows up to ``max_windows`` are broadcast at once. A larger benchmark is worked off in blocks of that many
windows: all documents against one block, the texts with hits (by SHA-256) kept in a checkpoint, the block's broadcast
released before the next one; at the end the hits of all blocks are merged by text. Driver and workers hold one block.

Null texts have no words. Items with a null id mark words but are not listed. Repeated ids count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import add_columns, cut, free_name

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows in one broadcast: about 1 KB each with their words, so 200 MB at the most.
MAX_WINDOWS = 200_000
_FIND = re.compile(WORD)
_LOWER = {i: i + 32 for i in range(65, 91)}
_FACTOR = 0x9E3779B97F4A7C15

FIELDS = [("n_words", "bigint"), ("n_hit", "bigint"), ("hit_items", "array<string>"), ("hit_words", "array<struct<start:int,end:int>>")]


def item_windows(benchmark: DataFrame, n: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The distinct windows of the items: ``words`` and the sorted ids of the ``items`` that have each."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = benchmark.select(F.col(item_id).cast("string").alias("item"), F.regexp_extract_all(lower, F.lit(f"({WORD})"), 1).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - n + 1))
    each = words.select("item", "w", F.explode(starts).alias("i")).select("item", F.slice("w", F.col("i"), F.lit(n)).alias("words"))
    return each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


class Windows:
    """A block of windows: words numbered by a vocabulary, windows by length, each with its hash."""

    def __init__(self, rows: list[tuple[list[str], list[str]]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items = [items for _, items in rows]
        by_length: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        for k, (words, _) in enumerate(rows):
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words)
            by_length.setdefault(len(ids), []).append((ids, k))
        self.by_length = {}
        for length, found in by_length.items():
            hashes = window_hashes(np.array([ids for ids, _ in found], dtype=np.uint64).ravel(), length)[::length]
            known: dict[int, list[tuple[tuple[int, ...], int]]] = {}
            for h, x in zip(hashes.tolist(), found, strict=True):
                known.setdefault(h, []).append(x)
            self.by_length[length] = (np.unique(hashes), known)

    def scan(self, text: str | None) -> tuple[int, np.ndarray, set[int]]:
        """Words of ``text``, a mask of those that are hit, and the windows that occur."""
        words = [] if text is None else _FIND.findall(text.translate(_LOWER) if not text.islower() else text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.uint64, count=len(words))
        hit, found = np.zeros(len(words) + 1, dtype=np.int64), set()
        for length, (hashes, known) in self.by_length.items():
            if len(words) < length:
                continue
            unknown = np.concatenate(([0], np.cumsum(ids == 0)))
            at = np.nonzero(unknown[length:] == unknown[:-length])[0]
            if not len(at):
                continue
            got = window_hashes(ids, length)[at]
            place = np.minimum(np.searchsorted(hashes, got), len(hashes) - 1)
            for i, h in zip(at[hashes[place] == got].tolist(), got[hashes[place] == got].tolist(), strict=True):
                mine = tuple(ids[i : i + length].tolist())
                for window, k in known[h]:
                    if window == mine:
                        found.add(k)
                        hit[i] += 1
                        hit[i + length] -= 1
        return len(words), np.cumsum(hit)[:-1] > 0, found


def window_hashes(ids: np.ndarray, length: int) -> np.ndarray:
    """The 64-bit polynomial hash of every run of ``length`` ids."""
    out = np.zeros(len(ids) - length + 1, dtype=np.uint64)
    for j in range(length):
        out = out * np.uint64(_FACTOR) + ids[j : len(ids) - length + 1 + j]
        out ^= out >> np.uint64(29)
    return out


def _runs(mask: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def _scanner(block: object) -> Callable[[], Callable[[pd.Series], pd.DataFrame]]:
    def make() -> Callable[[pd.Series], pd.DataFrame]:
        windows = Windows(block.value)

        def step(texts: pd.Series) -> pd.DataFrame:
            rows = []
            for text in texts:
                n, mask, found = windows.scan(text)
                items = sorted({i for k in found for i in windows.items[k]})
                rows.append((n, int(mask.sum()), items, _runs(mask)))
            return pd.DataFrame(rows, columns=[n for n, _ in FIELDS])

        return step

    return make


def blocks(windows: DataFrame, max_windows: int) -> Iterator[DataFrame]:
    """``windows`` in blocks of about ``max_windows``; one block if there are no more."""
    kept = cut(windows)
    parts = max(1, -(-kept.count() * 5 // (max_windows * 4)) if kept.count() > max_windows else 1)
    for i in range(parts):
        yield kept if parts == 1 else kept.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == i)


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10, item_id: str = "item_id", item_text: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_items`` (ids as sorted strings) and ``hit_words`` (runs of word numbers).

    Columns of ``docs`` with these names are replaced. A row is hit wherever a window of any item occurs.
    """
    if n < 1:
        raise ValueError("a window has one word at least")
    names, sc = [f for f, _ in FIELDS], docs.sparkSession.sparkContext
    parts = list(blocks(item_windows(benchmark, n, item_id, item_text), max_windows))
    if len(parts) == 1:
        return add_columns(docs, [text], FIELDS, _scanner(sc.broadcast(_rows(parts[0]))))
    digest = F.sha2(F.col(f"`{text}`"), 256)
    hits = []
    for block in parts:
        seen = sc.broadcast(_rows(block))
        found = add_columns(docs.select(F.col(f"`{text}`").alias("text")).filter("text IS NOT NULL"), ["text"], FIELDS, _scanner(seen)).filter("n_hit > 0")
        hits.append(cut(found.select(F.sha2("text", 256).alias("digest"), "hit_items", "hit_words").distinct()))
        seen.destroy()
    merged = reduce(DataFrame.unionAll, hits).groupBy("digest").agg(F.flatten(F.collect_list("hit_items")).alias("items"), F.flatten(F.collect_list("hit_words")).alias("words"))
    # The words are counted in a pass of their own, without windows.
    counted = add_columns(docs, [text], FIELDS, _scanner(sc.broadcast([]))).drop(*names[1:])
    key, found = free_name(counted, "__digest"), free_name(counted, "__found")
    held = merged.select(F.col("digest").alias(key), F.struct("items", "words").alias(found))
    joined = counted.withColumn(key, digest).join(held, key, "left")
    items, words = F.array_sort(F.array_distinct(F.col(found)["items"])), merged_runs(F.col(found)["words"])
    none_items, none_words = F.array().cast("array<string>"), F.from_json(F.lit("[]"), FIELDS[3][1])
    out = joined.withColumn("hit_items", F.coalesce(items, none_items)).withColumn("hit_words", F.coalesce(words, none_words))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return out.withColumn("n_hit", n_hit).select(*[F.col(f"`{c}`") for c in docs.columns if c not in names], *names)


def _rows(block: DataFrame) -> list[tuple[list[str], list[str]]]:
    """At most ``max_windows`` windows, give or take the hashing."""
    return [(r.words, r.items) for r in block.toLocalIterator()]


def merged_runs(runs: Column) -> Column:
    """Runs that touch or overlap made one, in order."""

    def add(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= r["start"]), joined).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(runs), F.slice(runs, F.lit(1), F.lit(0)), add)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", n: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with the columns of ``docs``.

    Null and empty texts stay, and so does every row if the benchmark is empty. Repeated rows stay or go alike, an
    empty table stays empty.
    """
    return mark(docs, benchmark, text, n).filter(F.col("n_hit") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_spans(marked: DataFrame, text: str = "text", clean: str = "clean_text") -> DataFrame:
    """``marked`` with ``clean``: the text without the hit words and what stands between two that adjoin; null stays null."""

    def make() -> Callable[[pd.Series, pd.Series], pd.DataFrame]:
        def step(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({clean: [_without(t, r) for t, r in zip(texts, runs, strict=True)]})

        return step

    return add_columns(marked, [text, "hit_words"], [(clean, "string")], make)


def _without(text: str | None, runs: list) -> str | None:
    if text is None or runs is None or not len(runs):
        return text
    at = [m.span() for m in _FIND.finditer(text.translate(_LOWER))]
    kept, end = [], 0
    for r in runs:
        kept.append(text[end : at[r["start"]][0]])
        end = at[r["end"] - 1][1]
    return "".join([*kept, text[end:]])


def digest(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The query's columns per document."""
    marked = mark(docs.select("doc_id", "text"), benchmark, "text", n)
    items = F.array_join("hit_items", ",")
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: DuckDB SQL for ``digest`` with windows of 10 words; rows are told apart by number, so repeated ids stay rows.
DIGEST_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + 9) AS win FROM b, unnest(range(1, greatest(2, len(w) - 8))) u(i) WHERE len(w) > 0),
s AS (SELECT r, i, n, list_slice(w, i, i + n - 1) AS win FROM d, (SELECT DISTINCT n FROM g) l, unnest(range(1, len(w) - n + 2)) u(i) WHERE len(w) >= n),
m AS (SELECT s.r, s.i, s.n, g.item FROM s JOIN g ON s.n = g.n AND s.win = g.win),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM m, unnest(range(i, i + n)) u(j) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
