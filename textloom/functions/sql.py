"""Table functions for use in SQL text: ``register(spark)``, then for instance

``SELECT d.doc_id, s.* FROM documents d, LATERAL text_segments(d.text, 'sentence') s``
``SELECT * FROM pack_units(TABLE(SELECT ...) PARTITION BY parent ORDER BY (pos), 64, 0.0)``
``SELECT d.doc_id, e.* FROM documents d, LATERAL text_words(d.text) e``
"""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T


class Segments:
    """``pos``, ``start``, ``end``, ``text`` of the paragraphs, sentences or lines of a text. Null or blank texts have none."""

    def __init__(self) -> None:
        self.patterns = {g: regex.compile(p) for g, p in T.UNITS.items()}

    def eval(self, text: str, granularity: str) -> Iterator[tuple]:
        if granularity not in self.patterns:
            raise ValueError(f"granularity is one of {', '.join(self.patterns)}")
        for pos, (start, own) in enumerate(zip(*T.units_of(text, self.patterns[granularity]), strict=True)):
            yield pos, start, start + len(own), own


class Words:
    """``pos``, ``start``, ``end``, ``word`` of the words and marks of a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for pos, (start, end) in enumerate(T.offsets_of(text).tolist()):
            yield pos, start, end, text[start:end]


class Pack:
    """Chunks of a parent's units, given in order: ``parent``, ``chunk``, ``first_pos``, ``last_pos``, ``tokens``, ``n_units``.

    Rows have ``parent``, ``pos``, ``tokens`` and ``sim``, the similarity to the unit before; rules as in ``chunk.pack``. A
    chunk is given out as soon as it ends, so nothing of a parent but its present chunk is held.
    """

    def __init__(self) -> None:
        self.now: list | None = None

    def eval(self, row: Row, max_tokens: int, drop_threshold: float) -> Iterator[tuple]:
        if max_tokens <= 0 or not 0 <= drop_threshold <= 1:
            raise ValueError("max_tokens is positive, drop_threshold from 0 to 1")
        tokens, sim = row["tokens"] or 0, row["sim"]
        if self.now is None:
            self.now = [row["parent"], 0, row["pos"], row["pos"], tokens, 1]
        elif (sim is not None and drop_threshold > 0 and sim < drop_threshold) or self.now[4] + tokens > max_tokens:
            yield tuple(self.now)
            self.now = [row["parent"], self.now[1] + 1, row["pos"], row["pos"], tokens, 1]
        else:
            self.now[3:] = [row["pos"], self.now[4] + tokens, self.now[5] + 1]

    def terminate(self) -> Iterator[tuple]:
        if self.now is not None:
            yield tuple(self.now)


def register(spark: SparkSession) -> None:
    """Make ``text_segments``, ``text_words`` and ``pack_units`` known to the session."""
    for name, made, kind in (
        ("text_segments", Segments, "pos: bigint, start: int, end: int, text: string"), ("text_words", Words, "pos: bigint, start: int, end: int, word: string"),
        ("pack_units", Pack, "parent: bigint, chunk: int, first_pos: bigint, last_pos: bigint, tokens: bigint, n_units: int"),
    ):
        spark.udtf.register(name, F.udtf(made, returnType=kind))
