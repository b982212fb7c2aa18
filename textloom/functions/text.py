"""Text expressions. Offsets are code points, from 0, half-open. A null text gives null unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns for words (with hyphens and underscores inside), or else single marks; white-space words; sentences.
WORD = r"\w+(?:[-_]\w+)*|\S"
SENTENCE = r"[^.!?\n]+[.!?]*"
#: The units of a text: each match, without white space around it. A paragraph goes on over lines that are not blank.
UNITS = {"paragraph": r"\S(?:.|\n(?!\s*\n))*", "sentence": SENTENCE, "line": r"[^\n]+"}


#: Texts that Python answers at once, so that the lists it makes of them stay small.
TEXTS_BACK = 200


def _parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        for at in range(0, len(texts), TEXTS_BACK):
            yield texts.iloc[at : at + TEXTS_BACK]


def words(text: Column | str) -> Column:
    """The words and marks of a text, in order."""
    return F.regexp_extract_all(_c(text), F.lit(f"(?U)({WORD})"), 1)


def white_space_words(text: Column | str) -> Column:
    return F.regexp_extract_all(_c(text), F.lit(r"(?U)(\S+)"), 1)


#: Control characters that are white space in Python and nowhere else.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_SPACES = regex.compile(r"[\s--[\x1c-\x1f]]+", regex.V1)


def white_space_split(text: str) -> list[str]:
    """The lower-cased white-space words of a text, for functions that see it in Python."""
    text = text.lower()
    return [w for w in _SPACES.split(text) if w] if _SEPARATORS.search(text) else text.split()


def token_count(text: Column | str) -> Column:
    """White-space words; 0 for null."""
    return F.coalesce(F.size(white_space_words(text)), F.lit(0)).cast("bigint")


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_c(text), r"(?U)^\s+|\s+$", "")


def snippet(text: Column | str, n: int = 1500) -> Column:
    return F.substring(strip(text), 1, n)


def sentences(text: Column | str) -> Column:
    """Trimmed sentences that are not blank."""
    found = F.regexp_extract_all(_c(text), F.lit(f"({SENTENCE})"), 1)
    return F.filter(F.transform(found, strip), lambda s: s != "")


def lines(text: Column | str) -> Column:
    return F.filter(F.split(_c(text), "\n"), lambda s: strip(s) != "")


def normalised(text: Column | str) -> Column:
    """Lower case, without white space and the marks ``,.;:"'()`` at the ends."""
    return F.regexp_replace(F.lower(strip(text)), "^[,.;:\"'() ]+|[,.;:\"'() ]+$", "")


def first_text(*columns: str) -> Column:
    """The first that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


@cache
def _classes() -> np.ndarray:
    """For each code point: 1 in words, 2 for marks, 0 for white space."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, 2, dtype=np.uint8)
    for pattern, kind in ((r"\s+", 0), (r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]+", 1)):
        for m in regex.finditer(pattern, every):
            a, b = (i if i < 0xD800 else i + 0x800 for i in (m.start(), m.end() - 1))
            out[a : b + 1] = kind
    out[0xD800:0xE000] = 2
    return out


def offsets_of(text: str | None) -> np.ndarray:
    """Start and end of every word of ``text``, a row each; for functions that see whole texts in Python.

    What ``WORD`` matches, found for all characters at once: runs of word characters, with single hyphens inside, and marks alone.
    """
    if not text:
        return np.zeros((0, 2), dtype=np.int32)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = np.concatenate([[0], _classes()[codes], [0]])
    word = kind == 1
    word[1:-1] |= (codes == 45) & word[:-2] & word[2:]
    mark = (kind == 2) & ~word
    starts = np.flatnonzero((word[1:-1] & ~word[:-2]) | mark[1:-1])
    ends = np.flatnonzero((word[1:-1] & ~word[2:]) | mark[1:-1]) + 1
    return np.stack([starts, ends], axis=1).astype(np.int32)


def word_offsets(text: Column | str) -> Column:
    """``start`` and ``end`` of every word as two arrays."""

    @F.pandas_udf("struct<start:array<int>,end:array<int>>")
    def offsets(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _parts(batches):
            at = [offsets_of(t) for t in texts]
            yield pd.DataFrame({"start": [x[:, 0] for x in at], "end": [x[:, 1] for x in at]})

    return F.when(_c(text).isNotNull(), offsets(_c(text)))


def word_spans(text: Column | str) -> Column:
    """Every word with its offsets and what stands ``after`` it, up to the next word, in one pass over the text."""

    @F.pandas_udf("struct<start:array<int>,end:array<int>,text:array<string>,after:array<string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _parts(batches):
            rows = []
            for t in texts:
                at = offsets_of(t)
                starts, ends = at[:, 0].tolist(), at[:, 1].tolist()
                own = [t[a:b] for a, b in zip(starts, ends, strict=True)]
                gaps = [t[a:b] for a, b in zip(ends, [*starts[1:], len(t)], strict=True)] if starts else []
                rows.append((at[:, 0], at[:, 1], own, gaps))
            yield pd.DataFrame(rows, columns=["start", "end", "text", "after"])

    # Named once and not deterministic by declaration: else a filter on the words would run the function a second time.
    held = F.array(spans.asNondeterministic()(_c(text)))
    zipped = F.transform(held, lambda s: F.arrays_zip(*[s[x].alias(x) for x in ("start", "end", "text", "after")]))
    return F.when(_c(text).isNotNull(), F.get(zipped, F.lit(0)))


def units_of(text: str | None, pattern: regex.Pattern) -> tuple[list[int], list[str]]:
    """Where the matches of ``pattern`` that are not blank begin, without white space around them, and they themselves."""
    starts, own = [], []
    for m in pattern.finditer(text or ""):
        held = m.group()
        unit = held.strip()
        if unit:
            starts.append(m.start() + len(held) - len(held.lstrip()))
            own.append(unit)
    return starts, own


def spans_of(pattern: str, text: Column | str) -> Column:
    """``start``, ``end`` and ``text`` of every match of ``pattern`` that is not blank, without white space around it."""
    found = regex.compile(pattern)

    @F.pandas_udf("struct<start:array<int>,end:array<int>,text:array<string>>")
    def units(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in _parts(batches):
            rows = []
            for t in texts:
                starts, own = units_of(t, found)
                at = np.array(starts, dtype=np.int32)
                rows.append((at, at + np.array([len(x) for x in own], dtype=np.int32), own))
            yield pd.DataFrame(rows, columns=["start", "end", "text"])

    held = F.array(units.asNondeterministic()(_c(text)))
    return F.get(F.transform(held, lambda s: F.arrays_zip(*[s[x].alias(x) for x in ("start", "end", "text")])), F.lit(0))


def slug(text: Column | str) -> Column:
    """Lower case, with ``_`` for slash, hyphen and dot."""
    return F.translate(F.lower(_c(text)), "/-.", "___")


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits, shifted by the maximum."""
    n = F.size(logits)
    shifted = F.zip_with(logits, F.array_repeat(F.array_max(logits), n), lambda x, m: F.exp(x - m))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(shifted, F.array_repeat(total, n), lambda x, t: x / t)


def first_argmax(values: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def bio_category(label: Column) -> Column:
    """The category of a BIO label, null for ``O``; a label without prefix begins a span of its own name."""
    return F.when(label == "O", F.lit(None)).when(label.startswith("B-") | label.startswith("I-"), F.substring(label, F.lit(3), F.length(label))).otherwise(label)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
