"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole, with a byte-level BPE. The tokens' bytes spell the text, so their ends give
byte offsets and, by counting characters, character spans [start, end) in code points; a token that holds part of a
character spans it. Spans are interval-joined to the document's sections, given as spans in its own code points.

A token that crosses a section boundary is allocated by ``rule``:

* ``first``: to the section of its first character;
* ``most``: to the section with most of its characters, the earlier one on ties (the default);
* ``share``: to each section in proportion to its characters.

Characters outside all sections count as the section ``outside``, so the sections always add up to the document. Where
sections overlap, the one that comes first in the list has the characters. A null text has no tokens.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame

from textloom.llm.common import add_columns

#: Fixed value: the public split pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as that pattern has it, in runs that are cut out of a text before the pattern sees it.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
RULES = ("first", "most", "share")
FIELDS = [("n_tokens", "bigint"), ("n_crossing", "bigint"), ("outside", "double"), ("section_tokens", "array<double>")]


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``. The pattern backtracks through a run of white space, so long runs go past it.

        A run is one piece up to its last character, which begins the next piece unless the text ends there; so the
        ids are those of the whole text.
        """
        ids, at = [], 0
        for m in LONG_BLANK.finditer(text):
            end = m.end() - (m.end() < len(text))
            ids += self.encoding.encode_ordinary(text[at : m.start()])
            ids += self.encoding._encode_single_piece(text[m.start() : end])
            at = end
        return ids + self.encoding.encode_ordinary(text[at:]) if at else self.encoding.encode_ordinary(text)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Start and end of every token in code points, and the number of code points."""
        ids = self.encode(text)
        ends = np.cumsum(self.sizes[ids])
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if len(data) == len(text):
            return ends - self.sizes[ids], ends, len(text)
        begun = np.cumsum((data & 0xC0) != 0x80)
        return begun[ends - self.sizes[ids]] - 1, begun[ends - 1], len(text)


def lines(text: str) -> list[tuple[int, int]]:
    """The spans of the lines, each with its line feed."""
    out, at = [], 0
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        out.append((at, end))
        at = end
    return out


def allocate(starts: np.ndarray, ends: np.ndarray, n_chars: int, sections: list[tuple[int, int]], rule: str) -> tuple[int, float, np.ndarray]:
    """Tokens that cross a boundary, tokens outside, and tokens of each section."""
    owner = np.full(n_chars, -1, dtype=np.int64)
    for k in range(len(sections) - 1, -1, -1):
        owner[max(0, sections[k][0]) : max(0, sections[k][1])] = k
    counts = np.zeros(len(sections) + 1)
    if not len(starts):
        return 0, 0.0, counts[1:]
    changes = np.concatenate(([0], np.cumsum(owner[1:] != owner[:-1])))
    crossing = changes[starts] != changes[ends - 1]
    whole = np.ones(len(starts), dtype=bool) if rule == "first" else ~crossing
    counts += np.bincount(owner[starts[whole]] + 1, minlength=len(counts))
    for a, b in zip(starts[~whole].tolist(), ends[~whole].tolist(), strict=True):
        held = Counter(owner[a:b].tolist())
        if rule == "most":
            counts[max(held, key=held.get) + 1] += 1  # the first of equals is the earlier one
        else:
            for k, n in held.items():
                counts[k + 1] += n / (b - a)
    return int(crossing.sum()), float(counts[0]), counts[1:]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def count_tokens(docs: DataFrame, ranks_file: str, text: str = "text", sections: str | None = None, rule: str = "most") -> DataFrame:
    """``docs`` with ``n_tokens``, ``n_crossing``, ``outside`` and ``section_tokens`` (in the order of the sections).

    ``sections`` names an ``array<struct<start, end>>`` column; without one, a document's lines are its sections. A null
    column has no sections; a section that is null, or whose start or end is, is empty and keeps its place in the list.
    Repeated rows count each, an empty table gives no rows. The rank file is read on the driver and broadcast; its size is that of the vocabulary. Columns
    with the new names are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_file))

    def make() -> Callable[..., pd.DataFrame]:
        tokenizer = Tokenizer(ranks.value)

        def row(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, float, np.ndarray]:
            starts, ends, n = tokenizer.spans(text or "")
            return (len(starts), *allocate(starts, ends, n, spans, rule))

        def span(s: dict | None) -> tuple[int, int]:
            ends = (0, 0) if s is None else (s["start"], s["end"])
            return (0, 0) if pd.isna(ends[0]) or pd.isna(ends[1]) else (int(ends[0]), int(ends[1]))

        def step(texts: pd.Series, given: pd.Series | None = None) -> pd.DataFrame:
            if given is None:
                rows = [row(t, lines(t or "")) for t in texts]
            else:
                rows = [row(t, [] if g is None else list(map(span, g))) for t, g in zip(texts, given, strict=True)]
            return pd.DataFrame(rows, columns=[n for n, _ in FIELDS])

        return step

    return add_columns(docs, [text] if sections is None else [text, sections], FIELDS, make)
