"""License scans by patience alignment.

Text and template become lower-case words. An alignment matches the words that begin and end both alike, then anchors
on words that occur once in both, takes the longest increasing subsequence of the anchors and aligns the gaps between
them the same way; a gap without anchors is aligned by its longest common subsequence. Its coverage is the share of
template words it matches.

A match with coverage ``c`` of ``m`` template words misses at the most (1 - c) m of them, so it holds one of any
(1 - c) m + 1 template words. The rarest of those in the document seed windows of about the template's length that are
aligned, so close occurrences are found however often a license is repeated in a text. Words that stand in order with
insertions of any length are found by the shortest spans of template words that reach the coverage; what such a span
lacks at its ends is aligned with the text up to the spans before and behind it. Of all these, the match that has most
template words less those that it lacks takes its words, then the next one whose words are left, and so on; ties go to
the shorter span, the earlier start and the first template name. A match whose words are taken is looked for again
between its neighbours, and the words that are left are searched again until nothing is found. Matches share no word, but one may stand in an insertion of another.

Up to ``STRAY`` matched words at an end that more than ``STRAY`` inserted words set apart are left off as chance, again
and again, as long as the coverage holds; a match of every template word stays whole. Templates of which too few words occur anywhere in the text are not tried.

Null and wordless texts have no match.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import count as count_from
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from textloom.llm.common import add_columns
from textloom.llm.license_texts import TEMPLATES as TEMPLATES

WORD = re.compile(r"[^\W_]+")
COVERAGE = 0.8
#: Matched words at an end that may belong to something else, and the inserted words that set them apart.
STRAY = 3
FIELDS = [("license_matches", "array<struct<license:string,coverage:double,start:int,end:int>>")]

def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1], at[k : k + 1] = [v], [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str], a0: int, a1: int, b0: int, b1: int, late: bool = False) -> list[tuple[int, int]]:
    """Matched positions of ``a[a0:a1]`` and ``b[b0:b1]`` by patience, in order; ``late`` as for ``longest``."""
    head: list[tuple[int, int]] = []
    tail: list[tuple[int, int]] = []
    while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
        head.append((a0, b0))
        a0, b0 = a0 + 1, b0 + 1
    while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
        a1, b1 = a1 - 1, b1 - 1
        tail.append((a1, b1))
    middle: list[tuple[int, int]] = []
    if a0 < a1 and b0 < b1:
        in_b = Counter(b[b0:b1])
        shared = [i for i in range(a0, a1) if a[i] in in_b]
        in_a = Counter([a[i] for i in shared])
        place = {a[i]: i for i in shared if in_a[a[i]] == 1}
        anchors = [(place[w], j) for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1 and w in place]
        x, y = a0, b0
        for i in increasing([p for p, _ in anchors]):
            p, q = anchors[i]
            middle += [*align(a, b, x, p, y, q, late), (p, q)]
            x, y = p + 1, q + 1
        if middle:
            middle += align(a, b, x, a1, y, b1, late)
        elif shared:
            middle = [(shared[i], b0 + j) for i, j in longest([a[i] for i in shared], b[b0:b1], late)]
    return head + middle + tail[::-1]


def trimmed(pairs: list[tuple[int, int]], need: int) -> list[tuple[int, int]]:
    """``pairs``, ``need`` at least, without up to ``STRAY`` at either end that stand apart in the text but not in the template."""
    for _ in range(2):
        pairs = [(-i, -j) for i, j in reversed(pairs)]
        while k := next((k for k in range(min(STRAY, len(pairs) - max(need, 1)), 0, -1) if pairs[k][0] - pairs[k - 1][0] - (pairs[k][1] - pairs[k - 1][1]) > STRAY), 0):
            pairs = pairs[k:]
    return pairs


def longest(a: list[str], b: list[str], late: bool = False) -> list[tuple[int, int]]:
    """Matched positions of a longest common subsequence; the last word matched as early in ``a`` as can be, with ``late`` the first one as late."""
    if late:
        return [(len(a) - 1 - i, len(b) - 1 - j) for i, j in reversed(longest(a[::-1], b[::-1]))]
    rows = [(1 << len(b)) - 1, *steps(a, b)]

    def length(i: int, j: int) -> int:
        return j - (rows[i] & ((1 << j) - 1)).bit_count()

    out, i, j = [], len(a), len(b)
    left = length(i, j)
    while left:
        if length(i - 1, j) == left:
            i -= 1
        elif length(i, j - 1) == left:
            j -= 1
        else:
            i, j, left = i - 1, j - 1, left - 1
            out.append((i, j))
    return out[::-1]


def masks_of(template: list[str]) -> dict[str, int]:
    """For each word of ``template`` the bits of its places."""
    masks: dict[str, int] = {}
    for j, w in enumerate(template):
        masks[w] = masks.get(w, 0) | 1 << j
    return masks


def steps(words: Iterable[str], template: list[str]) -> Iterator[int]:
    """After each word, the row of the common subsequence table, whose clear bits are its steps."""
    masks = masks_of(template)
    row = full = (1 << len(template)) - 1
    for w in words:
        hit = row & masks.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def reach(marks: list[int], begin: int, stop: int, step: int, size: int, need: int) -> int:
    """How many of ``marks[begin:stop:step]``, the words' places in a template of ``size`` words, hold ``need`` of it in order, the fewest; -1 if all do not."""
    row = full = (1 << size) - 1
    n, lacking = 0, need
    while True:
        # A word brings a step at the most, so as many as are lacking go without a count.
        last = begin + step * (n + lacking)
        if (last > stop) if step > 0 else (last < stop):
            return -1
        for x in marks[begin + step * n : last : step] if last >= 0 else marks[begin + step * n :: step]:
            hit = row & x
            row = ((row + hit) | (row - hit)) & full
        n += lacking
        lacking = need - size + row.bit_count()
        if lacking <= 0:
            return n


@dataclass
class Match:
    """Matched positions of text and template of ``size`` words, in order; ``whole`` with those left off, if they make it whole."""

    name: str
    size: int
    pairs: list[tuple[int, int]]
    whole: list[tuple[int, int]] | None

    @classmethod
    def of(cls, name: str, size: int, pairs: list[tuple[int, int]], need: int) -> Match:
        kept = trimmed(pairs, need)
        return cls(name, size, kept, pairs if len(pairs) == size > len(kept) else None)

    @property
    def coverage(self) -> float:
        return len(self.pairs) / self.size

    @property
    def start(self) -> int:
        return self.pairs[0][0]

    @property
    def end(self) -> int:
        return self.pairs[-1][0] + 1


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.templates = {n: w for n, t in sorted(templates.items()) if (w := WORD.findall(t.lower()))}
        self.counts = {n: Counter(t) for n, t in self.templates.items()}
        self.words = {n: frozenset(t) for n, t in self.templates.items()}
        self.masks = {n: masks_of(t) for n, t in self.templates.items()}

    def need(self, template: list[str]) -> int:
        return ceil(self.coverage * len(template) - 1e-9)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, start, end) of every match, in order; spans in code points."""
        lower = text.lower() if text else ""
        words = WORD.findall(lower)
        seen, near = set(words), {}
        for n, t in self.templates.items():
            lost = self.words[n] - seen
            if len(t) - sum(self.counts[n][w] for w in lost) >= self.need(t):
                near[n] = t
        if not near:
            return []
        wanted, places = set().union(*near.values()), defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                places[w].append(i)
        free = bytearray(b"\x01") * len(words)
        kept: list[Match] = []
        own_places = {n: sorted(i for w in self.words[n] for i in places[w]) for n in near}
        found = [m for n, t in near.items() for m in self.close(n, t, words, places, own_places[n])]
        order = lambda m: (m.size - 2 * len(m.pairs), m.end - m.start, m.start, m.name, m.whole is None)
        count = count_from(0)
        waiting = [(order(m), next(count), m, 0, 0) for m in found]

        def search(name: str, begin: int, stop: int) -> bool:
            """Let what stands among the free words of a stretch wait for its turn, each match with the stretch between its neighbours."""
            own, t = own_places[name], near[name]
            at = [i for i in own[bisect_left(own, begin) : bisect_left(own, stop)] if free[i]]
            left = Counter([words[i] for i in at])
            if sum(min(k, left[w]) for w, k in self.counts[name].items()) < self.need(t):
                return False
            more = self.scattered(name, t, words, at)
            for k, m in enumerate(more):
                heappush(waiting, (order(m), next(count), m, more[k - 1].end if k else begin, more[k + 1].start if k + 1 < len(more) else stop))
            return bool(more)

        heapify(waiting)
        tried = set(near)
        while tried or waiting:
            # Words only go, so a template that finds nothing in all of them finds nothing later.
            tried = {n for n in tried if search(n, 0, len(words))}
            taken = []
            while waiting:
                _, _, m, begin, stop = heappop(waiting)
                if all(free[i] for i, _ in m.pairs):
                    taken.append(m)
                    for i, _ in m.pairs:
                        free[i] = 0
                elif stop:
                    search(m.name, begin, stop)
            for m in taken:
                own = {i for i, _ in m.pairs}
                if m.whole and all(free[i] or i in own for i, _ in m.whole):
                    m.pairs = m.whole
                    for i, _ in m.pairs:
                        free[i] = 0
            kept += taken
        at = spans(text, lower) if kept else []
        return [(m.name, m.coverage, at[m.start][0], at[m.end - 1][1]) for m in sorted(kept, key=lambda m: (m.start, m.end, m.name))]

    def close(self, name: str, template: list[str], words: list[str], places: dict[str, list[int]], own: list[int]) -> list[Match]:
        """Close occurrences: windows around the seeds, of which only those are aligned whose common subsequence is long enough."""
        m, need = len(template), self.need(template)
        slack = max(4, m // 4)
        seeds = sorted(range(m), key=lambda j: (len(places[template[j]]), j))[: int((1 - self.coverage) * m + 1e-9) + 1]
        out: dict[tuple[int, int, int], Match] = {}
        marks = [self.masks[name][words[i]] for i in own]
        whole: list[int] = []  # where the template stands word for word
        for j in seeds:
            for p in places[template[j]]:
                at = bisect_right(whole, p) - 1
                if at >= 0 and p < whole[at] + m:
                    continue
                if reach(marks, bisect_left(own, p - j - slack), bisect_left(own, p + m - j + slack), 1, m, need) < 0:
                    continue
                left = align(words, template, max(0, p - j - slack), p, 0, j)
                right = align(words, template, p + 1, min(len(words), p + m - j + slack), j + 1, m)
                if len(left) + 1 + len(right) >= need:
                    found = Match.of(name, m, [*left, (p, j), *right], need)
                    out[len(found.pairs), found.start, found.end] = found
                    if len(found.pairs) == m == found.end - found.start:
                        insort(whole, found.start)
        return list(out.values())

    def scattered(self, name: str, template: list[str], words: list[str], at: list[int]) -> list[Match]:
        """Occurrences with any insertions among the words ``at`` these places, none of which share a word."""
        m, need = len(template), self.need(template)
        here, masks = [words[i] for i in at], self.masks[name]
        forward = [masks[w] for w in here]
        # The same places counted from the template's end.
        turned = {w: int(f"{x:0{m}b}"[::-1], 2) for w, x in masks.items()}
        backward = [turned[w] for w in here]
        begin, found, out = 0, [], []
        while (n := reach(forward, begin, len(at), 1, m, need)) > 0:
            end = begin + n
            found.append((end - reach(backward, end - 1, begin - 1, -1, m, need), end))
            begin = end
        last = 0
        for k, (begin, end) in enumerate(found):
            stop = found[k + 1][0] if k + 1 < len(found) else len(at)
            pairs = [(begin + i, j) for i, j in longest(here[begin:end], template)]
            before = align(here, template, last, begin, 0, pairs[0][1], late=True)
            behind = align(here, template, end, stop, pairs[-1][1] + 1, m)
            last = behind[-1][0] + 1 if behind else end
            out.append(Match.of(name, m, [(at[i], j) for i, j in (*before, *pairs, *behind)], need))
        return out


def spans(text: str, lower: str) -> list[tuple[int, int]]:
    """The spans in ``text`` of the words of its ``lower`` form, which may be longer."""
    at = [m.span() for m in WORD.finditer(lower)]
    if len(lower) == len(text):
        return at
    ends = np.cumsum([len(c.lower()) for c in text])  # where each character's lower form ends
    return [(int(np.searchsorted(ends, a, side="right")), int(np.searchsorted(ends, b - 1, side="right")) + 1) for a, b in at]


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``license_matches`` (license, coverage, start, end), which replaces a column of that name."""
    if not 0 < coverage <= 1:
        raise ValueError("coverage is over 0 and at most 1")
    given = TEMPLATES if templates is None else templates

    def make() -> Callable[[pd.Series], pd.DataFrame]:
        scanner = Scanner(given, coverage)

        def step(texts: pd.Series) -> pd.DataFrame:
            names = ("license", "coverage", "start", "end")
            return pd.DataFrame({FIELDS[0][0]: [[dict(zip(names, m, strict=True)) for m in scanner.scan(t)] for t in texts]})

        return step

    return add_columns(docs, [text], FIELDS, make)
