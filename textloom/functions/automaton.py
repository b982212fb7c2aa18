"""Which of many strings a text holds, by one pass over the text: an automaton in arrays, for use inside tasks.

States are the prefixes of the strings, numbered level by level; a row of ``table`` has the next state for each class of
bytes. Many stretches of text take a step at once. A stretch begins as many bytes early as the longest string has, so
that where it counts its state is that of the whole text.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a stretch, and bytes from which a string is looked for by its head and then as it is.
STRETCH, HEAD = 4096, 192
#: Bytes of text that are looked through at once.
ONCE = 1 << 23


class Automaton:
    """``patterns``: byte strings, of which empty ones are in no text."""

    def __init__(self, patterns: list[bytes]) -> None:
        heads: dict[bytes, list[int]] = {}
        for i, p in enumerate(patterns):
            if p:
                heads.setdefault(p[:HEAD], []).append(i)
        self.patterns, self.heads = patterns, list(heads)
        self.of_head = list(heads.values())
        data = np.frombuffer(b"".join(self.heads), dtype=np.uint8)
        sizes = np.array([len(h) for h in self.heads], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        self.longest = int(sizes.max(initial=0))
        self.classes = np.zeros(256, dtype=np.int64)
        used = np.unique(data)
        self.classes[used] = np.arange(1, len(used) + 1)

        state, levels, n = np.zeros(len(sizes), dtype=np.int64), [], 1
        for d in range(self.longest):
            on = np.flatnonzero(sizes > d)
            key, back = np.unique(state[on] * 256 + data[begins[on] + d], return_inverse=True)
            state[on] = n + back
            levels.append((n, key // 256, self.classes[key % 256]))
            n += len(key)
        self.table = np.zeros((n, len(used) + 1), dtype=np.int32)
        fail = np.zeros(n, dtype=np.int64)
        own = np.full(n, -1, dtype=np.int64)
        own[state] = np.arange(len(sizes))
        # The nearest state on the way of failures at which a string ends.
        link = np.zeros(n, dtype=np.int64)
        for d, (at, parent, char) in enumerate(levels):
            here = np.arange(at, at + len(parent))
            # Before the children are put into their parents' rows, these have where their failures go.
            fail[here] = self.table[parent, char]
            self.table[parent, char] = here
            link[here] = np.where(own[fail[here]] >= 0, fail[here], link[fail[here]])
            self.table[here] = self.table[fail[here]]
        self.own, self.link = own, link
        self.ends = (own >= 0) | (link > 0)

    def scan(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text, pattern) of every text and pattern in it, once, in order."""
        found: list[tuple[int, int]] = []
        at = 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held + len(texts[stop]) <= ONCE):
                held += len(texts[stop])
                stop += 1
            found += [(at + i, p) for i, p in self._scan(texts[at:stop])]
            at = stop
        return found

    def _scan(self, texts: list[bytes]) -> list[tuple[int, int]]:
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        if not len(data) or not self.longest:
            return []
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        own_begin = np.repeat(np.cumsum(sizes) - sizes, pieces)
        start = own_begin + (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        end = np.minimum(start + STRETCH, own_begin + sizes[owner])
        start = np.maximum(start - self.longest + 1, own_begin)
        order = np.argsort(start - end, kind="stable")
        owner, start, length = owner[order], start[order], (end - start)[order]
        state = np.zeros(len(owner), dtype=np.int64)
        hits: list[np.ndarray] = []
        many = len(self.ends)
        for t in range(int(length[0])):
            live = int(np.searchsorted(-length, -t, side="left"))
            state[:live] = self.table[state[:live], self.classes[data[start[:live] + t]]]
            end_here = np.flatnonzero(self.ends[state[:live]])
            if len(end_here):
                hits.append(owner[end_here] * many + state[end_here])
                if len(hits) > 256:
                    hits = [np.unique(np.concatenate(hits))]
        if not hits:
            return []
        text, at = np.divmod(np.unique(np.concatenate(hits)), many)
        pairs: set[tuple[int, int]] = set()
        while len(at):
            there = self.own[at] >= 0
            pairs.update(zip(text[there].tolist(), self.own[at[there]].tolist(), strict=True))
            text, at = text[self.link[at] > 0], self.link[at][self.link[at] > 0]
        out = []
        for i, head in pairs:
            for p in self.of_head[head]:
                if len(self.patterns[p]) <= HEAD or self.patterns[p] in texts[i]:
                    out.append((i, p))
        return sorted(out)
