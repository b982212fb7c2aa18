"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback.

Spaces become the marker U+2581 and one is put in front; the segmentation with the highest sum of piece scores wins,
the earlier split on ties. A character that no piece starts with costs the lowest score less ten and is spelt in byte
pieces (or the unknown piece, where the model has no bytes). Decoding joins pieces and bytes, turns markers into spaces
and takes the first one off, so every text without U+2581 comes back as it was.

If no piece has a marker behind another character, words are independent: the new words of some texts go through the
lattice together, position by position, and each task remembers them; otherwise a text is one lattice. A null text
has no ids and decodes to an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ROWS_BACK, add_columns, free_name

MARK = "▁"
#: Words that a task remembers, and the longest one it does; characters that it looks at for new words at once (of a
#: longer text, all), and words that go through the lattice together.
MEMORY, LONGEST, LOOK, TOGETHER = 150_000, 48, 1 << 18, 1 << 14


@dataclass
class Vocabulary:
    """Pieces by id with scores; ``kinds``: p for a piece of text, b for a byte, u for unknown, c for what no text has."""

    pieces: list[str]
    scores: list[float]
    kinds: str

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """Read a ``.model`` file on the driver; its pieces then go out by broadcast."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(sp.get_piece_size())
        kind = lambda i: "u" if sp.is_unknown(i) else "b" if sp.is_byte(i) else "c" if sp.is_control(i) or sp.is_unused(i) else "p"
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], "".join(map(kind, ids)))


class DoubleArray:
    """A trie in two arrays: from state s, character code c leads to t = base[s] + c if check[t] is s."""

    def __init__(self, keys: dict[str, int]) -> None:
        self.codes = {c: i + 1 for i, c in enumerate(sorted({c for k in keys for c in k}))}
        tree: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, value in keys.items():
            at = 0
            for c in key:
                code = self.codes[c]
                if code not in tree[at]:
                    tree[at][code] = len(tree)
                    tree.append({})
                    ids.append(-1)
                at = tree[at][code]
            ids[at] = value
        self._free = np.ones(len(tree) + 2 * len(self.codes) + 2 * self.STEP, dtype=bool)
        self._free[:2] = False
        base, check, value = ({}, {0: 0}, {})
        queue, place, first = [0], {0: 0}, {True: 1, False: 1}
        while queue:
            node = queue.pop()
            state, children = place[node], sorted(tree[node])
            value[state] = ids[node]
            if not children:
                continue
            lone = len(children) == 1
            start, first[lone] = self._fit(np.array(children), first[lone])
            base[state] = start
            for c in children:
                self._free[start + c], check[start + c] = False, state
                place[tree[node][c]] = start + c
                queue.append(tree[node][c])
        size = max(check) + 1
        self.base, self.check, self.value = np.zeros(size, dtype=np.int32), np.full(size, -1, dtype=np.int32), np.full(size, -1, dtype=np.int32)
        for array, filled in ((self.base, base), (self.check, check), (self.value, value)):
            array[list(filled)] = list(filled.values())
        del self._free

    STEP = 2048

    def _fit(self, children: np.ndarray, at: int) -> tuple[int, int]:
        """A base from which all ``children`` land on free places, and where to look next."""
        while True:
            if at + self.STEP + len(self.codes) > len(self._free):
                self._free = np.concatenate([self._free, np.ones(len(self._free), dtype=bool)])
            starts = at + np.flatnonzero(self._free[at : at + self.STEP]) - children[0]
            starts = starts[starts >= 1]
            for c in children[1:]:
                starts = starts[self._free[starts + c]]
            if len(starts):
                return int(starts[0]), at
            at += self.STEP


class Encoder:
    def __init__(self, vocabulary: Vocabulary, trie: DoubleArray) -> None:
        v = vocabulary
        self.pieces, self.scores = v.pieces, v.scores
        self.base, self.value, self.codes = trie.base.tolist(), trie.value.tolist(), trie.codes
        self.check = trie.check.tolist() + [-1] * (len(trie.codes) + 1)  # a code may lead past the last place
        text = [i for i, k in enumerate(v.kinds) if k == "p"]
        self.unknown = v.kinds.index("u") if "u" in v.kinds else -1
        self.bytes = [i for i, k in enumerate(v.kinds) if k == "b"]
        self.is_byte = {i: n for n, i in enumerate(self.bytes)}
        self.penalty = min((v.scores[i] for i in text), default=0.0) - 10
        self.places = np.zeros(max(map(ord, trie.codes), default=0) + 2, dtype=np.int32)  # codes by character; the last is of all beyond
        self.places[[ord(c) for c in trie.codes]] = list(trie.codes.values())
        self.arrays = trie.base, np.concatenate([trie.check, np.full(len(trie.codes) + 1, -1, dtype=np.int32)]), trie.value, np.array(v.scores)
        # Words end before a marker, and at line feeds and tabs that no piece has.
        alone = "".join(c for c in "\n\t\r" if c not in trie.codes)
        plain = f"[^{MARK}{alone}]"
        apart = not any(re.search(f"[^{MARK}]{MARK}", v.pieces[i]) for i in text)
        self.word = re.compile(f"{MARK}+{plain}*|{plain}+" + (f"|[{alone}]" if alone else "")) if apart else None
        self.spelling = np.zeros(len(v.pieces), dtype=bool)
        self.spelling[self.bytes] = True
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> bytes:
        """The ids, of four bytes each, of the best segmentation of ``text``, which has markers already."""
        base, check, value, scores, get = self.base, self.check, self.value, self.scores, self.codes.get
        codes, n = [get(c, 0) for c in text], len(text)
        best, back = [0.0] + [None] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            here, state, single = best[i], 0, False
            for j in range(i, n):
                c = codes[j]
                to = base[state] + c
                if not c or check[to] != state:
                    break
                state = to
                piece = value[state]
                if piece >= 0:
                    single |= j == i
                    total = here + scores[piece]
                    if best[j + 1] is None or total > best[j + 1]:
                        best[j + 1], back[j + 1] = total, (i, piece)
            if not single:
                total = here + self.penalty
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], back[i + 1] = total, (i, -1)
        out, at = [], n
        while at:
            i, piece = back[at]
            if piece >= 0:
                out.append(piece)
            elif len(self.bytes) == 256:
                out.extend(self.bytes[b] for b in reversed(text[i:at].encode("utf-8", "surrogatepass")))
            else:
                out.append(self.unknown)
            at = i
        return np.array(out[::-1], dtype=np.int32).tobytes()

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """The pieces found in ``codes``, in which 0 stands for the end of a word and what no piece has: place, length, id.

        A place where no piece of one character starts has one of id -1.
        """
        base, check, value, _ = self.arrays
        at, single = np.flatnonzero(codes > 0), np.zeros(len(codes), dtype=bool)
        state, size, found = np.zeros(len(at), dtype=np.int32), 0, []
        while len(at):
            to = base[state] + codes[at + size]
            on = (check[to] == state) & (codes[at + size] > 0)
            at, state, size = at[on], to[on], size + 1
            piece = value[state]
            ends = piece >= 0
            found.append((at[ends], np.full(int(ends.sum()), size), piece[ends]))
            if size == 1:
                single[found[0][0]] = True
        at = np.flatnonzero(~single)
        found.append((at, np.ones(len(at), dtype=np.int64), np.full(len(at), -1, dtype=np.int32)))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new ``words``, none longer than LONGEST: the lattices of many words, place by place."""
        words.sort(key=len, reverse=True)
        for k in range(0, len(words), TOGETHER):
            part = words[k : k + TOGETHER]
            n = np.array([len(w) for w in part])
            # Word after word, each with a place for its end.
            ends = np.cumsum(n + 1) - 1
            begins = ends - n
            chars = np.frombuffer("\0".join([*part, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
            codes = self.places[np.minimum(chars, len(self.places) - 1)]
            codes[ends] = 0
            inside = np.arange(len(codes)) - np.repeat(begins, n + 1)
            at, size, piece = self.edges(codes)
            score = np.where(piece >= 0, self.arrays[3][piece], self.penalty)
            best = np.full(len(codes) + 1, -np.inf)
            best[begins] = 0
            back, chosen = np.zeros(len(best), dtype=np.int64), np.full(len(best), -1, dtype=np.int32)
            # Of one place in all words, no two pieces end together; the earlier place wins a tie.
            order = np.argsort(inside[at].astype(np.uint16), kind="stable")
            at, to, piece, score = at[order], (at + size)[order], piece[order], score[order]
            stops = np.searchsorted(inside[at], np.arange(n[0] + 1)).tolist()
            for i in range(n[0]):
                some = slice(stops[i], stops[i + 1])
                start, stop = at[some], to[some]
                total = best[start] + score[some]
                more = total > best[stop]
                stop = stop[more]
                best[stop], back[stop], chosen[stop] = total[more], start[more], piece[some][more]
            longest = int(n[0])
            out, width = np.zeros((len(part), longest), dtype=np.int32), np.zeros(len(part), dtype=np.int64)
            odd, rows, place = np.zeros(len(part), dtype=bool), np.arange(len(part)), ends.copy()
            while len(rows):
                width[rows] += 1
                p = chosen[place[rows]]
                odd[rows] |= p < 0
                out[rows, longest - width[rows]] = p
                place[rows] = back[place[rows]]
                rows = rows[place[rows] > begins[rows]]
            flat, stops = out[np.arange(longest) >= longest - width[:, None]].tobytes(), (out.itemsize * np.cumsum(width)).tolist()
            self.known.update(zip(part, [flat[a:b] for a, b in zip([0, *stops], stops)], strict=True))
            for x in np.flatnonzero(odd).tolist():
                self.known[part[x]] = self.viterbi(part[x])

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        if self.word is None:
            yield from (np.frombuffer(self.viterbi(MARK + t.replace(" ", MARK)) if t else b"", dtype=np.int32) for t in texts)
            return
        held: list[list[str]] = []
        size = 0
        for k, t in enumerate(texts):
            held.append(self.word.findall(MARK + t.replace(" ", MARK)) if t else [])
            size += len(t or "")
            if size < LOOK and k + 1 < len(texts):
                continue
            if len(self.known) > MEMORY:
                self.known.clear()
            known, new = self.known, set(chain.from_iterable(held))
            new.difference_update(known)
            lone = {w: self.viterbi(w) for w in new if len(w) > LONGEST}
            self.learn([w for w in new if len(w) <= LONGEST])
            for words in held:
                found = [lone[w] if w in lone else known[w] for w in words] if lone else map(known.__getitem__, words)
                yield np.frombuffer(b"".join(found), dtype=np.int32)
            held, size = [], 0

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int], spelt: bool | None = None) -> str:
        """The text of ``ids``; ``spelt`` says, if known, whether byte pieces are among them."""
        if spelt is None:
            spelt = not self.is_byte.keys().isdisjoint(ids)
        if not spelt:
            return "".join(map(self.pieces.__getitem__, ids)).replace(MARK, " ")[1:]
        data = b"".join(bytes([self.is_byte[i]]) if i in self.is_byte else self.pieces[i].replace(MARK, " ").encode("utf-8", "surrogatepass") for i in ids)
        return data.decode("utf-8", "replace")[1:]

    def answer(self, texts: pa.Array) -> pa.StructArray:
        """For each text its ids, their number, that of byte pieces among them, and whether they give it again."""
        plain = texts.to_pylist()
        found = list(self.encode_all(plain))
        n_tokens = np.array([len(ids) for ids in found], dtype=np.int64)
        n_bytes = np.array([np.count_nonzero(self.spelling[ids]) for ids in found], dtype=np.int64)
        back = [self.decode(ids.tolist(), n > 0) == (t or "").replace(MARK, " ") for t, ids, n in zip(plain, found, n_bytes, strict=True)]
        ends = np.append(0, np.cumsum(n_tokens)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)), mask=texts.is_null())
        return pa.StructArray.from_arrays([lists, pa.array(n_tokens), pa.array(n_bytes), pa.array(back, pa.bool_())], names=["input_ids", "n_tokens", "n_bytes", "round_trip"])


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` in slices of up to ROWS_BACK texts and LOOK bytes, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOK, side="right"))
        stop = min(max(at + 1, stop), at + ROWS_BACK)
        yield texts.slice(at, stop - at)
        at = stop


def _encoder(df: DataFrame, model_file: str) -> Callable[[], Encoder]:
    vocabulary = Vocabulary.load(model_file)
    trie = DoubleArray({vocabulary.pieces[i]: i for i, k in enumerate(vocabulary.kinds) if k == "p"})
    sent = df.sparkSession.sparkContext.broadcast((vocabulary, trie))  # some MB, as large as the vocabulary
    return lambda: Encoder(*sent.value)


def add_ids(docs: DataFrame, model_file: str, text: str = "text", out: str = "input_ids") -> DataFrame:
    """``docs`` with the ids of the whole text as an array; null for a null text. A column named ``out`` is replaced."""
    load = _encoder(docs, model_file)

    def make() -> Callable[[pd.Series], pd.DataFrame]:
        encoder = load()
        def step(texts: pd.Series) -> pd.DataFrame:
            ids = encoder.encode_all(texts.tolist())
            return pd.DataFrame({out: [None if t is None else i for t, i in zip(texts, ids, strict=True)]})

        return step

    return add_columns(docs, [text], [(out, "array<int>")], make)


def add_decoded(docs: DataFrame, model_file: str, ids: str = "input_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text that ``ids`` stand for; empty for null or no ids. A column named ``out`` is replaced, an empty table stays empty."""
    load = _encoder(docs, model_file)

    def make() -> Callable[[pd.Series], pd.DataFrame]:
        encoder = load()
        return lambda column: pd.DataFrame({out: [encoder.decode([] if x is None else x.tolist()) for x in column]})

    return add_columns(docs, [ids], [(out, "string")], make)


def encode_table(docs: DataFrame, model_file: str, text: str = "text") -> DataFrame:
    """``docs`` with ``input_ids``, ``n_tokens``, ``n_bytes`` (byte pieces) and ``round_trip``: whether decoding the ids gives the text.

    The text counts as it is after U+2581 became a space. A null text has null ids, no tokens and makes the trip.
    """
    load = _encoder(docs, model_file)

    @F.arrow_udf("input_ids array<int>, n_tokens bigint, n_bytes bigint, round_trip boolean")
    def computed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = load()
        for batch in batches:
            yield from map(encoder.answer, slices(batch))
        # Workers go on to other tasks.
        encoder = batch = None
        pa.default_memory_pool().release_unused()

    held, names = free_name(docs, "__computed"), ("input_ids", "n_tokens", "n_bytes", "round_trip")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.withColumn(held, computed(F.col(text).cast("string"))).select(*rest, *[F.col(held)[n].alias(n) for n in names])
