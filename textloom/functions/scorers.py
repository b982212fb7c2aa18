"""Scorers. Those named HashVocab and Lexical are stand-ins where no weights exist: their algebra is real, their quality is not."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V

DIM = 16


class Embedder(Protocol):
    """Turns a list of texts into a matrix with a row of floats for each."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    """Turns (query, texts) into a logit for each text."""

    def score_pairs(self, query: str, texts: list[str]) -> list[float]: ...


def embed_udf(load: Callable[[], Embedder], dim: int = 0) -> Callable[[Column], Column]:
    """An Arrow function that embeds texts with unit length; ``load`` runs once per task. Null gives null.

    Another number of rows than texts raises an error, and so does another size than ``dim``, unless that is 0.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            there = texts.notna()
            known: Iterator[np.ndarray] = iter(())
            if there.any():
                x = np.asarray(model.embed(texts[there].tolist()), dtype=np.float64)
                if len(x) != there.sum():
                    raise ValueError(f"the embedder gave {len(x)} rows for {there.sum()} texts")
                if dim and x.shape[1:] != (dim,):
                    raise ValueError(f"the embedder gave vectors of {x.shape[1:]} where {dim} were expected")
                length = np.linalg.norm(x, axis=1, keepdims=True)
                known = iter(x / np.where(length == 0, 1, length))
            yield pd.Series([next(known) if t else None for t in there], dtype=object)

    return embed


def score_udf(load: Callable[[], PairScorer], query: str) -> Callable[[Column], Column]:
    """An Arrow function that gives the logit of (query, text)."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            yield pd.Series(model.score_pairs(query, texts.fillna("").tolist()), dtype=float)

    return score


#: Backends by name. Those that are retired are named, so that asking for one says so.
BACKENDS: dict[str, Callable[..., Embedder]] = {}
RETIRED = {"fastembed": "onnx", "sentence-transformers": "onnx"}
#: Tokens that a text may have: per backend, unless a model says otherwise.
NO_LIMIT = 1 << 20


def backend(name: str, static: bool = False) -> Callable[..., Embedder]:
    """The embedder class of a backend; ``auto`` is ``static`` for static models, else ``onnx``."""
    asked = ("static" if static else "onnx") if name == "auto" else name
    if asked in RETIRED:
        raise ValueError(f"the backend {asked} is retired; use {RETIRED[asked]}")
    if asked not in BACKENDS:
        raise ValueError(f"no backend {asked}; there are auto, {', '.join(sorted(BACKENDS))}")
    return BACKENDS[asked]


def register(name: str) -> Callable[[type], type]:
    def add(cls: type) -> type:
        BACKENDS[name] = cls
        return cls

    return add


@register("static")
class StaticEmbedder:
    """The mean of the rows of a token table: a text's known white-space words, lower-cased."""

    max_seq_len = NO_LIMIT

    def __init__(self, vectors: dict[str, list[float]]) -> None:
        self.places = {w: i for i, w in enumerate(vectors)}
        self.table = np.array(list(vectors.values()), dtype=np.float64)

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.table.shape[1]))
        for k, text in enumerate(texts):
            known = [self.places[w] for w in text.lower().split() if w in self.places]
            if known:
                out[k] = self.table[known].mean(axis=0)
        return out


@register("onnx")
class OnnxEmbedder:
    """Mean- or CLS-pooled embeddings from an ONNX session and a tokenizer, both given as open objects or local paths."""

    def __init__(self, session: object, tokenizer: object, pooling: str = "cls", max_length: int = 512, threads: int = 1) -> None:
        if pooling not in ("cls", "mean"):
            raise ValueError("pooling is cls or mean")
        if isinstance(session, str):
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = threads
            session = onnxruntime.InferenceSession(session, options, providers=["CPUExecutionProvider"])
        if isinstance(tokenizer, str):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer)
            tokenizer.enable_truncation(max_length)
            tokenizer.enable_padding()
        self.session, self.tokenizer, self.pooling, self.max_seq_len = session, tokenizer, pooling, max_length

    def embed(self, texts: list[str]) -> np.ndarray:
        encoded = self.tokenizer.encode_batch(texts)
        feeds = {"input_ids": [e.ids for e in encoded], "attention_mask": [e.attention_mask for e in encoded], "token_type_ids": [e.type_ids for e in encoded]}
        wanted = {i.name for i in self.session.get_inputs()}
        hidden = np.asarray(self.session.run(None, {k: np.array(v, dtype=np.int64) for k, v in feeds.items() if k in wanted})[0], dtype=np.float64)
        if self.pooling == "cls":
            return hidden[:, 0]
        mask = np.array(feeds["attention_mask"], dtype=np.float64)[:, :, None]
        return (hidden * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)


#: Tokens whose vectors a task holds, at the most twice as many.
HELD = 1 << 17


class HashVocab:
    """Whole-numbered vectors of tokens, from their MD5 digests; those of the last tokens are held, in two generations."""

    def __init__(self) -> None:
        self.place: list[dict[str, int]] = [{}, {}]
        self.rows = [np.zeros((0, DIM), dtype=np.int64)] * 2

    def vectors(self, tokens: list[str]) -> np.ndarray:
        """A row for each of the distinct ``tokens``."""
        out, missing = np.empty((len(tokens), DIM), dtype=np.int64), np.ones(len(tokens), dtype=bool)
        for place, rows in zip(self.place, self.rows, strict=True):
            at = np.fromiter((place.get(w, -1) for w in tokens), dtype=np.int64, count=len(tokens))
            found = missing & (at >= 0)
            out[found] = rows[at[found]]
            missing &= ~found
            if not missing.any():
                return out
        new = [tokens[i] for i in np.flatnonzero(missing).tolist()]
        digests = b"".join([hashlib.md5(f"{w}:{k}".encode("utf-8", "surrogatepass")).digest() for w in new for k in range(DIM // 4)])
        out[missing] = np.frombuffer(digests, dtype=">u4").astype(np.int64).reshape(-1, DIM) % 2001 - 1000
        if len(self.place[0]) >= HELD:
            self.place, self.rows = [{}, self.place[0]], [np.zeros((0, DIM), dtype=np.int64), self.rows[0]]
        self.place[0].update(zip(new, range(len(self.rows[0]), len(self.rows[0]) + len(new)), strict=True))
        self.rows[0] = np.concatenate([self.rows[0], out[missing]])
        return out

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """The sum of the vectors of the tokens of each text."""
        places: dict[str, int] = {}
        at = np.fromiter((places.setdefault(w, len(places)) for words in texts for w in words), dtype=np.int64)
        sizes = np.array([len(words) for words in texts])
        out = np.zeros((len(texts), DIM), dtype=np.int64)
        if len(at):
            filled = np.flatnonzero(sizes)
            out[filled] = np.add.reduceat(self.vectors(list(places))[at], (np.cumsum(sizes) - sizes)[filled], axis=0)
        return out


def vocab_embed(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``n_tokens``, ``embedding``: the unit mean of the token vectors of each text.

    Tokens are lower-cased white-space words; a text without any, or null, has a zero vector. A token's vector comes
    from the token itself, so there is nothing to join and no row moves. Whole numbers are added up.
    """

    @F.pandas_udf("struct<n_tokens:bigint,total:array<bigint>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocab = HashVocab()
        for batch in batches:
            for at in range(0, len(batch), T.TEXTS_BACK * 5):
                words = [T.white_space_split(t) if t else [] for t in batch.iloc[at : at + T.TEXTS_BACK * 5]]
                yield pd.DataFrame({"n_tokens": [len(w) for w in words], "total": list(vocab.sums(words))})

    each = texts.select(*keys, run(F.lower(F.col(text))).alias("__e"))
    return each.select(*keys, F.col("__e.n_tokens").alias("n_tokens"), V.unit("__e.total").alias("embedding"))


def lexical_logit(query: str, text: Column | str) -> Column:
    """Stand-in pair logit: eight times the Jaccard overlap of the lower-cased words, less two."""
    own = F.array_distinct(T.white_space_words(F.lower(F.col(text) if isinstance(text, str) else text)))
    words = F.array_distinct(T.white_space_words(F.lower(F.lit(query))))
    both, either = F.size(F.array_intersect(own, words)), F.size(F.array_union(own, words))
    return F.when(either > 0, both / F.greatest(either, F.lit(1))).otherwise(0.0) * 8.0 - 2.0


class LexicalPairs:
    """``lexical_logit`` as a pair scorer; the words of the last texts are held, so that many queries cost them once."""

    def __init__(self) -> None:
        self.held: tuple[list[str], list[set[str]]] = ([], [])

    def score_pairs(self, query: str, texts: list[str]) -> list[float]:
        if self.held[0] is not texts:
            self.held = (texts, [set(T.white_space_split(t)) for t in texts])
        asked = set(T.white_space_split(query))
        both = [len(asked & w) for w in self.held[1]]
        return [8.0 * b / max(len(asked) + len(w) - b, 1) - 2.0 for b, w in zip(both, self.held[1], strict=True)]
