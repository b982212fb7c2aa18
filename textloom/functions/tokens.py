"""Model tokens: a tokenizer file behind Arrow functions. The file is a path that every node has."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = "struct<input_ids:array<int>,attention_mask:array<int>,type_ids:array<int>,starts:array<int>,ends:array<int>,word_ids:array<int>>"


@cache
def _load(path: str, max_length: int | None, first: int | None, last: int | None) -> object:
    # A task has one core; else a batch is encoded by as many threads as the machine has.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.processors import TemplateProcessing

    found = Tokenizer.from_file(path)
    if first is not None and last is not None:
        a, b = (found.id_to_token(i) for i in (first, last))
        found.post_processor = TemplateProcessing(single=f"{a} $A {b}", pair=f"{a} $A {b} $B:1 {b}:1", special_tokens=[(a, first), (b, last)])
    if max_length is not None:
        found.enable_truncation(max_length)
    return found


#: Texts and their bytes that are encoded at once; a token takes some hundred bytes until its numbers are taken, even one that is cut off.
TEXTS_ONCE, BYTES_ONCE = 200, 1 << 18


def _slices(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Place and number of rows of slices of up to ``TEXTS_ONCE`` rows and ``BYTES_ONCE`` bytes of text, one row at least."""
    ends = np.cumsum(sum(pc.binary_length(c).fill_null(0).to_numpy().astype(np.int64) for c in columns))
    at = 0
    while at < len(ends):
        stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BYTES_ONCE, side="right"))
        stop = min(max(at + 1, stop), at + TEXTS_ONCE, len(ends))
        yield at, stop - at
        at = stop


def _encoded(tokenizer: object, texts: pa.Array, others: pa.Array, places: bool) -> pa.Array:
    pairs = [(t or "") if o is None else (t or "", o) for t, o in zip(texts.to_pylist(), others.to_pylist(), strict=True)]
    found = tokenizer.encode_batch(pairs) if places else tokenizer.encode_batch_fast(pairs)
    ends = pa.array(np.cumsum([0, *map(len, found)], dtype=np.int32))
    values = {"input_ids": [x for e in found for x in e.ids], "attention_mask": [x for e in found for x in e.attention_mask], "type_ids": [x for e in found for x in e.type_ids]}
    if places:
        spans = np.array([x for e in found for x in e.offsets], dtype=np.int32).reshape(-1, 2)
        values |= {"starts": spans[:, 0], "ends": spans[:, 1], "word_ids": [-1 if w is None else w for e in found for w in e.word_ids]}
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.array(v, dtype=np.int32))) for v in values.values()], names=list(values))


def encode(path: str, max_length: int | None = None, specials: tuple[int, int] | None = None, places: bool = True) -> Callable[..., Column]:
    """An Arrow function of a text, or a text and its pair, that gives ids, mask, types, offsets in code points and word numbers.

    ``specials`` are the ids put before and behind each text; ``max_length`` counts them. A null text is an empty one.
    Specials have no word, -1, and span nothing. A worker loads a file once. Without ``places`` there are no offsets
    and no word numbers, and the tokenizer keeps none.
    """
    first, last = specials or (None, None)

    @F.arrow_udf(FIELDS if places else FIELDS.partition(",starts:")[0] + ">")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        tokenizer = _load(path, max_length, first, last)
        for texts, others in batches:
            for at, n in _slices(texts, others):
                yield _encoded(tokenizer, texts.slice(at, n), others.slice(at, n), places)
        # Workers go on to other tasks.
        texts = others = None
        pa.default_memory_pool().release_unused()

    return lambda text, pair=None: run(text, F.lit(None).cast("string") if pair is None else pair)


def padded(ids: Column, length: Column, fill: int = 0) -> Column:
    """``ids`` filled up on the right."""
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(length - F.size(ids), F.lit(0))))


def words_mask(word_ids: Column) -> Column:
    """For each token the number of its word, from 1, where it is the word's first token; else 0."""
    before = F.concat(F.array(F.lit(-1)), F.slice(word_ids, F.lit(1), F.size(word_ids) - 1))
    firsts = F.zip_with(word_ids, before, lambda w, b: (w >= 0) & (w != b))
    return F.zip_with(word_ids, firsts, lambda w, f: F.when(f, w + 1).otherwise(F.lit(0)))


def entity_prompt(labels: list[str], words: Column) -> Column:
    """The words of an entity prompt: each label behind its mark, the separator, then the text's words."""
    marked = [F.lit(x) for label in labels for x in ("<<ENT>>", label)]
    return F.concat(F.array(*marked, F.lit("<<SEP>>")), words)
