"""Entity spans: enumeration, thresholds, greedy overlap filter, BIO decoding.

``span_table``, ``extract`` and ``tag_spans`` work on whole texts: a text's spans, scores and the walk over them stay in
arrays of its own row, so nothing is exploded, shuffled or grouped, and text is cut for what is left alone. The others
take tables of spans or tokens that come from elsewhere, a row each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T

#: Words of a text whose spans are scored at once, so that a very long text takes no more memory.
WORDS = 1 << 14


class SpanScorer(Protocol):
    """Logits of the spans of a text that begin with the words ``first`` to ``stop``: (words, ``max_width``, labels).

    ``words`` has start and end of every word. Spans that would go beyond the last word may have any logit.
    """

    def span_logits(self, key: object, text: str, words: np.ndarray, first: int, stop: int, max_width: int, labels: list[str]) -> np.ndarray: ...


class Tagger(Protocol):
    """Logits of the words of a text: (words, labels)."""

    def tag_logits(self, key: object, text: str, words: np.ndarray) -> np.ndarray: ...


def _in_rows(docs: DataFrame, key: str, text: str, fields: str, each: Callable[[], Callable[[object, str], tuple]]) -> DataFrame:
    """``key`` and ``fields`` that ``each()``, made once a task, gives for (key, text); a null text is empty."""
    names = [f.split(":")[0] for f in fields.split(",")]

    @F.pandas_udf(f"struct<{fields}>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        step = each()
        for keys, texts in batches:
            for at in range(0, len(texts), T.TEXTS_BACK):
                some = slice(at, at + T.TEXTS_BACK)
                yield pd.DataFrame([step(k, t or "") for k, t in zip(keys.iloc[some], texts.iloc[some], strict=True)], columns=names)

    return docs.select(key, run(F.col(key), F.col(text)).alias("__f")).select(key, "__f.*")


def span_table(docs: DataFrame, key: str, max_width: int = 12, text: str = "text") -> DataFrame:
    """``key`` and arrays ``word`` and ``width`` (0: one word): every run of up to ``max_width`` words, by word, then width."""
    if max_width < 1:
        raise ValueError("max_width is 1 at least")

    def each() -> Callable[[object, str], tuple]:
        def step(_: object, text: str) -> tuple:
            n = len(T.offsets_of(text))
            held = np.minimum(max_width, n - np.arange(n))
            word = np.repeat(np.arange(n, dtype=np.int32), held)
            return word, (np.arange(len(word)) - np.repeat(np.cumsum(held) - held, held)).astype(np.int32)

        return step

    return _in_rows(docs, key, text, "word:array<int>,width:array<int>", each)


def extract(docs: DataFrame, key: str, labels: list[str], load: Callable[[], SpanScorer], max_width: int = 12, threshold: float = 0.5, walk: bool = True,
            flat: bool = True, dup_label: bool = False, multi_label: bool = False, text: str = "text") -> DataFrame:
    """``key``, ``entities``: spans of up to ``max_width`` words whose sigmoid(logit) is ``threshold`` or more, by (start, end, label).

    With ``walk`` those that survive it, as in ``greedy``; without, all, by (word, width, label). An entity has ``start``,
    ``end``, ``word``, ``width``, ``text``, ``label``, ``score``. A text without spans has an empty array.
    """
    if max_width < 1 or not labels or not 0 <= threshold <= 1:
        raise ValueError("give labels, a max_width of 1 at least and a threshold from 0 to 1")

    # Spans that begin with one word overlap. Where overlapping ones never both stay, the first of the best of each word is
    # all that the walk can keep of it, whatever came before, so the others need not be walked over.
    alone = walk and (flat or not multi_label)

    def each() -> Callable[[object, str], tuple]:
        scorer = load()

        def step(key: object, text: str) -> tuple:
            at, found = T.offsets_of(text), []
            for first in range(0, len(at), WORDS):
                stop = min(first + WORDS, len(at))
                score = -np.asarray(scorer.span_logits(key, text, at, first, stop, max_width, labels), dtype=np.float64)
                score = 1.0 / (1.0 + np.exp(score, out=score))
                if stop + max_width > len(at):
                    # Spans beyond the last word.
                    score[np.arange(first, stop)[:, None] + np.arange(max_width) >= len(at)] = -1.0
                if alone:
                    best = score.reshape(stop - first, -1).argmax(axis=1)
                    width, label = np.divmod(best, len(labels))
                    own = score[np.arange(stop - first), width, label]
                    word = np.flatnonzero(own >= threshold)
                    width, label, own = width[word], label[word], own[word]
                else:
                    word, width, label = np.nonzero(score >= threshold)
                    own = score[word, width, label]
                found.append((word + first, width, label, own))
            word, width, label, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 4
            starts, ends = at[word, 0], at[word + width, 1]
            if walk:
                # Words follow each other, so (word, width, label) is the order of (start, end, label).
                kept = np.array(_walk(starts.tolist(), ends.tolist(), label.tolist(), score.tolist(), flat, dup_label, multi_label), dtype=np.int64)
                word, width, label, score, starts, ends = (x[kept] for x in (word, width, label, score, starts, ends))
            cut = [text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            return starts, ends, word.astype(np.int32), width.astype(np.int32), cut, label.astype(np.int32), score

        return step

    fields = "start:array<int>,end:array<int>,word:array<int>,width:array<int>,text:array<string>,place:array<int>,score:array<double>"
    named = F.transform("place", lambda i: F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1)).alias("label")
    return _in_rows(docs, key, text, fields, each).select(key, F.arrays_zip("start", "end", "word", "width", "text", named, "score").alias("entities"))


def tag_words(docs: DataFrame, key: str, labels: list[str], load: Callable[[], Tagger], text: str = "text") -> DataFrame:
    """``key``, ``place`` (of the first greatest logit in ``labels``) and ``prob`` of every word as two arrays."""

    def each() -> Callable[[object, str], tuple]:
        tagger = load()
        return lambda key, text: _tagged(tagger, key, text)

    return _in_rows(docs, key, text, "place:array<int>,prob:array<double>", each)


def _tagged(tagger: Tagger, key: object, text: str) -> tuple[np.ndarray, np.ndarray]:
    logits = np.asarray(tagger.tag_logits(key, text, T.offsets_of(text)), dtype=np.float64)
    if not len(logits):
        return np.zeros(0, dtype=np.int32), np.zeros(0)
    return logits.argmax(axis=1).astype(np.int32), 1.0 / np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1)


def tag_spans(docs: DataFrame, key: str, labels: list[str], load: Callable[[], Tagger], threshold: float = 0.0, text: str = "text") -> DataFrame:
    """``key``, ``spans``: the spans of each text's tagged words, as ``bio_spans`` has them: ``label``, ``first_pos``, ``last_pos``, ``score``."""
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is from 0 to 1")
    bare = [None if x == "O" else x[2:] if x[:2] in ("B-", "I-") else x for x in labels]
    categories = sorted({x for x in bare if x is not None})
    category = np.array([-1 if x is None else categories.index(x) for x in bare])
    inside = np.array([x.startswith("I-") for x in labels])

    def each() -> Callable[[object, str], tuple]:
        tagger = load()

        def step(key: object, text: str) -> tuple:
            place, prob = _tagged(tagger, key, text)
            own = category[place] if len(place) else np.zeros(0, dtype=np.int64)
            before = np.concatenate([[-1], own[:-1]])
            there = np.flatnonzero(own >= 0)
            begins = np.flatnonzero(~(inside[place[there]] & (before[there] == own[there]))) if len(there) else np.zeros(0, dtype=np.int64)
            score = np.minimum.reduceat(prob[there], begins) if len(begins) else np.zeros(0)
            first, last = there[begins], there[np.append(begins[1:], len(there)) - 1] if len(begins) else there[:0]
            kept = score >= threshold
            return own[first][kept].astype(np.int32), first[kept].astype(np.int32), last[kept].astype(np.int32), score[kept]

        return step

    fields = "place:array<int>,first_pos:array<int>,last_pos:array<int>,score:array<double>"
    named = F.transform("place", lambda i: F.element_at(F.array(*[F.lit(x) for x in categories] or [F.lit("")]), i + 1)).alias("label")
    return _in_rows(docs, key, text, fields, each).select(key, F.arrays_zip(named, "first_pos", "last_pos", "score").alias("spans"))


def word_table(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key``, ``pos``, ``start``, ``end``, ``text``, ``after`` of every word."""
    return docs.select(key, F.posexplode(T.word_spans(text)).alias("pos", "w")).select(key, "pos", "w.*")


def enumerate_spans(docs: DataFrame, key: str, max_width: int = 12, text: str = "text") -> DataFrame:
    """Every run of up to ``max_width`` words: ``key``, ``word``, ``width`` (0: one word), ``start``, ``end``, ``text``.

    Words stay an array, so runs need no join and no shuffle; each word goes on with the ``max_width`` words from it
    alone, so a long text makes no rows as long as itself.
    """
    if max_width < 1:
        raise ValueError("max_width is 1 at least")
    words = docs.select(key, T.word_spans(text).alias("w"))
    near = F.transform("w", lambda x, i: F.struct(i.alias("word"), F.slice("w", i + 1, max_width).alias("near")))
    starts = words.select(key, F.explode_outer(near).alias("s")).filter(F.col("s").isNotNull()).select(key, "s.*")
    each = starts.withColumn("width", F.explode(F.sequence(F.lit(0), F.size("near") - 1)))
    first, last = F.get("near", F.lit(0)), F.get("near", F.col("width"))
    # Joined from the words: cutting each span out of the whole text would read the text once per span.
    before = F.transform(F.slice("near", F.lit(1), F.col("width")), lambda x: F.concat(x["text"], x["after"]))
    whole = F.concat(F.array_join(before, ""), last["text"])
    return each.select(key, "word", "width", first["start"].alias("start"), last["end"].alias("end"), whole.alias("text"))


def label_spans(spans: DataFrame, labels: list[str], logit: Callable[[Column, Column], Column], threshold: float = 0.5) -> DataFrame:
    """Spans with each label whose sigmoid(logit) is ``threshold`` or more: ``label_pos``, ``label``, ``score``."""
    if not labels or not 0 <= threshold <= 1:
        raise ValueError("give labels and a threshold from 0 to 1")
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("label_pos"), F.lit(x).alias("label")) for i, x in enumerate(labels)]))
    each = spans.withColumn("__l", listed).select("*", "__l.*").drop("__l")
    return each.withColumn("score", T.sigmoid(logit(F.struct(*spans.columns), F.col("label_pos")))).filter(F.col("score") >= threshold)


def greedy(found: DataFrame, key: str, flat: bool = True, dup_label: bool = False, multi_label: bool = False) -> DataFrame:
    """``key``, ``entities``: per document the spans that survive the walk over (start, end, label) order.

    Each next span meets the last survivor only: if both may stay, the survivor is given out; else a next with a
    strictly higher score takes its place. Disjoint spans may both stay; overlapping ones never with ``flat``, with
    equal labels only if ``dup_label``, else only if ``multi_label``. A document's candidates meet in one task.
    """

    @F.pandas_udf("array<int>")
    def walk(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([_walk(*(x.tolist() for x in c), flat, dup_label, multi_label) for c in zip(*columns, strict=True)])

    one = F.struct("start", "end", "word", "width", "label_pos", "label", "score", "text")
    whole = found.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("c"))
    kept = whole.withColumn("k", walk(F.col("c.start"), F.col("c.end"), F.col("c.label_pos"), F.col("c.score")))
    entity = lambda e: F.struct(*[e[x].alias(x) for x in ("start", "end", "text", "label", "score")])
    return kept.select(key, F.transform("k", lambda i: entity(F.get("c", i))).alias("entities"))


def _walk(starts: list, ends: list, labels: list, scores: list, flat: bool, dup_label: bool, multi_label: bool) -> list[int]:
    """Places of the survivors among candidates in order."""
    out, p = [], -1
    for i in range(len(starts)):
        if p < 0:
            p = i
            continue
        apart = starts[i] >= ends[p] or starts[p] >= ends[i]
        if apart or (not flat and multi_label and (dup_label or labels[i] != labels[p])):
            out.append(p)
            p = i
        elif scores[p] < scores[i]:
            p = i
    return [*out, p] if p >= 0 else out


def bio_spans(tokens: DataFrame, key: str, pos: str = "pos", label: str = "label", prob: str = "prob", threshold: float = 0.0) -> DataFrame:
    """``key``, ``label``, ``first_pos``, ``last_pos``, ``score``: the spans of a tagged token sequence, by rising score floor.

    A token with a category starts a span unless it is ``I-`` of the category of the token before it. A span's score is
    its least probability; spans below ``threshold`` go. Padding and special tokens have label ``O`` or null.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("threshold is from 0 to 1")
    w = Window.partitionBy(key).orderBy(pos)
    tagged = tokens.withColumn("__c", T.bio_category(F.col(label)))
    carries = F.coalesce(F.col(label).startswith("I-") & (F.lag("__c").over(w) == F.col("__c")), F.lit(False))
    begun = tagged.withColumn("__new", (F.col("__c").isNotNull() & ~carries).cast("int")).withColumn("__span", F.sum("__new").over(w))
    spans = begun.filter(F.col("__c").isNotNull()).groupBy(key, "__span").agg(
        F.first("__c").alias("label"), F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.min(prob).alias("score"),
    )
    return spans.filter(F.col("score") >= threshold).drop("__span")


def span_labels(labels: DataFrame, label: str = "label") -> DataFrame:
    """The distinct categories of BIO labels, ``O`` left out, in order."""
    return labels.select(T.bio_category(F.col(label)).alias("category")).filter(F.col("category").isNotNull()).distinct().orderBy("category")
