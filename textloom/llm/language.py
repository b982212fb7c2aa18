"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary classifier weighs hashed character trigrams by the
log odds of the languages with +1 against those with -1. A text's margins are decoded by loss: the codeword with the
least reliability-weighted logistic loss is the language, the score is its share of exp(-loss), and a text whose best
two losses lie close is marked ambiguous.

Counts come from a bounded sample of labelled rows (about ``per_language`` rows of each language, picked by a hash of
the id). They are summed by language and bucket, and then by bucket and bit, in Spark; the driver gets the names of the
languages, of which every one can be predicted, and a row of bit weights for each bucket. Every text is predicted
whole. Texts that are null or have no letter (Unicode category L) are ``und`` with score 0; so is every text if nothing
is labelled. With one language only, every other text is of it with score 1. Ties go to the first name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import add_columns, cut, free_name, sample_below

PER_LANGUAGE = 3000
BUCKETS = 1 << 13
#: Characters that are hashed at once, so that a very long text takes no more memory.
CHUNK = 1 << 20
AMBIGUOUS = 0.35
SEED = 5
#: What a language has in every bucket beside its counts.
SPARE = 0.01
_NOT_WORDS = re.compile(r"[\W\d_]+")
_NOT_LETTERS = regex.compile(r"\P{L}+")


def trigrams(text: str | None) -> np.ndarray | None:
    """Counts of the hashed letter trigrams of the lower-cased text, or None if there is no letter."""
    letters = _NOT_WORDS.sub(" ", text.lower()).strip() if text else ""
    if not letters.replace(" ", "").isalpha():  # rare: numbers that are no digits, or nothing at all
        letters = _NOT_LETTERS.sub(" ", letters).strip()
    if not letters:
        return None
    letters = f" {letters} "
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, len(letters) - 2, CHUNK):
        codes = np.frombuffer(letters[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        mixed = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
        counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x27D4EB2F) >> np.uint32(19), minlength=BUCKETS)
    return counts


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: all splits up to 6 languages, else random ones far apart.

    Up to 512 languages the best of 50 codes is taken; beyond, any one, since random codewords of this length differ
    in about half their bits.
    """
    if n <= 6:
        bits = [[1 if b >> i & 1 else -1 for i in range(n)] for b in range(1, 1 << (n - 1))]
        return np.array(bits, dtype=float).T.reshape(n, -1)
    best, far = None, -1
    for k in range(50 if n <= 512 else 1):
        code = np.random.default_rng([SEED, n, k]).choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        near = (code.shape[1] - (code @ code.T - np.eye(n) * 1e9).max()) / 2 if n <= 512 else 0
        if near > far:
            best, far = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    reliability: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = trigrams(text)
        if counts is None or not self.languages:
            return "und", 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        margins = counts @ self.weights / np.sqrt(counts.sum())
        losses = (np.logaddexp(0, -self.code * margins) * self.reliability).sum(axis=1)
        best, second = np.partition(losses, 1)[:2]
        share = np.exp(best - losses)
        return self.languages[int(losses.argmin())], float(1 / share.sum()), bool(second - best < AMBIGUOUS)


def learned(doc_id: Column) -> Column:
    """Whether a row may be learned from; False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Learn from the rows of ``docs`` that may be learned from and have a ``lang``."""
    usable = docs.select(F.col("doc_id").alias("id"), "text", "lang").filter(F.col("lang").isNotNull() & learned(F.col("doc_id")))
    # One row per language.
    rates = [(r.lang, sample_below(per_language, r.n)) for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()]
    spark = docs.sparkSession
    limits = F.broadcast(spark.createDataFrame(rates, "lang string, below bigint"))
    sample = usable.join(limits, "lang").filter(F.xxhash64("id", F.lit(3)) <= F.col("below"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b["text"], b["lang"], strict=True):
                if (c := trigrams(text)) is not None:
                    # Each text counts alike up to its length's root, so a few very long ones do not rule.
                    sums[lang] = sums.get(lang, 0) + c / np.sqrt(c.sum())
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": c[at]})

    counts = cut(sample.select("text", "lang").mapInPandas(run, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    totals = {r.lang: r.n + SPARE * BUCKETS for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    code = codewords(len(languages))
    sent = spark.sparkContext.broadcast(({x: i for i, x in enumerate(languages)}, np.array([totals[x] for x in languages]), code > 0))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, total, plus = sent.value
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            at = b["lang"].map(place).to_numpy(dtype=np.int64)
            share = b["n"].to_numpy() / total[at]
            for bucket, i, x in zip(b["bucket"].tolist(), at.tolist(), share.tolist(), strict=True):
                own = sums.setdefault(bucket, np.zeros(plus.shape[1] + 1))
                own[-1] += x
                own[:-1][plus[i]] += x
        yield pd.DataFrame({"bucket": list(sums), "shares": list(sums.values())})

    # A bucket's row: the shares of the languages with +1 in each bit, then of all languages.
    rows = counts.repartition("bucket").mapInPandas(bits, "bucket int, shares array<double>").collect()
    shares = np.zeros((BUCKETS, code.shape[1] + 1))
    shares[[r.bucket for r in rows]] = [r.shares for r in rows]
    spare = SPARE / np.array([totals[x] for x in languages])
    plus = shares[:, :-1] + spare @ (code > 0)
    minus = shares[:, -1:] + spare.sum() - plus
    odds = np.log(plus / (code > 0).sum(axis=0)) - np.log(minus / (code < 0).sum(axis=0))
    # A bit is as reliable as its classifier separates the languages on average.
    gap = (odds * (plus - minus)).sum(axis=0) / len(languages)
    return Model(languages, code, odds, gap / gap.mean() if gap.size else gap)


FIELDS = [("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")]


def add_language(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with the predicted language, its score and the ambiguity mark; columns with these names are replaced."""

    def make() -> Callable[[pd.Series], pd.DataFrame]:
        return lambda texts: pd.DataFrame([model.predict(t) for t in texts], columns=list(names))

    return add_columns(docs, [text], [(n, t) for n, (_, t) in zip(names, FIELDS, strict=True)], make)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``ambiguous`` for each row of ``docs``."""
    found = add_language(docs.select("doc_id", "text"), fit(docs))
    held_out = F.col("doc_id").isNotNull() & ~learned(F.col("doc_id"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is found and not ambiguous, with the columns of ``docs``.

    Null texts and those without letters go. Where two languages tie the text is ambiguous and goes; repeated rows stay
    or go alike, an empty table stays empty. If no row has a ``lang`` to learn from, every row goes.
    """
    names = tuple(free_name(docs, n) for n in ("__lang", "__score", "__ambiguous"))
    return add_language(docs, fit(docs), "text", names).filter(f"{names[0]} <> 'und' AND NOT {names[2]}").drop(*names)
