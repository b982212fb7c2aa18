"""Model tokens are taken in slices, so that a task never holds the tokens of a whole batch."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.functions import tokens
from textloom.plans.more import SPECIALS, TOKENIZER


def test_slices_are_small_and_whole():
    rng = random.Random(2)
    texts = pa.array([None if i % 9 == 0 else "ä" * rng.choice([0, 5, 3000, 200_000]) for i in range(700)], pa.string())
    others = pa.array([None if i % 5 else "b" * 700 for i in range(700)], pa.string())
    found, size = list(tokens._slices(texts, others)), lambda i: len((texts[i].as_py() or "").encode()) + len(others[i].as_py() or "")
    assert [i for at, n in found for i in range(at, at + n)] == list(range(700))
    assert all(n <= tokens.TEXTS_ONCE and (n == 1 or sum(map(size, range(at, at + n))) <= tokens.BYTES_ONCE) for at, n in found)
    assert [n for _, n in tokens._slices(pa.array([None] * 500, pa.string()))] == [200, 200, 100]
    assert list(tokens._slices(pa.array([], pa.string()))) == []


def test_tokens_of_many_texts(spark):
    """The same as from the tokenizer one text at a time, over several slices, with nulls and pairs."""
    rng = random.Random(3)
    texts = [None if i % 50 == 3 else " ".join(rng.choices(["the", "Ünder", "x9", "don't", "😀"], k=rng.choice([0, 3, 40, 3000]))) for i in range(450)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)
    plain = Tokenizer.from_file(TOKENIZER)
    for r in df.select("i", tokens.encode(TOKENIZER, 64, SPECIALS)(F.col("text")).alias("e")).select("i", "e.*").collect():
        e = plain.encode(texts[r.i] or "", add_special_tokens=False)
        assert r.input_ids == [SPECIALS[0], *e.ids[:62], SPECIALS[1]] and r.word_ids == [-1, *e.word_ids[:62], -1]
        assert list(zip(r.starts, r.ends, strict=True)) == [(0, 0), *e.offsets[:62], (0, 0)] and set(r.attention_mask) == {1} and set(r.type_ids) == {0}
    both = df.select(tokens.encode(TOKENIZER, 64, SPECIALS)(F.col("text")).alias("e"), tokens.encode(TOKENIZER, 64, SPECIALS, places=False)(F.col("text")).alias("f"))
    assert "starts" not in both.select("f.*").columns and both.filter("e.input_ids <> f.input_ids OR e.type_ids <> f.type_ids").count() == 0
    asked = F.when(F.col("i") % 2 == 0, F.col("text"))
    for r in df.select("i", tokens.encode(TOKENIZER, 64, SPECIALS)(F.lit("what is it"), asked).alias("e")).select("i", "e.*").collect():
        first, second = (plain.encode(t or "", add_special_tokens=False).ids for t in ("what is it", texts[r.i]))
        pair = r.i % 2 == 0 and texts[r.i] is not None
        assert r.input_ids == [SPECIALS[0], *first, SPECIALS[1]] + ([*second[: 64 - 3 - len(first)], SPECIALS[1]] if pair else [])
