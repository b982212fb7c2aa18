import functools
import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

from textloom.llm import token_counts as T

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@functools.cache
def other_library():
    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def brute(text, sections, rule):
    """By the offsets of another library."""
    t = other_library()
    spans = t.encode(text, add_special_tokens=False).offsets if text else []
    owner = [next((k for k, (a, b) in enumerate(sections) if a <= i < b), -1) for i in range(len(text))]
    counts, crossing = Counter(), 0
    for a, b in spans:
        held = Counter(owner[a:b])
        crossing += len(held) > 1
        if rule == "first":
            counts[owner[a]] += 1
        elif rule == "most":
            counts[max(held, key=held.get)] += 1
        else:
            for k, n in held.items():
                counts[k] += n / (b - a)
    return len(spans), crossing, counts[-1], [counts[k] for k in range(len(sections))]


def test_against_another_library(spark):
    rng = random.Random(1)
    parts = ["hello ", "été", " 😀", "\n", "\n\n", "  ", "under_score", "Donaudampfschiff", "12345", "日本"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(60)]
    rows = []
    for i, t in enumerate(texts):
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 4)))
        rows.append((i, t, [(a, b) for a, b in zip(cuts, cuts[1:], strict=False)][:2], "x"))
    df = spark.createDataFrame(rows, "doc_id long, text string, parts array<struct<start:int,end:int>>, outside string")
    for rule in T.RULES:
        for r in T.count_tokens(df, RANKS, sections="parts", rule=rule).collect():
            n, crossing, outside, each = brute(r.text, rows[r.doc_id][2], rule)
            assert (r.n_tokens, r.n_crossing) == (n, crossing)
            assert r.outside == pytest.approx(outside) and r.section_tokens == pytest.approx(each)


def test_lines_nulls_long_texts_and_no_rows(spark):
    texts = [None, "", "a\nb\n\nc", "word " * 200000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r for r in T.count_tokens(df, RANKS).collect()}
    assert got[None].n_tokens == got[""].n_tokens == 0 and got[None].section_tokens == []
    assert len(got[texts[2]].section_tokens) == 4 and sum(got[texts[2]].section_tokens) == got[texts[2]].n_tokens
    assert got[texts[3]].section_tokens == [got[texts[3]].n_tokens]
    assert T.count_tokens(df.limit(0), RANKS).count() == 0
    with pytest.raises(ValueError):
        T.count_tokens(df, RANKS, rule="last")


def test_long_runs_of_any_character(spark, monkeypatch):
    tokenizer = T.Tokenizer(T.read_ranks(RANKS))
    with monkeypatch.context() as m:
        m.setattr(T, "LONG_BLANK", re.compile(T.LONG_BLANK.pattern.replace("10000", "3")))
        rng = random.Random(2)
        for _ in range(400):
            text = "".join(rng.choice(["a", "b1", ".", " ", "\n", "\t", "\u3000"]) * rng.choice([1, 1, 2, 3, 9]) for _ in range(rng.randint(0, 14)))
            assert tokenizer.encode(text) == tokenizer.encoding.encode_ordinary(text)
    for c in " \t\na^\u3000":
        for text in (c * 20000, f"x{c * 20000}y"):
            assert tokenizer.encode(text) == tokenizer.encoding.encode_ordinary(text)
    texts = [f"{c * 1_000_000}x" for c in " \t\na^\u3000"] + [" " * 1_000_000]
    rows = T.count_tokens(spark.createDataFrame([(t,) for t in texts], "text string"), RANKS).select("n_tokens", "section_tokens", "text").collect()
    assert len(rows) == len(texts) and all(r.n_tokens == sum(r.section_tokens) > 1000 for r in rows)


def test_null_sections(spark):
    schema = "doc_id long, text string, parts array<struct<start:int,end:int>>"
    rows = [(1, "one two three", [(0, 3), None, (None, 9), (4, None), (4, 13)]), (2, "one", None), (3, None, [None]), (4, "", [])]
    got = {r.doc_id: r for r in T.count_tokens(spark.createDataFrame(rows, schema), RANKS, sections="parts").collect()}
    assert len(got[1].section_tokens) == 5 and list(got[1].section_tokens)[1:4] == [0, 0, 0]
    assert got[1].outside + sum(got[1].section_tokens) == got[1].n_tokens > 2
    assert (got[2].outside, list(got[2].section_tokens)) == (got[2].n_tokens, []) and (got[3].n_tokens, list(got[3].section_tokens)) == (0, [0])
