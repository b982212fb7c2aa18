import math
import random
import re
import sys
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import neural_lm, recurrent

SCHEMA = "doc_id long, text string, word string, n long, row long"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) + [""]


def plain(rows):
    counts = Counter()
    for i, text in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(text))
    n, v = sum(counts.values()), len(counts)
    return {
        i: (i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(tokens(t)), sum(w in counts for w in tokens(t)), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)))
        for i, t in rows
    }


def rows():
    words = ["alpha", "BETA", "gamma", "délta", "İx", "e\x0bf", "the the the"]
    out = [(i, " ".join(words[(i * k + k) % 7] for k in range(i % 9)) + f" rare{i}") for i in range(300)]
    return out + [(None, "Alpha null"), (1000, None), (1001, ""), (1002, " \n"), (1003, "long " * 30_000), (1004, "x" * 200_000)]


def test_base_scores_and_counts(spark):
    given = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows()], SCHEMA)
    got = {r.doc_id: r for r in neural_lm.score_documents(given, lookup=5, model=3).collect()}
    want = plain(rows())
    assert set(got) == set(want)
    for i, (held_out, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score) and r.score < 0


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    got = neural_lm.score_documents(spark.createDataFrame([(i, "a b", "", 1, 1) for i in held], SCHEMA)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 2
    assert neural_lm.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_learns_order(spark):
    # Two kinds of text with words of their own: counts alone can't tell which goes with which.
    one, two = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    given = [(i, " ".join((one if i % 2 else two)[(i * 7 + k * k) % 30] for k in range(60)), "", 0, 0) for i in range(2000)]
    got = neural_lm.score_documents(spark.createDataFrame(given, SCHEMA), every=1).filter("held_out").collect()
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got)


def test_every_training_row_is_trained_on(spark, monkeypatch):
    """With the production parameters each row to learn from is in one round, whole, and no held-out row in any."""
    given = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows()] * 2, SCHEMA)
    learn = [t for i, t in rows() if i is None or zlib.crc32(str(i).encode()) % 5 != 1] * 2
    used, trained = [], neural_lm.trained

    def looking(net, texts, vocab, rounds):
        held = texts.filter(f"round BETWEEN 0 AND {rounds - 1}").selectExpr("held_out", "size(ids) AS n", "n_tokens").collect()
        used.extend(r.n for r in held)
        assert all(r.n == r.n_tokens and not r.held_out for r in held)
        return trained(net, texts, vocab, rounds)

    monkeypatch.setattr(neural_lm, "trained", looking)
    got = neural_lm.score_documents(given).collect()
    assert sorted(used) == sorted(len(tokens(t)) for t in learn) and len(got) == 2 * len(rows())


def test_scores_whatever_is_scored_at_once(spark, monkeypatch):
    given = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows()], SCHEMA).coalesce(1)
    counts = neural_lm.word_counts(given)
    vocab, _ = neural_lm.vocabulary(counts)
    net = recurrent.Network.new(vocab.ids[1], 4, 1)
    got = []
    for some in (1 << 21, 50, 1):
        monkeypatch.setattr(neural_lm, "TOKENS", some)
        found = neural_lm.scored(neural_lm.encoded(given, vocab), net, vocab).collect()
        got.append({r.doc_id: r.score for r in found})
        assert len(found) == len(rows())
    assert got[1] == pytest.approx(got[0], rel=1e-4) and got[2] == pytest.approx(got[0], rel=1e-4)


def small(ids=20, hidden=5):
    net = recurrent.Network.new(np.arange(ids, 0, -1), hidden, 1)
    return recurrent.Network(*[getattr(net, n).astype(np.float64) for n in net.NAMES])


def test_probabilities_sum_to_one_and_windows_change_nothing():
    net = small()
    states = np.random.default_rng(0).standard_normal((3, 5))
    every = np.array([recurrent.log_probs(net, states, np.full(3, i))[0] for i in range(20)])
    assert np.exp(every).sum(axis=0) == pytest.approx(1, abs=1e-5)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 20, n).astype(np.int32) for n in (1, 200, 33, 7, 64)]
    alone = [recurrent.score(net, [d], 4)[0] for d in docs]
    assert recurrent.score(net, docs, 4, most=2) == pytest.approx(alone, rel=1e-4)
    far = small()
    far.to_word[:] = 200.0
    assert np.isfinite(recurrent.log_probs(far, states, np.array([1, 2, 3]))[0]).all()


def test_gradients():
    net = small()
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 20, n).astype(np.int32) for n in (7, 3, 12)]
    before, keep, targets, of = next(recurrent.windows(*recurrent.streams(docs, 2), 4, 20))
    state = np.zeros((before.shape[1], 5))
    grads, at, _, _ = recurrent.gradients(net, before, keep, targets, of >= 0, state)
    whole = np.zeros_like(net.embed)
    whole[at] = grads["embed"]
    grads["embed"] = whole

    def loss():
        states, _ = recurrent.forward(net, before, keep, state)
        return -recurrent.log_probs(net, states[of >= 0].astype(np.float64), targets[of >= 0])[0].mean()

    for n in net.NAMES:
        x = getattr(net, n)
        for _ in range(5):
            i = tuple(rng.integers(0, s) for s in x.shape)
            v, e = x[i], 1e-2
            x[i] = v + e
            up = loss()
            x[i] = v - e
            assert (up - loss()) / (2 * e) == pytest.approx(grads[n][i], abs=2e-5)
            x[i] = v


class Taken:
    """Stands for a table and keeps the function that its tasks run."""

    def select(self, *_):
        return self

    groupBy = agg = filter = select

    def mapInArrow(self, run, _):
        self.run = run
        return self


def counter(monkeypatch):
    monkeypatch.setattr(neural_lm, "cut", lambda df: df)
    return neural_lm.word_counts(Taken()).run


def seconds(run):
    start = time.process_time()
    run()
    return time.process_time() - start


def test_words_cost_less_than_a_dictionary_of_python(spark, monkeypatch):
    rng = random.Random(3)
    known = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(20_000)]
    texts = [" ".join(rng.choices(known, k=300)) for _ in range(2000)]
    run, batch = counter(monkeypatch), pa.record_batch({"text": texts})

    def plain():
        counts = Counter()
        for t in texts:
            counts.update(t.lower().split())

    took = min(seconds(lambda: list(run([batch]))) for _ in range(4))
    assert took < 0.75 * min(seconds(plain) for _ in range(4))


def test_word_counts_whatever_is_counted_at_once(spark, monkeypatch):
    """Only ASCII letters are lower-cased and only ASCII white space parts words."""
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", " A  b\x0bB\x0cc\rD ", "x\x1cy\x1fz", "É\xa0é\u2003e İ ǅ", "a\x85b", "one", "\none\n"] * 3
    want = Counter(w for t in texts for w in tokens(t))
    for most, held in ((1 << 23, 1 << 20), (7, 2), (1, 0)):
        monkeypatch.setattr(neural_lm, "BYTES", most)
        monkeypatch.setattr(neural_lm, "COUNTED", held)
        got = Counter()
        for b in counter(monkeypatch)([pa.record_batch({"text": pa.array(t, pa.string())}) for t in (texts[:11], texts[11:], [])]):
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got[word] += n
        assert +got == want


def test_few_calls_for_a_window():
    """Training calls few functions for a window, whatever the number of classes; operators of numpy are not counted."""
    net, rng, calls = recurrent.Network.new(np.arange(4098, 0, -1), 16, 1), np.random.default_rng(1), []
    docs = [rng.integers(0, 4098, 320).astype(np.int32) for _ in range(128)]
    ids, owner, lengths = recurrent.streams(docs, 128)
    before, keep, targets, of = next(recurrent.windows(ids, owner, lengths, 0))
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    recurrent.gradients(net, before, keep, targets, of >= 0, np.zeros((128, 16), dtype=np.float32))
    sys.setprofile(None)
    assert len(calls) < 250
