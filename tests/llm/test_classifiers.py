import random
import zlib

import numpy as np
import pytest

from textloom.llm import language, quality
from textloom.llm.common import sample_below

TABLES = "doc_id long, text string, lang string, score string"


def corpus(n=600):
    rng = random.Random(1)
    stems = {"aa": ["the", "ing", "wh", "tion"], "bb": ["sch", "ung", "über", "keit"], "cc": ["eau", "ç", "que", "ment"]}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(stems))
        words = ["".join(rng.choices(stems[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        good = rng.random() < 0.7
        docs.append((i, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words), lang if i % 5 else None, ""))
        labels.append((i, int(good), "x"))
    return docs, labels


def out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


EDGES = [(None, None, None, None), (9000, "", "aa", ""), (9001, "12 345 !!", None, ""), (9002, "the ing " * 100000, None, ""), (5, "the", "aa", ""), (5, "the", "aa", "")]


def test_languages_of_held_out_rows(spark):
    docs, _ = corpus()
    df = spark.createDataFrame(docs + EDGES, TABLES)
    rows = language.identify(df).collect()
    assert len(rows) == len(docs) + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    truth = {d[0]: (d[1], d[2]) for d in docs}
    stem = {"the": "aa", "ing": "aa", "sch": "bb", "ung": "bb", "eau": "cc", "que": "cc"}
    held = [r for r in rows if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert held and all(r.held_out == out(r.doc_id) for r in rows if r.doc_id is not None)
    right = [r.lang_pred == (truth[r.doc_id][1] or next(v for k, v in stem.items() if k in truth[r.doc_id][0].lower())) for r in held]
    assert np.mean(right) > 0.98
    by = {r.doc_id: r.lang_pred for r in rows}
    assert (by[None], by[9000], by[9001], by[9002]) == ("und", "und", "und", "aa")
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and kept.filter("doc_id IN (9000, 9001) OR doc_id IS NULL").count() == 0 and kept.count() > 0.95 * len(docs)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None, "")], TABLES)
    assert [r.lang_pred for r in language.identify(df).collect()] == ["und"]
    assert language.identify(df.limit(0)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in quality.classify(df, labels).collect()] == [(0.5, 0)]


def test_codewords_differ():
    for n in (2, 3, 6, 7, 40):
        code = language.codewords(n)
        assert len({tuple(r) for r in code}) == n and (np.abs(code.sum(axis=0)) < n).all()


def test_quality_of_held_out_rows(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs + EDGES, TABLES)
    lab = spark.createDataFrame([*labels, (1, None, None), (None, 1, None), (3, labels[3][1], None)], "doc_id long, quality int, text string")
    rows = quality.classify(df, lab).collect()
    assert len(rows) == len(docs) + len(EDGES) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert quality.keep_good(df, lab).columns == df.columns


def test_isotonic_curve_rises():
    x, y = quality.isotonic(np.arange(6.0), np.array([1, 0, 2, 1, 3, 3.0]), np.array([2, 2, 4, 2, 4, 3.0]))
    assert (np.diff(y) > 0).all() and y[-1] == 1 and y[0] == pytest.approx(0.25)


def test_feature_kernel_is_gaussian():
    rng = np.random.default_rng(0)
    w, b = rng.standard_normal((4, 20000)), rng.uniform(0, 2 * np.pi, 20000)
    m = quality.Model(np.zeros(4), np.ones(4), w, b, np.zeros(1), (np.zeros(1), np.zeros(1)))
    x = rng.standard_normal((2, 4))
    z = m.features(x)[:, :-1]
    assert z[0] @ z[1] == pytest.approx(np.exp(-((x[0] - x[1]) ** 2).sum() / 2), abs=0.03)


def test_samples_of_any_size():
    for limit, n in ((3000, 0), (3000, 10), (3000, 3001), (3000, 10**6), (3000, 10**11), (20_000, 10**14)):
        rate = (sample_below(limit, n) + 2**63 + 1) / 2**64
        assert rate * max(n, 1) == pytest.approx(min(limit, max(n, 1)), rel=1e-3)
        assert -(2**63) <= sample_below(limit, n) < 2**63


def test_what_a_letter_is():
    assert [language.trigrams(t) is None for t in (None, "", "12 _ !", "½ ²", "Ⅷ ①", "\u0301", "a", "½é", "字", "x²")] == [True] * 6 + [False] * 4
    assert (language.trigrams("a½b²") == language.trigrams("a b")).all()


def test_three_hundred_languages(spark):
    rng = random.Random(5)
    docs, truth = [], {}
    for k in range(300):
        stems = ["".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(2)) for _ in range(6)]
        for _ in range(6):
            i = len(docs)
            docs.append((i, " ".join(rng.choices(stems, k=12)), f"l{k:03d}", None))
            truth[i] = f"l{k:03d}"
    rows = language.identify(spark.createDataFrame(docs, TABLES)).collect()
    assert len({r.lang_pred for r in rows}) > 290
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if not r.held_out]) > 0.98


def test_decoding_like_a_plain_one(spark):
    """Weights from all rows at once, and the codeword of the least weighted loss by loops."""
    docs, _ = corpus(300)
    df = spark.createDataFrame(docs, TABLES)
    model = language.fit(df)
    sums = {}
    for i, text, lang, _ in docs:
        if lang and not out(i):
            c = language.trigrams(text)
            sums[lang] = sums.get(lang, 0) + c / np.sqrt(c.sum())
    names = sorted(sums)
    share = np.array([(sums[x] + 0.01) / (sums[x] + 0.01).sum() for x in names])
    code = language.codewords(len(names))
    weights = np.array([[np.log(share[code[:, b] > 0, k].mean() / share[code[:, b] < 0, k].mean()) for b in range(code.shape[1])] for k in range(0, language.BUCKETS, 16)])
    assert model.languages == names and np.allclose(model.weights[::16], weights)
    gap = [np.mean([code[m, b] * (share[m] @ model.weights[:, b]) for m in range(len(names))]) for b in range(code.shape[1])]
    assert np.allclose(model.reliability, np.array(gap) / np.mean(gap))
    for _, text, _, _ in docs[:60]:
        c = language.trigrams(text)
        losses = []
        for m in range(len(names)):
            margin = [sum(c[k] * model.weights[k, b] for k in np.flatnonzero(c)) / c.sum() ** 0.5 for b in range(code.shape[1])]
            losses.append(sum(r * np.log1p(np.exp(-code[m, b] * margin[b])) for b, r in enumerate(model.reliability)))
        lang, score, ambiguous = model.predict(text)
        assert lang == names[int(np.argmin(losses))] and score == pytest.approx(1 / sum(np.exp(min(losses) - x) for x in losses))
        assert ambiguous == (sorted(losses)[1] - min(losses) < language.AMBIGUOUS)


def test_scores_like_one_plain_fit(spark):
    """The kernel ridge scores from all learnable rows in one matrix, calibrated by the max-min formula."""
    docs, labels = corpus(400)
    rng = random.Random(8)
    labels = [(i, q if rng.random() < 0.85 else 1 - q) for i, q, _ in labels]
    df, lab = spark.createDataFrame(docs, TABLES), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(df, lab).collect()}
    model = quality.fit(df, lab)
    known = [i for i, _ in labels if not out(i)]
    apart = {r.id for r in spark.createDataFrame([(i,) for i in known], "id long").selectExpr("id", "pmod(xxhash64(id, 2), 4) = 0 AS apart").collect() if r.apart}
    stats = {i: quality.statistics(t) for i, t, _, _ in docs}
    x = np.array([stats[i] for i in known])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale**2, np.maximum(x.var(axis=0), 1e-9), atol=1e-7)
    fitted, y = [i for i in known if i not in apart], dict(labels)
    z = np.hstack([np.sqrt(2 / 256) * np.cos(np.clip((np.array([stats[i] for i in fitted]) - model.mean) / model.scale, -6, 6) @ model.weights + model.phases), np.ones((len(fitted), 1))])
    beta = np.linalg.solve(z.T @ z + quality.RIDGE * len(z) * np.eye(257), z.T @ np.array([y[i] for i in fitted]))
    assert np.allclose(model.raw(x), model.features(x) @ beta, atol=1e-5)
    at = np.clip(np.searchsorted(np.linspace(-0.5, 1.5, 513), model.raw(np.array([stats[i] for i in sorted(apart)]))) - 1, 0, 511)
    bins = sorted(set(at.tolist()))
    ys, ns = [[float(sum(v[at == b])) for b in bins] for v in (np.array([y[i] for i in sorted(apart)]), np.ones(len(at)))]
    level = [max(min(sum(ys[a : b + 1]) / sum(ns[a : b + 1]) for b in range(k, len(bins))) for a in range(k + 1)) for k in range(len(bins))]
    assert len(set(np.round(level, 9))) == len(model.curve[1]) and np.allclose(sorted(set(np.round(level, 9))), model.curve[1])
    assert all(got[i] == pytest.approx(float(model.score(stats[i][None])[0])) for i in stats)
