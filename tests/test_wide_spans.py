import math

from textloom.plans import catalog

LENGTHS = {1: 1, 2: 3, 3: 5, 4: 12, 5: 13, 6: 40}


def plain(doc_id, n):
    """(word, width, label position) of every span of up to 12 words with a score of 0.5 or more."""
    logit = lambda word, width, p: (doc_id + word * 7 + width * 13 + p * 29) % 41 / 4.0 - 8.7
    every = [(i, w, p) for i in range(n) for w in range(min(12, n - i)) for p in range(3)]
    return [x for x in every if 1 / (1 + math.exp(-logit(*x))) >= 0.5]


def walked(found, flat):
    """The survivors of the walk over candidates in order, each against the last survivor."""
    score = lambda c: c[2]
    out, last = [], None
    for c in found:
        if last is None:
            last = c
        elif c[0] >= last[1] or (not flat and c[3] != last[3]):
            out.append(last)
            last = c
        elif score(last) < score(c):
            last = c
    return out + [last] if last else out


def test_spans_of_up_to_twelve_words(spark, tmp_path):
    docs = [(i, " ".join(f"w{k:03d}" for k in range(n))) for i, n in LENGTHS.items()]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    want = {i: sum(min(12, n - k) for k in range(n)) for i, n in LENGTHS.items()}
    assert {r.doc_id: r.n_spans for r in rows("span_enumerate_w12")} == want
    got = sorted((r.doc_id, r.word, r.width, catalog.LABELS.index(r.label)) for r in rows("ner_threshold_w12"))
    assert got == [(i, *x) for i, n in LENGTHS.items() for x in sorted(plain(i, n))]
    assert max(width for _, _, width, _ in got) == 11
    for name, flat in (("ner_greedy_flat_w12", True), ("ner_greedy_multi_w12", False)):
        kept = []
        for i, n in LENGTHS.items():
            found = [(w * 5, (w + x) * 5 + 4, ((i + w * 7 + x * 13 + p * 29) % 41), p) for w, x, p in plain(i, n)]
            kept += [(i, s, e, catalog.LABELS[p]) for s, e, _, p in walked(sorted(found, key=lambda c: (c[0], c[1], c[3])), flat)]
        assert sorted((r.doc_id, r.start, r.end, r.label) for r in rows(name)) == sorted(kept)
