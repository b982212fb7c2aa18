import random
import tracemalloc

import pyarrow as pa
import pytest
import sentencepiece

from textloom.llm import pieces as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = ["", " ", "  two  spaces ", "Hello, world!", "naïve café 😀 日本語\n\ttab", "x" * 300, "ünïcödé nbsp", "a▁b", "The quick brown fox " * 50, "\x00\x7f", "    indented code()"]


@pytest.fixture(scope="module")
def encoder():
    v = P.Vocabulary.load(MODEL)
    return P.Encoder(v, P.DoubleArray({v.pieces[i]: i for i, k in enumerate(v.kinds) if k == "p"}))


def as_unigram(model: bytes) -> bytes:
    """The model with trainer_spec.model_type (field 2, within it field 3) set to unigram."""

    def varint(at):
        value = shift = 0
        while True:
            b = model[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(model):
        key, at = varint(at)
        size, body = varint(at)
        if key == 2 << 3 | 2:
            i = body
            while i < body + size:
                k, i = varint(i)
                if k == 3 << 3:
                    return model[:i] + b"\x01" + model[i + 1 :]
                n, i = varint(i)
                i += n if k & 7 == 2 else 0
        at = body + size
    raise AssertionError("no model type")


def test_never_worse_than_the_library_with_these_scores(encoder):
    sp = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(open(MODEL, "rb").read()))
    rng = random.Random(1)
    parts = ["the", "ing", " ", "  ", "ß", "é", "tion", "\n", "Q", "7", ".", "好", "wh"]
    total = lambda ids: sum(encoder.scores[i] for i in ids)
    same = 0
    texts = [*TEXTS, *["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(300)]]
    for t in texts:
        mine, theirs = encoder.encode(t), sp.encode(t)
        assert total(mine) >= total(theirs) and encoder.decode(mine) == sp.decode(theirs)
        same += mine == theirs
    assert same


def test_best_of_all_segmentations():
    v = P.Vocabulary(["<unk>", "a", "b", "ab", "ba", "aba", P.MARK, P.MARK + "a"], [0, -1, -1.1, -1.5, -2.5, -2.4, -0.5, -1.2], "uppppppp")
    enc = P.Encoder(v, P.DoubleArray({p: i for i, p in enumerate(v.pieces) if i}))

    def splits(s):
        if not s:
            yield 0.0, ()
        for n in range(1, len(s) + 1):
            head = s[:n]
            known = head in v.pieces[1:]
            if known or (n == 1 and head not in v.pieces):
                for score, rest in splits(s[n:]):
                    yield score + (v.scores[v.pieces.index(head)] if known else enc.penalty), (v.pieces.index(head) if known else 0, *rest)

    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choices("ab c", k=rng.randint(1, 8)))
        got = enc.encode(t)
        score = lambda ids: sum(v.scores[i] if i else enc.penalty for i in ids)
        assert score(got) == pytest.approx(max(splits(P.MARK + t.replace(" ", P.MARK)))[0])


def test_words_together_like_each_alone(encoder):
    """Many words in one lattice get the ids of the plain one, odd characters too, in fewer steps than places times piece lengths."""
    rng = random.Random(4)
    marks = [P.MARK, "a", "th", "e", "ing", "ß", "好", "\0", "😀", "\ud800", "Z", ".", "##", "x"]
    words = list({"".join(rng.choices(marks, k=rng.randint(1, 12)))[: P.LONGEST] for _ in range(3000)} | {"a", "\0", "好" * P.LONGEST})
    fresh = P.Encoder.__new__(P.Encoder)
    fresh.__dict__ |= encoder.__dict__ | {"known": {}}
    walks, edges = [], P.Encoder.edges
    fresh.edges = lambda codes: walks.append(len(codes)) or edges(fresh, codes)
    fresh.learn(list(words))
    assert len(fresh.known) == len(words) and all(fresh.known[w] == encoder.viterbi(w) for w in words)
    assert walks == [sum(map(len, words)) + len(words)]  # all places of all words at once


def test_words_are_held_small(encoder):
    """A task remembers words in under 250 bytes each, with their ids."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randint(4, 9))) for _ in range(400)) for _ in range(250)]
    fresh = P.Encoder.__new__(P.Encoder)
    fresh.__dict__ |= encoder.__dict__ | {"known": {}}
    tracemalloc.start()
    try:
        n = sum(len(ids) for ids in fresh.encode_all(texts))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert n == sum(len(encoder.encode(t)) for t in texts)
    assert len(fresh.known) > 80_000 and held < 250 * len(fresh.known)


def test_batches_are_taken_in_slices(encoder, monkeypatch):
    """No more than LOOK bytes or ROWS_BACK texts are made Python strings at once, but one text at least, whatever Arrow's batch holds."""
    monkeypatch.setattr(P, "LOOK", 40)
    monkeypatch.setattr(P, "ROWS_BACK", 7)
    texts = [*TEXTS, None, None, *["ab"] * 30, *TEXTS]
    batch = pa.array(["before", *texts], pa.string()).slice(1)
    parts = list(P.slices(batch))
    assert [t for p in parts for t in p.to_pylist()] == texts
    assert all(len(p) <= 7 and (len(p) == 1 or sum(len((t or "").encode()) for t in p.to_pylist()) <= 40) for p in parts)
    assert max(map(len, parts)) == 7 and list(P.slices(batch.slice(0, 0))) == []
    rows = [r for p in parts for r in encoder.answer(p).to_pylist()]
    assert [r["input_ids"] for r in rows] == [None if t is None else encoder.encode(t) for t in texts]
    assert all(r["round_trip"] and r["n_tokens"] == len(r["input_ids"] or []) for r in rows)


def test_tables_round_trip(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, n_tokens string")
    rows = P.encode_table(df, MODEL).collect()
    assert all(r.round_trip for r in rows) and len(rows) == len(TEXTS) + 1
    assert {r.n_tokens for r in rows if r.text is None} == {0} and sum(r.n_bytes for r in rows) > 0
    back = {r.doc_id: r.decoded for r in P.add_decoded(P.add_ids(df, MODEL), MODEL).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate([*TEXTS, None])}
    assert P.encode_table(df.limit(0), MODEL).count() == 0
