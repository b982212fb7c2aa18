import hashlib
import random
import re

from textloom.llm import decontaminate as D

DOCS = "doc_id long, text string, n_hit string"


def brute(docs, items, n):
    word = re.compile(D.WORD)
    low = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for d, text in docs:
        w, hit, ids = low(text), set(), set()
        for item, t in items:
            v = low(t)
            for i in range(max(1, len(v) - n + 1)) if v else []:
                win = v[i : i + n]
                for j in range(len(w) - len(win) + 1):
                    if w[j : j + len(win)] == win:
                        hit |= set(range(j, j + len(win)))
                        ids |= {str(item)} - {"None"}
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(3)
    vocab = ["a", "b", "É", "é", "10", "Zed"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(i, text(rng.randint(4, 9))) for i in range(12)] + [(2, "a b"), (20, ""), (21, None), (None, "b b b b b"), (2, "a b")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(5, None), (None, "a b"), (7, "...")] * 2
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    df, bench = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in D.digest(df, bench, 4).collect()), key=str)
    assert got == brute(docs, items, 4)


def test_blocks_give_the_same(spark):
    docs, items = cases()
    df, bench = spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "hit_items", "hit_words"]
    one, many = (sorted(map(str, D.mark(df, bench, n=4, max_windows=m).select(cols).collect())) for m in (10**6, 12))
    assert one == many


def test_spans_and_documents(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    df = spark.createDataFrame([(1, "x, ONE two; three. y", None), (2, "one two", None), (3, None, None)], DOCS)
    clean = {r.doc_id: r.clean_text for r in D.cut_spans(D.mark(df, bench, n=3)).collect()}
    assert clean == {1: "x, . y", 2: "one two", 3: None}
    assert sorted(r.doc_id for r in D.drop_contaminated(df, bench, n=3).collect()) == [2, 3]
    assert D.digest(df.limit(0), bench).count() == 0 and D.digest(df, bench.limit(0)).filter("contaminated").count() == 0
