import random
import time

from textloom.llm import licenses as L


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_alignment_is_common_and_close_to_the_longest():
    rng = random.Random(1)
    worse = 0
    for _ in range(300):
        b = [f"w{i}" if rng.random() < 0.8 else "the" for i in range(30)]
        a = [w for w in b if rng.random() > 0.1]
        for _ in range(3):
            a.insert(rng.randrange(len(a) + 1), rng.choice(["the", "x"]))
        pairs = L.align(a, b, 0, len(a), 0, len(b))
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        best = lcs(a, b)
        assert len(pairs) >= best - 3
        worse += len(pairs) < best
    assert worse < 60


def test_every_planted_copy_is_found():
    rng = random.Random(2)
    scanner = L.Scanner(L.TEMPLATES, 0.8)
    for _ in range(100):
        filler = lambda k: " ".join(rng.choice(["the", "of", "licence", "version", "zzz", "software"]) for _ in range(k))
        names = rng.choices(sorted(L.TEMPLATES), k=3)
        parts = [filler(rng.randint(0, 80))]
        for n in names:
            words = L.TEMPLATES[n].split()
            if len(words) > 20:
                del words[rng.choice([i for i, w in enumerate(words) if w.lower() in ("the", "of", "this", "or", "and")])]
                words.insert(rng.randrange(len(words)), "inserted")
            parts += [" ".join(words), filler(rng.choice([0, 40]))]
        text = "\n".join(parts)
        got = scanner.scan(text)
        assert sorted(m[0] for m in got) == sorted(names)
        assert all(m[1] >= 0.8 for m in got)


def test_increasing():
    assert [[3, 1, 2, 5, 4][i] for i in L.increasing([3, 1, 2, 5, 4])] in ([1, 2, 4], [1, 2, 5])
    assert L.increasing([]) == []


def test_tables(spark):
    line = "Released under the MIT License."
    data = [(1, None), (2, ""), (3, f"é {line} {line}"), (4, "released under"), (5, "the " * 100000 + line), (3, line)]
    df = spark.createDataFrame([(*d, "x") for d in data], "doc_id long, text string, license_matches string")
    got = [(r.doc_id, [(m.license, m.coverage, r.text[m.start : m.end]) for m in r.license_matches]) for r in L.scan_licenses(df).collect()]
    hit = ("mit-notice", 1.0, line[:-1])
    assert sorted(got) == [(1, []), (2, []), (3, [hit]), (3, [hit, hit]), (4, []), (5, [hit])]
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_insertions_of_any_length():
    scanner = L.Scanner(L.TEMPLATES, 0.8)
    html = 'Released under the <a href="https://opensource.org/licenses/MIT">MIT License</a>'
    assert [(m[0], m[1], html[m[2] : m[3]]) for m in scanner.scan(html)] == [("mit-notice", 1.0, html[:-4])]
    inside = "Released " + "x " * 50 + "All rights reserved. under the " + "y " * 3000 + "MIT License"
    assert sorted(m[:2] for m in scanner.scan(inside)) == [("mit-notice", 1.0), ("rights-reserved", 1.0)]
    rng = random.Random(6)
    for _ in range(60):
        name = rng.choice(sorted(L.TEMPLATES))
        words = L.WORD.findall(L.TEMPLATES[name].lower())
        for at in sorted(rng.sample(range(1, len(words)), min(len(words) - 1, rng.randint(1, 4))), reverse=True):
            words[at:at] = rng.choices(["zzz", "the", "of", "software"], k=rng.choice([5, 39, 400]))
        # Alone, as chance words at an end may decide between two licenses that differ by a word.
        found = L.Scanner({name: L.TEMPLATES[name]}, 0.8).scan(" ".join(words))
        assert len(found) == 1 and found[0][1] >= 0.8


def test_matches_where_whole_text_alignment_has_the_coverage():
    rng = random.Random(7)
    templates = {"a": "p q r s t", "b": "q q s p r t u p q s"}
    scanner = L.Scanner(templates, 0.8)
    yes = 0
    for _ in range(400):
        words = rng.choices("pqrstuxyz", k=rng.randint(3, 30))
        got = scanner.scan(" ".join(words))
        for name, text in templates.items():
            template = text.split()
            enough = lcs(words, template) >= 0.8 * len(template)
            yes += enough
            # A template loses its words to another one only.
            if enough and not any(m[0] != name for m in got):
                assert any(m[0] == name for m in got)
            assert enough or not any(m[0] == name for m in got)
    assert yes > 100


def test_all_words_in_order_cover_all():
    """Foreign words anywhere inside a template, in any number, leave its coverage whole."""
    scanner = L.Scanner(L.TEMPLATES, 0.8)
    for name in sorted(L.TEMPLATES):
        words = L.WORD.findall(L.TEMPLATES[name].lower())
        for n in (5, 25, 40, 100, 3000):
            for at in (1, len(words) // 3, len(words) // 2, len(words) - 1):
                text = " ".join([*words[:at], *["zzz"] * n, *words[at:]])
                got = scanner.scan(f"before {text} behind")
                assert (name, 1.0, 7, 7 + len(text)) in got, (name, n, at, got)


def test_pieces_of_the_search():
    rng = random.Random(9)
    for _ in range(300):
        a, b = rng.choices("abcd", k=rng.randint(0, 12)), rng.choices("abcd", k=rng.randint(1, 8))
        for late in (False, True):
            pairs = L.longest(a, b, late)
            assert len(pairs) == lcs(a, b) and all(a[i] == b[j] for i, j in pairs)
            assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        need = rng.randint(1, len(b))
        want = next((n for n in range(1, len(a) + 1) if lcs(a[:n], b) >= need), -1)
        marks = [L.masks_of(b).get(w, 0) for w in a]
        assert L.reach(marks, 0, len(a), 1, len(b), need) == want
        turned = [L.masks_of(b[::-1]).get(w, 0) for w in a]
        assert L.reach(turned, len(a) - 1, -1, -1, len(b), need) == next((n for n in range(1, len(a) + 1) if lcs(a[::-1][:n], b[::-1]) >= need), -1)
    assert L.trimmed([(0, 0), (9, 1), (10, 2), (11, 3), (12, 4), (30, 5), (60, 6)], 2) == [(9, 1), (10, 2), (11, 3), (12, 4)]
    assert len(L.trimmed([(0, 0), (9, 1), (99, 2)], 2)) == 2


def test_spans_where_lower_case_is_longer():
    scanner = L.Scanner(L.TEMPLATES, 0.8)
    for text in ("İabc Released under the MIT License.", "İİİ\nReleased under the MIT License. İ"):
        assert [text[m[2] : m[3]] for m in scanner.scan(text)] == ["Released under the MIT License"]


def test_repeats_and_long_texts_take_linear_time():
    scanner, took = L.Scanner(L.TEMPLATES, 0.8), []
    for line, n in (("Released under the MIT License.", 8_000), (L.TEMPLATES["mit"], 400)):
        began = time.time()
        assert len(scanner.scan(f"{line}\n" * n)) == n
        took.append(time.time() - began)
    began = time.time()
    assert scanner.scan("the of software to in " * 200_000 + "Released under the MIT License.")[-1][:2] == ("mit-notice", 1.0)
    assert max(*took, time.time() - began) < 20


def seconds(scanner, text):
    began = time.process_time()
    scanner.scan(text)
    return time.process_time() - began


def test_time_grows_as_the_text():
    """Repeated notices, and random words of all templates, in which every template stands in order again and again."""
    scanner, rng = L.Scanner(L.TEMPLATES, 0.8), random.Random(1)
    soup = rng.choices([w for t in scanner.templates.values() for w in t], k=80_000)
    for made in (lambda n: "Released under the MIT License.\n" * (n // 4), lambda n: " ".join(soup[:n])):
        took = [min(seconds(scanner, made(n)) for _ in range(2)) for n in (20_000, 40_000)]
        assert took[1] < 3.2 * took[0] + 0.2 and took[0] < 8
