import itertools
import math
import random
import re
import time

import numpy as np

from gridloom.llm import pii


def brute(text):
    """The base patterns as they are written."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found)


def test_base_spans_against_patterns():
    rnd = random.Random(6)
    for alphabet in ("a@.-b", "0125. ", "0123456789 -", "+0123 ().-", "a@.1+é "):
        for _ in range(1500):
            text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 45)))
            assert pii.base_spans(text) == brute(text), repr(text)
    assert pii.base_spans("4111 1111 1111 1111 a.b@c.de +1 (415) 555-0100 at 10.0.0.1") == [(0, 2, 19), (20, 0, 28), (29, 3, 46), (50, 1, 58)]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "@" * 100_000):
        pii.base_spans(text)


def test_long_groups_of_digits():
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [(0, 1, 5006)]
    assert pii.base_spans("9" * 5000 + ".1.1.1") == []


TEXT = "call (415) 555-0100 (415) 555-0101, 030 1234567 030 7654321 or mail joe [at] site [dot] org.uk now 10 . 0 . 0 . 1"


def random_field(seed, scale=1.0):
    field, rng = pii.Field(), np.random.default_rng(seed)
    field.weights, field.follow = rng.normal(size=field.weights.shape) * scale, rng.normal(size=field.follow.shape) * scale
    return field


def within(field, path):
    """The score of a path of one part, whose segments always follow each other."""
    kinds = [pii.NONE, *(k for _, k, _, _ in path)]
    return sum(field.weights[list(x)].sum() + field.follow[before, k] for before, (_, k, _, x) in zip(kinds, path))


def test_gradient():
    field = random_field(1, 0.3)
    texts = [TEXT, "at 10 [.] 0 [.] 0 [.] 1 today", "or (415) 555-0100 (212) 555-0101"]
    examples = []
    for part in (p for text in texts for p in pii.parts(text, [])):
        examples.append((part, set(random_field(len(examples)).path(part))))
    assert len({len(part.segments) for part, _ in examples}) > 2 and sum(len(gold) for _, gold in examples) > 2
    held = pii.Examples(examples)
    base, grad, trans = held.gradient(field)
    for i in [*np.flatnonzero(grad)[::7]]:
        field.weights[i] += 1e-6
        assert abs((held.gradient(field)[0] - base) / 1e-6 - grad[i]) < 1e-3
        field.weights[i] -= 1e-6
    for place in itertools.product(range(5), range(4)):
        field.follow[place] += 1e-6
        assert abs((held.gradient(field)[0] - base) / 1e-6 - trans[place]) < 1e-3
        field.follow[place] -= 1e-6
    # the likelihood, over every path of each part
    total = 0.0
    for part, gold in examples:
        paths = [within(field, path) for path in every_path(part.segments)]
        total += within(field, [x for i, x in enumerate(part.segments) if i in gold]) - float(np.logaddexp.reduce(paths))
    assert abs(base - total) < 1e-9


def every_path(segments):
    """All sets of segments that don't overlap, in order."""
    if not segments:
        yield []
        return
    first, rest = segments[0], segments[1:]
    yield from every_path(rest)
    for path in every_path([x for x in rest if x[0] >= first[2]]):
        yield [first, *path]


def score(field, path, fixed):
    total, before = 0.0, (pii.NONE, None)
    for s, k, e, *x in sorted([*path, *fixed], key=lambda y: y[:3]):
        kind = before[0] if before[1] is not None and s - before[1] <= pii.GAP else pii.NONE
        total += field.follow[kind, k]
        total += field.weights[list(x[0])].sum() if x else 0
        before = (k, e)
    return total


def test_paths_against_enumeration():
    """The decoded path is the best of all, the odds are those of all paths, with and without compulsory segments."""
    rnd, spans = random.Random(3), 0
    pieces = ["030 1234567", "030 7654321", "(212) 555-0143", "10 . 0 . 0 . 1", "joe at site dot org", "4111/1111/1111/1111", "bob@site.org", "10.1.2.3", "+1 (415) 555-0100", "word"]
    for seed in range(120):
        field = random_field(seed)
        text = rnd.choice((" ", ", ", " x ")).join(rnd.choice(pieces) for _ in range(rnd.randint(1, 3)))
        fixed = pii.base_spans(text)
        free = [c for c in pii.candidates(text) if all(c[2] <= s or e <= c[0] for s, _, e in fixed)]
        if len(free) > 22:
            continue
        spans += bool(fixed)
        paths = list(every_path(sorted(free)))
        totals = [score(field, p, fixed) for p in paths]
        best = paths[int(np.argmax(totals))]
        assert field.best(text, fixed, None) == [x[:3] for x in best]
        weights = np.exp(np.array(totals) - max(totals))
        weights /= weights.sum()
        for part in pii.parts(text, fixed):
            for x, odds in zip(part.segments, field.odds(part, range(len(part.segments))), strict=True):
                p = sum(w for w, path in zip(weights, paths, strict=True) if x in path)
                assert math.isclose(1 / (1 + math.exp(-odds)), p, abs_tol=1e-6)
    assert spans > 20


def test_time_is_linear():
    field, took = random_field(5), []
    for n in (5_000, 20_000):
        text = " ".join(str(i * 7919 % 1000) for i in range(n)) + " a@b.cd" * n
        start = time.time()
        field.best(text, pii.base_spans(text))
        took.append(time.time() - start)
    assert took[1] < 10 * took[0] + 1


def test_field_finds_other_forms(spark, documents):
    field = pii.train_field(documents)

    def added(text):
        return [(pii.KINDS[k], text[s:e]) for s, k, e in field.best(text, pii.base_spans(text))]

    assert added("reach me at joe.doe [at] example [dot] org today") == [("email", "joe.doe [at] example [dot] org")]
    assert added("my phone is (415) 555-0100, thanks") == [("phone", "(415) 555-0100")]
    assert added("call 030 1234567 030 7654321") == [("phone", "030 1234567"), ("phone", "030 7654321")]
    assert added("(212) 555-0143 (212) 555-0199") == [("phone", "(212) 555-0143"), ("phone", "(212) 555-0199")]
    assert added("mail bob at site DOT org") == [("email", "bob at site DOT org")]
    for text in ("written on 2021-03-04 in version 2.0 for 1500 people", "nothing here", "89 90 91 92 93 94 95 96 97", "we look at this. And at that", "in 2019 2020 2021 2022 there"):
        assert added(text) == []


def other_form(kind, rnd):
    """Personal data in a form that no base pattern and no training form has."""
    digit = lambda n: "".join(rnd.choice("23456789") for _ in range(n))
    if kind == "email":
        at, dot = rnd.choice([("{at}", "{dot}"), (" [at] ", "."), (" AT ", " DOT "), ("<at>", "<dot>"), (" (AT) ", " (DOT) ")])
        return f"{rnd.choice('abcdef')}{digit(1)}.{rnd.choice(['smith', 'meier', 'li'])}{at}{rnd.choice(['mail', 'web', 'site'])}{dot}{rnd.choice(['org', 'net', 'de'])}"
    if kind == "ip":
        return rnd.choice([" .", ". ", " [.] ", " (.) "]).join(str(rnd.randint(1, 255)) for _ in range(4))
    if kind == "card":
        digits = "4" + digit(14)
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        return rnd.choice(["_", " /", "- "]).join(digits[i : i + 4] for i in range(0, 16, 4))
    return rnd.choice(["{a}-{b}-{c}", "{a} {b} {c}", "({a}){b}-{c}", "({a}) {b} {c}", "{a}/{b}{c}", "0{a} {b} {c}"]).format(a=digit(3), b=digit(3), c=digit(4))


def test_recall_on_forms_that_training_does_not_use(spark, documents):
    field, rnd = pii.train_field(documents), random.Random(11)
    for kind in pii.KINDS:
        found = 0
        for _ in range(200):
            span = other_form(kind, rnd)
            text = f"{rnd.choice(['some words', 'you may', 'please', 'here it is:'])} {span}{rnd.choice([' and more', ', thanks', '', '. End'])}"
            start = text.index(span)
            found += any(pii.KINDS[k] == kind and (s, e) == (start, start + len(span)) for s, k, e in [*pii.base_spans(text), *field.best(text, pii.base_spans(text))])
        print(kind, found / 200)
        assert found >= 180, kind


def test_documents(spark, documents):
    field = pii.train_field(documents)
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    rows = pii.find_pii(documents, field).collect()
    few = 0
    for r in rows:
        base = brute(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(pii.joined(base).split(",")) - {""} <= set(spans) and len(spans) == len(base) + r["n_added"]
        few += r["n_added"]
    assert few < 0.05 * len(rows)


def test_odd_rows(spark, odd):
    for field in (pii.train_field(odd), pii.Field()):
        found = pii.find_pii(odd.withColumnRenamed("score", "spans"), field)
        assert found.columns == ["doc_id", "text", "_row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
        assert found.count() == odd.count() and all(r["spans"] == "" for r in found.collect())
    assert pii.find_pii(odd.limit(0), pii.Field()).collect() == []
