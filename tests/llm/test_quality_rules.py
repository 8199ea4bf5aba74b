import math
import random
import re
from collections import Counter

from gridloom.llm import quality_rules as rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(marked)


def test_counts():
    rnd = random.Random(1)
    texts = ["", " ", "a", "a\na\n\n \na", "é ü\x1cß\x85\xa0 #$", "the " * 9, *("".join(rnd.choice("ab \n#é漢") for _ in range(rnd.randint(0, 200))) for _ in range(200))]
    for t in texts:
        assert rules.base_counts(t.encode()) == brute(t), repr(t)


def test_ratio_and_verdicts(spark, documents, labels):
    trusted = labels.where("quality = 1")
    rows = {r["doc_id"]: r for r in rules.apply_rules(documents, trusted).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    ids = {r["doc_id"] for r in trusted.collect()}
    raw, good = Counter(), Counter()

    def grams(t):
        data = t.encode()
        return [(int.from_bytes(data[i : i + 3], "big") * 2654435761 % 2**32) >> 14 for i in range(len(data) - 2)]

    for d, t in texts.items():
        g = grams(t)
        raw.update(g)
        if d in ids:
            good.update(g)
    share = lambda c, b: (c[b] + 1) / (sum(c.values()) + rules.BUCKETS)
    for d in sorted(texts)[::50]:
        g = grams(texts[d])
        want = sum(n * math.log(share(good, b) / share(raw, b)) for b, n in Counter(g).items()) / len(g) if g else 0
        assert abs(rows[d]["llr"] - want) < 1e-4
        n, _, _, _, repeat = brute(texts[d])
        assert rows[d]["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert rows[d]["kept"] == (not rows[d]["base_failed"] and rows[d]["llr"] >= rules.THRESHOLD)


def test_labelled_documents_agree(spark, documents, labels):
    rows = rules.apply_rules(documents, labels.where("quality = 1")).where("not base_failed").join(labels, "doc_id").collect()
    assert sum(r["kept"] == bool(r["quality"]) for r in rows) / len(rows) > 0.98


def test_odd_rows(spark, odd):
    trusted = spark.createDataFrame([(4, 1), (4, 1), (None, 1)], "doc_id long, quality int")
    rows = rules.apply_rules(odd, trusted).collect()
    assert len(rows) == odd.count()
    assert all(r["n_words"] == 0 and r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (2, 3, 5))
    assert all(r["llr"] == 0 for r in rules.apply_rules(odd, trusted.limit(0)).collect())
    assert rules.apply_rules(odd.limit(0), trusted).collect() == []
