import random
import time
from collections import defaultdict

import pytest

from gridloom.llm import decontamination as dec


def brute_tiles(doc, item, least=dec.MIN_MATCH):
    """Greedy string tiling by its definition: the longest match first, then the first in the document, then in the item."""
    a, b = [False] * len(doc), [False] * len(item)
    tiles = []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not a[i + k] and not b[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return tiles
        k, i, j = best
        a[i : i + k] = [True] * k
        b[j : j + k] = [True] * k
        tiles.append((i, j, k))


def tiles_of(doc, item):
    text = [dec.seeds(dec.word_codes(" ".join(x))).tolist() for x in (doc, item)]
    return dec.tile(list(range(len(text[0]))), *text)


@pytest.mark.parametrize("alphabet", ["ab", "abc", "abcdefgh"])
def test_tiles_against_definition(alphabet):
    rnd = random.Random(4)
    for _ in range(150):
        item = [rnd.choice(alphabet) * 2 for _ in range(rnd.randint(5, 28))]
        doc = [rnd.choice(alphabet) * 2 for _ in range(rnd.randint(0, 30))]
        at, n = rnd.randint(0, len(item)), rnd.randint(0, 12)
        doc = doc[:10] + item[at : at + n] + doc[10:] + item[: n // 2] + item[n // 2 : n + 3]
        assert tiles_of(doc, item) == brute_tiles(doc, item)


def test_one_repeated_word():
    start = time.time()
    assert tiles_of(["a"] * 100_000, ["a"] * 100) == [(0, 0, 100)]
    assert len(tiles_of(["a", "b", "c"] * 10_000, ["a", "b", "c", "d"] * 10 + ["a", "b", "c"] * 40)) == 1
    assert time.time() - start < 30


def test_needed_seeds():
    for n in range(5, 60):
        for coverage in (0.1, 0.5, 0.8, 1.0):
            covered = next(c for c in range(n + 1) if c >= coverage * n)
            least = min([c - 4 * t for c in range(max(covered, 5), n + 1) for t in range(1, c // 5 + 1)] or [1])
            assert 1 <= dec.needed(n, coverage) <= least


def test_reordered_passages(spark):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "too short"), (3, " ".join(f"v{i}" for i in range(9)))], "item_id long, text string")
    docs = [(1, "start " + " ".join(words[20:]).upper() + ", middle. " + " ".join(words[:20])), (2, " ".join(words[:32])), (3, " ".join(words[:31])), (4, " ".join(reversed(words))), (5, None), (6, "")]
    found = dec.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"], r["item_words"], r["covered_words"], r["tiles"]) for r in found) == [(1, 1, 40, 40, 2), (2, 1, 40, 32, 1)]


def every_pair(docs, items):
    """Tiling of every document that shares five words with an item, without hashes."""
    runs = defaultdict(set)
    for n, (_, item) in enumerate(items):
        for k in range(len(item) - dec.MIN_MATCH + 1):
            runs[tuple(item[k : k + dec.MIN_MATCH])].add(n)
    out = []
    for doc_id, doc in docs:
        near = {n for k in range(len(doc) - dec.MIN_MATCH + 1) for n in runs.get(tuple(doc[k : k + dec.MIN_MATCH]), ())}
        for n in near:
            item_id, item = items[n]
            # only the surroundings of shared runs can be in tiles
            marked = [any(tuple(doc[j : j + 5]) in runs for j in range(max(0, k - 4), k + 1)) for k in range(len(doc))]
            part = [w if m else f"no word {k}" for k, (w, m) in enumerate(zip(doc, marked, strict=True))]
            part = [w for k, w in enumerate(part) if marked[k] or (k and marked[k - 1])]
            tiles = brute_tiles(part, item)
            covered = sum(t[2] for t in tiles)
            if covered >= dec.MIN_COVERAGE * len(item):
                out.append((doc_id, item_id, len(item), covered, len(tiles)))
    return sorted(out)


def test_documents(spark, documents, sf, monkeypatch):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = dec.contaminated_pairs(documents, benchmark).collect()
    found = sorted((r["doc_id"], r["item_id"], r["item_words"], r["covered_words"], r["tiles"]) for r in rows)
    items = [(r["item_id"], dec.words(r["text"])) for r in benchmark.collect()]
    want = every_pair([(r["doc_id"], dec.words(r["text"])) for r in documents.collect()], items)
    assert want and found == want
    kept = {r["doc_id"] for r in dec.drop_contaminated(documents, benchmark).collect()}
    assert kept == {r["doc_id"] for r in documents.collect()} - {x[0] for x in found}
    # a filter that lets all seeds through changes the work only
    monkeypatch.setattr(dec, "BLOOM_LEAST", 6)
    monkeypatch.setattr(dec, "BLOOM_MOST", 6)
    again = dec.contaminated_pairs(documents, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"], r["item_words"], r["covered_words"], r["tiles"]) for r in again) == found


def test_random_documents(spark):
    rnd = random.Random(9)
    word = lambda: f"w{rnd.randint(0, 30)}"
    items = [(i, [word() for _ in range(rnd.randint(3, 25))]) for i in range(40)]
    docs = []
    for i in range(150):
        doc = [word() for _ in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            own = rnd.choice(items)[1]
            a, b = sorted(rnd.randint(0, len(own)) for _ in range(2))
            doc += rnd.choice(([], own[a:b], own, own[len(own) // 2 :] + own[: len(own) // 2]))
        docs.append((i, doc))
    frames = [spark.createDataFrame([(i, " ".join(x)) for i, x in rows], schema) for rows, schema in ((docs, "doc_id long, text string"), (items, "item_id long, text string"))]
    rows = dec.contaminated_pairs(*frames).collect()
    want = every_pair(docs, items)
    assert len(want) > 40
    assert sorted((r["doc_id"], r["item_id"], r["item_words"], r["covered_words"], r["tiles"]) for r in rows) == want


def test_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, "a b c d e f g h i j"), (1, None), (None, "a b c d e f"), (3, "")], "item_id long, text string")
    pairs = dec.contaminated_pairs(odd, items).collect()
    assert sorted((r["doc_id"], str(r["item_id"]), r["coverage"]) for r in pairs) == [(1, "1", 1.0), (1, "1", 1.0), (1, "None", 1.0), (1, "None", 1.0)]
    kept = dec.drop_contaminated(odd.withColumnsRenamed({"score": "key", "_row": "a.b"}), items)
    assert kept.columns == ["doc_id", "text", "key", "a.b"] and kept.count() == odd.count() - 2
    assert dec.contaminated_pairs(odd, items.limit(0)).collect() == [] and dec.contaminated_pairs(odd.limit(0), items).collect() == []
    assert dec.drop_contaminated(odd, items.limit(0)).count() == odd.count()
