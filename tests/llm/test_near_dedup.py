import random
import time
from itertools import combinations

import corpus_pipeline
import numpy as np
from gridloom.llm import near_dedup


def brute_kept(docs):
    """The smallest doc_id of each component over all pairs; docs: (doc_id, text)."""
    sets = {}
    for doc_id, text in docs:
        words = [w.decode() for w in text.encode().lower().split()]
        sets[doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return sorted(d for d in sets if find(d) == d)


def edited(words, rnd, edits):
    words = list(words)
    for k in rnd.sample(range(len(words)), edits):
        words[k] = f"new{rnd.random()}"
    return " ".join(words)


def made(seed):
    """Groups around the threshold, a large group, and copies that differ in case and spaces."""
    rnd, texts = random.Random(seed), []
    for group in range(25):
        words = [f"g{group}w{k}" for k in range(rnd.randint(5, 200))]
        texts += [edited(words, rnd, min(len(words), rnd.randint(0, 5))) for _ in range(5)] + [" ".join(words).upper().replace(" ", "\n", 2)]
    words = [f"hot{k}" for k in range(120)]
    texts += [edited(words, rnd, rnd.randint(1, 4)) for _ in range(60)] + ["one two", "One  two", "one two three"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_stage_against_all_pairs(spark, sf, monkeypatch):
    docs = made(3)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_kept(docs)
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, frame, sf).collect()) == want
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "SAMPLE_DOCS", 5)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 7)
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(frame).collect()) == want


def test_documents(spark, documents):
    kept = [r["doc_id"] for r in near_dedup.drop_near_duplicates(documents).collect()]
    assert sorted(kept) == brute_kept([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_bounds_leave_similar_texts_alone():
    """Of pairs at a similarity of just over 0.8 none is lost to the sketch, the sizes or the Hamming bound."""
    rnd, none = random.Random(5), np.zeros(0, np.uint64)
    furthest = 0
    for _ in range(3000):
        n = rnd.choice((9, 20, 60, 300))
        shared = [rnd.getrandbits(64) for _ in range(n)]
        own = [np.unique(np.array(shared + [rnd.getrandbits(64) for _ in range(k)], np.uint64)) for k in (n // 8, n // 4 - n // 8)]
        assert len(np.intersect1d(*own)) * 5 >= len(np.union1d(*own)) * 4
        assert len(np.intersect1d(*(near_dedup.sketch(x, none, none) for x in own)))
        x, y = (near_dedup.fingerprint(x) & (1 << 64) - 1 for x in own)
        furthest = max(furthest, (x ^ y).bit_count())
    assert 15 < furthest <= near_dedup.MAX_DISTANCE


def test_mostly_common_shingles(spark, monkeypatch):
    """Templates with texts of their own in them: the front of the order is what differs."""
    rnd = random.Random(6)
    common = [f"c{k}" for k in range(900)]
    docs = [(i, " ".join([f"d{i}x{k}" for k in range(60)] + common)) for i in range(8)] + [(8 + i, " ".join(f"e{i}y{rnd.random()}" for _ in range(300))) for i in range(8)]
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == brute_kept(docs) == [0, *range(8, 16)]


def test_many_repeated_rows(spark):
    """Two near copies, one of them ten thousand times, by id and text, and by text alone."""
    words = [f"w{k}" for k in range(60)]
    docs = [(1, " ".join(words))] * 5000 + [(k, " ".join(words)) for k in range(2, 5002)] + [(9000, " ".join(words[:-1] + ["x"])), (9001, "quite another text of seven words here")]
    began = time.time()
    assert sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()) == [1, 9001]
    assert time.time() - began < 120


def test_few_shingles_pass_whatever_their_fingerprints(spark):
    """Sets of four and five shingles of which four are shared differ in more bits than the filter allows, now and then."""
    docs = []
    for k in range(300):
        words = [f"a{k}x{i}" for i in range(8)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "more"]))]
    kept = sorted(r["doc_id"] for r in near_dedup.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert kept == list(range(0, 600, 2))


def test_shared_counts():
    rnd = random.Random(7)
    sets = [np.unique(np.array([rnd.randint(0, 60) for _ in range(rnd.randint(1, 50))], np.int32)) for _ in range(30)]
    found = near_dedup.shared_counts(sets, columns=16)
    for a, b in combinations(range(30), 2):
        assert found[a, b] == len(np.intersect1d(sets[a], sets[b]))
    assert near_dedup.shared_counts([np.array([1], np.int32), np.array([2], np.int32)]).sum() == 0


def similarity(x, y):
    x, y = (near_dedup.shingles(t.encode()) for t in (x, y))
    return len(np.intersect1d(x, y)) / len(np.union1d(x, y))


def lowest_own(words, tag, rnd, below, number):
    """The words with others after them, whose shingles come before all of the words' own by hash."""
    words = list(words)
    for _ in range(number):
        words.append(next(w for w in (f"{tag}{rnd.getrandbits(40)}" for _ in range(10**6)) if near_dedup.shingles(" ".join([*words[-4:], w]).encode())[0] < below))
    return " ".join(words)


def test_own_shingles_first(spark, monkeypatch):
    """What two similar texts share comes after 45 shingles of their own: the order and what is counted settle no result."""
    rnd = random.Random(8)
    words = [f"s{k}" for k in range(400)]
    below = near_dedup.shingles(" ".join(words).encode())[0]
    texts = [lowest_own(words, tag, rnd, below, 45) for tag in "xy"]
    assert 0.8 <= similarity(*texts) < 0.82
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()] == [0]


def far_apart(rnd):
    """Two texts at a similarity of 0.8 whose own words are chosen to turn majorities over."""
    words = [f"f{rnd.random()}" for _ in range(44)]
    texts, prints = [], []
    for k in range(2):
        own = list(words)
        for _ in range(5):
            tries = [[*own, f"o{rnd.random()}"] for _ in range(300)]
            sums = [near_dedup.fingerprint(near_dedup.shingles(" ".join(t).encode())) for t in tries]
            far = [(x ^ prints[0]).bit_count() if k else -(x & (1 << 64) - 1).bit_count() for x in (s & (1 << 64) - 1 for s in sums)]
            at = int(np.argmax(far))
            own = tries[at]
        texts.append(" ".join(own))
        prints.append(sums[at] & (1 << 64) - 1)
    return texts, (prints[0] ^ prints[1]).bit_count()


def test_beyond_the_hamming_bound(spark, monkeypatch):
    """Texts at the similarity that differ in more bits than the bound are found, in small buckets and in hot ones."""
    rnd = random.Random(9)
    texts, bits = max((far_apart(rnd) for _ in range(3)), key=lambda x: x[1])
    assert similarity(*texts) >= 0.8 and bits > near_dedup.MAX_DISTANCE
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()] == [0]
    monkeypatch.setattr(near_dedup, "HOT_BUCKET", 1)
    assert [r["doc_id"] for r in near_dedup.drop_near_duplicates(docs).collect()] == [0]


def test_counts_are_of_all_documents(spark):
    """A shingle in every hundredth document is counted in each of them, however many there are."""
    rows = [(i, f"alone{i} b{i} c{i} d{i} e{i}" if i % 100 else f"w{i} x y z common words here") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    common, counts = near_dedup._common(docs)
    at = near_dedup.buckets(near_dedup.shingles(b"x y z common words"))[0]
    assert 200 <= dict(zip(common.tolist(), counts.tolist()))[at] < 205
    assert len(common) < 20 and len(near_dedup._common(docs.limit(0))[0]) == 0


def test_need_is_never_more_than_similar_sets_share():
    """Of sets at the similarity and above, of any sizes and in any order, no sketches share fewer than they need."""
    rnd, none = random.Random(10), np.zeros(0, np.uint64)
    for _ in range(3000):
        shared = [rnd.getrandbits(64) for _ in range(rnd.randint(1, 120))]
        left = rnd.randint(0, len(shared) // 4)
        low = rnd.choice((20, 60, 64))
        x, y = (np.unique(np.array(shared + [rnd.getrandbits(low) for _ in range(k)], np.uint64)) for k in (left, len(shared) // 4 - left))
        if 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)):
            found = np.intersect1d(near_dedup.sketch(x, none, none), near_dedup.sketch(y, none, none))
            assert len(found) >= near_dedup.need(np.array([len(x)]), np.array([len(y)]))[0]
