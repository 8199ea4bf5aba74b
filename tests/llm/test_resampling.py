import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from gridloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def features(text, max_n):
    own = words(text)
    return [" ".join(own[i : i + n]) for n in range(1, max_n + 1) for i in range(len(own) - n + 1)]


def brute(docs, target, max_n=1, buckets=10000, share=10, min_words=20):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text)."""
    cell = lambda f: zlib.crc32(f.encode()) % buckets
    raw, wanted = Counter(cell(f) for _, x in docs for f in features(x, max_n)), Counter(cell(f) for x in target for f in features(x, max_n))
    s, t = float(sum(raw.values()) + buckets), float(sum(wanted.values()) + buckets)
    gain = lambda b: math.floor(1000 * math.log(float(wanted[b] + 1) * s / (float(raw[b] + 1) * t)))
    rows = []
    for doc_id, text in docs:
        own = features(text, max_n)
        weight = sum(gain(cell(f)) for f in own)
        rows.append((doc_id, len(own), weight, weight + resampling.gumbel(doc_id), len(words(text)) >= min_words))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    top = len(fit) * share // 100
    return [(*r[:4], k + 1 if k < top else None) for k, r in enumerate(fit)] + [(*r[:4], None) for r in rows if not r[4]]


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_documents(spark, sf, documents):
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    found = plain(resampling.resample(documents, benchmark))
    assert found == sorted(brute([(r["doc_id"], r["text"]) for r in documents.collect()], [r["text"] for r in benchmark.collect()]), key=str)
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from '{sf}/{name}.parquet'")
    cursor = duckdb.execute(resampling.ORACLE)
    assert [d[0] for d in cursor.description] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert found == sorted(cursor.fetchall(), key=str)


@pytest.mark.parametrize("max_n", [1, 2, 3])
def test_runs_of_words_across_cuts(spark, monkeypatch, max_n):
    monkeypatch.setattr(resampling, "SLICE_CHARS", 40)
    rnd = random.Random(max_n)
    docs = [(k, "".join(rnd.choice(["Ab", "cd", "é1", "x" * 50, "'", " ", "\n", "\0", "--"]) + rnd.choice([" ", "", ", "]) for _ in range(rnd.randint(0, 60)))) for k in range(40)]
    # cut texts in this process too, as the workers have their own SLICE_CHARS
    for _, text in docs:
        tables = list(resampling._slices([text], max_n))
        with resampling._connection() as con:
            counts = Counter()
            for slice_ in tables:
                con.register("slice", slice_)
                for _, _, bucket, times in con.execute(resampling.count_sql(max_n, 97)).fetchall():
                    counts[bucket] += times
        assert counts == Counter(zlib.crc32(f.encode()) % 97 for f in features(text, max_n))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    target = spark.createDataFrame([("ab cd ab",)], "text string")
    found = plain(resampling.resample(frame, target, max_n=max_n, buckets=97, share=30, min_words=5))
    assert found == sorted(brute(docs, ["ab cd ab"], max_n, 97, 30, 5), key=str)


def test_odd_rows(spark, odd):
    target = spark.createDataFrame([("word id",), (None,)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = plain(resampling.resample(odd, target, share=60, min_words=3))
    assert found == sorted(brute(docs, ["word id"], share=60, min_words=3), key=str)
    assert plain(resampling.resample(odd, target.limit(0), share=60, min_words=3)) == sorted(brute(docs, [], share=60, min_words=3), key=str)
    assert resampling.resample(odd.limit(0), target).collect() == []


def test_many_equal_rows(spark):
    docs = [(7, "the same words of one text here")] * 500 + [(k, f"another text number {k} of some words") for k in range(500)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    target = spark.createDataFrame([("some other words",)], "text string")
    found = plain(resampling.resample(frame, target, share=50, min_words=2))
    assert found == sorted(brute(docs, ["some other words"], share=50, min_words=2), key=str)
    assert sorted(r[4] for r in found if r[4]) == list(range(1, 501))
