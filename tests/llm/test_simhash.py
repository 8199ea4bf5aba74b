import random

import numpy as np
import xxhash

from gridloom.llm import simhash


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest index reachable, over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(monkeypatch):
    texts = ["", " \n", "One", "one two", "One TWO three", "É ü ß x\x1cy\xa0z w", "a b c " * 50, *(" ".join(random.Random(k).choices("abcdefg", k=k)) for k in range(1, 60))]
    for block in (1, 2, 7, simhash.BLOCK_WORDS):
        monkeypatch.setattr(simhash, "BLOCK_WORDS", block)
        assert [simhash.fingerprint(t.encode()) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_links_against_all_pairs(spark, monkeypatch):
    rnd = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        fp = rnd.getrandbits(64)
        for _ in range(6):
            fps.add(fp)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                fp ^= 1 << b
    # a large bucket: many fingerprints that share a segment
    fps |= {(rnd.getrandbits(42) << 22) | 12345 for _ in range(80)} | {(1 << 22 + b) | 12345 for b in range(40)}
    fps = sorted(fps)
    wanted = brute_components(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    for limit in (4, 128):
        monkeypatch.setattr(simhash, "BUCKET_LIMIT", limit)
        frame = spark.createDataFrame([(s,) for s in signed], "fp long")
        roots = {r["node"]: r["root"] for r in simhash.connected_components(simhash.links(frame)).collect()}
        groups, own = {}, {}
        for s, w in zip(signed, wanted, strict=True):
            groups.setdefault(w, set()).add(s)
            own.setdefault(roots.get(s, s), set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (-5, 101)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.connected_components(edges).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: -5, 101: -5, -5: -5}


def test_documents(spark, documents):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(documents).collect()}
    texts = [(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()]
    fps = [brute_fingerprint(t) for _, t in texts]
    wanted = brute_components(fps)
    assert {d: (f"{f:016x}", texts[w][0]) for (d, _), f, w in zip(texts, fps, wanted, strict=True)} == {d: (r["fingerprint"], r["component_id"]) for d, r in rows.items()}
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(documents).select("doc_id").collect()]
    assert sorted(kept) == sorted({texts[w][0] for w in wanted})


def test_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r["component_id"] for r in rows if r["fingerprint"] == "0" * 16}
    assert empty == {2}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "2", "4", "6", "None"]
    none = odd.limit(0)
    assert simhash.near_duplicates(none).collect() == [] and simhash.drop_near_duplicates(none).collect() == []
