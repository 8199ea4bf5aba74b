import hashlib
import random

import duckdb
import pytest

from gridloom.llm import line_dedup
from gridloom.llm.line_dedup import LONG_LINE, MIN_CHARS, MIN_WORDS


def chunks(lines):
    """For each line the number of its chunk."""
    out, before, k = [], "", 0
    for j, line in enumerate(lines):
        out.append(k)
        h = hashlib.md5(line.encode()).hexdigest()
        long = len(line) >= LONG_LINE or (j + 1 < len(lines) and len(lines[j + 1]) >= LONG_LINE)
        if long or hashlib.md5((before + h).encode()).hexdigest()[0] < "8":
            k += 1
        before = h
    return out


def brute(docs):
    """docs: (doc_id, text), unique doc_ids, in ascending order."""
    everywhere, seen, seen_chunks, out = {}, set(), set(), {}
    for _, text in docs:
        for line in text.split("\n"):
            everywhere[line] = everywhere.get(line, 0) + 1
    for doc_id, text in docs:
        lines = text.split("\n")
        filled = [j for j, x in enumerate(lines) if x.strip(" \t\r")]
        own = {}
        for j, k in enumerate(chunks(lines)):
            if j in filled:
                own.setdefault(k, []).append(j)
        later, again = {}, set()
        for j in filled:
            later[j] = lines[j] in seen
            seen.add(lines[j])
        for js in own.values():
            key = tuple((j - js[0], lines[j]) for j in js)
            if len(js) > 1 and sum(len(lines[j]) for j in js) + len(js) - 1 >= MIN_CHARS and all(everywhere[lines[j]] > 1 for j in js):
                if key in seen_chunks:
                    again.update(js)
                seen_chunks.add(key)
        gone, at = set(), 0
        while at < len(filled):
            end = at
            while end < len(filled) and later[filled[end]]:
                end += 1
            run = filled[at:end]
            if run and (again & set(run) or any(len(lines[j]) >= LONG_LINE for j in run) or sum(lines[j].count(" ") + lines[j].count("\t") + 1 for j in run) >= MIN_WORDS):
                gone |= set(range(run[0], run[-1] + 1))
            at = end + 1
        out[doc_id] = ("\n".join(x for j, x in enumerate(lines) if j not in gone), len(gone))
    return out


def test_documents(spark, documents, sf):
    rows = {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in line_dedup.dedup_lines(documents).collect()}
    assert rows == brute([(r["doc_id"], r["text"]) for r in documents.orderBy("doc_id").collect()])
    assert sum(n for _, n in rows.values()) > 100


def test_oracle(spark, documents, sf):
    duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'")
    assert {(r["doc_id"], r["text"], r["n_lines"], r["n_lines_removed"]) for r in line_dedup.dedup_lines(documents).collect()} == set(duckdb.sql(line_dedup.ORACLE).fetchall())


def test_passages_are_found_anywhere(spark):
    passage = " ".join(f"passage{i}" for i in range(60))
    several = "\n".join(f"line {i} of a shared block with words enough {i * i}" for i in range(30))
    docs = spark.createDataFrame([(i, f"own start {i}\nsecond {i}\n{passage}\nown middle {i}\n{several}\nown end {i}") for i in range(8)], "doc_id long, text string")
    for r in line_dedup.dedup_lines(docs).collect():
        assert f"own start {r['doc_id']}\nsecond {r['doc_id']}" in r["text"] and f"own middle {r['doc_id']}" in r["text"] and f"own end {r['doc_id']}" in r["text"]
        assert (passage in r["text"]) == (r["doc_id"] == 0)
        if r["doc_id"]:
            assert r["n_lines_removed"] >= 20


def test_odd_rows(spark, odd):
    rows = line_dedup.dedup_lines(odd)
    assert rows.columns == [*odd.columns, "n_lines", "n_lines_removed"]
    found = rows.collect()
    assert len(found) == odd.count()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in found) == sorted((str(r["doc_id"]), str(r["text"])) for r in odd.collect())
    clash = odd.withColumnRenamed("score", "n_lines")
    assert line_dedup.dedup_lines(clash).columns == ["doc_id", "text", "_row", "n_lines", "n_lines_removed"]
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []


def test_ties(spark):
    block = "\n".join(["x" * LONG_LINE, "y" * LONG_LINE])
    rows = [(1, block), (1, block), (2, block), (None, block), (3, f"{block}\n{block}")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["text"], r["n_lines_removed"]) for r in found) == sorted([("None", block, 0), ("1", "", 2), ("1", "", 2), ("2", "", 2), ("3", "", 4)])


@pytest.mark.parametrize("n_lines", [2, 3, 4, 5, 6])
def test_short_passages_between_any_neighbours(spark, n_lines):
    """Passages of few lines and just over 50 words go wherever they stand; their neighbours and shorter repeats stay."""
    rnd = random.Random(n_lines)
    docs = []
    for p in range(20):
        total, cuts = 51, sorted(rnd.sample(range(3, 49), n_lines - 1))
        words = [f"p{p}w{i}x{rnd.randint(0, 99)}" for i in range(total)]
        passage = [" ".join(words[a:b]) for a, b in zip([0, *cuts], [*cuts, total])]
        if p % 4 == 0:
            passage.insert(1, "")
        for c in range(3):
            own = [[f"own {side} {p} {c} {i} {rnd.random()}" for i in range(rnd.randint(0, 3))] for side in "ab"]
            docs.append((len(docs), "\n".join([*own[0], "Share this", *passage, *own[1]]), passage, own))
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")).collect()}
    for k, text, passage, own in docs:
        left = found[k].split("\n")
        assert all(x in left for x in own[0] + own[1])
        assert found[k] == text if k % 3 == 0 else not set(passage) & set(left) - {""}
    assert found == {k: t for k, (t, _) in brute([d[:2] for d in docs]).items()}


def test_random_lines_against_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"{'word ' * rnd.randint(1, 20)}{i}" for i in range(40)] + ["", " ", "x" * 210]
    docs = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.8 else f"own {rnd.random()}" for _ in range(rnd.randint(0, 25)))) for i in range(150)]
    rows = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines_removed"]) for r in rows} == brute(docs)
