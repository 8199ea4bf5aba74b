import hashlib
import random
import re
import zlib

import duckdb
import pytest

from gridloom.llm import structure_repair

NEW = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        yield from [(conv_id, turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)


def cheapest(rows):
    """The least (cost, audit) of (forced, cut, initial) rows, by all choices from the end on."""
    best = {s: (0, "") if s in (0, 3) else (10**9, "") for s in range(4)}
    then = lambda cost, edit, found: (cost + found[0], edit + found[1])
    insert = lambda own: own if (more := {s: min(own[s], then(3, "I", own[NEW[s]])) for s in own}) == own else insert(more)
    best = insert(best)
    for forced, cut, initial in reversed(rows):
        made = {}
        for s in range(4):
            choices = [then(4, "D", best[s])]
            if not forced:
                choices.append(then(3 + 3 * cut, "R", best[NEW[s]]))
                if (s, initial) in KEPT:
                    choices.append(then(3 * cut, "K", best[KEPT[s, initial]]))
            made[s] = min(choices)
        best = insert(made)
    return best[0]


def brute(rows):
    out = []
    for conv_id in {r[0] for r in rows}:
        own = sorted((r[1:] for r in damage(r for r in rows if r[0] == conv_id)), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
        counts, seen, judged = [0, 0, 0], set(), []
        for _, role, text in own:
            last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            judged.append((fault in (0, 1), fault == 2, role[:1]))
        cost, audit = cheapest(judged)
        lines, left, s = [], iter(own), 0
        for edit in audit:
            _, role, text = ("", "", "") if edit == "I" else next(left)
            if edit in "IR":
                s = NEW[s]
                lines.append(f"{ {2: 'user', 3: 'assistant'}[s]}:{text}")
            elif edit == "K":
                s = KEPT[s, role[0]]
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv_id, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    rows = structure_repair.repair_conversations(frame)
    assert rows.columns == COLUMNS
    return sorted((tuple(r) for r in rows.collect()), key=str)


def sql(rows):
    quote = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    duckdb.sql(f"create or replace view conversations as select * from (values {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) v(conv_id, turn, role, text)")
    cursor = duckdb.execute(structure_repair.ORACLE)
    assert [d[0] for d in cursor.description] == COLUMNS
    return sorted(cursor.fetchall(), key=str)


def made(seed, convs, turns):
    rnd = random.Random(seed)
    texts = ["Yes.", "No", "Why?", "", " ", "Go!  ", "well", "Ü.\n", "same.", None]
    roles = ["user", "assistant", "system", "user", "assistant", "bot", None, "", "u"]
    rows = [(c, rnd.choice([t, t, t, t + 3, None]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"text {t}.") for c in range(convs) for t in range(rnd.randint(1, turns))]
    return rows + [(None, 1, "user", "x."), (None, None, "assistant", "y.")] + rows[:5] * 2


def test_documents(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    assert found(frame) == brute(rows)
    duckdb.sql(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(duckdb.execute(structure_repair.ORACLE).fetchall(), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows(spark, seed):
    rows = made(seed, 60, 12)
    assert found(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as copies", "'x' as _salt")) == brute(rows)
    assert sql(rows) == brute(rows)


@pytest.mark.parametrize("segment", [1, 7, 1000])
def test_long_conversations_in_segments(spark, monkeypatch, segment):
    monkeypatch.setattr(structure_repair, "SHORT_ROWS", 10)
    monkeypatch.setattr(structure_repair, "SEGMENT_ROWS", segment)
    rows = made(segment, 12, 40) + [(99, 5, "user", "again and again.")] * 60 + [(98, None, "assistant", "no turn")] * 30 + [(98, None, "user", f"t{k}.") for k in range(30)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_all_dropped_and_empty(spark):
    conv_id = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv_id, 1, "user", "gone.")], SCHEMA)
    assert found(frame) == [(conv_id, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert found(frame.limit(0)) == []


def test_distances_by_all_paths():
    rnd = random.Random(4)
    for _ in range(300):
        rows = [(rnd.choice("suax"), rnd.random() < 0.3) for _ in range(rnd.randint(0, 7))]
        dist = structure_repair.distances(rows, [0, structure_repair.FAR, structure_repair.FAR, 0])
        edits, _ = structure_repair.walk(rows, dist, 0, True)
        assert (dist[0], "".join(edits)) == cheapest([(False, cut, initial) for initial, cut in rows])
