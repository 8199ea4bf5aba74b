import hashlib
import random

import duckdb

from gridloom.llm import chat


def brute(rows):
    convs = {}
    for conv_id, turn, role, text in rows:
        convs.setdefault(conv_id, []).append((turn, role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(v, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).digest()))] for c, v in convs.items()}
    kept = {}
    for c, own in turns.items():
        if not any(b != c and other[: len(own)] == own and (len(other) > len(own) or b < c) for b, other in turns.items()):
            kept[c] = (len(own), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in own))
    return kept


def test_documents(spark, sf):
    frame = spark.read.parquet(f"{sf}/conversations.parquet")
    found = {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_conversations(frame).collect()}
    assert found == brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])
    duckdb.sql(f"create or replace view conversations as select * from '{sf}/conversations.parquet'")
    assert {(c, *x) for c, x in found.items()} == set(duckdb.sql(chat.ORACLE).fetchall())


def test_snapshots(spark):
    rnd, rows = random.Random(2), []
    for c in range(60):
        n = rnd.randint(1, 5)
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", rnd.choice(["hi", "ok", None, ""])) for t in range(n)]
    rows += [(100, 0, "user", "hi"), (100, 0, "user", "hi"), (101, 3, None, "hi"), (102, None, "user", "hi")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", frame_column())
    assert {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_conversations(frame).collect()} == brute(rows)


def frame_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_null_ids_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "alone"), (None, 2, "user", "alone"), (None, 2, "user", "again"), (1, 1, "user", "alone"), (None, 7, "user", "hello"), (2, 1, "user", "hello"), (2, 2, "bot", None)]
    frame = spark.createDataFrame(rows, schema)
    found = sorted(chat.format_conversations(frame).collect(), key=str)
    assert sorted((str(r["conv_id"]), r["n_turns"]) for r in found) == [("1", 1), ("2", 2), ("None", 1)]
    assert [r["text"] for r in found if r["conv_id"] is None] == ["<|im_start|>user\nagain<|im_end|>\n"]
    duckdb.sql("create or replace view conversations as select * from (values " + ", ".join(f"({'NULL' if c is None else c}, {t}, '{r}', {'NULL' if x is None else repr(x)})" for c, t, r, x in rows) + ") v(conv_id, turn, role, text)")
    assert {(r["conv_id"], r["n_turns"], r["text"]) for r in found} == set(duckdb.sql(chat.ORACLE).fetchall())
    assert chat.format_conversations(frame.limit(0)).collect() == []


def test_long_conversations_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 3)
    rnd = random.Random(5)
    base = [("user", f"t{k}") for k in range(40)]
    rows = [(c, t, *base[t]) for c in range(20) for t in range(rnd.randint(1, 40))] + [(50, t, *base[t]) for t in range(39)] + [(50, 39, "user", "other")]
    rows += [(51, None, "user", "none"), (51, 4, "user", "x"), (51, 4, "user", "x"), (51, 4, "bot", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: (r["n_turns"], r["text"]) for r in chat.format_conversations(frame).collect()} == brute(rows)
